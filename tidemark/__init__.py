"""Market-text analytics on Spark DataFrames."""
