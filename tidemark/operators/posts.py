"""Posts: flattening, validity, content type, headline projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import PLACEHOLDERS, SOCIAL_SOURCES
from ..functions.text import strip


def flatten(records: DataFrame) -> DataFrame:
    """Posts of grouped records, with defaults for absent fields; records without posts give no rows."""
    exploded = records.select("ticker", "date", F.posexplode("posts").alias("post_index", "post"))
    return exploded.select(
        "ticker", "date", "post_index",
        F.coalesce("post.text", F.lit("")).alias("text"),
        F.coalesce("post.source", F.lit("unknown")).alias("source"),
        F.col("post.post_score").alias("post_score"),
    )


def is_valid(text: Column, source: Column) -> Column:
    low = F.lower(strip(F.coalesce(text, F.lit(""))))
    out = (low != "") & ~F.lower(strip(F.coalesce(source, F.lit("")))).startswith("mock")
    for phrase in PLACEHOLDERS:
        out = out & ~F.contains(low, F.lit(phrase))
    return out


def content_type(explicit: Column, source: Column) -> Column:
    kind, low = F.lower(strip(F.coalesce(explicit, F.lit("")))), F.lower(strip(F.coalesce(source, F.lit(""))))
    social = F.lit(False)
    for name in SOCIAL_SOURCES:
        social = social | F.contains(low, F.lit(name))
    return (
        F.when(kind.isin("social_post", "publisher_headline"), kind)
        .when(kind == "news_headline", "publisher_headline")
        .when(social, "social_post")
        .otherwise("publisher_headline")
    )


def top_headlines(posts: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` valid posts of each ticker by date and event, with display date; the cut comes after validity."""
    valid = posts.where(is_valid(F.col("text"), F.col("source")))
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy("date", "event_id"))
    kept = valid.withColumn("rank", rank).where(F.col("rank") <= limit)
    return kept.select(
        "ticker", "rank", "event_id", strip(F.col("text")).alias("headline"), "source",
        F.date_format(F.col("date").try_cast("timestamp"), "MMM d, yyyy").alias("time"),
    )
