"""Domain tables from the star-schema tables: posts, bars, stories, provider observations.

The posts' texts are authored headlines, picked by event id, so that all
lexicon outcomes, alias cases, rule categories and placeholders occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import TICKERS

HEADLINES = (
    "Tesla shares rise after record deliveries",
    "NVIDIA beats estimates on data center growth and raises its outlook for the next fiscal year again",
    "AMD chips face weak demand warning",
    "Apple pie recipe draws a crowd",
    "Meta Platforms cut costs",
    "Analysts see upside for GeForce maker while investors weigh supply and pricing over the coming quarters",
    "Quiet session for the market",
    "The company hosted its annual developer event in the city on Tuesday and showed several new products",
    "Instagram ads jump",
    "Recall hits Cybertruck owners",
    "Selloff deepens as Ryzen sales slump and the downgrade adds to a bearish mood in the whole sector today",
    "Enterprise software firms meet executives again",
    "The stock fell because of rates",
    "Shares will move higher says blog",
    "Investors should buy the stock now",
    "Model confidence is 80% probability of a rise",
    "This rally is guaranteed to continue",
    "Sample fallback post",
    "Discussion about nothing in particular",
    "Nikola Tesla exhibit opens downtown",
    "iPhone and Facebook stock move together",
    "Strong profit gain and rally offset one loss and a weak decline risk for the quarter that ended in March",
    "Metadata study published",
    "   ",
)
SOURCES = ("reddit", "Yahoo Finance", "Motley Fool", "mock feed", "fox.com")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, ticker, date, text, source, content_type, post_score``."""
    return posts_of(table(spark, sf_dir, "events"))


def posts_of(events: DataFrame, *more: str) -> DataFrame:
    """Posts of events, streaming or not, with ``more`` of their columns."""
    return events.select(
        "event_id", *more,
        pick(TICKERS, F.col("user_id") % 5).alias("ticker"),
        F.to_date("ts").cast("string").alias("date"),
        pick(HEADLINES, F.col("event_id") % len(HEADLINES)).alias("text"),
        pick(SOURCES, F.expr(f"(event_id div {len(HEADLINES)}) % 5")).alias("source"),
        F.when(F.col("event_id") % 7 == 0, "news_headline").when(F.col("event_id") % 11 == 0, "SOCIAL_POST").alias("content_type"),
        F.col("value").alias("post_score"),
    )


def grouped_records(posts: DataFrame) -> DataFrame:
    """One record for each ticker and day with its posts in event order."""
    row = F.struct("event_id", "text", "source", "content_type", "post_score")
    return posts.groupBy("ticker", "date").agg(F.array_sort(F.collect_list(row)).alias("posts"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ticker, date, close, high, volume``: one bar for each ticker and day, from exact decimal sums."""
    item = table(spark, sf_dir, "lineitem")
    return item.groupBy(
        pick(TICKERS, F.col("l_suppkey") % 5).alias("ticker"), F.to_date("l_shipdate").cast("string").alias("date")
    ).agg(
        (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.sum(F.col("l_quantity").cast("bigint")).cast("double")).alias("close"),
        F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("high"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("volume"),
    )


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stories of a ticker: ``story_id, ticker, title, outlet, published_at``."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("story_id"), pick(TICKERS, F.col("doc_id") % 5).alias("ticker"),
        F.col("text").alias("title"), F.col("text").alias("body"), F.col("source").alias("outlet"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 600).alias("published_at"),
    )


def sql_values(values: tuple[str, ...]) -> str:
    return ", ".join("({}, '{}')".format(i, v.replace("'", "''")) for i, v in enumerate(values))


#: The same posts and bars in SQL.
POSTS_SQL = f"""tpl(i, txt) AS (VALUES {sql_values(HEADLINES)}), src(i, name) AS (VALUES {sql_values(SOURCES)}),
posts AS (
  SELECT event_id, ['TSLA', 'NVDA', 'AMD', 'AAPL', 'META'][CAST(user_id % 5 AS INTEGER) + 1] AS ticker,
         CAST(CAST(ts AS DATE) AS VARCHAR) AS date, txt AS text, name AS source,
         CASE WHEN event_id % 7 = 0 THEN 'news_headline' WHEN event_id % 11 = 0 THEN 'SOCIAL_POST' END AS content_type,
         value AS post_score
  FROM events JOIN tpl ON tpl.i = event_id % {len(HEADLINES)} JOIN src ON src.i = (event_id // {len(HEADLINES)}) % 5
)"""
BARS_SQL = """bars AS (
  SELECT ['TSLA', 'NVDA', 'AMD', 'AAPL', 'META'][CAST(l_suppkey % 5 AS INTEGER) + 1] AS ticker,
         CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS close,
         max(l_extendedprice / l_quantity) AS high, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume
  FROM lineitem GROUP BY 1, 2
)"""
