"""Provider rows: news items, company news, quotes, posts with source indices, and what stands in where a provider has nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_text, number, strip
from .posts import content_type, is_valid

#: How many items are taken, and how many days back.
NEWS_LIMIT, HEADLINE_LIMIT, LOOKBACK_DAYS = 15, 8, 3


def display_date(at: Column) -> Column:
    return F.date_format(at, "MMM d, yyyy")


def publish_time(value: Column) -> Column:
    """Seconds since 1970 or ISO text as a timestamp; null if it is neither."""
    return F.coalesce(F.timestamp_seconds(number(value)), value.try_cast("timestamp"))


def news(feed: DataFrame, limit: int = NEWS_LIMIT) -> DataFrame:
    """Headlines of ``ticker, items``: the first ``limit`` items of each feed, then without those that have no title.

    A field of the item itself comes before those of its content; an id that
    both lack is the ticker with the item's place in the feed.
    """
    rows = feed.select("ticker", F.posexplode(F.slice("items", 1, limit)).alias("place", "i"))
    i, c = F.col("i"), F.col("i.content")
    at = publish_time(first_text(i["provider_publish_time"], c["pub_date"], c["display_time"]))
    return rows.select(
        "ticker", "place", F.coalesce(first_text(i["id"], c["id"]), F.concat_ws("-", "ticker", "place")).alias("id"), first_text(i["title"], c["title"]).alias("title"),
        F.coalesce(first_text(i["publisher"], c["provider"]["display_name"], c["provider"]["name"]), F.lit("Yahoo Finance")).alias("source"),
        first_text(i["link"], c["canonical_url"]["url"], c["click_through_url"]["url"]).alias("url"),
        first_text(i["summary"], c["summary"]).alias("summary"), at.alias("published_at"), display_date(at).alias("time"),
    ).where(F.col("title").isNotNull())


def company_news(articles: DataFrame, today: Column, fallback: DataFrame, days: int = LOOKBACK_DAYS, limit: int = NEWS_LIMIT) -> DataFrame:
    """``ticker, text, source``: the newest ``limit`` articles of the last ``days`` days; tickers that have none get the fallback's rows."""
    recent = articles.where(F.to_date("published_at").between(F.date_sub(today, days), today))
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("published_at").desc(), "article_id"))
    own = recent.withColumn("rank", rank).where(F.col("rank") <= limit).select("ticker", "text", "source")
    return own.unionByName(fallback.select("ticker", "text", "source").join(own.select("ticker").distinct(), "ticker", "left_anti"))


def own_or_headlines(posts: DataFrame, headlines: DataFrame, limit: int = HEADLINE_LIMIT) -> DataFrame:
    """``ticker, text, source``: a ticker's valid posts; without any the valid ones of its first ``limit`` headlines (by ``place``)."""
    own = posts.where(is_valid(F.col("text"), F.col("source"))).select("ticker", "text", "source")
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy("place"))
    first = headlines.withColumn("rank", rank).where(F.col("rank") <= limit)
    first = first.select("ticker", F.col("title").alias("text"), "source").where(is_valid(F.col("text"), F.col("source")))
    return own.unionByName(first.join(own.select("ticker").distinct(), "ticker", "left_anti"))


def quotes_or_bars(tickers: DataFrame, quotes: DataFrame, bars: DataFrame) -> DataFrame:
    """One snapshot a ticker: the quote (``c, d, dp, v`` as text), else the snapshot of the bars, else an unavailable one."""
    q = quotes.select(
        "ticker", F.struct(
            *(F.coalesce(number(F.col(c)), F.lit(0.0)).alias(n) for c, n in (("c", "price"), ("d", "price_delta_24h"), ("dp", "percent_change_24h"))),
            F.coalesce(F.col("v").try_cast("bigint"), F.lit(0).cast("bigint")).alias("volume"), F.lit(0.0).alias("volume_delta"), F.lit("quote").alias("source"), F.lit("cached").alias("status"),
        ).alias("first"),
    )
    b = bars.select("ticker", F.struct("price", "price_delta_24h", "percent_change_24h", "volume", "volume_delta", F.lit("bars").alias("source"), F.lit("cached").alias("status")).alias("second"))
    none = F.struct(*(F.lit(0.0).alias(c) for c in ("price", "price_delta_24h", "percent_change_24h")), F.lit(0).cast("bigint").alias("volume"), F.lit(0.0).alias("volume_delta"), F.lit("unavailable").alias("source"), F.lit("unavailable").alias("status"))
    return tickers.join(q, "ticker", "left").join(b, "ticker", "left").select("ticker", F.coalesce("first", "second", none).alias("s")).select("ticker", "s.*")


def _numbered(records: DataFrame) -> DataFrame:
    """Posts with the place of their record among the ticker's (by date) and their own place in it."""
    record = F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1
    return records.withColumn("record", record).select("ticker", "date", "record", F.posexplode("posts").alias("place", "post"))


def social_posts(records: DataFrame) -> DataFrame:
    """The valid posts of grouped records; ids keep the places in the source, a post without a score stays without."""
    p = _numbered(records)
    source = F.coalesce(F.nullif(strip(F.col("post.source")), F.lit("")), F.lit("Unknown source"))
    text = strip(F.coalesce("post.text", F.lit("")))
    out = p.select(
        F.concat_ws("-", "ticker", "record", "place").alias("id"), "ticker", text.alias("text"), source.alias("source"),
        content_type(F.col("post.content_type"), source).alias("content_type"), "date", F.col("post.post_score").alias("post_score"),
    )
    return out.where(is_valid(F.col("text"), F.col("source")))


def dataset_headlines(records: DataFrame, limit: int = 6) -> DataFrame:
    """The first ``limit`` valid posts of each ticker in source order, as headlines; the cut comes after validity."""
    p = _numbered(records)
    rows = p.select(
        "ticker", "record", "place", F.concat(F.concat_ws("-dataset-", "ticker", "record"), F.lit("-"), "place").alias("id"), strip(F.coalesce("post.text", F.lit(""))).alias("headline"),
        strip(F.coalesce("post.source", F.lit("Committed demo dataset"))).alias("source"), display_date(F.col("date").try_cast("timestamp")).alias("time"),
    ).where(is_valid(F.col("headline"), F.col("source")))
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy("record", "place"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit).drop("record", "place", "rank")


def finite(df: DataFrame, name: str) -> DataFrame:
    """Rows whose value is a finite number."""
    c = F.col(name)
    return df.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))


def health(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each source, and whether it has any."""
    counts = [df.agg(F.lit(name).alias("source"), F.count("*").alias("rows")) for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out.withColumn("available", F.col("rows") > 0)


def register(spark) -> None:
    """The row functions under names for SQL, as SQL functions that the optimizer sees through."""
    social = " OR ".join(f"contains(lower(trim(source)), '{s}')" for s in _social())
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION post_kind(explicit STRING, source STRING) RETURNS STRING
      RETURN CASE WHEN lower(trim(explicit)) IN ('social_post', 'publisher_headline') THEN lower(trim(explicit)) WHEN lower(trim(explicit)) = 'news_headline' THEN 'publisher_headline'
      WHEN {social} THEN 'social_post' ELSE 'publisher_headline' END""")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION score_gauge(score DOUBLE) RETURNS INT RETURN CAST(least(100, greatest(0, floor((score + 1) / 2 * 100 + 0.5))) AS INT)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION gauge_band(gauge INT) RETURNS STRING RETURN CASE WHEN gauge >= 65 THEN 'green' WHEN gauge >= 40 THEN 'amber' ELSE 'red' END")


def register_routes(spark) -> None:
    """The read routes as SQL table functions over views ``scored_posts`` (scored valid posts) and ``snapshots``, which must be there, for lateral joins."""
    # the wanted ticker is compared above the aggregates, which is what the optimizer turns into a plain join
    means = "SELECT ticker, count(*) AS posts, CAST(avg(CAST(sentiment_score AS DECIMAL(18, 12))) AS DOUBLE) AS sentiment_score FROM scored_posts GROUP BY ticker"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION ticker_sentiment(wanted STRING) RETURNS TABLE (posts BIGINT, sentiment_score DOUBLE, label STRING)
      RETURN SELECT posts, sentiment_score, CASE WHEN sentiment_score > 0.05 THEN 'positive' WHEN sentiment_score < -0.05 THEN 'negative' ELSE 'neutral' END FROM ({means}) WHERE ticker = upper(trim(wanted))""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION market_snapshot(wanted STRING) RETURNS TABLE (date STRING, price DOUBLE, volume BIGINT, volume_delta DOUBLE, status STRING)
      RETURN SELECT date, price, volume, volume_delta, status FROM snapshots WHERE ticker = upper(trim(wanted))""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION dashboard(wanted STRING) RETURNS TABLE (ticker STRING, posts BIGINT, sentiment_score DOUBLE, price DOUBLE, status STRING)
      RETURN SELECT ticker, posts, sentiment_score, price, status FROM ({means}) LEFT JOIN (SELECT ticker, price, status FROM snapshots) USING (ticker) WHERE ticker = upper(trim(wanted))""")


def _social() -> tuple[str, ...]:
    from ..functions.fixed import SOCIAL_SOURCES

    return SOCIAL_SOURCES
