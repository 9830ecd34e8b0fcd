"""Readers and writers: grouped ticker-day records, RSS items, rule tables, theme files."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import canonical_url, first_text, strip

POST = "struct<id: string, text: string, source: string, content_type: string, post_score: double>"
MARKET = "struct<price: double, price_delta_24h: double, percent_change_24h: double, volume: bigint, volume_delta: double, day_high: double, source: string, status: string>"
RECORD = f"ticker string, date string, posts array<{POST}>, market_data {MARKET}, text string, source string, post_score double"
STORY = "struct<id: string, title: string, description: string, outlet: string, published_at: string>"
THEME = f"theme_id string, ticker string, trading_day string, member_stories array<{STORY}>"
ITEM = "title string, link string, description string, pubDate string"


def _or_empty(spark: SparkSession, read, schema: str) -> DataFrame:
    """A path that is not there counts as an empty table."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def records(spark: SparkSession, path: str, array: bool = True) -> DataFrame:
    """Grouped and flat pipeline records from JSON arrays, or (not ``array``) from JSON lines, which can be split; a flat record becomes a record of one post."""
    df = _or_empty(spark, lambda: spark.read.schema(RECORD).option("multiLine", array).json(path), RECORD)
    own = F.array(F.struct(F.lit(None).cast("string").alias("id"), "text", "source", F.lit(None).cast("string").alias("content_type"), "post_score")).cast(f"array<{POST}>")
    return df.select(F.upper("ticker").alias("ticker"), "date", F.when(F.col("posts").isNull() & F.col("text").isNotNull(), own).otherwise(F.col("posts")).alias("posts"), "market_data")


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path)


def themes(spark: SparkSession, path: str) -> DataFrame:
    return _or_empty(spark, lambda: spark.read.schema(THEME).option("multiLine", True).json(path), THEME)


def _published(at: Column) -> Column:
    """The time of an RSS or ISO date text."""
    plain = F.regexp_replace(F.regexp_replace(at, r"^[A-Za-z]{3},\s*", ""), r"(?:GMT|UTC?)$", "+0000")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")), at.try_cast("timestamp"))


def _items(df: DataFrame, *more: Column) -> DataFrame:
    out = df.select(*more, strip(F.col("title")).alias("title"), canonical_url(F.col("link")).alias("canonical_url"), F.coalesce(strip(F.col("description")), F.lit("")).alias("description"), _published(F.col("pubDate")).alias("published_at"))
    return out.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("canonical_url", F.lit("")) != ""))


def feed_items(spark: SparkSession, path: str, source: str) -> DataFrame:
    """RSS items of landed files, with canonical link and parsed time; items without a title or link are dropped."""
    df = _or_empty(spark, lambda: spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path), ITEM)
    return _items(df, F.lit(source).alias("source"))


def feed_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """``source, file, text`` of landed feeds: one row a file, below ``source=...`` folders, as a table or a stream."""
    reader = (spark.readStream if stream else spark.read).format("text").schema("value string, source string").option("wholetext", True)
    named = lambda df: df.select("source", F.regexp_extract("_metadata.file_path", "([^/]*)$", 1).alias("file"), F.col("value").alias("text"))
    return _or_empty(spark, lambda: named(reader.load(path)), "source string, file string, text string")


def parsed_feeds(files: DataFrame) -> DataFrame:
    """Feed files with their items, and ``broken``: the text of a file that is no whole feed, which is set aside alone."""
    parsed = F.from_xml("text", F.lit(f"channel struct<item: array<struct<{ITEM.replace(' string', ': string')}>>>, broken string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken", "rowTag": "rss"})
    rows = files.withColumn("x", parsed)
    broken = F.when(F.col("text").isNull() | F.col("x.broken").isNotNull() | F.col("x.channel").isNull(), F.coalesce("text", F.lit("")))
    return rows.select("source", "file", broken.alias("broken"), F.when(broken.isNull(), F.col("x.channel.item")).alias("items"))


def feed_rows(parsed: DataFrame) -> DataFrame:
    """The items of whole feeds, as :func:`feed_items` gives them."""
    each = parsed.select("source", "file", F.explode("items").alias("i")).select("source", "file", "i.*")
    return _items(each, F.col("source"), F.col("file"))


def rules(text: str) -> tuple[tuple[str, str, str], ...]:
    """A rule table: category, kind and pattern in tab-separated columns; blank lines and remarks are skipped."""
    out = []
    for number, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        parts = line.split("\t")
        if len(parts) != 3 or not all(parts) or parts[1] not in ("literal", "regex"):
            raise ValueError(f"line {number}: not a rule")
        if parts[1] == "regex":
            re.compile(parts[2])
        out.append(tuple(parts))
    if not out:
        raise ValueError("no rules")
    return tuple(out)


def provider_news(items: Column) -> Column:
    """Title, source and link of a provider's news item, by the precedence of its nested fields."""
    return F.struct(
        first_text(items["title"], items["content"]["title"]).alias("title"),
        F.coalesce(first_text(items["publisher"], items["content"]["provider"]["displayName"], items["content"]["provider"]["name"]), F.lit("Yahoo Finance")).alias("source"),
        first_text(items["link"], items["content"]["canonicalUrl"]["url"], items["content"]["clickThroughUrl"]["url"]).alias("url"),
    )


def config(text: str) -> dict:
    """A YAML document of feeds or tickers; what is no mapping is an error."""
    try:
        import yaml
    except ImportError as e:  # not everywhere there
        raise RuntimeError("reading YAML needs a YAML library") from e
    out = yaml.safe_load(text)
    if not isinstance(out, dict):
        raise ValueError("not a configuration")
    return out


def feeds(spark: SparkSession, text: str) -> DataFrame:
    """``id, url, enabled, intended_role, fields`` of a feed configuration, a row a feed; ``fields`` are the names that it maps."""
    entries = config(text).get("feeds")
    if not isinstance(entries, list) or not entries:
        raise ValueError("a list of feeds is needed")
    rows = [(e.get("id"), e.get("url"), bool(e.get("enabled", True)), e.get("intended_role"), list(e.get("expected_fields") or {})) for e in entries]
    return spark.createDataFrame(rows, "id string, url string, enabled boolean, intended_role string, fields array<string>")


def aliases(text: str) -> tuple[fixed.Alias, ...]:
    """The ticker aliases of a configuration."""
    entries = config(text).get("tickers")
    if not isinstance(entries, list):
        raise ValueError("a list of tickers is needed")
    lists = ("strong_aliases", "context_required_aliases", "context_terms", "exclusion_terms")
    return tuple(fixed.Alias(e.get("ticker"), e.get("cashtag"), e.get("official_company_name"), *(tuple(e[k]) if isinstance(e.get(k), list) else None for k in lists)) for e in entries)
