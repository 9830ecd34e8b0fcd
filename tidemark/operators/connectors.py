"""Rows from landed provider payloads, by VARIANT: absent, null and badly typed fields stay apart.

A payload is the JSON text of one provider response. Texts that are no JSON
object are set aside by :func:`broken` and yield no rows; the others of the
same batch, file and ticker are not touched by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_text
from .providers import NEWS_LIMIT, display_date

#: Fields of a fundamentals row, with the names that a provider gives them, best first.
FUNDAMENTAL_NUMBERS = {
    "market_cap": ("marketCap", "market_cap"), "trailing_pe": ("trailingPE", "trailing_pe"), "forward_pe": ("forwardPE", "forward_pe"), "price_to_book": ("priceToBook", "price_to_book"),
    "dividend_yield": ("dividendYield", "dividend_yield"), "beta": ("beta",), "eps": ("trailingEps", "eps"), "revenue": ("totalRevenue", "revenue"),
    "net_income": ("netIncomeToCommon", "net_income"), "operating_cash_flow": ("operatingCashflow", "operating_cash_flow"), "debt_to_equity": ("debtToEquity", "debt_to_equity"),
}
FUNDAMENTAL_TEXTS = {"company_name": ("longName", "shortName"), "sector": ("sector",), "industry": ("industry",)}
PROVIDER = "Yahoo Finance via yfinance"

_PLACE = ("batch", "provider", "ticker", "file", "place")


def parsed(landed: DataFrame) -> DataFrame:
    """Landed rows with their payload as a VARIANT ``v``; null where the text is no JSON object."""
    v = F.try_parse_json("value")
    return landed.withColumn("v", F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def broken(landed: DataFrame) -> DataFrame:
    """The landed rows without a payload, to be reported."""
    return parsed(landed).where(F.col("v").isNull()).select(*_PLACE, "value")


def text_at(v: Column, path: str) -> Column:
    """A text field; null if it is absent, null or of another kind."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def number_at(v: Column, path: str) -> Column:
    """A number, or a text or truth value that reads as one."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "BOOLEAN", F.try_variant_get(v, path, "boolean").cast("double")).otherwise(F.try_variant_get(v, path, "string").try_cast("double"))


def time_at(v: Column, path: str) -> Column:
    """Seconds since 1970 if it is a number, else an ISO text."""
    at = F.try_variant_get(v, path, "variant")
    iso = F.try_variant_get(v, path, "string").try_cast("timestamp")
    return F.when(F.schema_of_variant(at) == "STRING", iso).otherwise(F.timestamp_seconds(F.try_variant_get(v, path, "double")))


def there(v: Column, path: str) -> Column:
    """Whether a field counts as given: not absent, null, zero, empty or false."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    value = F.try_variant_get(v, path, "string")
    return F.coalesce(~kind.isin("VOID", "STRING", "BOOLEAN") & (F.coalesce(value.try_cast("double"), F.lit(1.0)) != 0) | ((kind == "STRING") & (value != "")) | ((kind == "BOOLEAN") & (value == "true")), F.lit(False))


def first_given(v: Column, kind, *paths: str) -> Column:
    """The value of the first path that is given."""
    out = F.lit(None)
    for path in reversed(paths):
        out = F.when(there(v, path), kind(v, path)).otherwise(out)
    return out


def news(landed: DataFrame, limit: int = NEWS_LIMIT) -> DataFrame:
    """Headlines of ``{"news": [...]}``: the first ``limit`` items of each response, then without those that have no title."""
    items = parsed(landed).select(*_PLACE, F.posexplode(F.slice(F.try_variant_get("v", "$.news", "array<variant>"), 1, limit)).alias("index", "i"))
    i = F.col("i")
    text = lambda *paths: first_text(*[text_at(i, p) for p in paths])
    at = first_given(i, time_at, "$.providerPublishTime", "$.content.pubDate", "$.content.displayTime")
    own_id = first_given(i, lambda v, p: F.try_variant_get(v, p, "string"), "$.id", "$.content.id")
    return items.select(
        *_PLACE, "index", F.coalesce(own_id, F.concat_ws("-", "ticker", "index")).alias("id"), text("$.title", "$.content.title").alias("title"),
        F.coalesce(text("$.publisher", "$.content.provider.displayName", "$.content.provider.name"), F.lit("Yahoo Finance")).alias("source"),
        text("$.link", "$.content.canonicalUrl.url", "$.content.clickThroughUrl.url").alias("url"), text("$.summary", "$.content.summary").alias("summary"),
        at.alias("published_at"), display_date(at).alias("time"),
    ).where(F.col("title").isNotNull())


def quotes(landed: DataFrame) -> DataFrame:
    """Snapshots of ``{"c":, "d":, "dp":, "v":}``: what can't be read as a number is 0."""
    rows = parsed(landed).where(F.col("v").isNotNull())
    v = F.col("v")
    number = lambda path: F.coalesce(number_at(v, path), F.lit(0.0))
    whole = F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(v, "$.v", "variant")) == "STRING", F.try_variant_get(v, "$.v", "string").try_cast("bigint")).otherwise(F.try_variant_get(v, "$.v", "double").cast("bigint")), F.lit(0).cast("bigint"))
    return rows.select(*_PLACE, number("$.c").alias("price"), number("$.d").alias("price_delta_24h"), number("$.dp").alias("percent_change_24h"), whole.alias("volume"), F.lit(0.0).alias("volume_delta"), F.lit("quote").alias("source"), F.lit("cached").alias("status"))


def fundamentals(landed: DataFrame) -> DataFrame:
    """Company rows of ``{"info": {...}, "fast_info": {...}}``, a source's names before those of the next; without any value there is no row."""
    rows, v = parsed(landed).where(F.col("v").isNotNull()), F.col("v")
    numbers = [F.coalesce(*[number_at(v, f"$.{side}.{name}") for side in ("info", "fast_info") for name in names]).alias(field) for field, names in FUNDAMENTAL_NUMBERS.items()]
    texts = [first_text(*[text_at(v, f"$.info.{name}") for name in names]).alias(field) for field, names in FUNDAMENTAL_TEXTS.items()]
    currency = first_text(*[text_at(v, p) for p in ("$.info.financialCurrency", "$.info.currency", "$.fast_info.currency")]).alias("currency")
    out = rows.select(*_PLACE, *texts, *numbers, currency, F.lit(PROVIDER).alias("source"))
    return out.where(F.coalesce(*[F.col(c).cast("string") for c in out.columns if c not in (*_PLACE, "source")]).isNotNull())


def posts_of_records(records: DataFrame) -> DataFrame:
    """``ticker, date, post_index, text, source, content_type, post_score`` of record texts (column ``value``) in either layout.

    A score that is absent counts as 0, one that is there and null stays null; absent texts and sources have defaults.
    """
    v = F.try_parse_json("value")
    rows = records.select(v.alias("v")).where(F.col("v").isNotNull())
    own = F.try_variant_get("v", "$.posts", "array<variant>")
    grouped = F.schema_of_variant(F.try_variant_get("v", "$.posts", "variant")).startswith("ARRAY")
    flat = F.when(F.try_variant_get("v", "$.text", "variant").isNotNull() & F.try_variant_get("v", "$.posts", "variant").isNull(), F.array("v"))
    head = (F.upper(F.try_variant_get("v", "$.ticker", "string")).alias("ticker"), F.try_variant_get("v", "$.date", "string").alias("date"))
    each = rows.select(*head, F.posexplode(F.when(grouped, own).otherwise(flat)).alias("post_index", "p"))
    p = F.col("p")
    default = lambda path, kind, value: F.when(F.try_variant_get(p, path, "variant").isNull(), F.lit(value)).otherwise(F.try_variant_get(p, path, kind))
    return each.select(
        "ticker", "date", "post_index", F.coalesce(default("$.text", "string", ""), F.lit("")).alias("text"), default("$.source", "string", "unknown").alias("source"),
        F.try_variant_get(p, "$.content_type", "string").alias("content_type"), default("$.post_score", "double", 0.0).alias("post_score"),
    )
