"""Views over stored tables: tickers and themes for reading, run gaps in market hours, the scorecard's gates, configuration problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from . import matching

#: The gates of the scorecard, whether their value must be at least or at most the bound.
GATES = (
    ("G1_theme_agreement", "least", 0.75), ("G2_faithfulness", "least", 0.95), ("G3_banned_language", "most", 0.0), ("G4_dedup_precision", "least", 0.85), ("G4_dedup_recall", "least", 0.75),
    ("G5_run_success", "least", 0.95), ("G5_longest_gap_hours", "most", 2.0), ("G6_freshness_p95_minutes", "most", 45.0), ("G7_degraded_rate", "most", 0.15),
    ("Q1_comprehension", "least", 0.8), ("Q2_trust", "least", 0.8), ("Q3_intent", "least", 0.6),
)
#: What a feed entry must say about its fields.
FEED_FIELDS = ("title", "url", "description", "published_at")


def scorecard(values: DataFrame) -> DataFrame:
    """``gate, value, passed`` for every gate from measured ``(gate, value)``; an unmeasured one has nulls. A fixed table of few rows is broadcast."""
    gates = values.sparkSession.createDataFrame(GATES, "gate string, side string, bound double")
    passed = F.when(F.col("side") == "least", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return gates.join(values, "gate", "left").select("gate", "value", passed.alias("passed"))


def in_market_hours(at: Column) -> Column:
    """Whether a UTC time lies between 9:30 and 16:00 of a weekday in New York (holidays are not known)."""
    local = F.from_utc_timestamp(at, "America/New_York")
    minute = F.hour(local) * 60 + F.minute(local)
    return F.weekday(local).isin(0, 1, 2, 3, 4) & minute.between(570, 959)


def market_gaps(runs: DataFrame, hours: float = 2.0) -> DataFrame:
    """Longest pause between two runs of one market day, and how many are above ``hours``; windows hold one ticker's day."""
    at = F.col("started_at")
    open_ = runs.where(in_market_hours(at)).withColumn("day", F.to_date(F.from_utc_timestamp(at, "America/New_York")))
    gap = F.unix_timestamp(at) - F.unix_timestamp(F.lag("started_at").over(Window.partitionBy("ticker", "day").orderBy("started_at", "run_id")))
    return open_.withColumn("gap_s", gap).groupBy("ticker").agg(F.max("gap_s").alias("longest_gap_s"), F.count_if(F.col("gap_s") > hours * 3600).alias("long_gaps"))


def feed_problems(feeds: DataFrame) -> DataFrame:
    """``id, problem`` of feed entries ``id, url, intended_role, fields``: repeated ids, links without https, no role, missing fields."""
    repeated = feeds.groupBy("id").count().where("count > 1").select("id", F.lit("repeated").alias("problem"))
    problems = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("url"), F.lit("")).startswith("https://"), "not_https"),
        F.when(F.trim(F.coalesce("intended_role", F.lit(""))) == "", "no_role"),
        F.when(F.size(F.array_except(F.array(*map(F.lit, FEED_FIELDS)), F.coalesce("fields", F.array().cast("array<string>")))) > 0, "missing_fields"),
    ))
    return repeated.union(feeds.select("id", F.explode(problems).alias("problem")).distinct())


def alias_problems(aliases: tuple[fixed.Alias, ...], required: tuple[str, ...] = fixed.TICKERS) -> list[tuple[str | None, str]]:
    """``(ticker, problem)`` of a table of aliases, which is code and small: other tickers than ``required``, repeats, empty names, a list that is missing, a contextual name without context."""
    names = [a.ticker for a in aliases]
    out = [(t, "missing") for t in required if t not in names] + [(t, "unknown") for t in dict.fromkeys(names) if t not in required]
    out += [(t, "repeated") for t in dict.fromkeys(names) if names.count(t) > 1]
    for a in aliases:
        out += [(a.ticker, f"empty {name}") for name, value in (("cashtag", a.cashtag), ("company", a.company), ("strong", a.strong)) if not value]
        out += [(a.ticker, "no exclusions")] if a.exclusions is None else []
        out += [(a.ticker, "context")] if a.contextual and not a.context else []
    return out


def false_positives(cases: DataFrame, aliases: tuple[fixed.Alias, ...] = fixed.ALIASES) -> DataFrame:
    """Cases ``text, expected`` (sorted tickers, comma between) that the aliases map otherwise, with what they give."""
    found = matching.with_tickers(cases, aliases=aliases).withColumn("matched", F.array_join(F.array_sort("matched"), ","))
    return found.where(F.col("matched") != F.coalesce("expected", F.lit(""))).select("text", "expected", "matched")


def tickers_view(fresh: DataFrame, themes: DataFrame, day: Column) -> DataFrame:
    """Each ticker with its freshness and the themes of the day."""
    today = themes.where(F.col("day") == day).groupBy("ticker").agg(F.count("*").alias("themes"))
    return fresh.select("ticker", "stale").join(today, "ticker", "left").withColumn("themes", F.coalesce("themes", F.lit(0).cast("bigint")))


def themes_view(ranked: DataFrame, citations: DataFrame) -> DataFrame:
    """Ranked themes with their resolved citations in order; a theme without any is degraded."""
    told = citations.groupBy("theme_id").agg(F.array_sort(F.collect_list(F.struct("sentence", "place", "id", "headline", "outlet", "published_at"))).alias("citations"))
    out = ranked.join(told, "theme_id", "left")
    return out.withColumn("degraded", F.col("citations").isNull())
