"""Serving views: availability, provider states, freshness, scorecard, dashboard rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks

TTL_SECONDS = 900
STALE_MINUTES = 60
BATCH_LIMIT = 10


def social_status(posts: DataFrame) -> DataFrame:
    """Each ticker's posts with a ``kind``: are they social, publisher headlines, or both?"""
    counts = posts.groupBy("ticker").agg(F.count_if(F.col("kind") == "social_post").alias("social"), F.count_if(F.coalesce(F.col("kind") != "social_post", F.lit(True))).alias("publisher"))
    status = F.when((F.col("social") == 0) & (F.col("publisher") == 0), "unavailable").when(F.col("social") == 0, "cached").when(F.col("publisher") > 0, "partial").otherwise("ready")
    source = F.when(status == "cached", "Publisher headlines").when(status == "partial", "Social posts and publisher headlines").otherwise("Social posts")
    count = F.when(status == "partial", F.col("social") + F.col("publisher")).when(status == "cached", F.col("publisher")).otherwise(F.col("social"))
    return counts.select("ticker", "social", "publisher", status.alias("status"), source.alias("source"), (status != "unavailable").alias("available"), count.alias("count"))


def provider_state(fresh: Column, fetched: Column, count: Column, stale: Column, pipeline: Column) -> Column:
    """Headline provider: fresh cache, fetch, stale cache, pipeline posts, in that order."""
    own = F.when(pipeline > 0, "cached").otherwise("unavailable")
    return (
        F.when(fresh, F.when(count > 0, "cached").otherwise("unavailable"))
        .when(~fetched & stale, "fallback")
        .when(~fetched, own)
        .when(count > 0, "live")
        .otherwise(own)
    )


def provider_source(fresh: Column, fetched: Column, count: Column, stale: Column, pipeline: Column) -> Column:
    own = F.when(pipeline > 0, "Committed demo dataset").otherwise("Yahoo Finance via yfinance")
    return (
        F.when(fresh, "cache")
        .when(~fetched & stale, "Yahoo Finance via yfinance (stale cache)")
        .when(~fetched | (count == 0), own)
        .otherwise("Yahoo Finance via yfinance")
    )


def expired(age_seconds: Column, ttl: int = TTL_SECONDS) -> Column:
    return age_seconds > ttl


def market_message(price: Column, status: Column, source: Column, volume_delta: Column) -> Column:
    there = (price > 0) & (status != "unavailable")
    text = F.concat(F.lit("Market snapshot is available from "), source, F.lit("."))
    with_delta = F.concat(text, F.lit(" Volume delta "), F.format_string("%+.1f%%", volume_delta * 100), F.lit("."))
    return F.when(there & volume_delta.isNotNull(), with_delta).when(there, text).otherwise("Market snapshot unavailable from configured providers.")


def freshness(runs: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """Each ticker's last success, and whether it is too long ago; ``now`` is one value, as a literal or a column of the runs."""
    last = runs.where("ok").groupBy("ticker").agg(F.max("finished_at").alias("last_success"), F.max(now).alias("now"))
    return last.withColumn("stale", F.unix_timestamp("now") - F.unix_timestamp("last_success") > minutes * 60).drop("now")


def run_gaps(runs: DataFrame, hours: float = 2.0, size: int = blocks.SIZE) -> DataFrame:
    """Longest pause between two runs of a ticker, and how many are above ``hours``; a block of runs sees the last run before it."""
    rows = blocks.blocked(runs.select("ticker", "started_at", "run_id"), ["ticker"], ["started_at", "run_id"], 1, size)
    gap = F.unix_timestamp("started_at") - F.unix_timestamp(F.lag("started_at").over(blocks.in_block("ticker")))
    return rows.withColumn("gap_s", gap).where("own").groupBy("ticker").agg(F.max("gap_s").alias("longest_gap_s"), F.count_if(F.col("gap_s") > hours * 3600).alias("long_gaps"))


def dashboard(sentiment: DataFrame, market: DataFrame, history: DataFrame, headlines: DataFrame, social: DataFrame, fundamentals: DataFrame | None = None) -> DataFrame:
    """One nested row for each ticker; every side is aggregated by ticker before the left joins."""
    points = history.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "close", "volume"))).alias("history"))
    heads = headlines.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("rank", "headline", "source", "time"))).alias("headlines"))
    out = market.join(sentiment, "ticker", "left").join(points, "ticker", "left").join(heads, "ticker", "left").join(social, "ticker", "left")
    return out if fundamentals is None else out.join(fundamentals, "ticker", "left")


def batch_tickers(tickers: list[str], limit: int = BATCH_LIMIT) -> list[str]:
    """Upper case, first-seen order, no repeats; none or too many is an error."""
    wanted = list(dict.fromkeys(t.strip().upper() for t in tickers if t.strip()))
    if not 0 < len(wanted) <= limit:
        raise ValueError(f"1 to {limit} tickers")
    return wanted


def dashboard_batch(wanted: list[str], posts: DataFrame, bars: DataFrame, fundamentals: DataFrame, headlines: int = 6) -> DataFrame:
    """A nested row for each wanted ticker: market, sentiment, history, scored headlines, prediction and fundamentals, with their states.

    ``posts`` are valid posts. Tickers without any post are left out, as they
    are in single requests; all other sides may be missing.
    """
    from . import market, sentiment, signal

    posts, bars = posts.where(F.col("ticker").isin(wanted)), bars.where(F.col("ticker").isin(wanted))
    scored = sentiment.with_sentiment(posts)
    overall = sentiment.overall(scored, "ticker")
    overall = overall.select("ticker", F.struct(*[c for c in overall.columns if c != "ticker"]).alias("sentiment"))
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy("date", "event_id"))
    told = scored.withColumn("rank", rank).where(F.col("rank") <= headlines)
    told = told.select("ticker", F.struct("rank", F.col("text").alias("headline"), "source", "date", F.struct(*sentiment.SCORES).alias("sentiment")).alias("h"))
    told = told.groupBy("ticker").agg(F.array_sort(F.collect_list("h")).alias("headlines"))
    snap = market.snapshot(bars)
    snap = snap.select("ticker", F.struct(*[c for c in snap.columns if c != "ticker"]).alias("market"))
    points = market.history(bars).groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "close", "volume"))).alias("history"))
    own = fundamentals.select("ticker", F.struct(*[c for c in fundamentals.columns if c != "ticker"]).alias("fundamentals"))
    outcome = signal.gate(F.col("ticker"), F.lit(True), F.lit(True), F.lit(False))
    out = overall.join(told, "ticker", "left").join(snap, "ticker", "left").join(points, "ticker", "left").join(own, "ticker", "left")
    state = lambda c: F.when(F.col(c).isNull(), "unavailable").otherwise("live").alias(f"{c}_status")
    return out.select("*", F.struct(outcome.alias("outcome")).alias("prediction"), state("market"), state("history"), state("headlines"), state("fundamentals"))


def score_gates(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """Precision and recall of labelled pairs, success and degraded rates, each against its gate."""
    p = pairs.agg(
        (F.count_if(F.col("found") & F.col("truth")) / F.nullif(F.count_if("found"), F.lit(0))).alias("dedup_precision"),
        (F.count_if(F.col("found") & F.col("truth")) / F.nullif(F.count_if("truth"), F.lit(0))).alias("dedup_recall"),
    )
    r = runs.agg((F.count_if("ok") / F.count("*")).alias("run_success"), (F.count_if("degraded") / F.count("*")).alias("degraded_rate"))
    rows = F.array(
        F.struct(F.lit("dedup_precision").alias("gate"), F.col("dedup_precision").alias("value"), (F.col("dedup_precision") >= 0.85).alias("passed")),
        F.struct(F.lit("dedup_recall").alias("gate"), F.col("dedup_recall").alias("value"), (F.col("dedup_recall") >= 0.75).alias("passed")),
        F.struct(F.lit("run_success").alias("gate"), F.col("run_success").alias("value"), (F.col("run_success") >= 0.95).alias("passed")),
        F.struct(F.lit("degraded_rate").alias("gate"), F.col("degraded_rate").alias("value"), (F.col("degraded_rate") <= 0.15).alias("passed")),
    )
    return p.join(r).select(F.explode(rows).alias("g")).select("g.*")  # two single rows


#: The dashboard's sections in order, with their titles.
SECTIONS = (("market_data", "Market data"), ("sentiment", "Sentiment"), ("prediction", "Experimental signal"), ("headlines", "Headlines"), ("social_posts", "Social posts"), ("fundamentals", "Fundamentals"))
_UNTRAINED = "Experimental signal unavailable until a model is trained and evaluated on real historical outcomes."


def _section(available: Column, status: Column, source: Column, message: Column, count: Column | None = None) -> Column:
    none = F.lit(None).cast("bigint")
    return F.struct(available.alias("available"), status.alias("status"), source.alias("source"), message.alias("message"), (none if count is None else count.cast("bigint")).alias("count"))


def availability(rows: DataFrame) -> DataFrame:
    """``rows`` with a struct for each section, from what was found for a ticker.

    Read are ``sentiment_label``; ``price, market_status, market_source,
    volume_delta``; ``movement, real_training_data, reason``; ``headline_count,
    headline_status, headline_source``; ``social, publisher``;
    ``has_fundamentals, fundamentals_status, fundamentals_source``. A missing
    side is null.
    """
    c = F.col
    has = c("sentiment_label").isNotNull()
    sentiment = _section(has, F.when(has, "ready").otherwise("unavailable"), F.lit("Sentiment model"), F.when(has, "Sentiment is available.").otherwise("Aggregate sentiment unavailable until enough validated text data is available."))
    price = F.coalesce("price", F.lit(0.0))
    status = F.coalesce(F.nullif("market_status", F.lit("")), F.when(price > 0, "ready").otherwise("unavailable"))
    source = F.coalesce(F.nullif("market_source", F.lit("")), F.lit("source not reported"))
    market = _section((price > 0) & (status != "unavailable"), status, source, market_message(price, status, source, c("volume_delta")))
    real = c("movement").isNotNull() & F.coalesce("real_training_data", F.lit(False))
    told = F.when(real, "Experimental signal is available from a real-outcome validated model.").otherwise(F.coalesce("reason", F.lit(_UNTRAINED)))
    prediction = _section(real, F.when(real, "ready").otherwise("unavailable"), F.lit("Experimental signal"), told)
    n = F.coalesce("headline_count", F.lit(0))
    heads = F.when(n > 0, F.format_string("%d headline items are available.", n.cast("bigint"))).otherwise("Headline provider is unavailable or returned no articles.")
    headlines = _section(n > 0, F.coalesce("headline_status", F.when(n > 0, "ready").otherwise("unavailable")), F.coalesce("headline_source", F.lit("Yahoo Finance via yfinance")), heads, n)
    s, p = F.coalesce("social", F.lit(0)).cast("bigint"), F.coalesce("publisher", F.lit(0)).cast("bigint")
    kind = F.when(s + p == 0, "unavailable").when(s == 0, "cached").when(p > 0, "partial").otherwise("ready")
    words = (
        F.when(kind == "unavailable", "No social posts are available for this ticker yet.")
        .when(kind == "cached", F.format_string("%d publisher headline items are available. These are not social chatter.", p))
        .when(kind == "partial", F.format_string("%d social posts and %d publisher headline items are available.", s, p))
        .otherwise(F.format_string("%d social posts are available.", s))
    )
    whose = F.when(kind == "cached", "Publisher headlines").when(kind == "partial", "Social posts and publisher headlines").otherwise("Social posts")
    social = _section(kind != "unavailable", kind, whose, words, s + p)
    f = F.coalesce("has_fundamentals", F.lit(False))
    company = F.when(f, "Company fundamentals are available.").otherwise("Fundamentals provider is unavailable or returned no usable fields.")
    fundamentals = _section(f, F.coalesce("fundamentals_status", F.when(f, "ready").otherwise("unavailable")), F.coalesce("fundamentals_source", F.lit("Yahoo Finance via yfinance")), company)
    return rows.withColumns({"market_data": market, "sentiment": sentiment, "prediction": prediction, "headlines": headlines, "social_posts": social, "fundamentals": fundamentals})


def alerts(rows: DataFrame, key: str = "ticker") -> DataFrame:
    """``section, place, type, title, status, count, source, message``: the six notices of each row of :func:`availability`; a null section was never asked for."""
    notices = []
    for place, (name, title) in enumerate(SECTIONS):
        a = F.col(name)
        kind = F.when(a.isNull(), "info").when(a["status"].isin("ready", "live", "cached"), "success").when(a["status"].isin("fallback", "partial", "unavailable"), "warning").otherwise(F.when(a["available"], "success").otherwise("warning"))
        shown = F.when(F.contains(F.lower(a["source"]), F.lit("publisher")), "Publisher items").otherwise(title) if name == "social_posts" else F.lit(title)
        notices.append(F.struct(
            F.lit(name).alias("section"), F.lit(place).alias("place"), kind.alias("type"), shown.alias("title"),
            F.when(a.isNull(), "Not queried").otherwise(F.coalesce(F.nullif(a["status"], F.lit("")), F.when(a["available"], "ready").otherwise("unavailable"))).alias("status"),
            a["count"].alias("count"), a["source"].alias("source"), F.coalesce(F.nullif(a["message"], F.lit("")), F.lit("Backend availability has not been reported yet.")).alias("message"),
        ))
    return rows.select(key, F.explode(F.array(*notices)).alias("n")).select(key, "n.*")
