"""Queries behind the serving views: signal, provider states, dashboard, runs, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import market, posts as post_ops, sentiment, serving, signal
from ..sources import adapters
from ..sources.adapters import POSTS_SQL
from ..streaming import streams
from .market_queries import _DELTAS
from .registry import query
from .text_queries import _SCORED, _mean, _six, rounded, scored, valid_posts

_INPUT = f"""{_SCORED}, g AS (SELECT date, ticker, {_mean('sentiment_score')} AS s, {_mean('positive_prob')} AS pp, {_mean('negative_prob')} AS np, {_mean('neutral_prob')} AS up, {_mean('sentiment_confidence')} AS c FROM scored GROUP BY 1, 2)"""


@query(f"WITH {_INPUT} SELECT date, ticker, {_six('s')} AS sentiment_score, {_six('greatest(pp, np, up)')} AS sentiment_confidence FROM g")
def model_features(spark, sf_dir):
    df = sentiment.by_ticker_date(scored(spark, sf_dir)).withColumns({"price_delta_24h": F.lit(0.0), "volume_delta": F.lit(0.0)})
    return rounded(signal.prepare(df), "sentiment_score", "sentiment_confidence").select("date", "ticker", "sentiment_score", "sentiment_confidence")


_REQ = "r AS (SELECT event_id, CAST((event_id * 37 % 101) AS DOUBLE) / 100.0 AS p, CAST((event_id * 13 % 201) - 100 AS DOUBLE) / 100.0 AS s, CAST((event_id * 7 % 161) - 80 AS DOUBLE) / 1000.0 AS d, CAST((event_id * 11 % 101) - 50 AS DOUBLE) / 100.0 AS v FROM events)"
_CAL = f"""{_REQ}, k AS (SELECT *, least(greatest(CAST(0.6 AS DOUBLE) * least(greatest(p, 0.18), 0.82) + CAST(0.4 AS DOUBLE) / (1 + exp(-8 * (0.35 * s + 1.5 * d))), 0.18), 0.82) AS q FROM r)"""


def _requests(spark, sf_dir):
    e = F.col("event_id")
    return adapters.table(spark, sf_dir, "events").select(
        "event_id", ((e * 37 % 101).cast("double") / 100).alias("probability_up"), (((e * 13 % 201) - 100).cast("double") / 100).alias("sentiment_score"),
        (((e * 7 % 161) - 80).cast("double") / 1000).alias("price_delta_24h"), (((e * 11 % 101) - 50).cast("double") / 100).alias("volume_delta"),
    )


@query(f"""WITH {_CAL}, c AS (SELECT *, round(q + 1e-10, 4) AS calibrated FROM k) SELECT event_id, calibrated, CASE WHEN calibrated > 0.52 THEN 'up' WHEN calibrated < 0.48 THEN 'down' ELSE 'neutral' END AS movement,
  round(least(greatest(greatest(calibrated, 1 - calibrated) + least(abs(d) * 2, 0.04) + least(CAST(0.06 AS DOUBLE) * abs(s), 0.04) + least(CAST(0.02 AS DOUBLE) * abs(v), 0.02), 0.52), 0.78) + 1e-10, 4) AS confidence FROM c""")
def signal_calibration(spark, sf_dir):
    return signal.calibrate(_requests(spark, sf_dir), sentiment_in_row=True).select("event_id", "calibrated", "movement", "confidence")


@query(f"""WITH {_REQ}, c AS (SELECT event_id, least(greatest(d, -0.08), 0.08) AS d, least(greatest(v, -0.5), 0.5) AS v, s, p FROM r)
  SELECT event_id, d AS price_delta_24h, v AS volume_delta, round(p * greatest(CAST(0 AS DOUBLE), CAST(0.5 AS DOUBLE) + s / 2) + 1e-10, 4) AS avg_positive_prob,
   round(p * greatest(CAST(0 AS DOUBLE), CAST(0.5 AS DOUBLE) - s / 2) + 1e-10, 4) AS avg_negative_prob, round(greatest(0, 1 - p) + 1e-10, 4) AS avg_neutral_prob FROM c""")
def signal_request_row(spark, sf_dir):
    df = signal.request_row(_requests(spark, sf_dir).withColumn("sentiment_confidence", F.col("probability_up")))
    return df.select("event_id", "price_delta_24h", "volume_delta", "avg_positive_prob", "avg_negative_prob", "avg_neutral_prob")


@query("""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'TSLA' WHEN 1 THEN 'toolong' WHEN 2 THEN 'AMD' WHEN 3 THEN 'X1' ELSE 'META' END AS ticker FROM events)
  SELECT CASE WHEN NOT regexp_full_match(ticker, '[A-Z]{1,5}') OR event_id % 4 = 0 THEN 'not_found' WHEN event_id % 3 = 0 THEN 'no_sentiment' ELSE 'withheld' END AS outcome, count(*) AS requests FROM t GROUP BY 1""")
def output_gate(spark, sf_dir):
    e = F.col("event_id")
    t = F.when(e % 5 == 0, "TSLA").when(e % 5 == 1, "toolong").when(e % 5 == 2, "AMD").when(e % 5 == 3, "X1").otherwise("META")
    df = adapters.table(spark, sf_dir, "events").select(signal.gate(t, e % 4 != 0, e % 3 != 0, F.lit(False)).alias("outcome"))
    return df.groupBy("outcome").agg(F.count("*").alias("requests"))


@query()
def model_train_metrics(spark, sf_dir):
    _, metrics = signal.train(spark, signal.training_data(spark))
    return spark.createDataFrame(sorted(metrics.items()), "metric string, value double")


@query()
def model_predict_batch(spark, sf_dir):
    models, _ = signal.train(spark, signal.training_data(spark), trees=20)
    bars = market.delta_series(adapters.bars(spark, sf_dir)).select("ticker", "date", (F.col("percent_change_24h") / 100).alias("price_delta_24h"), "volume_delta")
    df = sentiment.by_ticker_date(scored(spark, sf_dir)).join(bars, ["ticker", "date"], "left").fillna(0.0, ["price_delta_24h", "volume_delta"])
    return signal.batch(df, models["rf"]).select("ticker", "date", "movement", "confidence")


_JOINED = _DELTAS.removeprefix("WITH ").replace("\nd AS (", "\nmoves AS (")


@query(f"WITH {_INPUT}, {_JOINED} SELECT g.date, g.ticker, {_six('g.s')} AS sentiment_score, round(coalesce(m.pct, 0) / 100, 6) AS price_delta_24h, round(coalesce(m.vd, 0), 6) AS volume_delta, m.close IS NOT NULL AS traded FROM g LEFT JOIN moves m ON m.ticker = g.ticker AND m.date = g.date")
def feature_join(spark, sf_dir):
    """Sentiment of each ticker and day with the moves of that day's bar, zero where there is none."""
    bars = market.delta_series(adapters.bars(spark, sf_dir)).select("ticker", "date", F.col("percent_change_24h") / 100, "volume_delta", F.lit(True)).toDF("ticker", "date", "price_delta_24h", "volume_delta", "traded")
    df = sentiment.by_ticker_date(scored(spark, sf_dir)).join(bars, ["ticker", "date"], "left")
    out = rounded(signal.prepare(df.fillna(0.0, ["price_delta_24h", "volume_delta"])), "sentiment_score")
    moves = [F.round(c, 6).alias(c) for c in ("price_delta_24h", "volume_delta")]
    return out.select("date", "ticker", "sentiment_score", *moves, F.coalesce("traded", F.lit(False)).alias("traded"))


_OBS = "o AS (SELECT event_id, event_id % 2 = 0 AS fresh, event_id % 3 <> 0 AS fetched, event_id % 4 AS n, event_id % 5 = 0 AS stale, event_id % 7 AS p FROM events)"


@query(f"""WITH {_OBS} SELECT CASE WHEN fresh THEN CASE WHEN n > 0 THEN 'cached' ELSE 'unavailable' END WHEN NOT fetched AND stale THEN 'fallback' WHEN NOT fetched OR n = 0 THEN CASE WHEN p > 0 THEN 'cached' ELSE 'unavailable' END ELSE 'live' END AS status,
  CASE WHEN fresh THEN 'cache' WHEN NOT fetched AND stale THEN 'Yahoo Finance via yfinance (stale cache)' WHEN NOT fetched OR n = 0 THEN CASE WHEN p > 0 THEN 'Committed demo dataset' ELSE 'Yahoo Finance via yfinance' END ELSE 'Yahoo Finance via yfinance' END AS source, count(*) AS observations FROM o GROUP BY 1, 2""")
def provider_status(spark, sf_dir):
    e = F.col("event_id")
    args = (e % 2 == 0, e % 3 != 0, e % 4, e % 5 == 0, e % 7)
    df = adapters.table(spark, sf_dir, "events").select(serving.provider_state(*args).alias("status"), serving.provider_source(*args).alias("source"))
    return df.groupBy("status", "source").agg(F.count("*").alias("observations"))


def _kinds(spark, sf_dir):
    return valid_posts(spark, sf_dir).withColumn("kind", post_ops.content_type(F.col("content_type"), F.col("source")))


_KIND = f"""CASE WHEN lower(coalesce(content_type, '')) IN ('social_post', 'publisher_headline') THEN lower(content_type) WHEN lower(coalesce(content_type, '')) = 'news_headline' THEN 'publisher_headline'
  WHEN {' OR '.join(f"contains(lower(source), '{s}')" for s in fixed.SOCIAL_SOURCES)} THEN 'social_post' ELSE 'publisher_headline' END"""
_SOCIAL = f"k AS (SELECT ticker, count(*) FILTER ({_KIND} = 'social_post') AS social, count(*) FILTER ({_KIND} <> 'social_post') AS publisher FROM scored GROUP BY ticker)"


@query(f"""WITH {_SCORED}, {_SOCIAL} SELECT ticker, social, publisher, CASE WHEN social = 0 THEN 'cached' WHEN publisher > 0 THEN 'partial' ELSE 'ready' END AS status,
  CASE WHEN social = 0 THEN 'Publisher headlines' WHEN publisher > 0 THEN 'Social posts and publisher headlines' ELSE 'Social posts' END AS source, true AS available, social + publisher AS count FROM k""")
def social_availability(spark, sf_dir):
    return serving.social_status(_kinds(spark, sf_dir))


_BARS_PART = _DELTAS.removeprefix("WITH ").replace("\nd AS (", "\nmoves AS (")


@query(f"""WITH {_SCORED}, {_SOCIAL}, {_BARS_PART}, t AS (SELECT ticker, {_mean('sentiment_score')} AS s FROM scored GROUP BY ticker)
  SELECT d.ticker, round(close, 4) AS price, {_six('t.s')} AS sentiment_score, least(32, (SELECT count(*) FROM bars b WHERE b.ticker = d.ticker)) AS history_points, CAST(6 AS BIGINT) AS headline_count, k.social + k.publisher AS posts,
  'Market snapshot is available from bars. Volume delta ' || printf('%+.1f', vd * 100) || '%.' AS market_message FROM moves d JOIN t USING (ticker) JOIN k USING (ticker) WHERE back = 1""")
def dashboard_summary(spark, sf_dir):
    bars = adapters.bars(spark, sf_dir)
    overall = sentiment.overall(scored(spark, sf_dir), "ticker").select("ticker", "sentiment_score", "sentiment_label")
    snap = market.snapshot(bars).withColumn("message", serving.market_message(F.col("price"), F.col("status"), F.lit("bars"), F.col("volume_delta"))).drop("status")
    social = serving.social_status(_kinds(spark, sf_dir)).select("ticker", (F.col("social") + F.col("publisher")).alias("posts"))
    rows = serving.dashboard(overall, snap, market.history(bars), post_ops.top_headlines(adapters.posts(spark, sf_dir), 6), social)
    return rows.select(
        "ticker", F.round("price", 4).alias("price"), (F.round(F.col("sentiment_score") + 1e-10, 6) + 0.0).alias("sentiment_score"), F.size("history").cast("bigint").alias("history_points"),
        F.size("headlines").cast("bigint").alias("headline_count"), "posts", F.col("message").alias("market_message"),
    )


_RUNS = "runs AS (SELECT event_id AS run_id, ['TSLA','NVDA','AMD','AAPL','META'][CAST(user_id % 5 AS INTEGER) + 1] AS ticker, CAST(floor(epoch(ts)) AS BIGINT) AS started, event_id % 10 <> 0 AS ok, event_id % 9 = 0 AS degraded, value FROM events)"


def _runs(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    return e.select(F.col("event_id").alias("run_id"), adapters.pick(fixed.TICKERS, F.col("user_id") % 5).alias("ticker"), at.alias("started_at"), at.alias("finished_at"), (F.col("event_id") % 10 != 0).alias("ok"), (F.col("event_id") % 9 == 0).alias("degraded"), "value")


@query(f"WITH {_RUNS}, g AS (SELECT ticker, started - lag(started) OVER (PARTITION BY ticker ORDER BY started, run_id) AS gap FROM runs) SELECT ticker, CAST(max(gap) AS BIGINT) AS longest_gap_s, count(*) FILTER (gap > 7200) AS long_gaps FROM g GROUP BY ticker")
def run_gaps(spark, sf_dir):
    return serving.run_gaps(_runs(spark, sf_dir).withColumn("started_at", F.date_trunc("second", "started_at")))


@query(f"WITH {_RUNS}, l AS (SELECT ticker, max(started) AS last FROM runs WHERE ok GROUP BY ticker), n AS (SELECT max(started) AS now FROM runs) SELECT ticker, (SELECT now FROM n) - last > 3600 AS stale FROM l")
def status_freshness(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    dated = runs.join(F.broadcast(runs.agg(F.max("started_at").alias("now"))))  # one row
    return serving.freshness(dated, F.col("now")).select("ticker", "stale")


@query(f"WITH {_RUNS} SELECT ticker, round(quantile_cont(value, 0.95), 6) AS p95 FROM runs GROUP BY ticker")
def latency_p95(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("ticker").agg(F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query(f"""WITH {_RUNS}, p AS (SELECT event_id % 3 = 0 AS found, event_id % 3 = 0 OR event_id % 12 = 1 AS truth FROM events),
  m AS (SELECT 'dedup_precision' AS gate, CAST(count(*) FILTER (found AND truth) AS DOUBLE) / count(*) FILTER (found) AS value FROM p UNION ALL
        SELECT 'dedup_recall', CAST(count(*) FILTER (found AND truth) AS DOUBLE) / count(*) FILTER (truth) FROM p UNION ALL
        SELECT 'run_success', CAST(count(*) FILTER (ok) AS DOUBLE) / count(*) FROM runs UNION ALL SELECT 'degraded_rate', CAST(count(*) FILTER (degraded) AS DOUBLE) / count(*) FROM runs)
  SELECT gate, round(value, 6) AS value, CASE gate WHEN 'dedup_precision' THEN value >= 0.85 WHEN 'dedup_recall' THEN value >= 0.75 WHEN 'run_success' THEN value >= 0.95 ELSE value <= 0.15 END AS passed FROM m""")
def scorecard_gates(spark, sf_dir):
    e = F.col("event_id")
    pairs = adapters.table(spark, sf_dir, "events").select((e % 3 == 0).alias("found"), ((e % 3 == 0) | (e % 12 == 1)).alias("truth"))
    return serving.score_gates(pairs, _runs(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily_totals(spark, sf_dir):
    return streams.daily_totals(spark, sf_dir)


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def stream_dedupe(spark, sf_dir):
    return streams.first_of_keys(spark, sf_dir)


@query("SELECT event_id, event_type, value FROM events")
def stream_replay(spark, sf_dir):
    return streams.replayed(spark, sf_dir)


@query(f"WITH {POSTS_SQL} SELECT version, ticker, date, count(*) AS posts, CAST(sum(CAST(post_score AS DECIMAL(18, 4))) AS DOUBLE) AS total FROM posts, (VALUES (1), (2)) versions(version) GROUP BY 1, 2, 3")
def stream_replay_days(spark, sf_dir):
    """Partitions by version, ticker and day, each derived from the raw events as often as a batch touches it, under two versions."""
    return streams.replayed_days(spark, sf_dir)
