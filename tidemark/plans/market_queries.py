"""Queries on bars: snapshots, deltas, history, indicators, joins of posts with bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import market
from ..sources import adapters
from ..sources.adapters import BARS_SQL, POSTS_SQL
from .registry import query
from .text_queries import rounded

_DELTAS = f"""WITH {BARS_SQL},
w AS (SELECT *, coalesce(lag(close) OVER t, close) AS prev, coalesce(avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), CAST(volume AS DOUBLE)) AS mean,
       row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM bars WINDOW t AS (PARTITION BY ticker ORDER BY date)),
d AS (SELECT *, close - prev AS delta, CASE WHEN prev <> 0 THEN (close - prev) / prev * 100 ELSE 0 END AS pct, CASE WHEN mean <> 0 THEN (volume - mean) / mean ELSE 0 END AS vd FROM w)"""
_SERIES = ("price_delta_24h", "percent_change_24h", "volume_delta")
_NUMBERS = "round(delta, 6) AS price_delta_24h, round(pct, 6) AS percent_change_24h, round(vd, 6) AS volume_delta"


@query(f"{_DELTAS} SELECT ticker, date, round(close, 6) AS price, round(high, 6) AS day_high, volume, {_NUMBERS}, CASE WHEN close > 0 THEN 'live' ELSE 'unavailable' END AS status FROM d WHERE back = 1")
def market_snapshot(spark, sf_dir):
    return rounded(market.snapshot(adapters.bars(spark, sf_dir)), "price", "day_high", "price_delta_24h", "percent_change_24h", "volume_delta")


@query(f"{_DELTAS} SELECT ticker, date, {_NUMBERS} FROM d")
def market_delta_series(spark, sf_dir):
    df = market.delta_series(adapters.bars(spark, sf_dir))
    # as the SQL rounds: the product in floating point, ties away from zero
    return df.select("ticker", "date", *[(F.round(F.col(c) * 1e6) / 1e6).alias(c) for c in _SERIES])


@query(f"{_DELTAS} SELECT ticker, date, round(close, 2) AS close, volume, CAST(back AS INTEGER) AS back FROM d WHERE back <= 32")
def market_history32(spark, sf_dir):
    return market.history(adapters.bars(spark, sf_dir))


@query(f"""WITH {BARS_SQL}, p AS (SELECT ticker, arg_min(close, date) AS f, arg_max(close, date) AS l, min(close) AS lo, max(close) AS hi FROM bars GROUP BY ticker)
  SELECT ticker, round(f, 6) AS first_close, round(l, 6) AS last_close, round(lo, 6) AS low, round(hi, 6) AS high, round(CASE WHEN f <> 0 THEN (l - f) / f * 100 ELSE 0 END, 6) AS change_pct,
  round(CASE WHEN hi > lo THEN hi - lo ELSE greatest(hi * 0.01, 1) END, 6) AS span, CASE WHEN l >= f THEN 'up' ELSE 'down' END AS tone FROM p""")
def period_change(spark, sf_dir):
    return rounded(market.period_change(adapters.bars(spark, sf_dir)), "first_close", "last_close", "low", "high", "change_pct", "span")


@query(f"WITH {POSTS_SQL} SELECT ticker, event_id, date FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC, event_id) AS r FROM posts) WHERE r = 1")
def latest_record(spark, sf_dir):
    return market.latest(adapters.posts(spark, sf_dir), F.col("event_id")).select("ticker", "event_id", "date")


@query(f"WITH {POSTS_SQL} SELECT ticker, min(event_id) AS event_id, arg_min(date, event_id) AS date FROM posts GROUP BY ticker")
def first_record(spark, sf_dir):
    return adapters.posts(spark, sf_dir).groupBy("ticker").agg(F.min("event_id").alias("event_id"), F.min_by("date", "event_id").alias("date"))


_PAYLOAD = """s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN 'n/a' END AS p1, CASE event_id % 3 WHEN 0 THEN CAST(value / 2 AS VARCHAR) WHEN 1 THEN '' END AS p2,
  CASE event_id % 2 WHEN 0 THEN CAST(value / 100 AS VARCHAR) END AS d1, CASE event_id % 5 WHEN 0 THEN CAST(value / 50 AS VARCHAR) WHEN 1 THEN 'bad' END AS d2 FROM events)"""


def _payload(spark, sf_dir):
    e, v = F.col("event_id"), F.col("value")
    return adapters.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(e % 4 == 0, v.cast("string")).when(e % 4 == 1, "n/a").alias("p1"), F.when(e % 3 == 0, (v / 2).cast("string")).when(e % 3 == 1, "").alias("p2"),
        F.when(e % 2 == 0, (v / 100).cast("string")).alias("d1"), F.when(e % 5 == 0, (v / 50).cast("string")).when(e % 5 == 1, "bad").alias("d2"),
    )


@query(f"WITH {_PAYLOAD} SELECT event_id, round(coalesce(try_cast(p1 AS DOUBLE) / 100, try_cast(p2 AS DOUBLE) / 100, try_cast(d1 AS DOUBLE), try_cast(d2 AS DOUBLE), 0), 6) AS delta FROM s")
def price_delta_fallback(spark, sf_dir):
    df = _payload(spark, sf_dir)
    return df.select("event_id", F.round(market.fractional_delta([F.col("p1"), F.col("p2")], [F.col("d1"), F.col("d2")]), 6).alias("delta"))


@query(f"WITH {_PAYLOAD} SELECT event_id, round(coalesce(try_cast(p1 AS DOUBLE), try_cast(d1 AS DOUBLE), try_cast(p2 AS DOUBLE), try_cast(d2 AS DOUBLE)), 6) AS market_cap FROM s")
def fundamentals_first_number(spark, sf_dir):
    df = _payload(spark, sf_dir)
    return df.select("event_id", F.round(market.first_number([[F.col("p1"), F.col("d1")], [F.col("p2"), F.col("d2")]]), 6).alias("market_cap"))


@query(f"""WITH {_PAYLOAD}, n AS (SELECT event_id, coalesce(try_cast(p1 AS DOUBLE), 0) AS price, try_cast(p2 AS DOUBLE) AS h, d1, d2 FROM s)
  SELECT event_id, round(price, 6) AS price, round(CASE WHEN h IS NULL OR h = 0 THEN price ELSE h END, 6) AS day_high, CASE WHEN price > 0 THEN 'cached' ELSE 'unavailable' END AS status,
  CASE WHEN price > 0 THEN 'Pipeline market snapshot' ELSE 'unavailable' END AS source, round(try_cast(d1 AS DOUBLE), 6) AS price_delta_24h, round(try_cast(d2 AS DOUBLE), 6) AS volume_delta FROM n""")
def snapshot_defaults(spark, sf_dir):
    df = _payload(spark, sf_dir).select("event_id", F.col("p1").alias("price"), F.col("p2").alias("day_high"), F.lit(None).cast("string").alias("volume"), F.lit("").alias("status"), F.lit(None).cast("string").alias("source"), F.col("d1").alias("price_delta_24h"), F.lit(None).cast("string").alias("percent_change_24h"), F.col("d2").alias("volume_delta"))
    out = rounded(market.normalized_snapshot(df), "price", "day_high", "price_delta_24h", "volume_delta")
    return out.select("event_id", "price", "day_high", "status", "source", "price_delta_24h", "volume_delta")


@query(f"""WITH {BARS_SQL}, m AS (SELECT *, close - lag(close) OVER (PARTITION BY ticker ORDER BY date) AS mv FROM bars), g AS (SELECT *, greatest(mv, 0) AS up, greatest(-mv, 0) AS dn FROM m),
  i AS (SELECT ticker, date, avg(close) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s, avg(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l,
    stddev_pop(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sd, avg(CASE WHEN mv IS NULL THEN 0 ELSE up END) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS u,
    avg(CASE WHEN mv IS NULL THEN 0 ELSE dn END) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS d FROM g WINDOW w AS (PARTITION BY ticker ORDER BY date))
  SELECT ticker, date, round(s, 3) AS sma_short, round(l, 3) AS sma_long, round(l + 2 * sd, 3) AS band_high, round(l - 2 * sd, 3) AS band_low, round(CASE WHEN u + d > 0 THEN 100 * u / (u + d) ELSE 50 END, 3) AS strength FROM i""")
def indicators(spark, sf_dir):
    df = market.indicators(adapters.bars(spark, sf_dir))
    return df.withColumns({c: F.round(c, 3) for c in ("sma_short", "sma_long", "band_high", "band_low", "strength")})


@query(f"""WITH {POSTS_SQL}, {BARS_SQL} SELECT p.event_id, p.ticker, p.date, b.date AS bar_date, round(b.close, 6) AS bar_close
  FROM posts p ASOF LEFT JOIN bars b ON p.ticker = b.ticker AND p.date >= b.date""")
def posts_as_of_bars(spark, sf_dir):
    out = market.as_of(adapters.posts(spark, sf_dir), adapters.bars(spark, sf_dir))
    return out.select("event_id", "ticker", "date", "bar_date", F.round("bar_close", 6).alias("bar_close"))


@query(f"WITH {BARS_SQL} SELECT ticker, substr(date, 1, 7) AS month, round(arg_min(close, date), 6) AS open, round(max(high), 6) AS high, round(min(close), 6) AS low, round(arg_max(close, date), 6) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY 1, 2")
def monthly_bars(spark, sf_dir):
    b = adapters.bars(spark, sf_dir)
    out = b.groupBy("ticker", F.substring("date", 1, 7).alias("month")).agg(F.min_by("close", "date").alias("open"), F.max("high").alias("high"), F.min("close").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"))
    return rounded(out, "open", "high", "low", "close")


@query(f"WITH {BARS_SQL} SELECT ticker, date, round(close, 6) AS close, volume FROM bars WHERE date BETWEEN '1994-01-01' AND '1996-12-31'")
def bars_in_range(spark, sf_dir):
    """The bars of a range of dates, which is what is asked for."""
    b = adapters.bars(spark, sf_dir).where(F.col("date").between("1994-01-01", "1996-12-31"))
    return b.select("ticker", "date", F.round("close", 6).alias("close"), "volume")


@query(f"""WITH RECURSIVE {BARS_SQL}, b AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM bars),
  t AS (SELECT ticker, date, n, close, close AS a, close AS b, CAST(0 AS DOUBLE) AS g, CAST(0 AS DOUBLE) AS u, CAST(0 AS DOUBLE) AS d FROM b WHERE n = 1 UNION ALL
    SELECT ticker, date, n, close, a, b, g + CAST(2 AS DOUBLE) / 10 * (a - b - g), u, d FROM (
      SELECT x.ticker, x.date, x.n, x.close, t.a + CAST(2 AS DOUBLE) / 13 * (x.close - t.a) AS a, t.b + CAST(2 AS DOUBLE) / 27 * (x.close - t.b) AS b, t.g,
        t.u + (greatest(x.close - t.close, 0) - t.u) / 14 AS u, t.d + (greatest(t.close - x.close, 0) - t.d) / 14 AS d FROM t JOIN b x ON x.ticker = t.ticker AND x.n = t.n + 1))
  SELECT ticker, date, round(a, 6) AS ema_short, round(b, 6) AS ema_long, round(a - b, 6) + 0.0 AS macd, round(g, 6) + 0.0 AS macd_signal, round(CASE WHEN u + d > 0 THEN 100 * u / (u + d) ELSE 50 END, 6) AS wilder_strength FROM t""")
def trend_indicators(spark, sf_dir):
    out = market.trend(adapters.bars(spark, sf_dir))
    names = ("ema_short", "ema_long", "macd", "macd_signal", "wilder_strength")
    return out.select("ticker", "date", *[(F.round(c, 6) + 0.0).alias(c) for c in names])
