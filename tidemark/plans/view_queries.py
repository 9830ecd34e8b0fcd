"""Queries of the reading views, the whole scorecard, gaps in market hours and feed problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import citations, serving, stories, views
from ..sources import adapters
from .registry import query
from .serving_queries import _RUNS, _runs
from .story_queries import _STORIES, _themes

_MEASURED = """m AS (SELECT 'G1_theme_agreement' AS gate, avg(quality) AS value FROM labels UNION ALL SELECT 'G2_faithfulness', 1 - avg(toxic) FROM labels UNION ALL SELECT 'G3_banned_language', CAST(sum(toxic) AS DOUBLE) FROM labels
  UNION ALL SELECT 'G5_run_success', avg(CAST(event_type <> 'error' AS INTEGER)) FROM events UNION ALL SELECT 'G7_degraded_rate', avg(CAST(value < 10 AS INTEGER)) FROM events UNION ALL SELECT 'G6_freshness_p95_minutes', quantile_cont(value, 0.95) FROM events)"""


@query(f"""WITH {_MEASURED}, g(gate, side, bound) AS (VALUES {', '.join(map(repr, views.GATES))})
  SELECT gate, round(value, 6) AS value, CASE side WHEN 'least' THEN value >= bound ELSE value <= bound END AS passed FROM g LEFT JOIN m USING (gate)""")
def scorecard(spark, sf_dir):
    """All gates; those that these tables can't measure stay open."""
    labels, events = adapters.table(spark, sf_dir, "labels"), adapters.table(spark, sf_dir, "events")
    named = lambda df, gate, value: df.agg(F.lit(gate).alias("gate"), value.cast("double").alias("value"))
    values = named(labels, "G1_theme_agreement", F.avg("quality"))
    for df, gate, value in (
        (labels, "G2_faithfulness", 1 - F.avg("toxic")), (labels, "G3_banned_language", F.sum("toxic")), (events, "G5_run_success", F.avg((F.col("event_type") != "error").cast("int"))),
        (events, "G7_degraded_rate", F.avg((F.col("value") < 10).cast("int"))), (events, "G6_freshness_p95_minutes", F.percentile("value", 0.95)),
    ):
        values = values.union(named(df, gate, value))
    return views.scorecard(values).withColumn("value", F.round("value", 6))


_LOCAL = """l AS (SELECT *, to_timestamp(started) AT TIME ZONE 'UTC' AS utc FROM runs),
  o AS (SELECT *, utc - CASE WHEN utc >= make_date(year(utc), 3, 1) + CAST(7 + (7 - dayofweek(make_date(year(utc), 3, 1))) % 7 AS INTEGER) + INTERVAL 7 HOUR
    AND utc < make_date(year(utc), 11, 1) + CAST((7 - dayofweek(make_date(year(utc), 11, 1))) % 7 AS INTEGER) + INTERVAL 6 HOUR THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS ny FROM l)"""


@query(f"""WITH {_RUNS.replace("CAST(floor(epoch(ts)) AS BIGINT) AS started", "CAST(ts AS TIMESTAMP) AS utc, CAST(floor(epoch(ts)) AS BIGINT) AS started")}, {_LOCAL.replace("l AS (SELECT *, to_timestamp(started) AT TIME ZONE 'UTC' AS utc FROM runs),", "").replace("FROM l)", "FROM runs)")},
  g AS (SELECT ticker, started - lag(started) OVER (PARTITION BY ticker, CAST(ny AS DATE) ORDER BY utc, run_id) AS gap FROM o WHERE dayofweek(ny) BETWEEN 1 AND 5 AND hour(ny) * 60 + minute(ny) BETWEEN 570 AND 959)
  SELECT ticker, CAST(max(gap) AS BIGINT) AS longest_gap_s, count(*) FILTER (gap > 7200) AS long_gaps FROM g GROUP BY ticker""")
def run_gaps_market_hours(spark, sf_dir):
    return views.market_gaps(_runs(spark, sf_dir))


@query("""WITH f AS (SELECT page_id // 2 AS id, url, page_id % 11 = 0 AS bare, page_id % 13 = 0 AS short FROM pages)
  SELECT id, 'repeated' AS problem FROM f GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT id, 'not_https' FROM f WHERE NOT starts_with(url, 'https://')
  UNION ALL SELECT DISTINCT id, 'no_role' FROM f WHERE bare UNION ALL SELECT DISTINCT id, 'missing_fields' FROM f WHERE short""")
def feed_problems(spark, sf_dir):
    k = F.col("page_id")
    fields = F.array(*map(F.lit, views.FEED_FIELDS))
    feeds = adapters.table(spark, sf_dir, "pages").select(F.expr("page_id div 2").alias("id"), "url", F.when(k % 11 == 0, " ").otherwise("news").alias("intended_role"), F.when(k % 13 == 0, F.slice(fields, 1, 2)).otherwise(fields).alias("fields"))
    return views.feed_problems(feeds)


@query(f"""WITH {_RUNS}, {_STORIES}, l AS (SELECT ticker, max(started) AS last FROM runs WHERE ok GROUP BY ticker), n AS (SELECT max(started) AS now FROM runs),
  t AS (SELECT ticker, story_id // 50 AS theme_id, max(published) // 86400 AS day FROM s GROUP BY 1, 2), c AS (SELECT ticker, count(*) AS themes FROM t WHERE day = (SELECT max(day) FROM t) GROUP BY 1)
  SELECT l.ticker, (SELECT now FROM n) - last > 3600 AS stale, coalesce(themes, 0) AS themes FROM l LEFT JOIN c USING (ticker)""")
def tickers_view(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    dated = runs.join(F.broadcast(runs.agg(F.max("started_at").alias("now"))))  # one row
    fresh = serving.freshness(dated, F.col("now"))
    s = adapters.stories(spark, sf_dir).withColumn("theme_id", F.expr("story_id div 50"))
    themes = s.groupBy("ticker", "theme_id").agg(F.to_date(F.max("published_at")).alias("day"))
    themes = themes.join(F.broadcast(themes.agg(F.max("day").alias("today"))))  # one row
    return views.tickers_view(fresh, themes, F.col("today"))


@query("""WITH r AS (SELECT doc_id // 5 AS theme_id, doc_id, row_number() OVER (PARTITION BY doc_id // 5 ORDER BY doc_id) AS k, max(doc_id) OVER (PARTITION BY doc_id // 5) AS latest, count(*) OVER (PARTITION BY doc_id // 5) AS n, count(DISTINCT source) OVER (PARTITION BY doc_id // 5) AS outlets FROM documents),
  t AS (SELECT theme_id, n + 2 * outlets - (max(latest) OVER () - latest) * 600 / 3600.0 / 10 AS salience, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (k <= 4) AS ids FROM r GROUP BY theme_id, n, outlets, latest)
  SELECT theme_id, CAST(row_number() OVER (ORDER BY round(CAST(salience AS DOUBLE), 9) DESC, theme_id) AS INTEGER) AS salience_rank, CASE WHEN theme_id IN (SELECT theme_id FROM r WHERE n = 1) THEN ids || ',' || ids ELSE ids END AS cited, false AS degraded FROM t""")
def themes_view(spark, sf_dir):
    t = _themes(spark, sf_dir)
    s = adapters.stories(spark, sf_dir).withColumn("theme_id", F.expr("story_id div 5"))
    sizes = s.groupBy("theme_id").agg(F.count("*").alias("stories"), F.count_distinct("outlet").alias("outlets"), F.max("published_at").alias("latest")).withColumn("ticker", F.lit("TSLA"))
    ranked = stories.salience(sizes.withColumn("theme_id", F.col("theme_id"))).select("theme_id", "salience_rank")
    out = views.themes_view(ranked, citations.resolved(citations.summarize(t)))
    return out.select("theme_id", "salience_rank", F.array_join(F.transform("citations", lambda c: c["id"]), ",").alias("cited"), "degraded")
