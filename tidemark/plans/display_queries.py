"""Queries of display rows, configuration checks and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display, fixed
from ..sources import adapters
from .registry import query


@query("""SELECT o_orderpriority, CASE WHEN sum(o_totalprice) >= 1e9 THEN printf('$%.1fB', sum(o_totalprice) / 1e9) WHEN sum(o_totalprice) >= 1e6 THEN printf('$%.1fM', sum(o_totalprice) / 1e6)
  WHEN sum(o_totalprice) >= 1e3 THEN printf('$%.1fK', sum(o_totalprice) / 1e3) ELSE printf('$%.2f', sum(o_totalprice)) END AS total FROM orders GROUP BY 1""")
def ui_money(spark, sf_dir):
    o = adapters.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("s"))
    return o.select("o_orderpriority", display.money(F.col("s")).alias("total"))


@query("""SELECT p_partkey, 'size' AS metric, CAST(p_size AS DOUBLE) AS value FROM part WHERE p_size % 5 <> 0 UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part WHERE p_partkey % 3 <> 0""")
def ui_metrics(spark, sf_dir):
    p = adapters.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("size"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("price"))
    return display.metrics(p, "p_partkey", ("size", "price"))


@query("""WITH s AS (SELECT CASE event_id % 5 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'fallback' WHEN 2 THEN 'cached' WHEN 3 THEN 'live' ELSE 'partial' END AS status FROM events)
  SELECT status, CASE WHEN status = 'unavailable' THEN 'error' WHEN status IN ('fallback', 'partial') THEN 'warning' WHEN status = 'cached' THEN 'info' END AS alert, count(*) AS sections FROM s GROUP BY 1, 2""")
def ui_alerts(spark, sf_dir):
    k = F.col("event_id") % 5
    s = adapters.table(spark, sf_dir, "events").select(F.when(k == 0, "unavailable").when(k == 1, "fallback").when(k == 2, "cached").when(k == 3, "live").otherwise("partial").alias("status"))
    return s.groupBy("status").agg(F.count("*").alias("sections")).select("status", display.alert(F.col("status")).alias("alert"), "sections")


@query("SELECT CAST(NULL AS VARCHAR) AS ticker, CAST(NULL AS VARCHAR) AS problem WHERE false")
def config_violations(spark, sf_dir):
    """Problems of the alias and rule tables: repeated tickers, wrong cashtags, contextual aliases without context, unknown categories."""
    rows = spark.createDataFrame([(a.ticker, a.cashtag, list(a.contextual), list(a.context)) for a in fixed.ALIASES], "ticker string, cashtag string, contextual array<string>, context array<string>")
    repeated = rows.groupBy("ticker").count().where("count > 1").select("ticker", F.lit("repeated").alias("problem"))
    cash = rows.where(F.col("cashtag") != F.concat(F.lit("$"), "ticker")).select("ticker", F.lit("cashtag"))
    bare = rows.where((F.size("contextual") > 0) & (F.size("context") == 0)).select("ticker", F.lit("context"))
    rules = spark.createDataFrame([(c,) for c, _, _ in fixed.RULES], "category string").where(~F.col("category").isin(*fixed.CATEGORIES)).select("category", F.lit("category"))
    return repeated.union(cash).union(bare).union(rules)


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 20 OFFSET 40")
def paged_events(spark, sf_dir):
    """Page three, twenty rows a page: the limit is what a page is."""
    return adapters.table(spark, sf_dir, "events").select("event_id", "event_type").orderBy("event_id").offset(40).limit(20)


@query("""SELECT c_nationkey % 5 AS book, count(*) AS positions, round(sum(c_acctbal), 2) AS value, round(sum(CASE WHEN c_acctbal < 0 THEN c_acctbal ELSE 0 END), 2) AS losses FROM customer GROUP BY 1""")
def portfolio(spark, sf_dir):
    c = adapters.table(spark, sf_dir, "customer")
    return c.groupBy((F.col("c_nationkey") % 5).alias("book")).agg(F.count("*").alias("positions"), F.round(F.sum("c_acctbal"), 2).alias("value"), F.round(F.sum(F.when(F.col("c_acctbal") < 0, F.col("c_acctbal")).otherwise(0.0)), 2).alias("losses"))


@query("""WITH y AS (SELECT CAST(ts AS TIMESTAMP) AS at_, make_date(year(ts), 3, 1) AS march, make_date(year(ts), 11, 1) AS november FROM events),
  d AS (SELECT at_, march + CAST(7 + (7 - dayofweek(march)) % 7 AS INTEGER) AS first, november + CAST((7 - dayofweek(november)) % 7 AS INTEGER) AS last FROM y)
  SELECT CAST(CAST(at_ - CASE WHEN at_ >= first + INTERVAL 7 HOUR AND at_ < last + INTERVAL 6 HOUR THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS DATE) AS VARCHAR) AS day, count(*) AS events FROM d GROUP BY 1""")
def trading_days(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events")
    return e.groupBy(display.trading_day(F.col("ts").cast("timestamp")).cast("string").alias("day")).agg(F.count("*").alias("events"))
