"""Queries on rule and vector indexes, landed feeds, sections of the dashboard, SQL table functions and the life of a model."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from ..functions import display, fixed
from ..functions.text import sign_counts
from ..operators import artifacts, market, matching, posts as post_ops, providers, rule_index, sentiment, serving, signal, vector_index
from ..operators.stories import _stored, shared_checkpoints
from ..sources import adapters, readers
from ..sources.adapters import POSTS_SQL
from ..streaming import streams
from .market_queries import _DELTAS
from .registry import query
from .serving_queries import _SOCIAL, _kinds
from .text_queries import _SCORED, _categories_sql, _mean, _six, rounded, scored

_PICK = "['TSLA','NVDA','AMD','AAPL','META']"
_MOVES = _DELTAS.removeprefix("WITH ").replace("\nd AS (", "\nmoves AS (")


@query(f"WITH {POSTS_SQL} SELECT event_id, {_categories_sql()} AS categories FROM posts")
def rule_index_lint(spark, sf_dir):
    """The copy rules on all posts: phrases through the index, over different texts; regular expressions in columns."""
    posts = adapters.posts(spark, sf_dir).select("event_id", "text")
    texts = posts.groupBy("text").agg(F.min("event_id").alias("id"))
    literal = [(k, p) for k, (_, kind, p) in enumerate(fixed.RULES) if kind == "literal"]
    names = spark.createDataFrame([(k, c) for k, (c, _, _) in enumerate(fixed.RULES)], "rule int, category string")
    hits = rule_index.phrase_hits(texts, spark.createDataFrame(literal, "rule int, phrase string")).join(names, "rule")
    own = hits.groupBy("id").agg(F.collect_set("category").alias("found"))
    coded = matching.categories(F.col("text"), tuple(r for r in fixed.RULES if r[1] == "regex"))
    broken = F.array_sort(F.array_union(coded, F.coalesce("found", F.array().cast("array<string>"))))
    linted = texts.join(own, "id", "left").select("text", F.array_join(broken, ",").alias("categories"))
    return posts.join(linted, posts["text"].eqNullSafe(linted["text"])).select("event_id", "categories")


@query(r"""WITH names AS (SELECT DISTINCT lower(source) AS phrase FROM documents WHERE source IS NOT NULL UNION SELECT DISTINCT lower(p_name) FROM part UNION SELECT DISTINCT lower(regexp_extract(text, '([A-Za-z]+ [A-Za-z]+)', 1)) FROM benchmark),
  n AS (SELECT phrase FROM names WHERE regexp_matches(phrase, '^[a-z0-9]+( [a-z0-9]+)*$')),
  w AS (SELECT doc_id, ' ' || regexp_replace(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9 ]', '|', 'g'), '[|]', ' | ', 'g') || ' ' AS t FROM documents)
  SELECT doc_id, phrase FROM w JOIN n ON contains(t, ' ' || phrase || ' ')""")
def document_phrases(spark, sf_dir):
    """Phrases of three tables (sources, parts, beginnings of benchmark items) in all documents."""
    d, p, b = (adapters.table(spark, sf_dir, n) for n in ("documents", "part", "benchmark"))
    phrases = d.select(F.lower("source").alias("phrase")).union(p.select(F.lower("p_name"))).union(b.select(F.lower(F.regexp_extract("text", "([A-Za-z]+ [A-Za-z]+)", 1)))).distinct()
    phrases = phrases.where(F.col("phrase").rlike("^[a-z0-9]+( [a-z0-9]+)*$"))
    hits = rule_index.phrase_hits(d.select(F.col("doc_id").alias("id"), "text"), phrases.select(F.col("phrase").alias("rule"), "phrase"))
    return hits.select(F.col("id").alias("doc_id"), F.col("rule").alias("phrase"))


_DOT = "list_sum(list_transform(list_zip(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), lambda z: z[1] * z[2]))"


@query(f"SELECT x.vec_id AS query, y.vec_id AS id, round({_DOT}, 6) AS similarity FROM embeddings x JOIN embeddings y ON x.vec_id % 20 = 0 AND x.vec_id <> y.vec_id AND {_DOT} >= 0.3")
def vector_search(spark, sf_dir):
    """Every vector whose id is divisible by 20 against all vectors, exactly: cells are left out by their angle alone."""
    e = adapters.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vector_index.search(e, e.where("id % 20 = 0"), 0.3).withColumn("similarity", F.round("similarity", 6))


#: Pages of one feed file.
_FEED = 25


def _land_feeds(spark, sf_dir, root):
    """Pages as RSS files of ``_FEED`` items below their source; a file that begins with a page of a mobile host is cut off in the middle."""
    p = adapters.table(spark, sf_dir, "pages")
    esc = lambda c: F.regexp_replace(F.regexp_replace(c, "&(?!amp;|lt;|gt;)", "&amp;"), "<", "&lt;")
    at = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 3600), "EEE, dd MMM yyyy HH:mm:ss")
    item = F.concat(F.lit("<item><title> "), esc(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit(" </title><link>"), esc(F.col("url")), F.lit("</link><pubDate>"), at, F.lit(" GMT</pubDate></item>"))
    rows = p.select(F.when(F.col("page_id") % 2 == 0, "wire").otherwise("desk").alias("source"), F.expr(f"page_id div {2 * _FEED}").alias("feed"), "page_id", F.regexp_extract("url", "://([^/]*)", 1).alias("host"), item.alias("item"))
    feeds = rows.groupBy("source", "feed").agg(F.array_sort(F.collect_list(F.struct("page_id", "item", "host"))).alias("i"))
    text = F.concat(F.lit("<rss><channel><title>feed</title>"), F.array_join(F.transform("i", lambda x: x["item"]), ""), F.lit("</channel></rss>"))
    text = F.when(F.get("i", F.lit(0))["host"].startswith("m."), F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))).otherwise(text)
    # one file a feed, as a fetcher writes them
    feeds.select("source", "feed", text.alias("value")).repartition("source", "feed").write.partitionBy("source", "feed").text(root)


_FEEDS = f"""f AS (SELECT *, CASE WHEN page_id % 2 = 0 THEN 'wire' ELSE 'desk' END AS source, page_id // {2 * _FEED} AS feed, regexp_extract(url, '://([^/]*)', 1) AS host FROM pages),
 b AS (SELECT source, feed, starts_with(arg_min(host, page_id), 'm.') AS broken FROM f GROUP BY 1, 2)"""


@query(f"WITH {_FEEDS} SELECT source, strftime(make_timestamp((1700000000 + page_id * 3600) * 1000000), '%Y-%m-%d %H:%M') AS published_at, count(*) AS items FROM f JOIN b USING (source, feed) WHERE NOT broken GROUP BY 1, 2")
def feed_stream(spark, sf_dir):
    """Items of landed feeds as a stream; a broken file loses none of another's."""
    root, out = streams.folder(spark, "feeds-in"), streams.folder(spark, "feeds-out")
    _land_feeds(spark, sf_dir, root)
    found = readers.feed_rows(readers.parsed_feeds(readers.feed_files(spark, root, stream=True)))
    streams.run(found.writeStream.format("parquet").option("path", out), spark, "feeds")
    rows = spark.read.schema(found.schema).parquet(out)
    return rows.groupBy("source", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published_at")).agg(F.count("*").alias("items"))


@query(f"WITH {_FEEDS} SELECT source, count(*) AS files, count(*) FILTER (broken) AS broken FROM b GROUP BY 1")
def feed_quarantine(spark, sf_dir):
    """Files of each source, and how many were set aside."""
    root = streams.folder(spark, "feeds-in")
    _land_feeds(spark, sf_dir, root)
    return readers.parsed_feeds(readers.feed_files(spark, root)).groupBy("source").agg(F.count("*").alias("files"), F.count("broken").alias("broken"))


@query(f"""WITH {_SCORED}, {_MOVES}, s AS (SELECT ticker, count(*) AS posts, {_mean('sentiment_score')} AS s FROM scored GROUP BY ticker), t AS (SELECT unnest({_PICK}) AS ticker UNION ALL SELECT 'NONE')
  SELECT t.ticker, s.posts, {_six('s.s')} AS sentiment_score, round(m.close, 4) AS price, CASE WHEN m.close > 0 THEN 'live' END AS status FROM t JOIN s USING (ticker) LEFT JOIN (SELECT * FROM moves WHERE back = 1) m USING (ticker)""")
def route_functions(spark, sf_dir):
    """The dashboard route as a SQL table function, joined laterally to tickers in any spelling."""
    scored(spark, sf_dir).createOrReplaceTempView("scored_posts")
    market.snapshot(adapters.bars(spark, sf_dir)).createOrReplaceTempView("snapshots")
    providers.register_routes(spark)
    out = spark.sql("SELECT d.* FROM VALUES (' tsla '), ('NVDA'), ('amd'), ('AAPL'), ('Meta'), ('none') AS wanted(name), LATERAL dashboard(name) d")
    return rounded(out, "sentiment_score").withColumn("price", F.round("price", 4))


_AVAILABLE = f"""{_SCORED}, {_MOVES}, {_SOCIAL}, sm AS (SELECT ticker, {_mean('sentiment_score')} AS s FROM scored GROUP BY ticker), wanted AS (SELECT unnest([{', '.join(repr(t) for t in fixed.TICKERS)}, 'NONE']) AS ticker),
 hd AS (SELECT {_PICK}[CAST(page_id % 4 AS INTEGER) + 1] AS ticker, count(*) AS heads FROM pages GROUP BY 1), fu AS (SELECT DISTINCT {_PICK}[CAST(p_partkey % 3 AS INTEGER) + 1] AS ticker, true AS has FROM part)"""


@query(f"""WITH {_AVAILABLE}, j AS (SELECT wanted.ticker, sm.s IS NOT NULL AS sent, m.close, m.vd, coalesce(k.social, 0) AS so, coalesce(k.publisher, 0) AS pu, coalesce(heads, 0) AS heads, coalesce(has, false) AS has
   FROM wanted LEFT JOIN sm USING (ticker) LEFT JOIN (SELECT * FROM moves WHERE back = 1) m USING (ticker) LEFT JOIN k USING (ticker) LEFT JOIN hd USING (ticker) LEFT JOIN fu USING (ticker))
  SELECT ticker, 'market_data' AS section, CASE WHEN close > 0 THEN 'success' ELSE 'warning' END AS type, 'Market data' AS title, CASE WHEN close > 0 THEN 'live' ELSE 'unavailable' END AS status, CAST(NULL AS BIGINT) AS count,
    CASE WHEN close > 0 THEN 'Market snapshot is available from bars. Volume delta ' || printf('%+.1f', vd * 100) || '%.' ELSE 'Market snapshot unavailable from configured providers.' END AS message FROM j
  UNION ALL SELECT ticker, 'sentiment', CASE WHEN sent THEN 'success' ELSE 'warning' END, 'Sentiment', CASE WHEN sent THEN 'ready' ELSE 'unavailable' END, NULL, CASE WHEN sent THEN 'Sentiment is available.' ELSE 'Aggregate sentiment unavailable until enough validated text data is available.' END FROM j
  UNION ALL SELECT ticker, 'prediction', 'warning', 'Experimental signal', 'unavailable', NULL, 'Experimental signal unavailable until a model is trained and evaluated on real historical outcomes.' FROM j
  UNION ALL SELECT ticker, 'headlines', CASE WHEN heads > 0 THEN 'success' ELSE 'warning' END, 'Headlines', CASE WHEN heads > 0 THEN 'ready' ELSE 'unavailable' END, heads, CASE WHEN heads > 0 THEN heads || ' headline items are available.' ELSE 'Headline provider is unavailable or returned no articles.' END FROM j
  UNION ALL SELECT ticker, 'social_posts', CASE WHEN so + pu = 0 OR (so > 0 AND pu > 0) THEN 'warning' ELSE 'success' END, CASE WHEN pu > 0 THEN 'Publisher items' ELSE 'Social posts' END,
    CASE WHEN so + pu = 0 THEN 'unavailable' WHEN so = 0 THEN 'cached' WHEN pu > 0 THEN 'partial' ELSE 'ready' END, so + pu, CASE WHEN so + pu = 0 THEN 'No social posts are available for this ticker yet.' WHEN so = 0 THEN pu || ' publisher headline items are available. These are not social chatter.'
    WHEN pu > 0 THEN so || ' social posts and ' || pu || ' publisher headline items are available.' ELSE so || ' social posts are available.' END FROM j
  UNION ALL SELECT ticker, 'fundamentals', CASE WHEN has THEN 'success' ELSE 'warning' END, 'Fundamentals', CASE WHEN has THEN 'ready' ELSE 'unavailable' END, NULL, CASE WHEN has THEN 'Company fundamentals are available.' ELSE 'Fundamentals provider is unavailable or returned no usable fields.' END FROM j""")
def dashboard_alerts(spark, sf_dir):
    """The six notices of each ticker, one that has nothing among them."""
    wanted = spark.createDataFrame([(t,) for t in (*fixed.TICKERS, "NONE")], "ticker string")
    overall = sentiment.overall(scored(spark, sf_dir), "ticker").select("ticker", "sentiment_label")
    snap = market.snapshot(adapters.bars(spark, sf_dir)).select("ticker", "price", F.col("status").alias("market_status"), F.lit("bars").alias("market_source"), "volume_delta")
    social = serving.social_status(_kinds(spark, sf_dir)).select("ticker", "social", "publisher")
    heads = adapters.table(spark, sf_dir, "pages").groupBy(adapters.pick(adapters.TICKERS, F.col("page_id") % 4).alias("ticker")).agg(F.count("*").alias("headline_count"))
    company = adapters.table(spark, sf_dir, "part").select(adapters.pick(adapters.TICKERS, F.col("p_partkey") % 3).alias("ticker"), F.lit(True).alias("has_fundamentals")).distinct()
    rows = wanted
    for side in (overall, snap, social, heads, company):
        rows = rows.join(side, "ticker", "left")
    none = F.lit(None).cast("string")
    rows = rows.withColumns({"movement": none, "real_training_data": F.lit(False), "reason": none, "headline_status": none, "headline_source": none, "fundamentals_status": none, "fundamentals_source": none})
    return serving.alerts(serving.availability(rows)).select("ticker", "section", "type", "title", "status", "count", "message")


@query("""SELECT c_custkey, CASE WHEN d IS NULL THEN 'Change not reported' ELSE '$' || d END AS change, 'Volume delta ' || v || '%' AS volume FROM (
  SELECT c_custkey, CASE WHEN c_nationkey <> 3 THEN CASE WHEN c_acctbal > 0 THEN '+' ELSE '' END || printf('%.2f', c_acctbal) END AS d, CASE WHEN c_nationkey > 0 THEN '+' ELSE '' END || printf('%.1f', CAST(c_nationkey AS DOUBLE)) AS v FROM customer)""")
def ui_changes(spark, sf_dir):
    """Signed decimals of balances, absent for one nation."""
    c = adapters.table(spark, sf_dir, "customer")
    delta = F.when(F.col("c_nationkey") != 3, F.col("c_acctbal"))
    return c.select("c_custkey", display.price_change(delta, F.lit(None).cast("double")).alias("change"), display.volume_delta(F.col("c_nationkey") / 100).alias("volume"))


#: Signs that the features of a document leave out, one set for each.
_SIGNS = (string.ascii_lowercase[:13], string.ascii_lowercase[13:], string.ascii_uppercase, string.digits, " \n", ".,!?")


@query()
def model_lifecycle(spark, sf_dir):
    """Where a model comes from at a first start, in the same process, after a restart and after a forced training; trained on labelled documents in the order of their ids."""
    shared_checkpoints(spark)
    root, trained = streams.folder(spark, "models"), []
    # counted before the join, so no text is shuffled, and stored: two trainings, each with a sort that samples its rows, would count four times
    signs = sign_counts(adapters.table(spark, sf_dir, "documents"), "doc_id", "text", _SIGNS)
    labels = adapters.table(spark, sf_dir, "labels").where(F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("label"))
    least = F.greatest(F.col("signs").cast("double"), F.lit(1.0))
    data = _stored(labels.join(signs, "doc_id").select(F.col("doc_id").alias("row"), *[((F.col("signs") - F.get("counts", F.lit(k))) / least).alias(c) for k, c in enumerate(signal.REQUIRED)], "label"))

    def train():
        trained.append(1)
        return signal.train(spark, data, trees=10)

    rows = []
    for step in ("first start", "same process", "restart", "forced"):
        if step == "restart":
            artifacts.forget(root)
        got = artifacts.bootstrap(spark, root, train, force=step == "forced")
        rows.append((step, got.provenance["artifact_source"], len(trained), round(got.metrics["lr_accuracy"], 6)))
    artifacts.forget(root)
    return spark.createDataFrame(rows, "step string, source string, trainings int, accuracy double")
