"""Queries on landed provider payloads, batch and stream, and on the cache before the providers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import connectors
from ..sources import adapters, landing
from ..sources.adapters import POSTS_SQL
from ..streaming import cache, streams
from .registry import query

_PICK = "['TSLA','NVDA','AMD','AAPL','META']"
#: Pages of one response, over all tickers, and items taken from it.
_PAGES, _TAKEN = 75, 10


def _land_news(spark, sf_dir, root, batch):
    """Responses of ``_PAGES`` pages each, one for each ticker, with the fields where their address and title put them; pages of blogs also come as bare text, which is no payload."""
    p, url = adapters.table(spark, sf_dir, "pages"), F.col("url")
    p = p.withColumn("response", F.expr(f"page_id div {_PAGES}")).where(F.col("response") % 3 == batch).withColumn("ticker", adapters.pick(adapters.TICKERS, F.col("page_id") % 5))
    title, safe = F.regexp_extract("html", "<title>([^<]*)</title>", 1), url.startswith("https:")
    asked, marked, host = url.contains("?"), url.contains("#"), F.regexp_extract("url", "://([^/]*)", 1)
    at = F.lit(1_700_000_000) + F.col("page_id") * 3600
    to = lambda there: F.when(there, F.struct(F.col("url").alias("url")))
    titled = ~host.startswith("m.")
    content = F.struct(
        F.when(titled & ~asked, title).alias("title"), F.when(host.startswith("blog."), F.concat(F.lit("c"), F.col("page_id"))).alias("id"),
        F.struct(F.when(host.endswith(".org"), "Wire").alias("displayName"), F.lit("Desk").alias("name")).alias("provider"), to(marked & ~asked).alias("canonicalUrl"), to(~asked & ~marked).alias("clickThroughUrl"),
        F.when(~safe & titled, F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("pubDate"), F.lit("soon").alias("displayTime"), F.substring(title, 1, 40).alias("summary"),
    )
    item = F.struct(
        F.col("page_id").alias("order"), F.when(titled & asked, title).alias("title"), F.when(safe & ~host.startswith("blog."), F.col("page_id")).alias("id"), F.when(host.endswith(".net"), host).alias("publisher"),
        F.when(asked, url).alias("link"), F.when(safe, at).alias("providerPublishTime"), F.lit("").alias("summary"), content.alias("content"),
    )
    feeds = p.groupBy("ticker", "response").agg(F.array_sort(F.collect_list(item)).alias("news")).select(F.lit("news").alias("provider"), "ticker", F.to_json(F.struct("news")).alias("value"))
    texts = p.where(host.startswith("blog.")).select(F.lit("news").alias("provider"), "ticker", F.col("html").alias("value"))
    landing.land(feeds.unionByName(texts), root, batch)


_NEWS = f"""f AS (SELECT *, {_PICK}[CAST(page_id % 5 AS INTEGER) + 1] AS ticker, page_id // {_PAGES} AS response, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, regexp_extract(url, '://([^/]*)', 1) AS host FROM pages),
 n AS (SELECT *, row_number() OVER (PARTITION BY ticker, response ORDER BY page_id) - 1 AS place FROM f),
 news AS (SELECT response % 3 AS batch, ticker, CAST(place AS INTEGER) AS place, t AS title, url, substr(t, 1, 40) AS summary,
   CASE WHEN starts_with(host, 'blog.') THEN 'c' || page_id WHEN starts_with(url, 'https:') THEN CAST(page_id AS VARCHAR) ELSE ticker || '-' || place END AS id,
   CASE WHEN host LIKE '%.net' THEN host WHEN host LIKE '%.org' THEN 'Wire' ELSE 'Desk' END AS source,
   strftime(make_timestamp((1700000000 + page_id * 3600) * 1000000), '%b %-d, %Y') AS time
  FROM n WHERE place < {_TAKEN} AND NOT starts_with(host, 'm.'))"""


@query(f"WITH {_NEWS} SELECT ticker, place, id, title, source, url, summary, time FROM news")
def connector_news(spark, sf_dir):
    """Headlines of all landed responses; broken ones beside them change nothing."""
    root = streams.folder(spark, "landed")
    for batch in range(3):
        _land_news(spark, sf_dir, root, batch)
    out = connectors.news(landing.read(spark, root, provider="news"), _TAKEN)
    return out.select("ticker", F.col("index").alias("place"), "id", "title", "source", "url", "summary", "time")


@query(f"WITH {_NEWS} SELECT CAST(response % 3 AS BIGINT) AS batch, ticker, count(*) AS broken, sum(length(html))::BIGINT AS signs FROM f WHERE starts_with(host, 'blog.') GROUP BY 1, 2")
def connector_broken(spark, sf_dir):
    """What was landed and is no payload, by batch and ticker."""
    root = streams.folder(spark, "landed")
    for batch in range(3):
        _land_news(spark, sf_dir, root, batch)
    return connectors.broken(landing.read(spark, root)).groupBy("batch", "ticker").agg(F.count("*").alias("broken"), F.sum(F.length("value")).alias("signs"))


@query(f"WITH {_NEWS} SELECT CAST(batch AS BIGINT) AS batch, ticker, id, title, time FROM news")
def connector_stream(spark, sf_dir):
    """The same headlines by a stream that stops after two batches and goes on from its checkpoint when the third is there."""
    root, out, state = (streams.folder(spark, f"landed-{name}") for name in ("in", "out", "state"))
    for batches in ((0, 1), (2,)):
        for batch in batches:
            _land_news(spark, sf_dir, root, batch)
        found = connectors.news(landing.read_stream(spark, root), _TAKEN).select("batch", "ticker", "id", "title", "time")
        streams.run(found.writeStream.format("parquet").option("path", out), spark, "landed", state)
    return spark.read.schema(found.schema).parquet(out)


@query(f"""SELECT CAST(s_suppkey AS DOUBLE) AS price, CASE WHEN s_nationkey > 12 THEN 1.5::DOUBLE ELSE 0::DOUBLE END AS price_delta_24h, {_PICK}[CAST(s_suppkey % 5 AS INTEGER) + 1] AS ticker, round(CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 0 END, 4) AS percent_change_24h,
  CAST(CASE WHEN s_nationkey > 20 THEN 0 WHEN s_nationkey > 10 THEN s_nationkey ELSE s_nationkey * 100 END AS BIGINT) AS volume FROM supplier""")
def connector_quotes(spark, sf_dir):
    """Quotes with numbers as numbers or texts, absent, null and unreadable."""
    s, root = adapters.table(spark, sf_dir, "supplier"), streams.folder(spark, "landed")
    n = F.col("s_nationkey")
    volume = F.when(n > 20, F.format_string('"%d.7"', n)).when(n > 10, F.format_string('"%d"', n)).otherwise(F.format_string("%d.7", n * 100))
    move = F.when(n > 12, F.lit('"1.5"')).otherwise(F.when(n % 2 == 0, F.lit("null")).otherwise(F.lit('"n/a"')))
    percent = F.when(F.col("s_acctbal") > 0, F.concat(F.lit(', "dp": '), F.col("s_acctbal").cast("string"))).otherwise("")
    value = F.concat(F.lit('{"c": '), F.col("s_suppkey").cast("string"), F.lit(', "d": '), move, percent, F.lit(', "v": '), volume, F.lit("}"))
    landing.land(s.select(F.lit("quote").alias("provider"), adapters.pick(adapters.TICKERS, F.col("s_suppkey") % 5).alias("ticker"), value.alias("value")), root, 0)
    out = connectors.quotes(landing.read(spark, root, provider="quote"))
    return out.select("price", "price_delta_24h", "ticker", F.round("percent_change_24h", 4).alias("percent_change_24h"), "volume")


@query(f"""SELECT {_PICK}[CAST(p_partkey % 5 AS INTEGER) + 1] AS ticker, CAST(p_partkey AS DOUBLE) AS beta, p_name AS company_name, CASE WHEN p_size > 30 THEN p_type END AS sector, round(CASE WHEN p_size < 25 THEN p_retailprice ELSE p_size * 1000000.0 END, 4) AS market_cap,
  CASE WHEN p_brand LIKE '%1' THEN CAST(p_size AS DOUBLE) END AS trailing_pe, CASE WHEN p_size > 10 THEN 'USD' END AS currency FROM part WHERE p_size > 1""")
def connector_fundamentals(spark, sf_dir):
    """Company rows of two nested sources; a response without any value gives no row."""
    p, root = adapters.table(spark, sf_dir, "part"), streams.folder(spark, "landed")
    size = F.col("p_size")
    info = F.struct(
        F.col("p_name").alias("longName"), F.lit("short").alias("shortName"), F.when(size > 30, F.col("p_type")).alias("sector"), F.when(size < 25, F.col("p_retailprice").cast("string")).otherwise(F.when(size % 2 == 0, "n/a")).alias("marketCap"),
        F.when(F.col("p_brand").endswith("1"), size).alias("trailing_pe"), F.col("p_partkey").alias("beta"),
    )
    fast = F.struct((size * 1_000_000).alias("market_cap"), F.when(size > 10, "USD").alias("currency"))
    full = F.struct(info.alias("info"), fast.alias("fast_info"))
    # nulls are written as nulls in some responses and left out in others
    value = F.when(size == 1, '{"info": {"longName": "", "sector": null}, "fast_info": null}').when(size % 3 == 0, F.to_json(full, {"ignoreNullFields": "false"})).otherwise(F.to_json(full))
    landing.land(p.select(F.lit("fundamentals").alias("provider"), adapters.pick(adapters.TICKERS, F.col("p_partkey") % 5).alias("ticker"), value.alias("value")), root, 0)
    out = connectors.fundamentals(landing.read(spark, root, provider="fundamentals"))
    return out.select("ticker", "beta", "company_name", "sector", F.round("market_cap", 4).alias("market_cap"), "trailing_pe", "currency")


@query(f"""WITH {POSTS_SQL}, p AS (SELECT p.*, e.event_type FROM posts p JOIN events e USING (event_id))
  SELECT ticker, date, source, count(*) AS posts, count(*) FILTER (event_type <> 'error') AS scored, round(coalesce(sum(post_score) FILTER (event_type NOT IN ('error', 'view')), 0), 4) AS total, count(*) FILTER (trim(text) = '') AS blank FROM p GROUP BY 1, 2, 3""")
def record_posts(spark, sf_dir):
    """Posts of JSON records in both layouts: a null score stays null, an absent one counts as 0."""
    posts = adapters.posts_of(adapters.table(spark, sf_dir, "events"), "event_type")
    score = F.when(F.col("event_type") == "error", ', "post_score": null}').when(F.col("event_type") == "view", "}").otherwise(F.concat(F.lit(', "post_score": '), F.col("post_score").cast("string"), F.lit("}")))
    post = lambda *more: F.concat(F.expr("rtrim('}', to_json(struct(" + ", ".join((*more, "text", "source", "content_type")) + ")))"), score)
    flat = posts.where("event_type = 'signup'").select(post("ticker", "date").alias("value"))
    texts = posts.where("event_type <> 'signup'").groupBy("ticker", "date").agg(F.array_join(F.collect_list(post()), ", ").alias("posts"))
    grouped = texts.select(F.concat(F.expr("rtrim('}', to_json(struct(ticker, date)))"), F.lit(', "posts": ['), F.col("posts"), F.lit("]}")).alias("value"))
    rows = connectors.posts_of_records(grouped.unionByName(flat))
    return rows.groupBy("ticker", "date", "source").agg(F.count("*").alias("posts"), F.count("post_score").alias("scored"), F.round(F.coalesce(F.sum("post_score"), F.lit(0.0)), 4).alias("total"), F.count_if(F.trim("text") == "").alias("blank"))


_DAY = 86_400
#: Requests of the three providers, from events: what fails, how many items come, and how many rows the dataset has of its own.
_REQUESTS = f"""r AS (SELECT event_id AS id, epoch_us(ts) AS asked, ['headlines','fundamentals','market_history:1mo'][CAST(k % 3 AS INTEGER) + 1] AS provider, event_type = 'error' AS failed, user_id,
   CAST(CASE WHEN k % 3 = 1 THEN least(1, k // 15) ELSE k // 15 END AS INTEGER) AS items, CAST(least(6, greatest(0, floor(coalesce(c_acctbal, 0) / 1000))) AS INTEGER) AS own
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events) LEFT JOIN customer ON c_custkey = user_id),
 q AS (SELECT *, provider || ':' || {_PICK}[CAST(user_id % 5 AS INTEGER) + 1] || ':' || user_id AS key, row_number() OVER (PARTITION BY provider, user_id ORDER BY asked, id) AS place FROM r)"""


def _requests(events, customers):
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    provider = F.element_at(F.array(*map(F.lit, ("headlines", "fundamentals", "market_history:1mo"))), (k % 3 + 1).cast("int"))
    own = customers.select(F.col("c_custkey").alias("user_id"), F.least(F.lit(6), F.greatest(F.lit(0), F.floor(F.col("c_acctbal") / 1000))).cast("int").alias("own"))
    items = F.expr("cast(regexp_extract(props, '[0-9]+', 0) as int) div 15").cast("int")
    return events.join(own, "user_id", "left").select(
        F.concat_ws(":", provider, adapters.pick(adapters.TICKERS, F.col("user_id") % 5), F.col("user_id").cast("string")).alias("key"), "at", F.col("event_id").alias("id"), provider.alias("provider"),
        (F.col("event_type") == "error").alias("failed"), F.when(k % 3 == 1, F.least(F.lit(1), items)).otherwise(items).alias("items"), F.coalesce("own", F.lit(0)).alias("own"),
    )


def _sql_answer(column: str) -> str:
    """One column of the answer to request q, given the entry of the request before (e.stored, e.n, e.src)."""
    fresh, stale, head = f"(e.stored IS NOT NULL AND q.asked - e.stored <= {_DAY * 1_000_000})", "(q.failed AND e.stored IS NOT NULL)", "q.provider = 'headlines'"
    own = f"({head} AND q.own > 0 AND (q.failed OR q.items = 0))"
    values = {
        "status": ("CASE WHEN e.n > 0 THEN 'cached' ELSE 'unavailable' END", "'fallback'", "'cached'", "'unavailable'", "CASE WHEN q.items > 0 THEN 'live' ELSE 'unavailable' END"),
        "source": (f"CASE WHEN {head} THEN e.src ELSE '{cache.CACHE}' END", f"'{cache.STALE}'", f"'{cache.DATASET}'", f"'{cache.PROVIDER}'", f"'{cache.PROVIDER}'"),
        "items": ("e.n", "e.n", "q.own", "0", "q.items"),
        "stored": ("e.stored", "e.stored", "q.asked", f"CASE WHEN {head} THEN q.asked END", "q.asked"),
        "n": ("e.n", "e.n", "q.own", f"CASE WHEN {head} THEN 0 END", "q.items"),
        "src": ("e.src", "e.src", f"'{cache.DATASET}'", f"CASE WHEN {head} THEN '{cache.PROVIDER}' END", f"'{cache.PROVIDER}'"),
    }[column]
    return f"CASE WHEN {fresh} THEN {values[0]} WHEN {stale} THEN {values[1]} WHEN {own} THEN {values[2]} WHEN q.failed THEN {values[3]} ELSE {values[4]} END"


_ANSWER = "q.id, q.key, q.provider, q.place, " + ", ".join(f"{_sql_answer(c)} AS {c}" for c in ("status", "source", "items", "stored", "n", "src"))


@query(f"""WITH RECURSIVE {_REQUESTS}, a AS (
  SELECT {_ANSWER} FROM q, (SELECT CAST(NULL AS BIGINT) AS stored, CAST(NULL AS INTEGER) AS n, CAST(NULL AS VARCHAR) AS src) e WHERE q.place = 1
  UNION ALL SELECT {_ANSWER} FROM q JOIN a e ON e.key = q.key AND q.place = e.place + 1)
 SELECT id, key, provider, status, source, CAST(items AS INTEGER) AS items, items > 0 AS available FROM a""")
def stream_provider_cache(spark, sf_dir):
    """Every request's answer by a cache whose entries live for a day: all rows of the providers' truth tables."""
    requests = _requests(streams.events(spark, sf_dir), adapters.table(spark, sf_dir, "customer"))
    return cache.answers(spark, requests, streams.span(spark, sf_dir), _DAY)


@query(f"""WITH RECURSIVE q AS (SELECT user_id, epoch_us(ts) AS asked, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
 a AS (SELECT user_id, place, asked AS stored, false AS hit FROM q WHERE place = 1
  UNION ALL SELECT q.user_id, q.place, CASE WHEN q.asked - a.stored <= {_DAY * 1_000_000} THEN a.stored ELSE q.asked END, q.asked - a.stored <= {_DAY * 1_000_000} FROM q JOIN a ON a.user_id = q.user_id AND q.place = a.place + 1)
 SELECT user_id, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM a GROUP BY 1""")
def stream_ttl_cache(spark, sf_dir):
    """Hits and misses of a cache whose entries live for a day, by user."""
    e = streams.events(spark, sf_dir)
    requests = e.select(F.col("user_id").cast("string").alias("key"), "at", F.col("event_id").alias("id"), F.lit("headlines").alias("provider"), F.lit(False).alias("failed"), F.lit(1).alias("items"), F.lit(0).alias("own"))
    out = cache.answers(spark, requests, streams.span(spark, sf_dir), _DAY, label="ttl")
    return out.groupBy(F.col("key").cast("bigint").alias("user_id")).agg(F.count_if(F.col("status") == "cached").alias("hits"), F.count_if(F.col("status") == "live").alias("misses"))
