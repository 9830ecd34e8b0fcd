"""Queries on provider rows: news, quotes, posts with indices, fallbacks, health, SQL functions, retries, the batch dashboard."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import citations, market, matching, providers, sentiment, serving
from ..sources import adapters
from ..sources.adapters import POSTS_SQL
from ..streaming import streams
from .market_queries import _DELTAS
from .registry import query
from .text_queries import _KIND_SQL, _MAPPED, _OUTCOME, _PROBS, _SCORED, _VALID, _mean, _six, rounded, scored, valid_posts

_PICK = "['TSLA','NVDA','AMD','AAPL','META']"
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


def _feeds(spark, sf_dir, ticker=None):
    """Each ticker's pages as a feed of nested items; fields lie in the item or in its content, by page id. Only items that any limit can reach are gathered."""
    p, k = adapters.table(spark, sf_dir, "pages"), F.col("page_id")
    title, date = F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + k * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    url = lambda on: F.struct(F.when(k % 3 == on, F.col("url")).alias("url"))
    text = k.cast("string")
    content = F.struct(
        F.when(k % 4 == 0, title).alias("title"), F.when(k % 5 == 0, F.concat(F.lit("c"), text)).alias("id"), F.struct(F.when(k % 2 == 0, "Wire").alias("display_name"), F.lit("Desk").alias("name")).alias("provider"),
        url(1).alias("canonical_url"), url(2).alias("click_through_url"), F.when(k % 6 == 1, date).alias("pub_date"), F.lit("soon").alias("display_time"), F.lit("text").alias("summary"),
    )
    item = F.struct(
        k.alias("order"), F.when((k % 4 != 0) & (k % 7 != 3), title).alias("title"), F.when(k % 2 == 0, text).alias("id"), F.when(k % 9 == 0, "House").alias("publisher"),
        F.when(k % 3 == 0, F.col("url")).alias("link"), F.when(k % 6 == 0, (F.lit(1_700_000_000) + k * 3600).cast("string")).alias("provider_publish_time"), F.lit("").alias("summary"), content.alias("content"),
    )
    rows = p.select((adapters.pick(adapters.TICKERS, k % 5) if ticker is None else ticker).alias("ticker"), item.alias("item"))
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy("item.order"))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= providers.NEWS_LIMIT)
    return first.groupBy("ticker").agg(F.array_sort(F.collect_list("item")).alias("items"))


_NEWS = f"""feed AS (SELECT page_id, url, {_PICK}[CAST(page_id % 5 AS INTEGER) + 1] AS ticker, row_number() OVER (PARTITION BY page_id % 5 ORDER BY page_id) - 1 AS place, {_TITLE} AS t FROM pages),
 news AS (SELECT ticker, CAST(place AS INTEGER) AS place, CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) WHEN page_id % 5 = 0 THEN 'c' || page_id ELSE ticker || '-' || place END AS id, t AS title,
   CASE WHEN page_id % 9 = 0 THEN 'House' WHEN page_id % 2 = 0 THEN 'Wire' ELSE 'Desk' END AS source, url, 'text' AS summary,
   CASE WHEN page_id % 6 IN (0, 1) THEN strftime(make_timestamp((1700000000 + page_id * 3600) * 1000000), '%b %-d, %Y') END AS time
   FROM feed WHERE place < 15 AND t <> '' AND NOT (page_id % 4 <> 0 AND page_id % 7 = 3))"""


@query(f"WITH {_NEWS} SELECT ticker, place, id, title, source, url, summary, time FROM news")
def provider_news(spark, sf_dir):
    return providers.news(_feeds(spark, sf_dir)).drop("published_at")


@query(f"""WITH {_NEWS}, a AS (SELECT doc_id, {_PICK}[CAST(doc_id % 4 AS INTEGER) + 1] AS ticker, text, source, make_timestamp((1700000000 + doc_id * 600) * 1000000) AS stamp FROM documents),
  t AS (SELECT CAST(max(stamp) AS DATE) AS today FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY stamp DESC, doc_id) AS k FROM a, t WHERE CAST(stamp AS DATE) BETWEEN today - 3 AND today)
  SELECT ticker, sha256(coalesce(text, '')) AS text_sha, source FROM r WHERE k <= 15 UNION ALL SELECT ticker, sha256(title), source FROM news WHERE ticker NOT IN (SELECT ticker FROM r)""")
def company_news(spark, sf_dir):
    s = adapters.stories(spark, sf_dir)
    articles = s.select(F.col("story_id").alias("article_id"), adapters.pick(adapters.TICKERS, F.col("story_id") % 4).alias("ticker"), F.col("body").alias("text"), F.col("outlet").alias("source"), "published_at")
    today = articles.agg(F.to_date(F.max("published_at")).alias("today"))
    dated = articles.join(F.broadcast(today))  # one row
    out = providers.company_news(dated, F.col("today"), providers.news(_feeds(spark, sf_dir)).withColumn("text", F.col("title")))
    return out.select("ticker", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha"), "source")


_KEYED_NEWS = _NEWS.replace(f"{_PICK}[CAST(page_id % 5 AS INTEGER) + 1] AS ticker", "'U' || page_id % 400 AS ticker").replace("PARTITION BY page_id % 5", "PARTITION BY page_id % 400")


@query(f"""WITH {POSTS_SQL}, {_KEYED_NEWS}, own AS (SELECT 'U' || user_id AS ticker, text, source FROM posts JOIN (SELECT event_id, user_id FROM events) USING (event_id) WHERE {_VALID}),
  f AS (SELECT ticker, title AS text, source FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY place) AS k FROM news) WHERE k <= 8)
  SELECT ticker, text, source, count(*) AS posts FROM (SELECT * FROM own UNION ALL SELECT * FROM f WHERE ticker NOT IN (SELECT ticker FROM own) AND {_VALID}) GROUP BY 1, 2, 3""")
def posts_or_headlines(spark, sf_dir):
    """Posts by user and pages dealt to more keys than there are users: keys without a valid post get headlines."""
    posts = adapters.posts_of(adapters.table(spark, sf_dir, "events"), "user_id").withColumn("ticker", F.concat(F.lit("U"), "user_id"))
    out = providers.own_or_headlines(posts, providers.news(_feeds(spark, sf_dir, F.concat(F.lit("U"), F.col("page_id") % 400))))
    return out.groupBy("ticker", "text", "source").agg(F.count("*").alias("posts"))


_MOVES = _DELTAS.removeprefix("WITH ").replace("\nd AS (", "\nmoves AS (")


@query(f"""WITH {_MOVES}, every AS (SELECT {_PICK}[CAST(s_suppkey % 5 AS INTEGER) + 1] AS ticker, max(s_acctbal) AS c, CAST(count(*) AS BIGINT) AS v FROM supplier GROUP BY 1),
  q AS (SELECT * FROM every WHERE c >= (SELECT avg(c) FROM every)), t AS (SELECT unnest({_PICK}) AS ticker UNION ALL SELECT 'NONE')
  SELECT t.ticker, round(coalesce(q.c, m.close, 0), 4) AS price, CAST(coalesce(q.v, m.volume, 0) AS BIGINT) AS volume,
   CASE WHEN q.c IS NOT NULL THEN 'quote' WHEN m.close IS NOT NULL THEN 'bars' ELSE 'unavailable' END AS source FROM t LEFT JOIN q USING (ticker) LEFT JOIN (SELECT * FROM moves WHERE back = 1) m USING (ticker)""")
def quote_fallback(spark, sf_dir):
    """Quotes of the tickers whose largest balance is no less than their mean, bars for the others, nothing for a ticker without either."""
    s = adapters.table(spark, sf_dir, "supplier")
    every = s.groupBy(adapters.pick(adapters.TICKERS, F.col("s_suppkey") % 5).alias("ticker")).agg(F.max("s_acctbal").alias("c"), F.count("*").cast("string").alias("v"))
    quotes = every.join(F.broadcast(every.agg(F.avg("c").alias("mean")))).where("c >= mean")  # one row
    quotes = quotes.select("ticker", F.col("c").cast("string").alias("c"), F.lit("n/a").alias("d"), F.lit(None).cast("string").alias("dp"), "v")
    tickers = spark.createDataFrame([(t,) for t in (*adapters.TICKERS, "NONE")], "ticker string")
    return providers.quotes_or_bars(tickers, quotes, market.snapshot(adapters.bars(spark, sf_dir))).select("ticker", F.round("price", 4).alias("price"), "volume", "source")


_PLACED = f"""{POSTS_SQL}, placed AS (SELECT *, dense_rank() OVER (PARTITION BY ticker ORDER BY date) - 1 AS record, row_number() OVER (PARTITION BY ticker, date ORDER BY event_id) - 1 AS place FROM posts)"""


@query(f"WITH {_PLACED} SELECT ticker || '-' || record || '-' || place AS id, ticker, trim(text) AS text, source, {_KIND_SQL} AS content_type, date, post_score FROM placed WHERE {_VALID}")
def social_posts(spark, sf_dir):
    return providers.social_posts(adapters.grouped_records(adapters.posts(spark, sf_dir)))


@query(f"""WITH {_PLACED}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY record, place) AS rank FROM placed WHERE {_VALID})
  SELECT ticker, ticker || '-dataset-' || record || '-' || place AS id, trim(text) AS headline, source, strftime(CAST(date AS DATE), '%b %-d, %Y') AS time FROM k WHERE rank <= 6""")
def dataset_headlines(spark, sf_dir):
    return providers.dataset_headlines(adapters.grouped_records(adapters.posts(spark, sf_dir)))


@query("SELECT event_id, value FROM events WHERE event_id % 5 NOT IN (0, 1, 2)")
def finite_values(spark, sf_dir):
    k = F.col("event_id") % 5
    bad = F.when(k == 0, F.lit(None)).when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("-inf"))).otherwise(F.col("value"))
    return providers.finite(adapters.table(spark, sf_dir, "events").select("event_id", bad.alias("value")), "value")


@query(f"{_MAPPED} SELECT event_id, CASE {' '.join(f'WHEN m_{t} THEN {t!r}' for t in fixed.TICKERS)} END AS assigned FROM m WHERE {_OUTCOME} = 'assigned'")
def assigned_posts(spark, sf_dir):
    mapped = matching.with_tickers(adapters.posts(spark, sf_dir)).where("outcome = 'assigned'")
    return mapped.select("event_id", F.get("matched", F.lit(0)).alias("assigned"))


@query(f"WITH {_SCORED} SELECT date, ticker, {_six(_mean('sentiment_score'))} AS avg_sentiment_score, count(text) AS mention_count FROM scored GROUP BY date, ticker")
def aggregate_sink(spark, sf_dir):
    """The aggregates as JSON lines in the order of date and ticker, read again."""
    out = streams.folder(spark, "aggregates")
    df = rounded(sentiment.by_ticker_date(scored(spark, sf_dir)), "avg_sentiment_score").select("date", "ticker", "avg_sentiment_score", "mention_count")
    df.orderBy("date", "ticker").write.json(out)
    return spark.read.schema(df.schema).json(out)


_TABLES = ("events", "documents", "pages", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS rows, count(*) > 0 AS available FROM {t}" for t in _TABLES))
def health(spark, sf_dir):
    return providers.health({t: adapters.table(spark, sf_dir, t) for t in _TABLES})


@query(f"""WITH {_SCORED}, t AS (SELECT ticker, {_mean('sentiment_score')} AS s FROM scored GROUP BY ticker),
  g AS (SELECT ticker, CAST(least(100, greatest(0, floor((s + 1) / 2 * 100 + 0.5))) AS INTEGER) AS gauge FROM t)
  SELECT ticker, gauge, CASE WHEN gauge >= 65 THEN 'green' WHEN gauge >= 40 THEN 'amber' ELSE 'red' END AS band FROM g""")
def sql_functions(spark, sf_dir):
    providers.register(spark)
    sentiment.overall(scored(spark, sf_dir), "ticker").createOrReplaceTempView("ticker_scores")
    return spark.sql("SELECT ticker, score_gauge(sentiment_score) AS gauge, gauge_band(score_gauge(sentiment_score)) AS band FROM ticker_scores")


@query("""WITH t AS (SELECT doc_id // 5 AS theme_id, count(*) AS stories, bool_or(lang IS NULL) AS gap FROM documents GROUP BY 1)
  SELECT theme_id, CASE WHEN stories % 2 = 1 AND theme_id % 3 <> 1 THEN 'accepted' WHEN theme_id % 4 <> 2 THEN 'accepted_after_retry' ELSE 'degraded' END AS status FROM t""")
def summaries_with_retry(spark, sf_dir):
    """A generator that fails on some themes, called again for those alone; what fails twice is shown without a summary."""
    s = adapters.stories(spark, sf_dir).withColumn("theme_id", F.expr("story_id div 5"))
    story = F.struct(F.col("story_id").alias("order"), F.col("story_id").cast("string").alias("id"), F.lit("Shares of a company").alias("title"), F.col("body").alias("description"), F.lit("A wire").alias("outlet"), F.date_format("published_at", "yyyy-MM-dd").alias("published_at"))
    themes = s.groupBy("theme_id").agg(F.array_sort(F.collect_list(story)).alias("stories")).withColumn("ticker", F.lit("TSLA"))

    def generate(df, attempt):
        told = citations.summarize(df)
        good = (F.size("stories") % 2 == 1) & (F.col("theme_id") % 3 != 1) if attempt == 1 else F.col("theme_id") % 4 != 2
        return told.withColumn("label", F.when(good, F.col("label")).otherwise(F.lit("")))

    return citations.with_retry(themes, generate).select("theme_id", "status")


_FUND = f"f AS (SELECT {_PICK}[CAST(p_partkey % 4 AS INTEGER) + 1] AS ticker, max(p_retailprice) AS market_cap FROM part GROUP BY 1)"
_HEADS = f"heads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date, event_id) AS rank FROM scored) WHERE rank <= 6)"


@query(f"""WITH {_SCORED}, {_MOVES}, {_FUND}, {_HEADS}, s AS (SELECT ticker, {_mean('sentiment_score')} AS s FROM scored GROUP BY ticker), wanted AS (SELECT unnest(['TSLA', 'AMD', 'META']) AS ticker)
  SELECT wanted.ticker, round(m.close, 4) AS price, {_six('s.s')} AS sentiment_score, 'withheld' AS prediction, round(f.market_cap, 4) AS market_cap, CASE WHEN f.market_cap IS NULL THEN 'unavailable' ELSE 'live' END AS fundamentals_status,
   (SELECT count(*) FROM heads WHERE heads.ticker = wanted.ticker) AS headlines, (SELECT {_six('sum(CAST(sentiment_score AS DECIMAL(18, 12)))')} FROM heads WHERE heads.ticker = wanted.ticker) AS headline_score
  FROM wanted JOIN s USING (ticker) JOIN (SELECT * FROM moves WHERE back = 1) m USING (ticker) LEFT JOIN f USING (ticker)""")
def dashboard_batch(spark, sf_dir):
    """The nested rows of a batch of tickers, with scored headlines, prediction and fundamentals."""
    wanted = serving.batch_tickers(["tsla", "AMD", " meta ", "TSLA"])
    bars, posts = adapters.bars(spark, sf_dir), valid_posts(spark, sf_dir)
    part = adapters.table(spark, sf_dir, "part")
    fundamentals = part.groupBy(adapters.pick(adapters.TICKERS, F.col("p_partkey") % 4).alias("ticker")).agg(F.max("p_retailprice").alias("market_cap"))
    rows = serving.dashboard_batch(wanted, posts, bars, fundamentals)
    score = F.aggregate("headlines", F.lit(0).cast("decimal(28,12)"), lambda a, h: (a + h["sentiment"]["sentiment_score"].cast("decimal(18,12)")).cast("decimal(28,12)")).cast("double")
    out = rows.select(
        "ticker", F.round("market.price", 4).alias("price"), F.col("sentiment.sentiment_score").alias("sentiment_score"), F.col("prediction.outcome").alias("prediction"),
        F.round("fundamentals.market_cap", 4).alias("market_cap"), "fundamentals_status", F.size("headlines").cast("bigint").alias("headlines"), score.alias("headline_score"),
    )
    return rounded(out, "sentiment_score", "headline_score")


@query("""SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase'
  AND CAST(b.ts AS TIMESTAMP) BETWEEN CAST(a.ts AS TIMESTAMP) - INTERVAL 36 HOUR AND CAST(a.ts AS TIMESTAMP) + INTERVAL 36 HOUR""")
def stream_merge_window(spark, sf_dir):
    return streams.merge_window(spark, sf_dir)


@query("""WITH w AS (SELECT event_type, value, unnest([date_trunc('hour', ts) - ((hour(ts) % 12)) * INTERVAL 1 HOUR, date_trunc('hour', ts) - ((hour(ts) % 12) + 12) * INTERVAL 1 HOUR]) AS start FROM events)
  SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS events FROM w GROUP BY 1, 2""")
def stream_sliding_windows(spark, sf_dir):
    return streams.sliding(spark, sf_dir)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, events, count(*) AS sessions FROM (SELECT user_id, n, count(*) AS events FROM s GROUP BY 1, 2) GROUP BY 1, 2""")
def stream_sessions(spark, sf_dir):
    return streams.sessions(spark, sf_dir).groupBy("user_id", "events").agg(F.count("*").alias("sessions"))


_DAILY = f"WITH {_SCORED} SELECT date, ticker, {_six(_mean('sentiment_score'))} AS avg_sentiment_score, count(*) AS posts FROM scored GROUP BY date, ticker"


@query(_DAILY)
def stream_sentiment(spark, sf_dir):
    """Posts as a stream, scored and averaged by ticker and day."""
    return rounded(streams.daily_sentiment(spark, sf_dir), "avg_sentiment_score")


@query(_DAILY)
def stream_daily_sentiment(spark, sf_dir):
    """The same under the name of its table."""
    return stream_sentiment(spark, sf_dir)
