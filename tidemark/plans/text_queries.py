"""Queries on posts: validity, sentiment, aggregates, ticker mapping, copy rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import term_hits, word_count
from ..operators import matching, posts as post_ops, sentiment
from ..sources import adapters
from ..sources.adapters import POSTS_SQL
from .registry import query

_VALID = (
    "trim(text) <> '' AND NOT starts_with(lower(trim(source)), 'mock')"
    + "".join(f" AND NOT contains(lower(text), '{p}')" for p in fixed.PLACEHOLDERS)
)


def _hits_sql(terms: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(contains(lower(text), '{t}') AS INTEGER)" for t in terms)


_SCORED = f"""{POSTS_SQL},
h AS (SELECT *, {_hits_sql(fixed.POSITIVE)} AS pos, {_hits_sql(fixed.NEGATIVE)} AS neg,
        len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words FROM posts WHERE {_VALID}),
a AS (SELECT *, CAST(CASE WHEN pos > neg THEN CASE WHEN pos >= 2 THEN 0.70 ELSE 0.64 END WHEN neg > pos THEN 0.10 ELSE 0.18 END AS DOUBLE) AS p,
        CAST(CASE WHEN neg > pos THEN CASE WHEN neg >= 2 THEN 0.70 ELSE 0.64 END WHEN pos > neg THEN 0.10 ELSE 0.18 END AS DOUBLE) AS n FROM h),
b AS (SELECT *, CAST(1 AS DOUBLE) - p - n AS u FROM a),
c AS (SELECT * EXCLUDE (p, n, u), CASE WHEN abs(p - n) < 0.12 THEN p * CAST(0.95 AS DOUBLE) ELSE p END AS p,
        CASE WHEN abs(p - n) < 0.12 THEN n * CAST(0.95 AS DOUBLE) ELSE n END AS n,
        CASE WHEN abs(p - n) < 0.12 THEN u + CAST(0.10 AS DOUBLE) ELSE u END AS u FROM b),
d AS (SELECT * EXCLUDE (u), pos + neg AS hits, (words <= 12 AND pos + neg <= 1) AS brief,
        CASE WHEN words <= 12 AND pos + neg <= 1 THEN u + CAST(0.08 AS DOUBLE) ELSE u END AS u FROM c),
e AS (SELECT * EXCLUDE (p, n, u), p / (p + n + u) AS p, n / (p + n + u) AS n, u / (p + n + u) AS u, CAST(CASE WHEN brief THEN 0.76 ELSE 0.82 END AS DOUBLE) AS cap FROM d),
scored AS (SELECT event_id, ticker, date, text, source, content_type, post_score, p AS positive_prob, n AS negative_prob, u AS neutral_prob,
        p - n AS sentiment_score, greatest(p, n, u) AS sentiment_confidence,
        CASE WHEN u >= greatest(p, n) OR (abs(p - n) < 0.12 AND u >= 0.30) THEN 'neutral' WHEN p > n THEN 'positive' ELSE 'negative' END AS sentiment_label FROM e)"""


def _mean(c: str) -> str:
    return f"avg(CAST({c} AS DECIMAL(18, 12)))"


def _six(e: str) -> str:
    """Six places, a tie going up: engines round a tie of decimals that isn't one of doubles either way."""
    return f"round({e} + 1e-10, 6) + 0.0"


_LABEL = f"CASE WHEN {_mean('sentiment_score')} > 0.05 THEN 'positive' WHEN {_mean('sentiment_score')} < -0.05 THEN 'negative' ELSE 'neutral' END"
_MEANS = ", ".join(f"{_six(_mean(c))} AS {c}" for c in ("positive_prob", "negative_prob", "neutral_prob", "sentiment_score", "sentiment_confidence"))


def valid_posts(spark, sf_dir):
    df = adapters.posts(spark, sf_dir)
    return df.where(post_ops.is_valid(F.col("text"), F.col("source")))


def scored(spark, sf_dir):
    return sentiment.with_sentiment(valid_posts(spark, sf_dir))


def rounded(df, *columns):
    return df.withColumns({c: F.round(F.col(c) + 1e-10, 6) + 0.0 for c in columns})  # ties go up; no negative zero


_PROBS = ("positive_prob", "negative_prob", "neutral_prob", "sentiment_score", "sentiment_confidence")


@query(f"WITH {POSTS_SQL} SELECT ticker, date, row_number() OVER (PARTITION BY ticker, date ORDER BY event_id) - 1 AS post_index, text, source, post_score FROM posts")
def post_flatten(spark, sf_dir):
    flat = post_ops.flatten(adapters.grouped_records(adapters.posts(spark, sf_dir)))
    return flat.withColumn("post_index", F.col("post_index").cast("bigint"))


@query(f"WITH {POSTS_SQL} SELECT event_id, ticker, text, source, ({_VALID}) AS valid FROM posts")
def post_validity(spark, sf_dir):
    return adapters.posts(spark, sf_dir).select("event_id", "ticker", "text", "source", post_ops.is_valid(F.col("text"), F.col("source")).alias("valid"))


_KIND_SQL = f"""CASE WHEN lower(coalesce(content_type, '')) IN ('social_post', 'publisher_headline') THEN lower(content_type)
  WHEN lower(coalesce(content_type, '')) = 'news_headline' THEN 'publisher_headline'
  WHEN {' OR '.join(f"contains(lower(source), '{s}')" for s in fixed.SOCIAL_SOURCES)} THEN 'social_post' ELSE 'publisher_headline' END"""


@query(f"WITH {POSTS_SQL} SELECT event_id, source, {_KIND_SQL} AS kind FROM posts")
def content_type(spark, sf_dir):
    return adapters.posts(spark, sf_dir).select("event_id", "source", post_ops.content_type(F.col("content_type"), F.col("source")).alias("kind"))


@query(f"""WITH {POSTS_SQL} SELECT ticker, CAST(rank AS INTEGER) AS rank, event_id, trim(text) AS headline, source,
  strftime(CAST(date AS DATE), '%b %-d, %Y') AS time FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date, event_id) AS rank FROM posts WHERE {_VALID}) WHERE rank <= 6""")
def pipeline_headlines_topk(spark, sf_dir):
    return post_ops.top_headlines(adapters.posts(spark, sf_dir), 6)


@query(f"""WITH {POSTS_SQL} SELECT event_id, {_hits_sql(fixed.POSITIVE)} AS pos_hits, {_hits_sql(fixed.NEGATIVE)} AS neg_hits,
  CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS words FROM posts""")
def lexicon_hits(spark, sf_dir):
    return sentiment.with_hits(adapters.posts(spark, sf_dir)).select("event_id", "pos_hits", "neg_hits", "words")


_ROW = ", ".join(f"{_six(c)} AS {c}" for c in _PROBS)


@query(f"WITH {_SCORED} SELECT event_id, ticker, {_ROW}, sentiment_label FROM scored")
def sentiment_score(spark, sf_dir):
    return rounded(scored(spark, sf_dir), *_PROBS).select("event_id", "ticker", *_PROBS, "sentiment_label")


@query(f"WITH {_SCORED} SELECT event_id, ticker, {_ROW}, sentiment_label FROM scored WHERE sentiment_confidence >= 0.65")
def sentiment_high_confidence(spark, sf_dir):
    df = sentiment.with_sentiment(valid_posts(spark, sf_dir), min_confidence=0.65)
    return rounded(df, *_PROBS).select("event_id", "ticker", *_PROBS, "sentiment_label")


@query(f"""WITH {_SCORED} SELECT date, ticker, {', '.join(f"{_six(_mean(c))} AS avg_{c}" for c in _PROBS)}, {_six('avg(post_score)')} AS avg_post_score, count(text) AS mention_count
  FROM scored GROUP BY date, ticker""")
def sentiment_by_ticker_date(spark, sf_dir):
    df = sentiment.by_ticker_date(scored(spark, sf_dir))
    return rounded(df, *[f"avg_{c}" for c in (*_PROBS, "post_score")])


@query(f"WITH {_SCORED} SELECT ticker, {_MEANS}, count(*) AS post_count, {_LABEL} AS sentiment_label FROM scored GROUP BY ticker")
def sentiment_by_ticker(spark, sf_dir):
    return rounded(sentiment.overall(scored(spark, sf_dir), "ticker"), *_PROBS)


@query(f"WITH {_SCORED} SELECT ticker, source, {_MEANS}, count(*) AS post_count, {_LABEL} AS sentiment_label FROM scored GROUP BY ticker, source")
def sentiment_by_source(spark, sf_dir):
    return rounded(sentiment.overall(scored(spark, sf_dir), "ticker", "source"), *_PROBS)


@query(f"""WITH {_SCORED} SELECT coalesce(ticker, 'all') AS ticker, coalesce(source, 'all') AS source, coalesce(date, 'all') AS date, count(*) AS posts,
  {_six(_mean('sentiment_score'))} AS sentiment_score FROM scored GROUP BY ROLLUP (ticker, source, date)""")
def sentiment_rollup(spark, sf_dir):
    out = scored(spark, sf_dir).rollup("ticker", "source", "date").agg(F.count("*").alias("posts"), sentiment.mean("sentiment_score").alias("sentiment_score"))
    return rounded(out, "sentiment_score").withColumns({c: F.coalesce(c, F.lit("all")) for c in ("ticker", "source", "date")})


@query(f"WITH {POSTS_SQL} SELECT ticker, round(coalesce(avg(post_score), 0), 6) AS avg_post_score, count(*) AS post_count FROM posts WHERE {_VALID} GROUP BY ticker")
def post_score_summary(spark, sf_dir):
    return valid_posts(spark, sf_dir).groupBy("ticker").agg(F.round(F.coalesce(F.avg("post_score"), F.lit(0.0)), 6).alias("avg_post_score"), F.count("*").alias("post_count"))


@query(f"""WITH {_SCORED} SELECT ticker, CAST(least(100, greatest(0, floor((avg(sentiment_score) + 1) / 2 * 100 + 0.5))) AS INTEGER) AS gauge,
  CASE WHEN floor((avg(sentiment_score) + 1) / 2 * 100 + 0.5) >= 65 THEN 'green' WHEN floor((avg(sentiment_score) + 1) / 2 * 100 + 0.5) >= 40 THEN 'amber' ELSE 'red' END AS band,
  CAST(floor(avg(positive_prob) * 100 + 0.5) AS INTEGER) AS positive_pct FROM scored GROUP BY ticker""")
def ui_score_mix(spark, sf_dir):
    m = scored(spark, sf_dir).groupBy("ticker").agg(F.avg("sentiment_score").alias("s"), F.avg("positive_prob").alias("p"))
    gauge = F.least(F.lit(100), F.greatest(F.lit(0), F.floor((F.col("s") + 1) / 2 * 100 + 0.5))).cast("int")
    return m.select("ticker", gauge.alias("gauge"), F.when(gauge >= 65, "green").when(gauge >= 40, "amber").otherwise("red").alias("band"), F.floor(F.col("p") * 100 + 0.5).cast("int").alias("positive_pct"))


def _phrases_sql(phrases: tuple[str, ...]) -> str:
    import re

    if not phrases:
        return "false"
    body = "|".join(re.escape(p).replace("\\ ", " ").replace("\\-", "-") for p in phrases).replace("'", "''")
    return f"regexp_matches(text, '(?i)(^|[^A-Za-z0-9])({body})([^A-Za-z0-9]|$)')"


def _matched_sql(a: fixed.Alias) -> str:
    low = {c.casefold() for c in a.contextual}
    direct = tuple(t for t in (a.ticker, a.cashtag, a.company, *a.strong) if t.casefold() not in low)
    return f"(NOT {_phrases_sql(a.exclusions)} AND ({_phrases_sql(direct)} OR ({_phrases_sql(a.contextual)} AND {_phrases_sql(a.context)})))"


_MAPPED = f"WITH {POSTS_SQL}, m AS (SELECT event_id, ticker, {', '.join(f'{_matched_sql(a)} AS m_{a.ticker}' for a in fixed.ALIASES)} FROM posts)"
_COUNT = " + ".join(f"CAST(m_{t} AS INTEGER)" for t in fixed.TICKERS)
_OUTCOME = f"CASE WHEN {_COUNT} > 1 THEN 'ambiguous' WHEN {_COUNT} = 1 THEN 'assigned' ELSE 'unmatched' END"


@query(f"{_MAPPED} SELECT event_id, concat_ws(',', {', '.join(f'CASE WHEN m_{t} THEN chr(39) END'.replace('chr(39)', repr(t)) for t in fixed.TICKERS)}) AS matched, {_OUTCOME} AS outcome FROM m")
def ticker_mapping(spark, sf_dir):
    return matching.with_tickers(adapters.posts(spark, sf_dir)).select("event_id", F.array_join("matched", ",").alias("matched"), "outcome")


@query(f"{_MAPPED} SELECT {_OUTCOME} AS outcome, count(*) AS items FROM m GROUP BY 1")
def mapping_outcomes(spark, sf_dir):
    return matching.with_tickers(adapters.posts(spark, sf_dir)).groupBy("outcome").agg(F.count("*").alias("items"))


def _word_hits_sql(terms: tuple[str, ...]) -> str:
    return " + ".join(f"CAST({_phrases_sql((t,))} AS INTEGER)" for t in terms)


@query(f"WITH {POSTS_SQL} SELECT event_id, CAST({_word_hits_sql(fixed.POSITIVE)} AS INTEGER) AS pos_hits, CAST({_word_hits_sql(fixed.NEGATIVE)} AS INTEGER) AS neg_hits FROM posts")
def strict_hits(spark, sf_dir):
    """Lexicon terms as whole words."""
    return sentiment.with_hits(adapters.posts(spark, sf_dir), strict=True).select("event_id", "pos_hits", "neg_hits")


_STRICT = f"WITH {POSTS_SQL}, m AS (SELECT event_id, {', '.join(f'{_matched_sql(a)} AS m_{a.ticker}' for a in fixed.STRICT_ALIASES)} FROM posts)"


@query(f"{_STRICT} SELECT event_id, concat_ws(',', {', '.join(f'CASE WHEN m_{t} THEN {t!r} END' for t in fixed.TICKERS)}) AS matched, {_OUTCOME} AS outcome FROM m")
def strict_mapping(spark, sf_dir):
    """Ticker mapping without the generic words among one company's names."""
    found = matching.with_tickers(adapters.posts(spark, sf_dir), aliases=fixed.STRICT_ALIASES)
    return found.select("event_id", F.array_join("matched", ",").alias("matched"), "outcome")


def _rule_sql(kind: str, pattern: str) -> str:
    if kind == "literal":
        return _phrases_sql((pattern,))
    return "regexp_matches(text, '(?i)" + pattern.replace("'", "''") + "')"


def _categories_sql() -> str:
    names = sorted(fixed.CATEGORIES)
    parts = [f"CASE WHEN {' OR '.join(_rule_sql(k, p) for c, k, p in fixed.RULES if c == n)} THEN '{n}' END" for n in names]
    return f"concat_ws(',', {', '.join(parts)})"


@query(f"WITH {POSTS_SQL} SELECT event_id, {_categories_sql()} AS categories FROM posts")
def copy_lint(spark, sf_dir):
    df = matching.lint(adapters.posts(spark, sf_dir), F.lit("generated_summary"))
    return df.select("event_id", F.array_join("categories", ",").alias("categories"))


_SCOPES = (*fixed.GENERATED_SCOPES, *fixed.RAW_SCOPES)


@query(f"""WITH {POSTS_SQL}, s AS (SELECT event_id, [{', '.join(map(repr, _SCOPES))}][CAST(event_id % 6 AS INTEGER) + 1] AS scope, {_categories_sql()} AS found FROM posts)
  SELECT scope, count(*) AS items, CAST(sum(CASE WHEN scope LIKE 'publisher%' OR found = '' THEN 0 ELSE 1 END) AS BIGINT) AS flagged FROM s GROUP BY scope""")
def copy_lint_by_scope(spark, sf_dir):
    df = adapters.posts(spark, sf_dir).withColumn("scope", adapters.pick(_SCOPES, F.col("event_id") % 6))
    return matching.lint(df, F.col("scope")).groupBy("scope").agg(F.count("*").alias("items"), F.count_if(F.size("categories") > 0).alias("flagged"))


@query(f"""SELECT doc_id, CAST({_hits_sql(fixed.POSITIVE + fixed.NEGATIVE)} AS INTEGER) AS hits FROM documents""")
def document_lexicon_hits(spark, sf_dir):
    d = adapters.table(spark, sf_dir, "documents")
    return d.select("doc_id", term_hits(F.col("text"), fixed.POSITIVE + fixed.NEGATIVE).alias("hits"))


@query("SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '')) AS INTEGER) AS words FROM conversations")
def turn_words(spark, sf_dir):
    c = adapters.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", word_count(F.col("text")).alias("words"))
