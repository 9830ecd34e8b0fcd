"""Lexicon sentiment: calibrated scores and their aggregates. All plain column expressions, but for model priors."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import term_hits, word_count, word_hits

SCORES = ("positive_prob", "negative_prob", "neutral_prob", "sentiment_score", "sentiment_confidence", "sentiment_label")


def normalize(p: float, n: float, u: float) -> tuple[float, float, float]:
    """Clamped at zero and summing to one; nothing left means neutral."""
    p, n, u = max(p, 0.0), max(n, 0.0), max(u, 0.0)
    total = p + n + u
    return (p / total, n / total, u / total) if total > 0 else (0.0, 0.0, 1.0)


def prior(pos: int, neg: int) -> tuple[float, float, float]:
    """Class probabilities that hit counts stand for."""
    if pos == neg:
        return 0.18, 0.18, 0.64
    win = 0.70 if max(pos, neg) >= 2 else 0.64
    return (win, 0.10, 1 - win - 0.10) if pos > neg else (0.10, win, 1 - win - 0.10)


#: When a rule applies (to the probabilities as the rules before left them), and its factor and shift.
_SHIFTS = (
    (lambda p, n, u, hits, short: abs(p - n) < fixed.GAP, fixed.CLOSE),
    (lambda p, n, u, hits, short: hits == 0 and max(p, n) > u, fixed.UNFOUNDED),
    (lambda p, n, u, hits, short: short, fixed.BRIEF),
)


def calibrate(p: float, n: float, u: float, hits: int, words: int) -> tuple[float, float, float, float, float, str]:
    """The scores of :data:`SCORES` from any prior: the rules in their order."""
    p, n, u = normalize(p, n, u)
    short = words <= fixed.SHORT_WORDS and hits <= 1
    for applies, (factor, shift) in _SHIFTS:
        if applies(p, n, u, hits, short):
            p, n, u = p * factor, n * factor, u + shift
    p, n, u = normalize(p, n, u)
    cap = fixed.SHORT_CAP if short else fixed.LONG_CAP
    # of equal probabilities positive wins, then negative; only a directional winner is capped
    if p >= n and p >= u and p > cap:
        p, u = cap, u + p - cap
    elif n > p and n >= u and n > cap:
        n, u = cap, u + n - cap
    neutral = u >= max(p, n) or (abs(p - n) < fixed.GAP and u >= fixed.NEUTRAL_FLOOR)
    return p, n, u, p - n, max(p, n, u), "neutral" if neutral else "positive" if p > n else "negative"


def outcome(pos: Column, neg: Column, words: Column) -> Column:
    """A struct of :data:`SCORES`.

    Lexicon scores depend on who leads, on one or more hits and on length
    alone, so all outcomes are worked out once for the plan and each row picks
    one of the literals. Nested arithmetic would be repeated at each use when
    projections are merged.
    """
    table = []
    for lead in range(3):
        for strong in range(2):
            for hits in range(3):
                for short in range(2):
                    most = 2 if strong else 1 if lead else 0
                    pair = ((most, most), (most, 0), (0, most))[lead]
                    table.append(calibrate(*prior(*pair), hits, fixed.SHORT_WORDS if short else fixed.SHORT_WORDS + 1))
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(SCORES, row)]) for row in table])
    lead = F.when(pos > neg, 1).when(neg > pos, 2).otherwise(0)
    at = lead * 12 + (F.greatest(pos, neg) >= 2).cast("int") * 6 + F.least(pos + neg, F.lit(2)) * 2 + (words <= fixed.SHORT_WORDS).cast("int")
    return F.element_at(rows, at + 1)


def with_hits(df: DataFrame, text_col: str = "text", strict: bool = False) -> DataFrame:
    """Hits of both term lists and words; ``strict`` counts terms as whole words, not inside others."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hits = word_hits if strict else term_hits
    return df.withColumns({"pos_hits": hits(text, fixed.POSITIVE), "neg_hits": hits(text, fixed.NEGATIVE), "words": word_count(text)})


def with_sentiment(df: DataFrame, text_col: str = "text", min_confidence: float = 0.0, strict: bool = False) -> DataFrame:
    """The rows with six score columns; a positive ``min_confidence`` filters, ``strict`` as in :func:`with_hits`."""
    hits = with_hits(df, text_col, strict).withColumn("__s", outcome(F.col("pos_hits"), F.col("neg_hits"), F.col("words")))
    out = hits.select(*df.columns, *[F.col("__s")[k].alias(k) for k in SCORES])
    return out.where(F.col("sentiment_confidence") >= min_confidence) if min_confidence > 0 else out


def rescored(df: DataFrame, prior: Column, hits: Column, words: Column) -> DataFrame:
    """Scores for priors of a model: ``prior`` is a struct ``p, n, u``; calibrated in Arrow batches."""
    kind = "positive_prob double, negative_prob double, neutral_prob double, sentiment_score double, sentiment_confidence double, sentiment_label string"

    def run(x: pd.DataFrame, h: pd.Series, w: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([calibrate(*r, a, b) for r, a, b in zip(x[["p", "n", "u"]].itertuples(index=False), h, w)], columns=list(SCORES))

    out = df.withColumn("__s", F.pandas_udf(run, kind)(prior, hits, words))
    return out.select(*df.columns, *[F.col("__s")[k].alias(k) for k in SCORES])


def mean(name: str) -> Column:
    """The mean of a score as an exact decimal sum, so that the order of rows doesn't matter."""
    return F.avg(F.col(name).cast("decimal(18,12)")).cast("double")


def by_ticker_date(scored: DataFrame) -> DataFrame:
    """Means and mention counts of each date and ticker; null keys are left out."""
    return scored.where("date IS NOT NULL AND ticker IS NOT NULL").groupBy("date", "ticker").agg(
        *(mean(c).alias(f"avg_{c}") for c in ("sentiment_score", "positive_prob", "negative_prob", "neutral_prob", "sentiment_confidence")),
        F.avg("post_score").alias("avg_post_score"),
        F.count("text").alias("mention_count"),
    )


def ticker_label(score: Column) -> Column:
    return F.when(score > fixed.TICKER_BAND, "positive").when(score < -fixed.TICKER_BAND, "negative").otherwise("neutral")


def overall(scored: DataFrame, *keys: str) -> DataFrame:
    """Means over all dates for ``keys`` (ticker, or ticker and source)."""
    out = scored.groupBy(*keys).agg(
        *(mean(c).alias(c) for c in ("positive_prob", "negative_prob", "neutral_prob", "sentiment_score", "sentiment_confidence")),
        F.count("*").alias("post_count"),
    )
    return out.withColumn("sentiment_label", ticker_label(F.col("sentiment_score")))
