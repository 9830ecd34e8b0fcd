"""Rule tables of any size: an inverted index by each phrase's rarest pair of neighbouring tokens.

A phrase that stands in a text with no ASCII letter or digit on either side
has its tokens (runs of ASCII letters and digits) beside each other in the
text. So texts and phrases are joined by equality on the one pair of
neighbours of a phrase (or its only token) that the fewest texts have, and
only what meets is verified by the phrase itself. A single token won't do: the
rarest one of two frequent words is in most texts, and each would be searched.
Phrases with a pair that no text has go at once. Rules that are regular
expressions are code; a fixed number of them stays in literal columns
(:func:`matching.categories`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stories import _stored, shared_checkpoints

#: Signs that equal an ASCII letter in any case (long s, Kelvin sign, dotted and dotless i).
_FOLDED = "ABCDEFGHIJKLMNOPQRSTUVWXYZſKİı", "abcdefghijklmnopqrstuvwxyzskii"


def tokens(c: Column) -> Column:
    """The tokens of a text in their order."""
    return F.array_remove(F.split(F.translate(F.coalesce(c, F.lit("")), *_FOLDED), "[^a-z0-9]+"), "")


def neighbours(t: Column, n: Column) -> Column:
    """Hashes of the first ``n`` tokens, each with the next; of the token alone where none follows."""
    return F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda x, y: F.xxhash64(x, y))


def phrase_pattern(phrase: Column) -> Column:
    """The pattern of a phrase that no ASCII letter or digit touches, in any case."""
    quoted = F.replace(phrase, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit(r"(?iU)(?<![A-Za-z0-9])\Q"), quoted, F.lit(r"\E(?![A-Za-z0-9])"))


def phrase_hits(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """``id, rule``: which phrases (``rule, phrase``) stand in which texts (``id, text``).

    Null texts hold nothing; null phrases and those without a letter or digit
    are held by nothing. Repeated rows of either side give their pair once.
    """
    shared_checkpoints(texts.sparkSession)
    t, n = F.col("tokens"), F.size("tokens")
    asked = phrases.select("rule", "phrase", tokens(F.col("phrase")).alias("tokens"))
    # stored, as its size then is known: a small one is sent to the texts, whose keys stay where they are
    asked = _stored(asked.select("rule", "phrase", F.explode(neighbours(t, F.when(n < 2, n).otherwise(n - 1))).alias("key")).distinct())
    keys = F.array_distinct(F.concat(neighbours(t, n), F.transform(t, lambda x: F.xxhash64(x))))
    words = texts.select("id", tokens(F.col("text")).alias("tokens")).select("id", F.explode(keys).alias("key"))
    found = _stored(words.join(asked.select("key").distinct(), "key", "left_semi"))
    counts = found.groupBy("key").agg(F.count("*").alias("n"))
    ranked = asked.join(counts, "key", "left").groupBy("rule", "phrase").agg(
        F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"), F.min(F.coalesce("n", F.lit(0))).alias("n")
    )
    rarest = ranked.where("n > 0").select("rule", "phrase", "key")
    pairs = found.join(rarest, "key").select("id", "rule", "phrase").distinct()
    met = pairs.join(texts.where(F.col("text").isNotNull()).select("id", "text"), "id")
    return met.where(F.call_function("regexp_like", F.col("text"), phrase_pattern(F.col("phrase")))).select("id", "rule").distinct()
