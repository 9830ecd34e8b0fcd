"""Cited summaries: prompt text, schema and citation checks, guardrail status, a deterministic generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, word_count
from .matching import categories
from .stories import shared_checkpoints

LABEL_WORDS = (1, 8)
SENTENCES = (2, 4)


def prompt(ticker: Column, day: Column, stories: Column) -> Column:
    """The text that a generator gets: one block for each member story, null day left out."""
    block = F.transform(stories, lambda s: F.concat(
        F.lit("- id: "), s["id"], F.lit("\n  title: "), s["title"], F.lit("\n  description: "), s["description"],
        F.lit("\n  outlet: "), s["outlet"], F.lit("\n  time: "), s["published_at"],
    ))
    head = F.array_compact(F.array(F.concat(F.lit("Ticker: "), ticker), F.when(F.coalesce(day, F.lit("")) != "", F.concat(F.lit("Trading day: "), day)), F.lit("Member stories:")))
    return F.array_join(F.concat(head, block), "\n")


def violations(label: Column, sentences: Column, members: Column) -> Column:
    """Names of the rules that a summary breaks; ``sentences`` are (text, citation_ids), ``members`` story ids."""
    words, n = word_count(F.coalesce(label, F.lit(""))), F.size(F.coalesce(sentences, F.array().cast(SENTENCE_ARRAY)))
    blank = F.exists(sentences, lambda s: strip(F.coalesce(s["text"], F.lit(""))) == "")
    uncited = F.exists(sentences, lambda s: F.coalesce(F.size(s["citation_ids"]), F.lit(0)) < 1)
    cited = F.array_distinct(F.flatten(F.transform(sentences, lambda s: s["citation_ids"])))
    foreign = F.size(F.array_except(cited, members)) > 0
    return F.array_compact(F.array(
        F.when((words < LABEL_WORDS[0]) | (words > LABEL_WORDS[1]), "label_length"),
        F.when((n < SENTENCES[0]) | (n > SENTENCES[1]), "sentence_count"),
        F.when(blank, "blank_sentence"), F.when(uncited, "no_citation"), F.when(foreign, "unresolved_citation"),
    ))


SENTENCE_ARRAY = "array<struct<text: string, citation_ids: array<string>>>"


def status(first_ok: Column, second_ok: Column) -> Column:
    """One retry, then the theme is shown without a summary."""
    return F.when(first_ok, "accepted").when(second_ok, "accepted_after_retry").otherwise("degraded")


def acceptable(label: Column, sentences: Column, members: Column) -> Column:
    text = F.array_join(F.transform(sentences, lambda s: s["text"]), " ")
    return (F.size(violations(label, sentences, members)) == 0) & (F.size(categories(F.concat_ws(" ", label, text))) == 0)


def summarize(themes: DataFrame) -> DataFrame:
    """An extractive summary for ``theme_id, ticker, stories``: the titles of the first stories, each cited. A theme without stories is an error."""
    told = F.slice(F.col("stories"), 1, SENTENCES[1])
    told = F.when(F.size("stories") == 1, F.concat(told, told)).otherwise(told)
    lines = F.transform(told, lambda s: F.struct(F.concat(s["outlet"], F.lit(" reported: "), s["title"]).alias("text"), F.array(s["id"]).alias("citation_ids")))
    first = F.array_join(F.slice(F.filter(F.split(F.get("stories", F.lit(0))["title"], r"\s+"), lambda w: w != ""), 1, 6), " ")
    empty = F.raise_error(F.lit("a theme needs at least one story")).cast(SENTENCE_ARRAY)
    return themes.withColumns({"label": F.concat_ws(" ", F.col("ticker"), first), "sentences": F.when(F.size("stories") > 0, lines).otherwise(empty)})


def resolved(summaries: DataFrame) -> DataFrame:
    """Citations joined with their member stories, in order of sentence and citation."""
    cited = summaries.select("theme_id", "stories", F.posexplode("sentences").alias("sentence", "s")).select("theme_id", "stories", "sentence", F.posexplode("s.citation_ids").alias("place", "id"))
    story = F.get(F.filter("stories", lambda s: s["id"] == F.col("id")), F.lit(0))
    return cited.select("theme_id", "sentence", "place", "id", story["title"].alias("headline"), story["outlet"].alias("outlet"), story["published_at"].alias("published_at"))


def with_retry(themes: DataFrame, generate) -> DataFrame:
    """Summaries of ``generate(themes, attempt)`` that pass the rules; the second attempt gets only what failed in the first.

    ``generate`` returns the themes with ``label`` and ``sentences``. It may
    answer at random, so each attempt is checkpointed before its rows are
    divided: every theme comes out once. A theme that fails twice is degraded:
    it keeps its stories and has no summary.
    """
    shared_checkpoints(themes.sparkSession)
    ok = F.coalesce(acceptable(F.col("label"), F.col("sentences"), F.transform("stories", lambda s: s["id"])), F.lit(False))
    first = generate(themes, 1).withColumn("ok", ok).checkpoint()
    again = generate(first.where(~F.col("ok")).select(*themes.columns), 2).withColumn("ok", ok).checkpoint()
    kept = F.when(F.col("ok"), F.col("label")), F.when(F.col("ok"), F.col("sentences"))
    second = again.select(*themes.columns, kept[0].alias("label"), kept[1].alias("sentences"), F.when(F.col("ok"), "accepted_after_retry").otherwise("degraded").alias("status"))
    return first.where("ok").select(*themes.columns, "label", "sentences", F.lit("accepted").alias("status")).unionByName(second)
