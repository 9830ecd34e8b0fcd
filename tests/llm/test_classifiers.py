import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, toxicity
from tidemark.llm.common import Tables, crc_mod

SCHEMA = "doc_id bigint, text string, id string, label string, score string, hash string"
LABELS = "doc_id bigint, quality int, toxic int"


def test_label_model_recovers_accuracies_and_dependence():
    rng = np.random.RandomState(1)
    n, prior = 200_000, 0.1
    y = rng.rand(n) < prior
    votes = np.zeros((n, toxicity.VOTERS), np.int64)
    accuracy = rng.uniform(0.4, 0.8, toxicity.VOTERS)
    for k in range(toxicity.VOTERS - 2):
        votes[:, k] = np.where(y, rng.rand(n) < accuracy[k], rng.rand(n) < 0.02)
    votes[:, 1] = np.where(rng.rand(n) < 0.9, votes[:, 0], votes[:, 1])  # voter 1 follows voter 0
    model = toxicity.LabelModel(n, votes.sum(0).astype(float), (votes.T @ votes).astype(float), prior)
    assert np.abs(model.accuracy[2:-2] - (accuracy[2:-2] - 0.02)).max() < 0.06
    assert model.correlation[0, 1] > 5 * abs(model.correlation[0, 2])
    p = model.posterior(votes.astype(float))
    assert ((p > 0.5) == y).mean() > 0.99


def held_out_report(spark, sf, score, label, modulus, held):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    rows = score(docs, labels).withColumnRenamed("id", "doc_id").join(labels, "doc_id").where(crc_mod(F.col("doc_id"), modulus) == held)
    return [(r[label], r.score) for r in rows.select(label, "score").collect()]


def test_toxicity_held_out(spark):
    rows = held_out_report(spark, "sf0.1", toxicity.score_documents, "toxic", 3, 1)
    toxic, clean = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    assert sum(s >= 0.7 for s in toxic) / len(toxic) > 0.8
    assert sum(s >= 0.7 for s in clean) / len(clean) < 0.03


def test_quality_held_out(spark):
    rows = held_out_report(spark, "sf0.1", lambda d, x: quality.score_documents(d, quality.fit(d, x)), "quality", 4, 2)
    good, bad = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    assert sum(s >= 0.7 for s in good) / len(good) > 0.95
    assert sum(s < 0.7 for s in bad) / len(bad) > 0.9


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("mor", "tal", "ven", "sor") for b in ("an", "el", "ion", "us", "a")]
    rows, labels = [], []
    for i in range(240):
        ws = rng.choices(words, k=rng.randint(20, 80))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                ws.insert(rng.randrange(len(ws)), rng.choice(["grukon", "grukel", "vilest"]))
        junk = i % 3 == 0
        rows.append((i, " ".join(w + "$$$" if junk else w for w in ws), "a", "b", "c", "d"))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(900, None, *"abcd"), (901, "", *"abcd"), (902, "vilest grukon " * 20_000, *"abcd"), (None, rows[1][1], *"abcd"), rows[0]]
    labels += [(5000, 1, 1), (None, 0, 1), (3, 1, None), (2, None, 0), (7, 1, 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS), rows


def test_toxicity_of_odd_rows(spark, small):
    docs, labels, rows = small
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.id: r.score for r in got}
    assert by[902] >= 0.7 and by[900] == by[901] < 0.5 and by[None] == by[1]
    wrong = sum((by[i] >= 0.7) != (i % 4 == 0) for i in range(240))
    assert wrong <= 5
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.id) for r in got if r.score < 0.7)


def test_quality_of_odd_rows(spark, small):
    docs, labels, rows = small
    model = quality.fit(docs, labels)
    got = quality.score_documents(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.id: r.score for r in got}
    assert by[900] == by[901] and by[None] == by[1]
    assert sum((by[i] >= 0.7) != (i % 3 != 0) for i in range(240)) <= 5


def test_votes_are_exact_cosine_neighbours(small):
    docs, labels, _ = small
    model = quality.fit(docs, labels)
    counts = np.stack([quality.Features().vector(t) for t in ("moran talel", "venion$$$ sorus$$$", "")])
    for x, s in zip(model.project(counts), model.score(counts)):
        cosine = model.vectors @ x
        order = np.argsort(-cosine)
        edge = cosine[order[quality.NEAREST - 1]]
        weight = np.maximum(cosine[order[: quality.NEAREST]], 1e-3).astype(float) ** quality.POWER
        if edge > cosine[order[quality.NEAREST]] + 1e-6:
            assert abs(float(weight @ model.labels[order[: quality.NEAREST]] / weight.sum()) - s) < 1e-4


def test_no_labels_and_no_rows(spark, small):
    docs, _, rows = small
    none, empty = spark.createDataFrame([], LABELS), spark.createDataFrame([], SCHEMA)
    assert {r.score < 0.5 for r in toxicity.score_documents(docs, none).collect()} == {True}
    assert toxicity.score_documents(empty, none).collect() == []
    assert quality.score_documents(docs, quality.fit(docs, none)).count() == len(rows)
    assert quality.score_documents(empty, quality.fit(empty, none)).collect() == []


def test_toxicity_against_plain_votes_and_scores(spark, small):
    """Lexicon in hand, votes, moments, label model and scores are made again by plain loops."""
    docs, labels, rows = small
    classifier, _ = toxicity.fit(docs, labels, Tables(spark, "test-toxicity"))
    lexicon, texts = classifier.lexicon, sorted({r[1] or "" for r in rows})
    held = {}
    for t in texts:
        words = [w for w in re.findall(r"[^\W\d_]+", t.lower())]
        counts = {}
        for w in words:
            for term in [w, *(w[:k] + "*" for k in (4, 5, 6, 7) if len(w) > k)]:
                if term in lexicon.terms:
                    counts[term] = counts.get(term, 0) + 1
        families = list(dict.fromkeys(x[:4] for x in lexicon.terms))
        v = [int(any(families.index(x[:4]) % 12 == k for x in counts)) for k in range(12)]
        total = sum(counts.values())
        v += [int(len(counts) >= 2), int(len(counts) >= 4), int(total > 0 and total * 50 >= len(words)), -int(total == 0)]
        v += [int(sum(c.isupper() for c in t) > 0.3 * len(t)), int(t.count("!") > 0.01 * len(t))]
        held[t] = counts, np.array(v, float)
    votes = np.array([held[t][1] for t in texts])
    known = {}
    for r in labels.collect():
        if r.toxic is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            known[r.doc_id] = max(r.toxic, known.get(r.doc_id, 0))
    marked = {}
    for r in rows:
        if r[0] in known:
            marked[r[1] or ""] = max(known[r[0]], marked.get(r[1] or "", 0))
    model = toxicity.LabelModel(len(texts), votes.sum(0), votes.T @ votes, sum(marked.values()) / len(marked))
    assert np.allclose(model.accuracy, classifier.model.accuracy) and np.allclose(model.weights, classifier.model.weights)
    x = np.array([toxicity.features(len(lexicon.terms), [lexicon.terms.index(k) for k in held[t][0]], list(held[t][0].values()), held[t][1]) for t in texts])
    want = dict(zip(texts, 1 / (1 + np.exp(-(np.hstack([x, np.ones((len(x), 1))]) @ toxicity.logistic(x, model.posterior(votes)))))))
    for r in toxicity.score_documents(docs, labels).collect():
        text = next(t for i, t, *_ in rows if i == r.id) or ""
        assert abs(r.score - want[text]) < 1e-6


def test_copies_do_not_change_what_is_caught(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    two = docs.where("text IS NOT NULL AND length(text) > 500").orderBy("doc_id").limit(2)
    copies = two.crossJoin(spark.range(2500)).withColumn("doc_id", F.col("id") * 2 + 1_000_000 + F.col("doc_id") % 2).drop("id")

    def caught(table):
        rows = toxicity.score_documents(table, labels).withColumnRenamed("id", "doc_id").join(labels, "doc_id").where((F.col("toxic") == 1) & (crc_mod(F.col("doc_id"), 3) == 1))
        return {r.doc_id for r in rows.where("score >= 0.7").collect()}, rows.count()

    plain, n = caught(docs)
    many, _ = caught(docs.unionByName(copies))
    assert len(plain) >= 0.8 * n and many == plain
