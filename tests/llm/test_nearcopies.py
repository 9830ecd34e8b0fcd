import itertools
import random

import corpus_pipeline
from tidemark.llm import nearcopies
from tidemark.llm.common import written


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else frozenset()


def plain_kept(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {i: plain_shingles(t) for i, t in rows}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or (x and y and len(x & y) >= 0.8 * len(x | y)):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {find(i) for i in root}


def made(seed, groups, copies, words=60):
    """Groups of near copies: each copy changes one word of its base, or four."""
    r, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{r.randrange(5000)}" for _ in range(words)]
        for k in range(copies):
            text = list(base)
            for _ in range(1 if k % 2 else 4):
                text[r.randrange(words)] = f"v{r.randrange(5000)}"
            rows.append((len(rows), " ".join(text)))
    return [*rows, (len(rows), "a b c"), (len(rows) + 1, "A  b c"), (len(rows) + 2, "a b d"), (len(rows) + 3, None), (len(rows) + 4, " ")]


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}


def test_kept_documents_against_brute_force(spark):
    rows = made(3, 40, 5)
    assert kept(spark, rows) == plain_kept(rows)


def test_large_bands_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "SHORT", 3)
    monkeypatch.setattr(nearcopies, "BLOCK", 8)
    rows = made(5, 3, 40)
    assert kept(spark, rows) == plain_kept(rows)


def test_pipeline_keeps_no_similar_pair(spark):
    """Recall on a table with pairs that three bits of a fingerprint miss."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:]:
        if name == "suffix_array":
            break
        docs = written(stage(spark, docs, ""), f"test-{name}")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert plain_kept(rows) == {i for i, _ in rows}
