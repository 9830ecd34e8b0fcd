import random

import numpy as np
import pytest

from tidemark.llm import decontam

SCHEMA = "doc_id bigint, text string, id string, item_id string, overlap string"
ITEMS = "item_id bigint, text string"


def plain(index, text):
    """All items of all passages, verified without retrieval."""
    ws, out = decontam.words(text), {}
    for tier in index.tiers:
        for s in range(0, max(1, len(ws) - tier.length), tier.length):
            part = ws[s : s + 2 * tier.length]
            there = {tuple(part[i : i + n]) for n in range(1, index.width + 1) for i in range(len(part) - n + 1)}
            for item in tier.items:
                got = index.overlap(item, there)
                if got and got > out.get(index.ids[item], (0.0,)):
                    out[index.ids[item]] = got
    return out


def corpus(seed):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(500)]
    prose = lambda n: [rng.choice(common if rng.random() < 0.6 else rare) for _ in range(n)]
    items = [(i, " ".join(prose(rng.choice([3, 6, 15, 30, 59, 90]))) + ".\n" + " ".join(prose(rng.choice([1, 4, 9])))) for i in range(70)]
    items += [(100, "same words here to be found twice"), (101, "same words here to be found twice"), (102, ""), (103, "one")]
    docs = []
    for i in range(80):
        ws = prose(rng.choice([0, 20, 400]))
        if i % 2:
            leak = decontam.words(rng.choice(items)[1])
            if i % 4 == 1 and len(leak) > 5:
                for _ in range(rng.randint(1, 3)):
                    leak[rng.randrange(len(leak))] = "changed"
            at = rng.randint(0, len(ws))
            ws[at:at] = leak
        docs.append((i, " ".join(ws).upper() if i % 3 else ", ".join(ws)))
    return items, docs


@pytest.mark.parametrize("seed", range(8))
def test_retrieval_loses_nothing(seed):
    items, docs = corpus(seed)
    index = decontam.Index(items)
    for _, text in docs:
        assert index.search(text) == plain(index, text)


def test_bm25_threshold_retrieval_is_exact():
    rng = random.Random(1)
    items, docs = corpus(1)
    index = decontam.Index(items)
    for tier in index.tiers:
        for _ in range(60):
            terms = rng.sample(range(1, len(index.number) + 1), min(60, len(index.number)))
            score = {k: 0.0 for k in tier.items}
            for t in terms:
                if t in tier.postings:
                    for k, x in zip(*tier.postings[t][:2], strict=True):
                        score[tier.items[int(k)]] += float(x)
            got = index.retrieve(tier, terms)
            assert sorted(got) == sorted(k for k, s in score.items() if s >= 1 - 1e-9)


@pytest.mark.parametrize("cells", [1, 7, 1 << 19])
def test_bounds_in_slices_equal_plain_bounds(monkeypatch, cells):
    """The first test lets through each passage whose block maxima reach one, whatever the slices."""
    monkeypatch.setattr(decontam, "CELLS", cells)
    items, docs = corpus(4)
    index = decontam.Index(items)
    for _, text in docs[:30]:
        ws = decontam.words(text)
        terms = np.array([index.number.get(w, 0) for w in ws], np.int64)
        for tier in index.tiers:
            starts = np.arange(0, max(1, len(ws) - tier.length), tier.length)
            ends = np.minimum(starts + 2 * tier.length, len(ws))
            want = []
            for s, e in zip(starts, ends):
                sums = {}
                for t in set(terms[s:e].tolist()) - {0}:
                    for b, x in tier.postings.get(t, (0, 0, {}))[2].items():
                        sums[b] = sums.get(b, 0) + x
                want.append(any(x >= 1 - 1e-9 for x in sums.values()))
            assert index.hopeful(tier, terms, starts, ends).tolist() == want


def test_documents(spark):
    items, docs = corpus(3)
    docs = [*docs, (900, None), (901, ""), (5, docs[5][1]), (None, items[3][1])]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in docs], SCHEMA)
    bench = spark.createDataFrame([*items, (104, None)], ITEMS)
    index = decontam.Index(items)
    want = sorted((str(i), item, *map(float, got)) for i, t in docs for item, got in plain(index, t).items())
    for limit in (20_000, 30):
        out = decontam.contaminated(df, bench, items=limit)
        got = sorted((str(r.id), r.item_id, r.overlap, r.question, r["answer"]) for r in out.collect())
        assert got == want
    kept = decontam.without_leaks(df, bench)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in docs if not plain(index, t))


def test_empty_tables(spark):
    df, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEMS)
    assert decontam.contaminated(df, bench).collect() == []
    full = spark.createDataFrame([(1, "a b c", "x", "y", "z")], SCHEMA)
    assert decontam.without_leaks(full, bench).count() == 1


def test_whole_items_of_the_benchmark_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    verbatim = {(r.doc_id, i) for r in docs.collect() for i, t in items if " ".join(decontam.words(t)) in " ".join(decontam.words(r.text))}
    got = {(r.id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert verbatim and verbatim <= got
