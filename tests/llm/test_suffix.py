import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import suffix

SCHEMA = "doc_id bigint, text string, id string, kept string, removed string, rid string"


def plain(rows):
    raw = [(t or "").encode() for _, t in rows]
    seen: dict[bytes, list] = {}
    for i, b in enumerate(raw):
        for p in range(len(b) - suffix.DEPTH + 1):
            seen.setdefault(b[p : p + suffix.DEPTH], []).append((i, p))
    cover = [np.zeros(len(b), bool) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                cover[i][p : p + suffix.DEPTH] = True
    out = []
    for (doc_id, _), b, c in zip(rows, raw, cover):
        edges = np.diff(np.concatenate([[0], c.astype(int), [0]]))
        kept = bytes(np.frombuffer(b, np.uint8)[~c])
        out.append((doc_id, len(b), int(c.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", "k", "r", "q") for i, t in rows], SCHEMA)
    out = []
    for r in suffix.remove_repeats(df, **options).collect():
        n = len((r["text"] or "").encode())
        out.append((r["id"], n, sum(s["end"] - s["start"] for s in r["removed"]), len(r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest()))
        assert r["other"]["rid"] == "q"
    return sorted(out, key=str)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))


def cases(seed):
    rng = random.Random(seed)
    common = prose(rng, 60)
    rows = []
    for i in range(40):
        text = prose(rng, rng.choice([5, 60, 300]))
        if i % 2:
            text = prose(rng, rng.randint(0, 30)) + common + text
        rows.append((i, text))
    rows += [(100 + i, rows[3][1]) for i in range(5)]
    near = prose(rng, 500).split()
    for i in range(6):
        words = list(near)
        words[rng.randrange(500)] = "changed"
        rows.append((200 + i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, "short"), (303, "a" * 199), (304, "b" * 201), (305, "ab" * 400), (306, "é" * 150), (307, "x" + "é" * 250)]
    rows += [(308, common[:199]), (309, common[:200]), (310, common[5:205] + common[:220]), (0, rows[0][1]), (None, prose(rng, 80))]
    return rows


def test_difference_cover():
    cover = suffix.difference_cover(8)
    assert {(a - b) % 8 for a in cover for b in cover} == set(range(8))


@pytest.mark.parametrize("hot_rows", [200, 3, 0])
def test_against_brute_force(spark, hot_rows):
    rows = cases(11)
    assert found(spark, rows, hot_rows=hot_rows) == plain(rows)


def test_block_orders_windows_of_all_residues():
    rng = random.Random(12)
    part = "".join(rng.choices("ab", k=260))
    raw = (part + "c" + part + "dd" + part[:230] + "eee" + "ab" * 150 + "f" + "ab" * 150).encode()
    at = np.arange(len(raw) - suffix.DEPTH + 1)
    order, same = suffix.Block(np.frombuffer(raw, np.uint8)).sort(np.zeros(len(at), np.int64), at)
    strings = [raw[p : p + suffix.DEPTH] for p in at]
    got = [strings[p] for p in order]
    assert got == sorted(got)
    assert same.tolist() == [False] + [a == b for a, b in zip(got, got[1:])]


def test_long_text_over_several_slabs(spark, monkeypatch):
    rng = random.Random(13)
    text = prose(rng, 9000)
    rows = [(1, text), (2, prose(rng, 50) + text[20_000:45_000] + prose(rng, 9)), (3, text[:1000])]
    monkeypatch.setattr(suffix, "SLAB", 1 << 12)
    raw = np.frombuffer(text.encode(), np.uint8)
    whole = suffix.runs(raw, np.array([0, len(raw)]))
    assert whole[2].sum() == len(raw) - suffix.DEPTH + 1 and whole[2].max() <= suffix.SPAN
    assert found(spark, rows) == plain(rows)


def test_documents_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, rows) == plain(rows)


def test_empty_table_and_cleaned_documents(spark):
    assert found(spark, []) == []
    rng = random.Random(14)
    shared = "é" + prose(rng, 60) + "é"
    df = spark.createDataFrame([(1, "start " + shared + " end", "a", "b", "c", "d"), (2, shared, "a", "b", "c", "d"), (3, None, None, None, None, None)], SCHEMA)
    out = suffix.without_repeats(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "start  end", 2: "", 3: None}
