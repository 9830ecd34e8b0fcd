import itertools
import random
import re

import pytest
import xxhash

from tidemark.llm import simhash

SCHEMA = "doc_id bigint, text string, id string, fp string"


def plain_fingerprint(text: str | None) -> int:
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(rows):
    fps = {i: plain_fingerprint(t) for i, t in rows}
    comp = {i: i for i in fps}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            comp[y] = x
    return {i: (f"{fps[i]:016x}", find(i)) for i in fps}


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    return {r["id"]: (f"{r['fp'] & (2**64 - 1):016x}", r["component"]) for r in simhash.near_duplicates(df).collect()}


def test_golay_keys_meet_within_one_error():
    import numpy as np

    rng = random.Random(1)
    words = np.array([rng.getrandbits(23) for _ in range(500)])
    values, there = simhash.segment_keys(words)
    sets = [set(v[t].tolist()) for v, t in zip(values, there)]
    assert {len(s) for s in sets} == {1, 6}
    for bit in range(23):
        v, t = simhash.segment_keys(words ^ (1 << bit))
        assert all(s & set(x[y].tolist()) for s, x, y in zip(sets, v, t))


def test_every_pair_within_three_bits_shares_a_key():
    import numpy as np

    rng = random.Random(2)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        rows, keys = simhash.keys_of(np.array([a, b], np.uint64))
        assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())


def test_bucket_links_keep_groups_connected():
    import numpy as np

    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = np.array(sorted({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(80)}), np.uint64)
    x, y = simhash.bucket_links(np.zeros(len(fps), np.int64), fps)
    assert len(x) < len(fps)
    assert all(int(a ^ b).bit_count() <= 3 for a, b in zip(x, y))


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        words = rng.choices(vocab, k=rng.choice([1, 2, 3, 40, 300]))
        rows.append((i * 7, " ".join(words)))
        if i % 3 == 0:
            rows.append((i * 7 + 1, "\t".join(words).upper()))
            words[len(words) // 2] = "changed"
            rows.append((i * 7 + 2, " ".join(words)))
    rows += [(9001, None), (9002, ""), (9003, " \n "), (9004, "a" * 100_000), (9005, "x y " * 20_000), (9006, "É é É")]
    assert found(spark, rows) == plain_components(rows)


def test_documents_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, rows) == plain_components(rows)


def test_empty_table_and_repeated_rows(spark):
    assert found(spark, []) == {}
    df = spark.createDataFrame([(1, "a b c d", None, None)] * 3 + [(None, "a b c d", None, None)], SCHEMA)
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == 4 and {r["component"] for r in rows} == {1}
    kept = simhash.keep_one(df).collect()
    assert [(r.doc_id, r.text) for r in kept] == [(1, "a b c d")]


@pytest.mark.parametrize("limit", [4])
def test_buckets_dealt_as_blocks(spark, limit):
    rng = random.Random(5)
    base = rng.getrandbits(63)
    fps = sorted({base ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for _ in range(60)})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp bigint")

    def roots(pairs):
        comp = {f: f for f in fps}

        def find(x):
            while comp[x] != x:
                x = comp[x]
            return x

        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            comp[y] = x
        return {f: find(f) for f in fps}

    got = roots((r.a, r.b) for r in simhash.links(nodes, bucket_limit=limit).collect())
    assert got == roots((a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3)
