import random
import zlib

import numpy as np
import pytest

from tidemark.llm import sharding

SCHEMA = "doc_id bigint, text string, size string, shard string, digest string"


def plain_minimax(sizes, shards):
    best = None
    low, high = max(sizes), sum(sizes)
    for c in range(low, high + 1):
        used, fill = 1, 0
        for s in sizes:
            if fill + s > c:
                used, fill = used + 1, 0
            fill += s
        if used <= shards:
            best = c
            break
    return best


@pytest.mark.parametrize("seed", range(30))
def test_minimax_of_blocks(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 5, rng.randint(1, 40)]) for _ in range(rng.randint(1, 120))]
    if seed % 3 == 0:
        sizes[rng.randrange(len(sizes))] = 500
    shards, width = rng.randint(1, 9), rng.randint(1, 30)
    blocks = [sizes[i : i + width] for i in range(0, len(sizes), width)]
    ordered = sharding.Ordered([sum(b) for b in blocks], max(sizes), lambda i: np.array(blocks[i]), keep=2)
    best, cuts = sharding.minimax(ordered, shards)
    assert best == plain_minimax(sizes, shards)
    at = [min(b * width + k, len(sizes)) for b, k in cuts]
    bounds = [0, *at, len(sizes)]
    assert at == sorted(at) and max(sum(sizes[a:b]) for a, b in zip(bounds, bounds[1:])) == best


@pytest.mark.parametrize(("rows", "shards"), [(400, 8), (3, 8), (0, 8)])
def test_shards_of_documents(spark, rows, shards):
    rng = random.Random(rows)
    pool = ["é" * rng.randint(0, 300) for _ in range(150)] + [None, ""]
    data = [(rng.choice([i, i, 7, None]), "copy" * 30 if i % 3 == 0 else rng.choice(pool), "s", "h", "d") for i in range(rows)]
    out = sharding.shard(spark.createDataFrame(data, SCHEMA), shards, block=20).collect()
    want = sorted((str(d[0]), len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in data)
    assert sorted((str(r.id), r["size"], r.text_crc32) for r in out) == want
    totals, of = {}, {}
    for s in range(shards):
        own = sorted(r.slot for r in out if r.shard == s)
        assert own == list(range(len(own)))
        totals[s] = sum(r["size"] for r in out if r.shard == s)
    for r in out:
        assert of.setdefault((r["size"], r.text_crc32), r.shard) == r.shard
    if rows:
        groups = {}
        for r in out:
            g = groups.setdefault((r["size"], r.text_crc32), [r.first, 0])
            g[1] += r["size"]
        firsts = [g[0] for g in groups.values()]
        if len(set(firsts)) == len(firsts):
            ordered = [g[1] for g in sorted(groups.values(), key=lambda g: (g[0] is not None, g[0] or 0))]
            assert max(totals.values()) == plain_minimax(ordered, shards)


def test_distinct_ids_reach_the_minimum(spark):
    rng = random.Random(9)
    data = [(i, "w" * rng.randint(1, 90) + str(i % 40), "s", "h", "d") for i in range(200)]
    out = sharding.shard(spark.createDataFrame(data, SCHEMA), 5, block=16).collect()
    groups = {}
    for i, t, *_ in data:
        groups.setdefault(t, [i, 0])[1] += len(t) + 1
    totals = [sum(r["size"] for r in out if r.shard == s) for s in range(5)]
    assert max(totals) == plain_minimax([g[1] for g in sorted(groups.values())], 5)


@pytest.mark.parametrize("at", [0, 550, 1100])
def test_a_large_group_leaves_the_others_even(at):
    sizes = [25 + i % 5 for i in range(1100)]
    sizes.insert(at, 100_000)
    blocks = [sizes[i : i + 64] for i in range(0, len(sizes), 64)]
    ordered = sharding.Ordered([sum(b) for b in blocks], max(sizes), lambda i: np.array(blocks[i]))
    best, cuts = sharding.minimax(ordered, 8)
    bounds = [0, *[b * 64 + k for b, k in cuts], len(sizes)]
    totals = sorted(sum(sizes[a:b]) for a, b in zip(bounds, bounds[1:]))
    assert totals[-1] == best and totals[0] > 0 and totals[-2] < 1.6 * totals[0]
