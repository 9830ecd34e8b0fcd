import random

from tidemark.llm import nearcopies


def variants(n, words=450):
    """Near copies of one text, one word changed in each."""
    base = [f"w{i}" for i in range(words)]
    return [(i, " ".join(f"x{i}" if k == i * 7 else w for k, w in enumerate(base))) for i in range(n)]


def test_pairs_grow_as_the_group_not_as_its_square(spark, monkeypatch):
    seen, plain = [], nearcopies._verified

    def verified(pairs, sets):
        seen.append(pairs.count())
        return plain(pairs, sets)

    monkeypatch.setattr(nearcopies, "_verified", verified)
    monkeypatch.setattr(nearcopies, "SHORT", n := 60)
    docs = spark.createDataFrame(variants(n), "doc_id bigint, text string")
    assert {r.component for r in nearcopies.near_copies(docs, rid_col=None).collect()} == {0}
    assert n - 1 <= sum(seen) <= 12 * n, seen


def test_small_bucket_whose_least_links_to_none(spark, monkeypatch):
    """One bucket for all: two groups and a loner, so pairs beside the least decide."""
    r = random.Random(8)
    other = [" ".join(f"v{r.randrange(9000)}" for _ in range(400)) for _ in range(2)]
    texts = [t for _, t in variants(4)] + [other[0], other[0] + " more", other[1]]
    monkeypatch.setattr(nearcopies, "NEAR", 184)
    keys = nearcopies._golay_keys

    def one_key(batches):
        for b in keys(batches):
            yield type(b).from_arrays([nearcopies.pa.array([7] * b.num_rows, nearcopies.pa.int64()), b.column(1), b.column(2)], names=b.schema.names)

    monkeypatch.setattr(nearcopies, "_golay_keys", one_key)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x.id: x.component for x in nearcopies.near_copies(docs, rid_col=None).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6}


def test_bucket_size_does_not_decide_a_link(spark, monkeypatch):
    """Small sets whose fingerprints are far apart: one bucket of every size gives the same links."""
    r = random.Random(4)
    texts = []
    for _ in range(6):
        base = [f"w{r.randrange(9000)}" for _ in range(9)]
        texts += [" ".join(base), " ".join(base[:8])]
    texts.append("alone and with no copy at all")
    keys = nearcopies._golay_keys

    def one_key(batches):
        for b in keys(batches):
            yield type(b).from_arrays([nearcopies.pa.array([7] * b.num_rows, nearcopies.pa.int64()), b.column(1), b.column(2)], names=b.schema.names)

    monkeypatch.setattr(nearcopies, "_golay_keys", one_key)
    for rows in (texts[:12], texts):
        docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
        found = []
        for short in (1, len(rows) - 1, len(rows), 99):
            monkeypatch.setattr(nearcopies, "SHORT", short)
            found.append(sorted(map(tuple, nearcopies.near_copies(docs, rid_col=None).collect())))
        assert all(f == found[0] for f in found) and found[0] == [(i, i // 2 * 2) for i in range(len(rows))]


def test_far_fingerprints_of_similar_sets(spark):
    """Pairs of 8 and 9 words, similarity 0.8: none is farther apart than ``NEAR``."""
    r, most = random.Random(5), 0
    for _ in range(4000):
        base = [f"w{r.randrange(10**6)}" for _ in range(9)]
        x, y = (nearcopies.sketch(nearcopies.shingles(" ".join(base[:n]).encode()))[0] for n in (9, 8))
        most = max(most, sum(int(a ^ b).bit_count() for a, b in zip(x, y)))
    assert 52 < most <= nearcopies.NEAR
