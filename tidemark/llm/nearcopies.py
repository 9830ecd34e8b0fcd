"""Near copies by Golay-code fuzzy hashing of SimHash fingerprints, verified by Jaccard similarity.

The fuzzy hashing of :mod:`simhash`, for links of a similarity of 0.8 or more
on sets of five-word shingles, which are much wider than three bits of 64:

1. Texts with equal sets of shingles are one class. A class has a fingerprint
   of 184 bits, 8 segments of 23, each a word of the Golay code.
2. A segment has one or six keys, the indices of codewords near it. Two
   segments that differ in two bits or fewer always share a key; by the
   pigeonhole principle that holds for one of the 8 if the fingerprints differ
   in 23 bits or fewer. Segments that differ in three or four bits share one
   with a probability of 0.6.
3. Each segment is joined to the least shingle of the set in an order of its
   own, so that a key's bucket doesn't grow with the square of the corpus.
   Keys are made only where that shingle occurs in several classes. At a
   similarity of 0.8 segments differ in 3.5 bits in the mean, and a pair misses
   all 8 keys with a probability of 0.005 (0.001 at 0.85; up to 0.03 for sets
   of four and five shingles).
4. Classes that share a key are candidates if their fingerprints differ in
   ``NEAR`` bits at most, whatever the bucket; that is a condition of the join
   on keys, so other pairs never leave it. Bits differ with a probability of
   0.1875 at most at a similarity of 0.8 (sets of four and five; 0.15 to 0.16
   for larger ones), and ``NEAR`` is six deviations beyond that mean, so one
   similar pair of 10^8 is beyond it. Candidates are compared by their whole
   sets of shingles. A shingle and a set are 64-bit hashes: an invented link
   needs two that agree.

In each bucket all classes are compared with the least first, which is a pair
for each class and key. Only what that leaves apart is compared further: all
pairs in a bucket of ``SHORT`` classes at most; the classes of a larger one
meet in full, in blocks of bounded size. What is connected already is never
compared again, so a group of near copies costs in proportion to its size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Side, Tables, by_part, column, id_texts, slabs, utf8
from .graph import connected_components
from .simhash import bit_counts, segment_keys

WIDTH = 5
SEGMENT, SEGMENTS = 23, 8
#: Most bits in which the fingerprints of candidates differ, in buckets of every size.
NEAR = 67
#: Buckets of so many classes at most give all pairs that their least leaves apart.
SHORT = 12
#: Classes and shingles of one block, about; two blocks meet in one task.
BLOCK, BLOCK_SHINGLES = 500, 200_000
#: Fixed value: the orders in which least shingles are taken.
_RANDOM = np.random.default_rng(11)
XOR = _RANDOM.integers(0, 1 << 64, SEGMENTS, np.uint64)
FACTOR = _RANDOM.integers(0, 1 << 64, SEGMENTS, np.uint64) | np.uint64(1)


def shingles(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted hashes of all shingles of UTF-8 bytes; a text of fewer words is one shingle, one without words has none."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n, digest = max(1, len(words) - width + 1), xxhash.xxh64_intdigest
    a, b = starts[:n].tolist(), (ends[width - 1 :] if len(words) > width else ends[-1:]).tolist()
    return np.unique(np.fromiter((digest(line[x:y]) for x, y in zip(a, b)), np.uint64, n))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits that depend on all bits of ``x`` (the finish of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments of a set's fingerprint, and the least shingle in the order of each segment."""
    least = np.full(SEGMENTS, (1 << 64) - 1, np.uint64)
    n, ones = len(hashes), np.zeros(192, np.int64)
    for i in range(0, n, 1 << 14):
        part = hashes[i : i + (1 << 14)]
        least = np.minimum(least, ((part[None, :] ^ XOR[:, None]) * FACTOR[:, None]).min(axis=1))
        wide = np.stack([part, *(_mixed(part + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in (1, 2))], axis=1)
        ones += bit_counts(wide.view(np.uint8))
    bits = (ones * 2 > n)[: SEGMENT * SEGMENTS].reshape(SEGMENTS, SEGMENT)
    return bits @ (1 << np.arange(SEGMENT)), least


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is 0.8 or more."""
    n = len(a) + len(b)
    if 9 * min(len(a), len(b)) < 4 * n:
        return False
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * n


def _hashed(text: pa.Array) -> Iterator[np.ndarray]:
    raw, offsets = utf8(text)
    raw = raw.tobytes()
    return (shingles(raw[a:b]) for a, b in itertools.pairwise(offsets.tolist()))


def _class(hashes: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(hashes.tobytes())], np.uint64).view(np.int64)[0])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slabs(batches, "text"):
        cls, size, words, least = [], [], [], []
        for h in _hashed(column(part, "text")):
            w, m = sketch(h)
            cls.append(_class(h))
            size.append(len(h))
            words.append(w)
            least.append(m.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [column(part, "id"), column(part, "rid"), pa.array(cls, pa.int64()), pa.array(size, pa.int32()), pa.array(words, pa.list_(pa.int32())), pa.array(least, pa.list_(pa.int64()))],
            names=["id", "rid", "cls", "n", "words", "least"],
        )


def _golay_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of class, segment number, its word and least shingle -> a row for each key."""
    for batch in batches:
        value, there = segment_keys(column(batch, "word").to_numpy().astype(np.int64))
        r, c = np.nonzero(there)
        mark = column(batch, "mark").to_numpy().view(np.uint64)
        keys = _mixed(mark[r] + value[r, c].astype(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), column(batch, "cls").take(pa.array(r)), column(batch, "n").take(pa.array(r))], names=["key", "cls", "n"])


def _sets(path: str):
    """Rows -> the shingles of those that the side table names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = Side(path, [])
        for batch in batches:
            text = column(batch, "text").filter(pa.array(side.holds(column(batch, "rid").to_numpy())))
            if not len(text):
                continue
            for part in slabs([pa.RecordBatch.from_arrays([text], names=["text"])], "text"):
                sets = list(_hashed(column(part, "text")))
                whole = pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(map(_class, sets), pa.int64()), whole], names=["cls", "shingles"])

    return run


def _fits(n, m):
    """Sizes that allow a similarity of 0.8."""
    return 9 * F.least(n, m) >= 4 * (n + m)


def _candidates(shared: DataFrame) -> DataFrame:
    """``(a, b, star)``: pairs of near fingerprints that share a key, with the least class of a bucket (``star``) or in a small bucket."""
    least = F.col("cls") == F.col("least")
    one = shared.where(least | (F.col("classes") <= SHORT)).select("key", F.col("cls").alias("a"), F.col("n").alias("m"), F.col("words").alias("x"), least.alias("star"))
    other = shared.select("key", F.col("cls").alias("b"), "n", F.col("words").alias("y"))
    apart = sum((F.bit_count(F.get("x", F.lit(k)).bitwiseXOR(F.get("y", F.lit(k)))) for k in range(SEGMENTS)), F.lit(0))
    both = other.join(one, "key").where((F.col("a") < F.col("b")) & _fits(F.col("m"), F.col("n")) & (apart <= NEAR))
    return both.groupBy("a", "b").agg(F.max("star").alias("star"))


def _unconnected(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose classes have different roots; a class without one is its own."""
    for c, root in (("a", "p"), ("b", "q")):
        pairs = pairs.join(roots.select(F.col("cls").alias(c), F.col("root").alias(root)), c, "left")
    return pairs.where(F.coalesce("p", "a") != F.coalesce("q", "b")).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(x, "a").join(y, "b")
    return both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def _meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links between the components of one block pair that connect what is linked."""
    cls, root = table["cls"].to_numpy(), table["root"].to_numpy()
    words = np.array(table["words"].to_pylist(), np.int64)
    sets = [np.asarray(x.values).view(np.uint64) for x in table["shingles"]]
    sizes, left, out = np.array([len(s) for s in sets]), np.arange(len(cls)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            joined = root[left] == root[i]
            fits = ~joined & (9 * np.minimum(sizes[left], sizes[i]) >= 4 * (sizes[left] + sizes[i]))
            fits[fits] = np.bitwise_count(words[left[fits]] ^ words[i]).sum(1) <= NEAR
            hit = joined.copy()
            hit[fits] = [alike(sets[i], sets[j]) for j in left[fits]]
            out += [(cls[i], cls[j]) for j in left[hit & ~joined]]
            queue += left[hit].tolist()
            left = left[~hit]
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rid_col: str | None = "rid") -> DataFrame:
    """``(id, component)``: component is the smallest id that can be reached by links of a Jaccard similarity of 0.8 or more.

    Nulls and texts without words are one class; ids as in ``simhash.near_duplicates``.
    ``rid_col`` holds row numbers of a written table (part and place), so that
    texts are read again where they lie; with None rows are copied to get them.
    """
    tables = Tables(docs.sparkSession, "near-copies")
    if rid_col is None:
        picked = tables.write(id_texts(docs, id_col, text_col, F.monotonically_increasing_id().alias("rid")), "copy")
    else:
        picked = id_texts(docs, id_col, text_col, F.col(rid_col).alias("rid"))
    kind = picked.schema["id"].dataType.simpleString()
    rows = tables.write(picked.mapInArrow(_sketched, f"id {kind}, rid bigint, cls bigint, n int, words array<int>, least array<bigint>"), "rows")
    # the least id names a class (nulls last), any of its rows stands for it
    nodes = rows.groupBy("cls").agg(F.min("id").alias("first"), F.min("rid").alias("rid"), F.min("n").alias("n"), F.first("words").alias("words"), F.first("least").alias("least"))
    nodes = tables.write(nodes, "nodes")
    parts = nodes.select("cls", "n", F.posexplode(F.arrays_zip("words", "least")).alias("segment", "part"))
    parts = parts.select("cls", "n", F.col("part.words").alias("word"), F.xxhash64("segment", "part.least").alias("mark"))
    several = parts.groupBy("mark").agg(F.count("*").alias("classes")).where("classes > 1").select("mark")
    keyed = parts.join(several, "mark").select("cls", "n", "word", "mark").mapInArrow(_golay_keys, "key bigint, cls bigint, n int")
    keyed = tables.write(keyed, "keyed")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("classes"), F.sum("n").alias("shingles"), F.min("cls").alias("least")).where("classes > 1")
    shared = tables.write(keyed.join(sizes, "key").join(nodes.select("cls", "words"), "cls"), "shared")
    tables.drop(keyed)
    pairs = tables.write(_candidates(shared), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).union(shared.where(F.col("classes") > SHORT).select("cls")).distinct()
    path = by_part(wanted.join(nodes.select("cls", "rid"), "cls").select("rid"), "near-wanted")
    sets = tables.write(picked.select("text", "rid").mapInArrow(_sets(path), "cls bigint, shingles array<bigint>"), "sets")
    links = tables.write(_verified(pairs.where("star"), sets), "links")
    roots = tables.write(connected_components(links).withColumnRenamed("node", "cls"), "roots")
    # small buckets that their least doesn't connect
    left = tables.write(_unconnected(pairs.where("not star"), roots), "left")
    tables.drop(pairs)
    if not left.isEmpty():
        # few classes, as a rule: their sets alone are joined
        ends = tables.write(left.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "ends")
        rest = tables.write(_verified(left, tables.write(sets.join(ends, "cls", "left_semi"), "left-sets")), "rest")
        links = roots.select(F.col("cls").alias("a"), F.col("root").alias("b")).union(rest)
        roots = tables.write(connected_components(links).withColumnRenamed("node", "cls"), "roots")
    # large buckets that are not one component yet
    large = shared.where(F.col("classes") > SHORT).select("key", "cls", "classes", "shingles", "words").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    apart = large.groupBy("key").agg(F.count_distinct("root").alias("roots")).where("roots > 1").select("key")
    large = tables.write(large.join(apart, "key"), "large")
    if not large.isEmpty():
        blocks = F.ceil(F.greatest(F.col("classes") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
        dealt = large.withColumn("m", blocks).withColumn("x", F.pmod(F.xxhash64("cls"), "m").cast("int"))
        dealt = dealt.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        dealt = dealt.select(F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y")).alias("key"), "cls", "root", "words")
        more = dealt.join(sets, "cls").groupBy("key").applyInArrow(_meet, "a bigint, b bigint")
        links = links.union(tables.write(more.distinct(), "more"))
        roots = tables.write(connected_components(links).withColumnRenamed("node", "cls"), "roots")
    tables.drop(sets, shared, large)
    names = nodes.select("cls", "first").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    names = tables.write(names, "names")
    least = names.groupBy("root").agg(F.min("first").alias("component"))
    named = tables.write(names.join(least, "root").select("cls", "component"), "named")
    return rows.select("id", "cls").join(named, "cls").select("id", "component")
