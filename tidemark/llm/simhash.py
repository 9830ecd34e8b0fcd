"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments (22, 21 and 21 bits), each
read as a word of the perfect binary Golay code (23, 12). A word within two
bits of a codeword has one key, the codeword's index; a word three bits away
has six: its own codeword and the five at distance four. Two words that
differ in one bit or none then always share a key.

If two fingerprints differ in three bits or fewer, the errors of the segments
are, in some order, (0, 0, <=3), (0, 1, <=2) or (1, 1, 1). So either one
segment is equal and another has one error at most (six ordered pairs: exact
bits and a Golay key), or the first two segments have one error each (two
Golay keys). Fingerprints are joined on those keys and each candidate is
verified by its Hamming distance, so no link is lost and none is invented.

Equal fingerprints are collapsed first. Inside a bucket of equal keys only a
spanning forest of the links is emitted, never all pairs; a bucket beyond
``bucket_limit`` rows is dealt out as pairs of blocks, which covers the same
comparisons in tasks of bounded size.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Side, Tables, by_part, column, id_texts, named, slabs, utf8
from .graph import connected_components

#: Bits of each segment, lowest first.
SEGMENTS = (22, 21, 21)
#: Fixed value: generator polynomial of the binary Golay code.
GOLAY = 0b101011100011
RADIUS = 3


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How often each bit is set in rows of bytes, lowest bit first; short sums stay in bytes."""
    total = np.zeros(rows.shape[1] * 8, np.int64)
    for i in range(0, len(rows), 255):
        total += np.add.reduce(np.unpackbits(rows[i : i + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return total


def fingerprint(raw: bytes, width: int = 3) -> int:
    """The unsigned fingerprint of UTF-8 bytes; 0 for a text without words."""
    words = raw.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > width:
        starts, ends = starts[: -(width - 1) or None], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    n, ones = len(starts), np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, 1 << 15):
        a, b = starts[i : i + (1 << 15)].tolist(), ends[i : i + (1 << 15)].tolist()
        hashes = np.fromiter((digest(line[x:y], 42) for x, y in zip(a, b)), np.uint64, len(a))
        ones += bit_counts(hashes.view(np.uint8).reshape(-1, 8))
    return int(sum(1 << i for i in np.flatnonzero(ones * 2 > n).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp)``: one row for each document; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "text"):
            raw, offsets = utf8(column(batch, "text"))
            raw, at = raw.tobytes(), offsets.tolist()
            fps = np.fromiter((fingerprint(raw[a:b], width) for a, b in itertools.pairwise(at)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(fps.view(np.int64))], names=["id", "fp"])

    picked = id_texts(docs, id_col, text_col)
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, fp bigint")


@functools.cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits; for each syndrome the error patterns that lead to its keys, and how many."""

    def mod(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GOLAY << (i - 11)
        return x

    low = np.array([mod(x) for x in range(1 << 12)], np.int64)
    high = np.array([mod(x << 12) for x in range(1 << 11)], np.int64)
    leader = np.zeros(2048, np.int64)
    weight = np.full(2048, 9)
    for k in range(4):
        for bits in itertools.combinations(range(23), k):
            e = sum(1 << b for b in bits)
            s = mod(e)
            if k < weight[s]:
                leader[s], weight[s] = e, k
    patterns, count = np.zeros((2048, 6), np.int64), np.ones(2048, np.int64)
    for s in range(2048):
        found = [int(leader[s])]
        if weight[s] == 3:
            for bit in range(23):
                if not found[0] >> bit & 1:
                    e = (1 << bit) ^ int(leader[s ^ mod(1 << bit)])
                    if e not in found:
                        found.append(e)
        assert len(found) <= 6
        count[s] = len(found)
        patterns[s, : len(found)] = found
        patterns[s, len(found) :] = found[0]
    return low, high, patterns, count


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of each word, six columns, and which of them count."""
    low, high, patterns, count = golay()
    syndrome = low[words & 0xFFF] ^ high[words >> 12]
    return (words[:, None] ^ patterns[syndrome]) >> 11, np.arange(6)[None, :] < count[syndrome][:, None]


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All join keys of unsigned fingerprints: the row of each key, and the key."""
    at = np.cumsum((0, *SEGMENTS))
    parts = [((fps >> np.uint64(at[i])) & np.uint64((1 << SEGMENTS[i]) - 1)).astype(np.int64) for i in range(3)]
    fuzzy = [segment_keys(x) for x in parts]
    rows, keys = [], []
    for kind, (i, j) in enumerate(itertools.permutations(range(3), 2)):
        value, there = fuzzy[j]
        r, c = np.nonzero(there)
        rows.append(r)
        keys.append((kind << 40) | (parts[i][r] << 12) | value[r, c])
    (a, a_there), (b, b_there) = fuzzy[0], fuzzy[1]
    r, c, d = np.nonzero(a_there[:, :, None] & b_there[:, None, :])
    rows.append(r)
    keys.append((6 << 40) | (a[r, c] << 12) | b[r, d])
    return np.concatenate(rows), np.concatenate(keys)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            fps = column(batch, "fp").slice(start, 4096).to_numpy().view(np.uint64)
            rows, keys = keys_of(fps)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows].view(np.int64))], names=["key", "fp"])


def forest(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among fingerprints: each step compares one with all that are still unreached."""
    left, out = np.arange(len(fps)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]) <= RADIUS
            if near.any():
                got = left[near]
                out.append((np.full(len(got), fps[x]), fps[got]))
                queue += got.tolist()
                left = left[~near]
    return out


def bucket_links(keys: np.ndarray, fps: np.ndarray, short: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked inside each run of equal keys; ``keys`` must be sorted."""
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    for s, n in zip(starts[sizes > short].tolist(), sizes[sizes > short].tolist()):
        for x, y in forest(np.unique(fps[s : s + n])):
            a.append(x)
            b.append(y)
    size_at = np.repeat(sizes, sizes)
    small = np.flatnonzero((size_at > 1) & (size_at <= short))
    k, f = keys[small], fps[small]
    for lag in range(1, short):
        same = k[lag:] == k[:-lag]
        if not same.any():
            break
        i = np.flatnonzero(same)
        x, y = f[i], f[i + lag]
        hit = (np.bitwise_count(x ^ y) <= RADIUS) & (x != y)
        a.append(x[hit])
        b.append(y[hit])
    x, y = np.concatenate(a), np.concatenate(b)
    both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0) if len(x) else np.zeros((0, 2), np.uint64)
    return both[:, 0], both[:, 1]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> links; a run of equal keys may span batches."""

    def out(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        x, y = bucket_links(keys, fps)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    held_k, held_f = [], []
    for batch in batches:
        held_k.append(column(batch, "key").to_numpy())
        held_f.append(column(batch, "fp").to_numpy().view(np.uint64))
        if held_k[0][0] != held_k[-1][-1] and sum(map(len, held_k)) >= 100_000:
            keys, fps = np.concatenate(held_k), np.concatenate(held_f)
            cut = int(np.searchsorted(keys, keys[-1]))
            yield out(keys[:cut], fps[:cut])
            held_k, held_f = [keys[cut:]], [fps[cut:]]
    if held_k:
        yield out(np.concatenate(held_k), np.concatenate(held_f))


#: Rows of a bucket that one task takes, about: larger buckets are dealt out as pairs of blocks.
BLOCK = 20_000


def links(distinct: DataFrame, bucket_limit: int = BLOCK) -> DataFrame:
    """``(a, b)``: links among distinct fingerprints ``fp`` that leave every group connected."""
    tables = Tables(distinct.sparkSession, "simhash-links")
    keyed = tables.write(distinct.select("fp").mapInArrow(_expand, "key bigint, fp bigint"), "keys")
    # only keys of many rows are named, so this table stays small, and the rest keeps its key
    big = tables.write(keyed.groupBy("key").count().where(F.col("count") > bucket_limit), "big")
    blocks = F.ceil(F.col("count") * 2 / bucket_limit).cast("int")
    dealt = keyed.join(big, "key", "left").withColumn("n", F.coalesce(blocks, F.lit(1)))
    dealt = dealt.withColumn("x", F.pmod(F.xxhash64("fp"), "n").cast("int"))
    dealt = dealt.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select(F.when(F.col("n") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y"))).alias("key"), "fp")
    dealt = dealt.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp, component)``: component is the smallest id that can be reached by links of ``RADIUS`` bits.

    Nulls and texts without words have fingerprint zero and link like any
    other. Repeated rows stay repeated. A null id never names a component
    unless all ids of it are null. An empty table gives an empty result.
    """
    tables = Tables(docs.sparkSession, "simhash")
    rows = tables.write(fingerprints(docs, id_col, text_col, width), "rows")
    nodes = tables.write(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = connected_components(links(nodes)).withColumnRenamed("node", "fp")
    names = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = tables.write(names, "roots")
    least = tables.write(names.groupBy("root").agg(F.min("least").alias("component")), "least")
    found = tables.write(names.join(least, "root").select("fp", "component"), "named")
    return rows.join(found, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find: Callable[[DataFrame, str, str], DataFrame] = near_duplicates) -> DataFrame:
    """The documents without near copies, as ``find`` groups them: of each group the row with the smallest id stays (of equal rows, one).

    Rows get numbers of their own, so repeated ids are told apart; a null id
    stays only if all ids of its group are null. Columns may have any names.
    The rows that go are a small side table that each task reads for its part
    of the rows, so no text is shuffled or sorted.
    """
    tables = Tables(docs.sparkSession, "keep-one")
    copy = tables.write(docs.select(F.struct(*map(named, docs.columns)).alias("row"), F.monotonically_increasing_id().alias("rid")), "rows")
    own = F.col("row").getField(id_col)
    place = F.struct(own.isNull().alias("none"), own.alias("id"), F.col("rid").alias("rid")).alias("place")
    found = find(copy.select(place, F.col("row").getField(text_col).alias("text"), "rid"), "place", "text")
    path = by_part(found.where("id <> component").select("id.rid"), "keep-one-gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = Side(path, [])
        for batch in batches:
            kept = batch.filter(pa.array(~gone.holds(column(batch, "rid").to_numpy())))
            if kept.num_rows:
                yield kept

    return copy.mapInArrow(run, copy.schema).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
