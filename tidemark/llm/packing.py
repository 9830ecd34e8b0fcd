"""Best-fit-decreasing packing of token sequences.

Best fit decreasing looks at nothing but lengths, and there are at most
``capacity`` different ones. So the documents are counted by length, and the
packing is planned on the driver over those counts, whatever the corpus: for
each length, longest first, a segment tree over the remaining capacities
finds the tightest open class of bins in logarithmic time. All bins of a class
that get the same pieces move together, so the plan has at most a few
thousand entries, and it is the plan that best fit decreasing would make
document by document.

Pieces then find their place in the plan by their rank among pieces of their
length: the rank inside their part, plus a prefix sum over parts that each
task reads from a small side file. No piece is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, named, read_part, slabs, write_by_part, written
from .tokens import encoder

CAPACITY = 1024


class CapacityTree:
    """Which remaining capacities have open bins; finds the least that is large enough."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << max(1, capacity).bit_length()
        self.open = [0] * (2 * self.size)

    def set(self, capacity: int, there: bool) -> None:
        i = self.size + capacity
        self.open[i] = int(there)
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        i = self.size + need
        while not self.open[i]:
            while i & 1:  # a right child has nothing to its right below its parent
                i >>= 1
                if i <= 1:
                    return None
            i += 1
        while i < self.size:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.size


@dataclass
class Plan:
    """Runs of equal placement, by length and rank: ``each`` pieces a bin, from ``offset`` on."""

    capacity: int
    sequences: int = 0
    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)

    def add(self, length: int, rank: int, first: int, each: int, offset: int) -> None:
        for values, x in ((self.length, length), (self.rank, rank), (self.first, first), (self.each, each), (self.offset, offset)):
            values.append(x)

    def arrays(self) -> tuple[np.ndarray, ...]:
        order = np.lexsort((self.rank, self.length))
        columns = [np.array(x, np.int64)[order] for x in (self.length, self.rank, self.first, self.each, self.offset)]
        return (columns[0] << 44 | columns[1], *columns[1:])


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best fit decreasing of ``counts[length]`` pieces."""
    out, tree = Plan(capacity), CapacityTree(capacity)
    classes: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: groups (first bin, bins)

    def put(remaining: int, first: int, bins: int) -> None:
        if bins and remaining:
            classes.setdefault(remaining, []).append((first, bins))
            tree.set(remaining, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, bins = capacity, -(-left // (capacity // length))
                first = out.sequences
                out.sequences += bins
            else:
                first, bins = classes[remaining].pop()
                if not classes[remaining]:
                    tree.set(remaining, False)
            each = remaining // length  # a bin that took one piece is the tightest for the next
            full = min(bins, left // each)
            if full:
                out.add(length, rank, first, each, capacity - remaining)
                put(remaining - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < bins:  # the last pieces of this length fill part of one bin
                out.add(length, rank, first + full, left, capacity - remaining)
                put(remaining - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(remaining, first + full, bins - full)
    return out


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Starts and lengths of the pieces of ``n`` ids: whole ones, but for a shorter first piece."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, *, leading_space: bool, id_col: str, text_col: str) -> DataFrame:
    """Encoded pieces with their rank inside their part: ``id, piece, start, length, ids, part, idx`` (a written table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary, leading_space), TaskContext.get().partitionId()
        small = max(encode.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slabs(batches, "text"):
            rows, at, out = [], [], {k: [] for k in ("piece", "start", "length", "idx")}
            flat, counts = encode.flat_ids(column(batch, "text").to_pylist(), end_id)
            for i, ids in enumerate(np.split(flat.astype("<u2" if small else "<u4"), np.cumsum(counts)[:-1])):
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append(ids[start : start + length].tobytes())
                    at.append(i)
                    for name, v in (("piece", k), ("start", start), ("length", length), ("idx", int(seen[length]))):
                        out[name].append(v)
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id").take(pa.array(at)), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()), pa.array(rows, pa.binary()), pa.array([part] * len(at), pa.int32()), pa.array(out["idx"], pa.int64())],
                names=["id", "piece", "start", "length", "ids", "part", "idx"],
            )

    picked = docs.select(named(id_col).alias("id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return written(picked.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids binary, part int, idx bigint"), "pack-pieces")


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, *, leading_space: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their place: ``id, piece, start, length, ids, ids_crc32, sequence_id, offset``.

    ``ids`` are little-endian, 16 bits each where the vocabulary allows it,
    else 32. A null text counts as empty: one piece with the end id. Repeated
    rows and null ids are packed like any other. An empty table packs to
    nothing. The driver gathers one count for each length, ``capacity`` at most.
    """
    rows = pieces(docs, vocabulary, end_id, capacity, leading_space=leading_space, id_col=id_col, text_col=text_col)
    counts = written(rows.groupBy("part", "length").count(), "pack-counts")
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    keys, rank, first, each, offset = plan(by_length, capacity).arrays() if by_length else (np.zeros(1, np.int64),) * 5
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    path = write_by_part(counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")), "pack-bases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases: dict[int, np.ndarray] = {}
        for batch in batches:
            part, length = column(batch, "part").to_numpy(), column(batch, "length").to_numpy()
            base = np.zeros(len(part), np.int64)
            for p in np.unique(part).tolist():
                if p not in bases:
                    bases.clear()
                    bases[p], table = np.zeros(capacity + 1, np.int64), read_part(path, p, ["length", "base"])
                    bases[p][table["length"].to_numpy()] = table["base"].to_numpy()
                base[part == p] = bases[p][length[part == p]]
            own = base + column(batch, "idx").to_numpy()
            i = np.searchsorted(keys, length << 44 | own, "right") - 1
            inside = own - rank[i]
            blobs = column(batch, "ids")
            crcs = []
            for blob, n in zip(blobs.to_pylist(), length.tolist()):
                crcs.append(zlib.crc32(np.frombuffer(blob, "<u2").astype("<u4")) if len(blob) == 2 * n else zlib.crc32(blob))
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, c) for c in ("id", "piece", "start", "length", "ids")), pa.array(crcs, pa.int64()), pa.array(first[i] + inside // each[i]), pa.array(offset[i] + inside % each[i] * length)],
                names=["id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids binary, ids_crc32 bigint, sequence_id bigint, offset bigint")
