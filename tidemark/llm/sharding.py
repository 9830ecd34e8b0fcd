"""Contiguous shards with the smallest possible largest shard.

Documents of equal text are one atomic group. Groups stand in the order of
their first document, and the ordered sizes are cut into ``shards`` runs so
that the largest run is as small as it can be: the capacity is binary
searched, each candidate is checked greedily, and the cuts of the smallest
feasible one are taken. Among the cuts that keep to this capacity those nearest
to equal shares of what is left are chosen, so that a large group, which may set
the capacity alone, leaves no shard empty while others are full.

The ordered sizes stay in the shared folder as blocks. The driver holds the
sum of each block and, one at a time, the sizes of the blocks that a cut
falls into (a small cache). It first narrows the capacity with block sums
alone, so the exact search touches few blocks.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, named, written

#: Groups in a block, about. The driver holds one number for each block.
BLOCK = 50_000


class Ordered:
    """Ordered sizes in blocks; ``fetch(block)`` gives a block's sizes."""

    def __init__(self, sums: list[int], largest: int, fetch, keep: int = 32) -> None:
        self.ends = np.cumsum([0, *sums])
        self.total, self.largest, self.fetch, self.keep = int(self.ends[-1]), largest, fetch, keep
        self.cache: OrderedDict[int, np.ndarray] = OrderedDict()

    def inside(self, block: int) -> np.ndarray:
        """Running sums in a block."""
        if block not in self.cache:
            self.cache[block] = np.cumsum(self.fetch(block))
            if len(self.cache) > self.keep:
                self.cache.popitem(last=False)
        self.cache.move_to_end(block)
        return self.cache[block]

    def reach(self, start: int, capacity: int) -> tuple[int, tuple[int, int]]:
        """How far a shard that begins after ``start`` bytes gets: the sum at its end, and (block, groups of it taken)."""
        goal = start + capacity
        if goal >= self.total:
            return self.total, (len(self.ends) - 1, 0)
        block = int(np.searchsorted(self.ends, goal, "right")) - 1
        sums = self.inside(block)
        n = int(np.searchsorted(sums, goal - int(self.ends[block]), "right"))
        return int(self.ends[block]) + (int(sums[n - 1]) if n else 0), (block, n)

    def last(self, goal: int) -> tuple[int, tuple[int, int]]:
        """The last end of a group at or before ``goal`` bytes: the sum, and its cut."""
        return self.reach(goal, 0)

    def first(self, goal: int) -> tuple[int, tuple[int, int]]:
        """The first end of a group at or behind ``goal`` bytes."""
        if goal <= 0:
            return 0, (0, 0)
        block = min(int(np.searchsorted(self.ends, goal, "left")) - 1, len(self.ends) - 2)
        sums = self.inside(block)
        n = int(np.searchsorted(sums, goal - int(self.ends[block]), "left"))
        return int(self.ends[block]) + int(sums[n]), (block, n + 1)

    def ahead(self, at: int, share: int) -> tuple[int, tuple[int, int]]:
        """The end of a shard that begins at ``at`` and holds ``share`` bytes at most, or one larger group."""
        there = self.reach(at, share)
        return there if there[0] > at or at >= self.total else self.first(at + 1)

    def back(self, end: int, share: int) -> int:
        """The first begin of such a shard that ends at ``end``."""
        begin = self.first(end - share)[0]
        return begin if begin < end or end <= 0 else self.last(end - 1)[0]

    def share(self, capacity: int, shards: int) -> int:
        """The least bytes that shards need if larger groups have shards of their own."""
        low, high = 1, capacity
        while low < high:
            middle, at = (low + high) // 2, 0
            for _ in range(shards):
                at = self.ahead(at, middle)[0]
            low, high = (low, middle) if at >= self.total else (middle + 1, high)
        return low

    def even(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        """Cuts near equal shares, no shard above the least :meth:`share` but for single larger groups."""
        share = self.share(capacity, shards)
        starts = [self.total]  # the first place from which 0, 1, ... shards hold the rest
        for _ in range(shards - 1):
            starts.append(self.back(starts[-1], share))
        at, out = 0, []
        for left in range(shards, 1, -1):
            low, high = max(at, starts[left - 1]), self.ahead(at, share)[0]
            goal = min(max(at + (self.total - at) / left, low), high)
            before, after = self.last(math.floor(goal)), self.first(min(math.ceil(goal), self.total))
            take = before
            if after[0] <= high and (before[0] <= at or before[0] < low or after[0] - goal < goal - before[0]):
                take = after
            at, cut = take
            out.append(cut)
        return out

    def cuts(self, capacity: int, shards: int) -> list[tuple[int, int]] | None:
        """Greedy cuts, or None if ``shards`` shards don't hold everything."""
        at, out = 0, []
        for _ in range(shards):
            at, cut = self.reach(at, capacity)
            out.append(cut)
        return out[:-1] if at >= self.total else None

    def coarse(self, capacity: int, shards: int, lucky: bool) -> bool:
        """Feasible if each cut could fall anywhere (lucky), or only between blocks?"""
        at = 0
        for _ in range(shards):
            at = min(self.total, at + capacity) if lucky else int(self.ends[np.searchsorted(self.ends, at + capacity, "right") - 1])
        return at >= self.total


def minimax(sizes: Ordered, shards: int) -> tuple[int, list[tuple[int, int]]]:
    """The least capacity of a contiguous partition, and even cuts that keep to it (block, groups of the block before the cut)."""

    def least(low: int, high: int, good) -> int:
        while low < high:
            middle = (low + high) // 2
            if good(middle):
                high = middle
            else:
                low = middle + 1
        return low

    low = max(sizes.largest, -(-sizes.total // shards))
    top = low + sizes.largest
    high = max(low, min(top, least(low, max(top, sizes.total), lambda c: sizes.coarse(c, shards, False))))
    best = least(low, high, lambda c: sizes.cuts(c, shards) is not None)
    return best, sizes.even(best, shards)


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``id, size, text_crc32, first, shard, slot``: ``size`` is the UTF-8 bytes plus one, ``first`` the group's least id.

    A null text counts as empty, and equals an empty one. Repeated rows are
    members of one group and get slots of their own; a null id comes last in
    its group. Shards may stay empty. An empty table gives an empty result.
    """
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        named(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("digest"),
    )
    rows = written(rows, "shard-rows")
    groups = written(rows.groupBy("digest").agg(F.min("id").alias("first"), F.sum("size").alias("bytes")), "shard-groups")
    n = groups.count()
    ordered = groups.repartitionByRange(max(1, -(-n // block)), "first", "digest").sortWithinPartitions("first", "digest")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            place = np.arange(seen, seen + batch.num_rows)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(place)], names=[*batch.schema.names, "block", "place"])

    kind = rows.schema["id"].dataType.simpleString()
    ordered = written(ordered.select("digest", "first", "bytes").mapInArrow(number, f"digest string, first {kind}, bytes bigint, block int, place bigint"), "shard-ordered")
    sums = ordered.groupBy("block").agg(F.sum("bytes").alias("s"), F.max("bytes").alias("m")).orderBy("block").collect()  # one row a block
    names = [r["block"] for r in sums]
    if names:
        def fetch(i: int) -> np.ndarray:
            part = ordered.where(F.col("block") == names[i]).select("place", "bytes").toPandas()
            return part.sort_values("place")["bytes"].to_numpy(np.int64)

        sizes = Ordered([r["s"] for r in sums], max(r["m"] for r in sums), fetch)
        cuts = [(names[b] if b < len(names) else names[-1] + 1, k) for b, k in minimax(sizes, shards)[1]]
    else:
        cuts = []
    number_of = F.lit(0)
    for b, k in cuts:
        number_of = number_of + F.when((F.col("block") > b) | ((F.col("block") == b) & (F.col("place") >= k)), 1).otherwise(0)
    labelled = ordered.select("digest", "first", number_of.cast("int").alias("shard"))
    # shards are contiguous in group order, so a slot is a rank in that order: place in a range part plus the counts before it
    joined = written(rows.join(labelled, "digest"), "shard-joined")
    spread = F.xxhash64("id")  # equal rows of one group in any order; the group itself may fill many parts
    dealt = joined.withColumn("last", F.col("id").isNull()).repartitionByRange("shard", "first", "digest", "last", "id", spread)
    dealt = dealt.sortWithinPartitions("shard", "first", "digest", "last", "id").drop("last", "digest")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            own = column(batch, "shard").to_numpy()
            place = np.empty(len(own), np.int64)
            for s in np.unique(own).tolist():
                at = np.flatnonzero(own == s)
                place[at] = np.arange(seen[s], seen[s] + len(at))
                seen[s] += len(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(own), pa.int32()), pa.array(place)], names=[*batch.schema.names, "part", "place"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    ranked = written(dealt.mapInArrow(rank, f"{fields}, part int, place bigint"), "shard-ranked")
    counts = ranked.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    slots = ranked.join(bases, ["shard", "part"])
    return slots.select("id", "size", "text_crc32", "first", "shard", (F.col("base") + F.col("place")).alias("slot"))
