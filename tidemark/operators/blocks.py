"""Ordered work on keys of any size: rows get their number within the key, blocks of them go to different tasks.

A window that is partitioned by a ticker has one task a ticker. Here one
distributed sort numbers the rows, a block is a run of ``size`` numbers, and a
frame that looks back gets the last rows of the block before as a halo. What a
block hands on to the next (a last value, an affine map) is a small table, one
row a block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stories import shared_checkpoints

SIZE = 1 << 14


def _joined(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """An inner join on equal columns, nulls included; the right side's are left out."""
    other = right.withColumnsRenamed({n: f"__right_{n}" for n in names})
    same = reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"__right_{n}")) for n in names))
    return left.join(other, same).drop(*[f"__right_{n}" for n in names])


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "number") -> DataFrame:
    """``df`` with the place of each row within its key, from 0.

    Rows that ``order`` leaves equal are numbered in any order, but once and for
    all: the sorted partitions are checkpointed before they are counted.
    """
    shared_checkpoints(df.sparkSession)
    by = [*map(F.col, keys), *(F.col(c) if isinstance(c, str) else c for c in order)]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id()}).checkpoint()
    runs = placed.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*keys, "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    joined = _joined(placed, runs, [*keys, "__part"])
    return joined.select(*df.columns, (F.col("__place") - F.col("__first") + F.col("__before")).alias(name))


def blocked(df: DataFrame, keys: list[str], order: list[str | Column], halo: int = 0, size: int = SIZE) -> DataFrame:
    """``df`` with ``number``, ``block`` and ``own``: the last ``halo`` rows of a block are in the next one too, not its own."""
    if halo >= size:
        raise ValueError("a halo must be shorter than a block")
    rows = numbered(df, keys, order).withColumn("block", F.expr(f"number div {size}"))
    if not halo:
        return rows.withColumn("own", F.lit(True))
    place = F.struct("block", F.lit(True).alias("own"))
    more = F.when(F.col("number") % size >= size - halo, F.struct((F.col("block") + 1).alias("block"), F.lit(False).alias("own")))
    return rows.select(*df.columns, "number", F.explode(F.array_compact(F.array(place, more))).alias("__b")).select(*df.columns, "number", "__b.block", "__b.own")


def in_block(*keys: str) -> Window:
    """The window of a block in order."""
    return Window.partitionBy(*keys, "block").orderBy("number")


def own(df: DataFrame) -> DataFrame:
    """Without the halo and the helping columns."""
    return df.where("own").drop("number", "block", "own")


def last_before(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Blocked rows with the last ``value`` that isn't null, up to and including each row: in the block, else from the blocks before."""
    here = F.last(value, ignorenulls=True).over(in_block(*keys).rowsBetween(Window.unboundedPreceding, 0))
    ends = df.groupBy(*keys, "block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("number"))).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "block", F.last("__end", ignorenulls=True).over(before).alias("__carry"))
    joined = _joined(df, ends, [*keys, "block"])
    return joined.withColumn(value, F.coalesce(here, "__carry")).drop("__carry")
