"""Search among unit vectors by an inverted file: cells around centroids, probes, an exact check.

Centroids are fitted on a bounded sample (``SAMPLE`` vectors, on the driver);
every vector is put into the cell of its nearest one. A query visits cells.
By the triangle inequality of angles, a vector within the angle ``t`` of the
query has an angle to its centroid that differs from the query's by ``t`` at
most, and its cell's radius bounds it too. Without a limit on probes all cells
that may hold one are visited, and the search is exact; with one, the nearest
cells. Cells of many vectors are dealt into blocks, queries likewise, and each
block of a cell meets each block of queries as two matrices, so no task holds a
cell or all queries. A product of matrices decides with a slack; what it lets
through is summed again in the order of the elements, as :func:`cosine` does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stories import shared_checkpoints

SAMPLE, ROUNDS = 20_000, 8
#: Vectors of one block of a cell, about, and queries of one block.
BLOCK, ASKED = 4_096, 2_048
#: Rows of a block that are multiplied at a time.
STRIPE = 512
#: Slack of angles for rounding.
SLACK = 1e-6


@dataclass
class Centroids:
    points: np.ndarray

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ self.points.T, -1.0, 1.0))


def fit(df: DataFrame, cells: int, vector: str = "embedding", key: str = "id", sample: int = SAMPLE) -> Centroids:
    """Spherical k-means of ``sample`` vectors at most, those with the least hashes of their keys."""
    picked = df.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(vector).toArrow()[vector]
    if not len(picked):
        return Centroids(np.zeros((0, 0)))
    x = np.array(picked.to_pylist(), np.float64)
    points = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(ROUNDS):
        near = (x @ points.T).argmax(1)
        sums = np.zeros_like(points)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        points = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), points)
    return Centroids(points)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), width)


def products(x: np.ndarray, y: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Products of rows of ``x`` and rows of ``y``, both transposed, summed from the first element to the last."""
    total = np.zeros(len(row))
    for a, b in zip(x, y):
        total += a[row] * b[col]
    return total


def alike(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``x`` and in ``y`` of all pairs whose product is not below ``threshold``, and the product, by stripes of ``x``."""
    slack = 1e-9 * max(1.0, *(float(np.linalg.norm(m, axis=1).max(initial=0.0)) ** 2 for m in (x, y)))
    tall, wide = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    for at in range(0, len(x), STRIPE):
        with np.errstate(invalid="ignore", over="ignore"):
            row, col = np.nonzero(~(x[at : at + STRIPE] @ wide < threshold - slack))
            row += at
            exact = products(tall, wide, row, col)
            kept = ~(exact < threshold)
        yield row[kept], col[kept], exact[kept]


def assigned(df: DataFrame, centroids: Centroids, vector: str = "embedding") -> DataFrame:
    """``df`` with the ``cell`` of each vector and its ``angle`` to the centroid; null vectors are left out."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)  # its cells are a parameter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            angles = own.angles(_matrix(batch.column(batch.schema.get_field_index(vector)), own.points.shape[1]))
            cell = angles.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angles[np.arange(len(cell)), cell])], names=[*batch.schema.names, "cell", "angle"])

    kept = df.where(F.col(vector).isNotNull())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, cell int, angle double")


def visits(queries: DataFrame, centroids: Centroids, radii: dict[int, float], threshold: float, probes: int | None, vector: str = "embedding") -> DataFrame:
    """A row for each query and cell to visit, with the query's angle to its centroid (``at``)."""
    shared = queries.sparkSession.sparkContext.broadcast((centroids, radii))
    limit = float(np.arccos(np.clip(threshold, -1.0, 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, radius = shared.value
        reach = np.array([radius.get(c, -np.inf) for c in range(len(own.points))])
        for batch in batches:
            angles = own.angles(_matrix(batch.column(batch.schema.get_field_index(vector)), own.points.shape[1]))
            able = angles - reach[None, :] <= limit + SLACK
            if probes is not None:
                rank = np.where(able, angles, np.inf).argsort(1).argsort(1)
                able &= rank < probes
            row, cell = np.nonzero(able)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(cell, pa.int32()), pa.array(angles[row, cell])], names=[*batch.schema.names, "cell", "at"])

    kept = queries.where(F.col(vector).isNotNull())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, cell int, at double")


def search(rows: DataFrame, queries: DataFrame, threshold: float, cells: int = 64, probes: int | None = None, block: int = BLOCK) -> DataFrame:
    """``query, id, similarity``: vectors (``id, embedding``) at least ``threshold`` alike a query vector, the query's own row left out.

    Repeated ids are reported as often as they occur. Empty tables give an empty result.
    """
    spark = rows.sparkSession
    shared_checkpoints(spark)
    centroids = fit(rows, cells)
    if not len(centroids.points):
        kind = rows.schema["id"].dataType.simpleString()
        return spark.createDataFrame([], f"query {kind}, id {kind}, similarity double")
    index = assigned(rows.select("id", "embedding"), centroids).checkpoint()
    about = index.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()  # a row a cell
    radii = {r.cell: r.radius for r in about}
    blocks = F.broadcast(spark.createDataFrame([(r.cell, -(-r.n // block)) for r in about], "cell int, blocks int"))
    asked = queries.select(F.col("id").alias("query"), "embedding")
    parts = max(1, -(-asked.count() // ASKED))
    dealt = index.join(blocks, "cell").select("id", "embedding", "cell", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    asked = visits(asked, centroids, radii, threshold, probes).join(blocks, "cell")
    asked = asked.select("query", "embedding", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query", F.lit(parts)), F.lit(parts)).cast("int").alias("part"))
    key, width = ["cell", "block", "part"], centroids.points.shape[1]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = _matrix(left["embedding"], width), _matrix(right["embedding"], width)
        query, number, names = right["query"].combine_chunks(), left["id"].combine_chunks(), ["query", "id", "similarity"]
        found = [pa.Table.from_arrays([query.take(pa.array(col)), number.take(pa.array(row)), pa.array(similar)], names=names) for row, col, similar in alike(x, y, threshold)]
        return pa.concat_tables([pa.Table.from_arrays([query[:0], number[:0], pa.array([], pa.float64())], names=names), *found])

    kind = {c: df.schema[c].dataType.simpleString() for df, c in ((dealt, "id"), (asked, "query"))}
    both = dealt.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(meet, f"query {kind['query']}, id {kind['id']}, similarity double")
    return both.where(F.col("query") != F.col("id"))
