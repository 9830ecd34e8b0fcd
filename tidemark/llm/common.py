"""Shared pieces: scratch tables, shared files, Arrow helpers and stable splits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a Python worker.
SLAB_BYTES = 1 << 20
#: Bytes of an Arrow batch that goes to a Python worker, about; one row at least.
BATCH_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes, as texts vary a lot in length; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, "64m")).lower().rstrip("b")
    size = int(now[:-1]) << {"k": 10, "m": 20, "g": 30}[now[-1]] if now[-1:] in ("k", "m", "g") else int(now)
    if size > BATCH_BYTES or size <= 0:
        spark.conf.set(key, str(BATCH_BYTES))


def named(name: str) -> Column:
    """The top-level column of that very name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_texts(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``id, text`` (a string) and ``more``, for a pass in Python."""
    bounded_batches(docs.sparkSession)
    return docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"), *more)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``. Only a local master may run without that
    setting; there a folder below ``/tmp/checkpoints`` is set for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    bounded_batches(spark)
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str, *, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Tables of one run of an operator in the shared folder.

    A table may be dropped once a later one that was made from it is written:
    nothing is computed from it again, whatever executor is lost.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.root, self.count = spark, scratch(spark, label), 0
        self.made: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path, self.count = f"{self.root}/{self.count}-{name}", self.count + 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            for own, path in self.made:
                if own is table:
                    drop_scratch(self.spark, path)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_by_part(df: DataFrame, label: str) -> str:
    """Write rows with an integer column ``part`` as one small folder for each part; return the folder."""
    path = scratch(df.sparkSession, label)
    df.repartition("part").write.partitionBy("part").option("compression", "zstd").parquet(path)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """A pyarrow file system for a folder of the shared store, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def read_part(path: str, part: int, columns: list[str]) -> pa.Table | None:
    """One part that :func:`write_by_part` wrote; None if it has no rows."""
    fs, base = filesystem(path)
    folder = f"{base}/part={part}"
    if fs.get_file_info(folder).type == pafs.FileType.NotFound:
        return None
    files = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(folder)) if PurePosixPath(x.path).name.startswith("part-"))
    if not files:
        return None
    import pyarrow.parquet as pq

    return pa.concat_tables([pq.ParquetFile(fs.open_input_file(f)).read(columns) for f in files])


#: Bits of a row id that hold the place in a part.
PLACE = 33


class Side:
    """Rows of a side table that :func:`write_by_part` wrote, for one part at a time, sorted by row id."""

    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns, self.part = path, ["rid", *columns], None

    def at(self, part: int) -> tuple[np.ndarray, pa.Table | None]:
        if part != self.part:
            table = read_part(self.path, part, self.columns)
            self.part, self.table = part, None if table is None else table.sort_by([("rid", "ascending")]).combine_chunks()
            self.rid = np.zeros(0, np.int64) if table is None else self.table["rid"].to_numpy()
        return self.rid, self.table

    def holds(self, rids: np.ndarray) -> np.ndarray:
        """Which row ids the table has."""
        out = np.zeros(len(rids), bool)
        for part in np.unique(rids >> PLACE).tolist():
            here = rids >> PLACE == part
            out[here] = np.isin(rids[here], self.at(part)[0])
        return out


def by_part(rows: DataFrame, label: str) -> str:
    """Write rows with a ``rid`` for :class:`Side`."""
    return write_by_part(rows.withColumn("part", F.shiftright("rid", PLACE)), label)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, one after another, and the n + 1 offsets; null counts as empty."""
    array = pc.fill_null(array.cast(pa.large_string()), "")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slabs(batches: Iterator[pa.RecordBatch], name: str, limit: int = SLAB_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of each slice stays near ``limit`` bytes (one row at least)."""
    for batch in batches:
        _, offsets = utf8(column(batch, name))
        start, n = 0, batch.num_rows
        while start < n:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, min(end, n) - start)
            start = min(end, n)


def least_hashed(df: DataFrame, key: str, rows: int, take: int, distinct: bool = False) -> DataFrame:
    """The ``take`` rows with the smallest hashes of the column ``key``, out of ``rows``; ``distinct``: one for each key.

    Rows beyond a bound on the hash, which about ``1.5 take`` pass, go first,
    so that few reach the sort and the driver, whatever the partitions.
    """
    bound = min(1 << 31, -(-(3 * take + 200) * (1 << 31) // (2 * max(1, rows))))
    place = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 31))
    near = df.where(place < bound)
    return (near.dropDuplicates([key]) if distinct else near).orderBy(place, key).limit(take)


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)

