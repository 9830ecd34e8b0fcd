"""Provider payloads that a fetcher has landed, as a Python data source for batch and stream.

A fetcher (or :func:`land`) puts each batch of responses into a folder of its
own, ``batch=000000000042``, with the texts of the responses, one a line, below
``provider=.../ticker=...``, and marks it ``_SUCCESS``. What lies in an
unmarked folder isn't there yet. Lines are handed on as they are; the operators
of :mod:`tidemark.operators.connectors` parse them, so a broken one loses
nothing else.

    register(spark)
    spark.read.format("landed_payloads").load(root)
    spark.readStream.format("landed_payloads").load(root)

Files are listed once on the driver, by names alone, and read in tasks of
about ``partitionBytes``. The options ``provider``, ``ticker``, ``fromBatch``
and ``toBatch`` choose folders, so that no other file is opened. They are options
because Spark 4.1 keeps a reader whose filters it pushed: a later query on the
same DataFrame without them would miss rows. A stream's offset is the last
batch taken, so a restart from the checkpoint neither loses nor repeats one.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "landed_payloads"
SCHEMA = "batch bigint, provider string, ticker string, file string, place int, value string"
#: Lines of one Arrow batch, and bytes of files of one task, about.
LINES, PARTITION_BYTES = 2_000, 32 << 20
#: Fixed value: how a partition folder spells a null.
NULL = "__HIVE_DEFAULT_PARTITION__"

@dataclass(frozen=True)
class File:
    batch: int
    provider: str | None
    ticker: str | None
    path: str
    size: int


@dataclass
class Files(InputPartition):
    files: list[File]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def batches(root: str) -> list[int]:
    """The marked batches, in order."""
    fs, base = filesystem(root)
    found = []
    for entry in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        name = entry.base_name
        if name.startswith("batch=") and name[6:].isdigit() and fs.get_file_info(f"{entry.path}/_SUCCESS").type == pafs.FileType.File:
            found.append(int(name[6:]))
    return sorted(found)


@dataclass
class Wanted:
    """What the options choose."""

    root: str
    size: int
    provider: str | None
    ticker: str | None
    first: int
    last: int | None

    def batches(self) -> list[int]:
        return [b for b in batches(self.root) if b >= self.first and (self.last is None or b <= self.last)]

    def partitions(self, some: list[int]) -> list[Files]:
        return _dealt((f for f in _files(self.root, some) if self.provider in (None, f.provider) and self.ticker in (None, f.ticker)), self.size)


def _files(root: str, wanted: list[int]) -> Iterator[File]:
    fs, base = filesystem(root)
    for batch in wanted:
        for entry in sorted(fs.get_file_info(pafs.FileSelector(f"{base}/batch={batch:012d}", recursive=True)), key=lambda e: e.path):
            if entry.type != pafs.FileType.File or entry.base_name.startswith(("_", ".")):
                continue
            of = dict(p.split("=", 1) for p in entry.path.split("/") if "=" in p)
            provider, ticker = (None if of.get(k, NULL) == NULL else unquote(of[k]) for k in ("provider", "ticker"))
            yield File(batch, provider, ticker, entry.path, entry.size)


def _dealt(files: Iterator[File], size: int) -> list[Files]:
    """Files in order, some in one task until they make up ``size`` bytes."""
    out, room = [], 0
    for f in files:
        if not out or room < f.size:
            out.append(Files([]))
            room = size
        out[-1].files.append(f)
        room -= f.size
    return out


def _lines(root: str, partition: Files) -> Iterator[pa.RecordBatch]:
    fs, _ = filesystem(root)
    names = ["batch", "provider", "ticker", "file", "place", "value"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
    for f in partition.files:
        with io.BufferedReader(fs.open_input_file(f.path), 1 << 20) as stream:
            held, place = [], 0
            for line in (x.rstrip(b"\r\n") for x in stream):
                held.append(line.decode(errors="replace"))
                if len(held) == LINES:
                    yield _rows(f, place, held, names, types)
                    place, held = place + len(held), []
            if held:
                yield _rows(f, place, held, names, types)


def _rows(f: File, place: int, lines: list[str], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    n = len(lines)
    values = ([f.batch] * n, [f.provider] * n, [f.ticker] * n, [f.path.rsplit("/", 1)[1]] * n, list(range(place, place + n)), lines)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=names)


class _Reader(DataSourceReader):
    def __init__(self, wanted: Wanted) -> None:
        self.wanted = wanted

    def partitions(self) -> list[Files]:
        return self.wanted.partitions(self.wanted.batches())

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _lines(self.wanted.root, partition) if partition is not None else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, wanted: Wanted) -> None:
        self.wanted = wanted

    def initialOffset(self) -> dict:
        return {"batch": -1}

    def latestOffset(self) -> dict:
        return {"batch": max(self.wanted.batches(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.wanted.partitions([b for b in self.wanted.batches() if start["batch"] < b <= end["batch"]])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _lines(self.wanted.root, partition)


class LandedPayloads(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _wanted(self) -> Wanted:
        o = self.options
        last = o.get("toBatch")
        return Wanted(o["path"], int(o.get("partitionBytes", PARTITION_BYTES)), o.get("provider"), o.get("ticker"), int(o.get("fromBatch", 0)), None if last is None else int(last))

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self._wanted())

    def streamReader(self, schema: StructType) -> _StreamReader:
        return _StreamReader(self._wanted())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedPayloads)


def read(spark: SparkSession, root: str, **options: str | int) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).options(**options).load(root)


def read_stream(spark: SparkSession, root: str, **options: str | int) -> DataFrame:
    register(spark)
    return spark.readStream.format(NAME).options(**options).load(root)


def land(payloads: DataFrame, root: str, batch: int) -> None:
    """Write ``provider, ticker, value`` as one batch; the same number again replaces it whole.

    Line feeds in a value become spaces; JSON writes those of its texts as escapes.
    """
    rows = payloads.select("provider", "ticker", F.translate("value", "\r\n", "  ").alias("value"))
    rows.repartition("provider", "ticker").write.mode("overwrite").partitionBy("provider", "ticker").text(f"{root}/batch={batch:012d}")
