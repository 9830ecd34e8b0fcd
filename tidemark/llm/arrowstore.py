"""Token ids as Arrow stream files of fixed-size lists.

A store is a folder of part files in ascending document order. Each part is
an Arrow IPC stream whose batches hold ``rows`` sequences (the last batch may
hold fewer) of exactly ``length`` ids, as ``fixed_size_list`` columns ``ids``
and ``mask``; the mask is false on the padding that ends a part. Buffers are
not compressed, so a memory map gives every sequence without a copy. A second
stream, ``.docs``, has each document's id, first token in the part and count.
Ids take 16 bits where the vocabulary allows it.

A part is written by one task under a name of its own, and the manifest that
Spark commits lists the files of the attempts that succeeded; a lost executor
or a second attempt leaves at most an unlisted file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, filesystem, named, scratch, slabs, written
from .tokens import encoder

LENGTH = 1024
ROWS = 128


def _schema(kind: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class PartWriter:
    """Appends documents to one part file; memory holds one batch."""

    def __init__(self, folder: str, name: str, id_type: pa.DataType, kind: pa.DataType, length: int) -> None:
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.name, self.kind, self.length = name, kind, length
        self.out = self.fs.open_output_stream(f"{base}/{name}.arrow")
        self.sequences = pa.ipc.new_stream(self.out, _schema(kind, length))
        self.doc_out = self.fs.open_output_stream(f"{base}/{name}.docs")
        self.doc_schema = pa.schema([("doc", id_type), ("start", pa.int64()), ("count", pa.int64())])
        self.docs = pa.ipc.new_stream(self.doc_out, self.doc_schema)
        self.tokens = self.documents = 0
        self.left = np.zeros(0, kind.to_pandas_dtype())

    def _write(self, ids: np.ndarray, valid: int) -> None:
        n = len(ids) // self.length
        mask = np.zeros(len(ids), bool)
        mask[:valid] = True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        batch = pa.RecordBatch.from_arrays(lists, schema=_schema(self.kind, self.length))
        for i in range(0, n, ROWS):
            self.sequences.write_batch(batch.slice(i, ROWS))

    def add(self, ids: pa.Array, tokens: np.ndarray, counts: np.ndarray) -> None:
        """Documents ``ids`` with ``counts`` tokens each, which lie in ``tokens`` one after another."""
        starts = self.tokens + np.cumsum(counts) - counts
        self.docs.write_batch(pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(counts)], schema=self.doc_schema))
        self.tokens += int(counts.sum())
        self.documents += len(counts)
        flat = np.concatenate([self.left, tokens.astype(self.left.dtype)])
        whole = len(flat) - len(flat) % (self.length * ROWS)
        if whole:
            self._write(flat[:whole], whole)
        self.left = flat[whole:]

    def close(self) -> None:
        if len(self.left):
            n = -(-len(self.left) // self.length) * self.length
            self._write(np.pad(self.left, (0, n - len(self.left))), len(self.left))
        for x in (self.sequences, self.out, self.docs, self.doc_out):
            x.close()


class PartReader:
    """Random access to a part: local files are memory mapped, others are read."""

    def __init__(self, folder: str, name: str) -> None:
        fs, base = filesystem(folder)
        if fs.type_name == "local":
            self.source = pa.memory_map(f"{base}/{name}.arrow")
        else:
            self.source = fs.open_input_file(f"{base}/{name}.arrow")
        self.batches = list(pa.ipc.open_stream(self.source))
        self.docs = pa.ipc.open_stream(fs.open_input_stream(f"{base}/{name}.docs"))
        self.length = self.batches[0].column(0).type.list_size if self.batches else LENGTH
        self.flat = [b.column(0).flatten().to_numpy() for b in self.batches]
        self.starts = np.concatenate([[0], np.cumsum([len(f) for f in self.flat])]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.starts[-1]) // self.length

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids (a view of the file) and the mask of sequence ``i``."""
        b, at = int(np.searchsorted(self.starts, i * self.length, "right")) - 1, 0
        at = i * self.length - int(self.starts[b])
        mask = self.batches[b].column(1).flatten().slice(at, self.length).to_numpy(zero_copy_only=False)
        return self.flat[b][at : at + self.length], mask

    def tokens(self, start: int, count: int) -> Iterator[np.ndarray]:
        """Views that make up ``count`` ids from ``start`` on."""
        while count > 0:
            b = int(np.searchsorted(self.starts, start, "right")) - 1
            at = start - int(self.starts[b])
            view = self.flat[b][at : at + count]
            yield view
            start, count = start + len(view), count - len(view)


def write_store(docs: DataFrame, vocabulary: str, end_id: int, *, leading_space: bool, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> tuple[str, DataFrame]:
    """Encode all documents in ascending id order: the folder, and its manifest ``(part, name, documents, tokens)``.

    A null text counts as empty (it still gets its end id), a null id comes
    first; equal ids are in order of their texts' hash. Repeated rows are
    kept. An empty table makes an empty manifest.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    rows = docs.select(named(id_col).alias("id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = encoder(vocabulary, leading_space), None
        kind = pa.uint16() if max(encode.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else pa.uint32()
        part = TaskContext.get().partitionId()
        for batch in slabs(batches, "text"):
            if writer is None:
                writer = PartWriter(folder, f"part-{part:06d}-{uuid.uuid4().hex[:8]}", column(batch, "id").type, kind, length)
            writer.add(column(batch, "id"), *encode.flat_ids(column(batch, "text").to_pylist(), end_id))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [writer.name], "documents": [writer.documents], "tokens": [writer.tokens]})

    manifest = ordered.mapInArrow(run, "part bigint, name string, documents bigint, tokens bigint")
    return folder, written(manifest, "tokens-manifest")


def read_store(spark: SparkSession, folder: str, manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """One row for each document, from the files: ``id, start, n_tokens, ids_crc32, part``.

    The driver gathers the manifest only, one row for each file, to sum up
    where each part starts.
    """
    parts, total = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        parts.append((r["part"], r["name"], total))
        total += r["tokens"]
    files = spark.createDataFrame(parts, "part bigint, name string, base bigint").repartition(max(1, len(parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, name, base in zip(*(c.to_pylist() for c in batch.columns)):
                reader = PartReader(folder, name)
                for docs in reader.docs:
                    crcs = []
                    for start, count in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist()):
                        crc = 0
                        for view in reader.tokens(start, count):
                            crc = zlib.crc32(view.astype("<u4"), crc)
                        crcs.append(crc)
                    starts = pa.array(docs.column(1).to_numpy() + base)
                    yield pa.RecordBatch.from_arrays(
                        [docs.column(0), starts, docs.column(2), pa.array(crcs, pa.int64()), pa.array([part] * len(crcs), pa.int64())],
                        names=["id", "start", "n_tokens", "ids_crc32", "part"],
                    )

    return files.mapInArrow(run, f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint, part bigint")
