"""Media columns: Netpbm and BMP images, area-resized tiles and difference hashes.

Images are decoded to numpy arrays (PBM, PGM and PPM, plain and raw, up to 8
bits; uncompressed BMP of 8 or 24 bits), resized by exact area means from an
integral image, and written as NPY tiles with a difference hash. Bytes of
any kind can be stored as the samples of a raw PGM, and read back.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, column, id_texts, named, slabs, written

WIDTH = 64
TILE = 16
_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([^\s#]+)")


def payload(raw: bytes, unit: int = WIDTH) -> bytes:
    """The bytes, with zeros up to a positive multiple of ``unit``."""
    return raw + bytes(-len(raw) % unit or (unit if not raw else 0))


def encode_pgm(samples: bytes, width: int = WIDTH) -> bytes:
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


def encode_bmp(image: np.ndarray) -> bytes:
    """A grey (8 bits, with palette) or RGB (24 bits) image as an uncompressed BMP, bottom row first."""
    grey = image.ndim == 2
    height, width = image.shape[:2]
    row = -(-width * (1 if grey else 3) // 4) * 4
    body = np.zeros((height, row), np.uint8)
    body[:, : width * (1 if grey else 3)] = image if grey else image[:, :, ::-1].reshape(height, -1)
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if grey else b""
    at = 54 + len(palette)
    head = b"BM" + struct.pack("<IHHI", at + body.size, 0, 0, at)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 if grey else 24, 0, body.size, 2835, 2835, 256 if grey else 0, 0)
    return head + info + palette + body[::-1].tobytes()


def decode_bmp(raw: bytes) -> np.ndarray:
    at, size = struct.unpack_from("<I", raw, 10)[0], struct.unpack_from("<I", raw, 14)[0]
    width, height, _, bits, packing = struct.unpack_from("<iiHHI", raw, 18)
    if size < 40 or bits not in (8, 24) or packing or width <= 0 or not height:
        raise ValueError("not an uncompressed BMP of 8 or 24 bits")
    row = -(-width * bits // 32) * 4
    body = np.frombuffer(raw, np.uint8, row * abs(height), at).reshape(abs(height), row)
    body = body[::-1] if height > 0 else body
    if bits == 24:
        return body[:, : width * 3].reshape(abs(height), width, 3)[:, :, ::-1]
    used = struct.unpack_from("<I", raw, 46)[0] or 256
    palette = np.frombuffer(raw, np.uint8, used * 4, 14 + size).reshape(used, 4)[:, 2::-1]
    if int(body[:, :width].max()) >= used:
        raise ValueError("a palette index out of range")
    image = palette[body[:, :width]]
    return image[:, :, 0] if (palette == palette[:, :1]).all() else image


def decode_netpbm(raw: bytes) -> np.ndarray:
    kind, at, head = raw[:2], 2, []
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    while len(head) < (2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(raw, at)
        if not m:
            raise ValueError("the header ends early")
        head.append(int(m[1]))
        at = m.end()
    width, height = head[:2]
    most = head[2] if len(head) > 2 else 1
    if width <= 0 or height <= 0 or not 0 < most < 256:
        raise ValueError("sizes or depth out of range")
    depth = 3 if kind in (b"P3", b"P6") else 1
    if kind == b"P1":
        values = np.frombuffer(bytes(c for c in re.sub(rb"#[^\n\r]*", b"", raw[at:]) if c in b"01"), np.uint8) - 48
    elif kind in (b"P2", b"P3"):
        values = np.array(re.sub(rb"#[^\n\r]*", b"", raw[at:]).split(), np.int64)
    elif kind == b"P4":
        rows = np.frombuffer(raw, np.uint8, -(-width // 8) * height, at + 1).reshape(height, -1)
        values = np.unpackbits(rows, axis=1)[:, :width].ravel()
    else:
        values = np.frombuffer(raw, np.uint8, width * height * depth, at + 1)
    values = values[: width * height * depth]
    if kind not in (b"P1", b"P4") and len(values) and not 0 <= values.min() <= values.max() <= most:
        raise ValueError("samples out of range")
    if kind in (b"P1", b"P4"):
        values = (1 - values) * 255
    elif most != 255:
        values = (values.astype(np.int64) * 255 + most // 2) // most
    image = values.astype(np.uint8, copy=False)
    return image.reshape((height, width, 3) if depth == 3 else (height, width))


def decode(raw: bytes) -> np.ndarray:
    """A (height, width) or (height, width, 3) array of 8 bits."""
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return ((image.astype(np.int64) @ np.array([299, 587, 114]) + 500) // 1000).astype(np.uint8)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact means over equal areas: the integral image, read between its points by linear interpolation, which is exact for it."""
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    total[1:, 1:] = image.astype(np.float64).cumsum(0).cumsum(1)

    def along(table: np.ndarray, n: int) -> np.ndarray:
        at = np.linspace(0, len(table) - 1, n + 1)
        low = np.minimum(at.astype(np.int64), len(table) - 2)
        part = (at - low).reshape(-1, 1)
        return table[low] * (1 - part) + table[low + 1] * part

    cells = np.diff(np.diff(along(along(total, height).T, width).T, axis=0), axis=1)
    return cells * (height * width / image.size)


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: is each of 8 x 8 area means smaller than its right neighbour?"""
    small = np.round(area_resize(grey(image), 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def tile(image: np.ndarray, size: int = TILE) -> bytes:
    """An NPY file of the grey image at ``size`` x ``size``."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(grey(image), size, size)), 0, 255).astype(np.uint8))
    return out.getvalue()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table ``id, n_bytes, media``: each whole text (null: empty) as the samples of a PGM of width 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "text"):
            raws = [t.encode() for t in column(batch, "text").to_pylist()]
            media = [encode_pgm(payload(r)) for r in raws]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(map(len, raws), pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    picked = id_texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    kind = picked.schema["id"].dataType.simpleString()
    return written(picked.mapInArrow(run, f"id {kind}, n_bytes bigint, media binary"), "media")


#: The columns that :func:`features` makes.
NEW = {"width": T.IntegerType(), "height": T.IntegerType(), "feature": T.StringType(), "tile": T.BinaryType(), "samples": T.BinaryType()}


def features(table: DataFrame, media_col: str = "media", samples: bool = False) -> DataFrame:
    """The table with ``width, height, feature`` (difference hash) and ``tile`` (NPY) of each stored image.

    ``samples`` adds the decoded grey samples. A null or broken image, also one
    with samples or palette indices out of range, has nulls there. A column of
    the table that has the name of a new one gives way to it. Repeated rows get equal values; an empty table stays empty.
    """
    bounded_batches(table.sparkSession)
    media = named(media_col).alias("__media")
    names = [c for c in table.columns if c not in NEW]
    # plain names on the way through Python, which takes a dot for a field
    table = table.select(*[named(c).alias(f"__{i}") for i, c in enumerate(names)], media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, rows = batch.slice(lo, 256), []
                for raw in part.column(part.num_columns - 1).to_pylist():
                    try:
                        image = decode(raw or b"")
                        rows.append((image.shape[1], image.shape[0], difference_hash(image), tile(image), grey(image).tobytes() if samples else None))
                    except (ValueError, IndexError, OverflowError, struct.error):
                        rows.append((None,) * 5)
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary())
                made = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*part.schema.names[:-1], *NEW])

    schema = T.StructType([*table.schema.fields[:-1], *(T.StructField(n, k) for n, k in NEW.items())])
    out = table.mapInArrow(run, schema).toDF(*names, *NEW)
    return out if samples else out.drop("samples")
