import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import media, queries

SCHEMA = "doc_id bigint, text string, id string, media string, feature string"


def plain_resize(image, height, width):
    """Means over cells, with every pixel cut into equal small squares."""
    h, w = image.shape
    big = np.repeat(np.repeat(image.astype(float), height, 0), width, 1)
    return big.reshape(height, h, width, w).mean((1, 3))


@pytest.mark.parametrize("shape", [(1, 64), (2, 64), (7, 5), (40, 33), (16, 16), (9, 8)])
def test_area_resize(shape):
    image = np.random.RandomState(1).randint(0, 256, shape).astype(np.uint8)
    for size in ((8, 9), (16, 16), (1, 1)):
        assert np.allclose(media.area_resize(image, *size), plain_resize(image, *size))
    assert np.load(io.BytesIO(media.tile(image))).shape == (16, 16)


def test_decoders():
    rng = np.random.RandomState(2)
    grey, colour = rng.randint(0, 256, (5, 7)).astype(np.uint8), rng.randint(0, 256, (6, 3, 3)).astype(np.uint8)
    for image in (grey, colour):
        assert (media.decode(media.encode_bmp(image)) == image).all()
    assert (media.decode(media.encode_pgm(grey.tobytes(), 7)) == grey).all()
    assert (media.decode(b"P6\n# note\n3 6\n255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P2 # x\n7 5 255\n" + b" ".join(b"%d" % v for v in grey.ravel())) == grey).all()
    assert media.decode(b"P1\n3 2\n1 0 1\n010").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 2\n\xa0\x40").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P5 2 1 15\n\x0f\x00").tolist() == [[255, 0]]
    for bad in (b"", b"P5\n2", b"P9 1 1 1\n1", b"BM", b"P5 3 3 255\nx"):
        with pytest.raises((ValueError, media.struct.error)):
            media.decode(bad)


def test_stored_texts_come_back(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    texts = [None, "", "a" * 64, "b" * 65, "é\n" * 1000, "long " * 30_000] + ["".join(rng.choices("ab é", k=rng.randint(1, 400))) for _ in range(30)]
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts + texts)] + [(None, "q", "x", "y", "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(queries, "documents", lambda *_: df)
    out = queries.op5_media_columns(spark, "").collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    for i, t, *_ in rows:
        raw = (t or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        pgm = b"P5\n64 %d\n255\n" % (len(padded) // 64) + padded
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(padded[-64:]), len(pgm), hashlib.sha256(pgm).hexdigest())
        small = np.round(plain_resize(np.frombuffer(padded, np.uint8).reshape(-1, 64), 8, 9), 6)
        assert r.feature == np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()
    monkeypatch.setattr(queries, "documents", lambda *_: spark.createDataFrame([], SCHEMA))
    assert queries.op5_media_columns(spark, "").collect() == []


def test_broken_images_have_nulls(spark):
    df = spark.createDataFrame([(1, b"junk"), (2, None), (3, b"P5 1 1 255\n\x07")], "k int, media binary")
    got = {r.k: r for r in media.features(df, samples=True).collect()}
    assert got[1].feature is None and got[2].tile is None and bytes(got[3].samples) == b"\x07"


def short_palette():
    """A BMP with two colours and samples beyond them."""
    raw = bytearray(media.encode_bmp(np.full((2, 4), 9, np.uint8)))
    raw[46:50] = (2).to_bytes(4, "little")
    return bytes(raw)


def test_images_with_samples_out_of_range_have_nulls(spark):
    bad = [short_palette(), b"P2 2 1 10\n255 3", b"P3 1 1 7\n1 2 8", b"P5 1 1 10\n\xff", b"P2 1 1 9\n99999999999999999999", b"P5 99999999 99999999 255\n1"]
    rows = [(i, b, 5, "t", "s", "h") for i, b in enumerate(bad)] + [(9, b"P2 1 1 10\n10", 5, "t", "s", "h")]
    df = spark.createDataFrame(rows, "k int, media binary, width int, tile string, samples string, `a.b` string")
    got = {r.k: r for r in media.features(df, samples=True).collect()}
    assert len(got) == len(rows) and all(got[i].feature is None for i in range(len(bad)))
    assert bytes(got[9].samples) == b"\xff" and got[9].width == 1 and got[9]["a.b"] == "h" and bytes(got[9].media) == b"P2 1 1 10\n10"
