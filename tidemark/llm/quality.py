"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of terms (hashed words), word shapes, pairs of shapes,
word beginnings and a few ratios in buckets; tokens beyond ``LONGEST`` signs are
of more than ``RUNS`` runs are cut into pieces that count each. A tf-idf weighting and a truncated SVD, both of a
bounded sample of labelled rows, turn them into a short unit vector. The
labelled vectors are broadcast (``sample`` rows of each class at most). Every
document is compared with all of them by exact blocked cosine products, and
the labels of the nearest ``NEAREST`` vote with a power of their similarity.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, column, id_texts, least_hashed, named, slabs
from .toxicity import labelled_texts, text_hash

SAMPLE = 1500
RANK = 40
NEAREST = 25
POWER = 8
#: Sizes of the feature groups: shapes, pairs of shapes, word beginnings, terms, ratios.
SHAPES, PAIRS, WORDS, TERMS, RATIOS = 128, 256, 128, 512, 64
GROUPS = (SHAPES, PAIRS, WORDS, TERMS, RATIOS)
DIMENSIONS = sum(GROUPS)
#: Longest piece of a token.
LONGEST = 48
#: Runs of a piece, which its shape shows.
RUNS = 6
BLOCK = 512

_RUN = re.compile(r"[^\W\d_]+|\d+|(.)\1*", re.DOTALL)


def shape(token: str) -> str:
    """Runs of letters (A if all are capitals, T if only the first is) and digits as one sign each; of a run of another sign it shows one or two."""
    out = []
    for m in _RUN.finditer(token):
        run = m[0]
        if run[0].isalpha():
            out.append("A" if len(run) > 1 and run.isupper() else "T" if run[0].isupper() else "a")
        elif run[0].isdigit():
            out.append("0")
        else:
            out.append(run[:2])
    return "".join(out)


def cut(token: str) -> list[str]:
    """The token in pieces of ``RUNS`` runs and ``LONGEST`` signs at most."""
    out, size, runs = [], 0, 0
    for m in _RUN.finditer(token):
        if runs == RUNS:
            out.append(token[size : m.start()])
            size, runs = m.start(), 0
        runs += 1
    out.append(token[size:])
    return [p[i : i + LONGEST] for p in out for i in range(0, len(p), LONGEST)]


def _bucket(text: str, size: int) -> int:
    return zlib.crc32(text.encode()) % size


class Features:
    """Feature counts of texts; remembers tokens up to a bound."""

    def __init__(self, memory: int = 150_000) -> None:
        self.memory, self.known = memory, {}

    def token(self, token: str) -> int:
        """The number of a token's features; -1 if it must be cut first."""
        got = self.known.get(token)
        if got is None:
            if len(self.known) >= self.memory:
                self.known.clear()
            word = "".join(c for c in token.lower() if c.isalpha())
            got = -1 if sum(1 for _ in _RUN.finditer(token)) > RUNS else (_bucket(shape(token), SHAPES) * WORDS + _bucket(word[:3], WORDS)) * TERMS + _bucket(word, TERMS)
            self.known[token] = got
        return got

    def vector(self, text: str | None) -> np.ndarray:
        x = np.zeros(DIMENSIONS, np.float32)
        tokens = (text or "").split()
        n = len(tokens)
        x[-1] = 1
        if not n:
            return x
        known, learn = self.known, self.token
        pieces = tokens
        if max(map(len, tokens)) > LONGEST:
            pieces = [p for t in tokens for p in (cut(t) if len(t) > LONGEST else (t,))]
        codes = np.fromiter((known[t] if t in known else learn(t) for t in pieces), np.int64, len(pieces))
        if codes.min() < 0:
            pieces = [p for t, c in zip(pieces, codes.tolist()) for p in (cut(t) if c < 0 else (t,))]
            codes = np.fromiter((known[t] if t in known else learn(t) for t in pieces), np.int64, len(pieces))
        both, terms = codes // TERMS, codes % TERMS
        shapes, words = both // WORDS, both % WORDS
        x[:SHAPES] = np.bincount(shapes, minlength=SHAPES)
        x[SHAPES : SHAPES + PAIRS] = np.bincount((shapes[1:] * 31 + shapes[:-1]) % PAIRS, minlength=PAIRS)
        x[SHAPES + PAIRS : SHAPES + PAIRS + WORDS] = np.bincount(words, minlength=WORDS)
        x[SHAPES + PAIRS + WORDS : DIMENSIONS - RATIOS] = np.bincount(terms, minlength=TERMS)
        lines = text.split("\n")
        different = Counter(tokens)
        ratios = (
            len(different) / n,
            max(different.values()) / n,
            len(set(lines)) / len(lines),
            sum(map(len, tokens)) / n / 16,
            min(1.0, n / max(1, len(lines)) / 64),
            min(1.0, float(np.log2(n + 1)) / 16),
            sum(t[-1] in ".!?" for t in tokens) / n * 4,
        )
        at = DIMENSIONS - RATIOS
        for k, r in enumerate(ratios):
            place = min(max(r, 0.0), 1.0) * 7
            low = min(int(place), 6)
            x[at + 8 * k + low] = n * (1 - place + low)
            x[at + 8 * k + low + 1] = n * (place - low)
        return x


@dataclass
class Model:
    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = weigh(counts, self.idf) @ self.projection
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled rows."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        out, near = np.empty(len(counts)), min(NEAREST, len(self.labels))
        for lo in range(0, len(counts), BLOCK):
            cosine = self.project(counts[lo : lo + BLOCK]) @ self.vectors.T
            at = np.argpartition(-cosine, near - 1, axis=1)[:, :near]
            weight = np.maximum(np.take_along_axis(cosine, at, 1), 1e-3).astype(np.float64) ** POWER
            out[lo : lo + BLOCK] = (weight * self.labels[at]).sum(1) / weight.sum(1)
        return np.clip(out, 0.0, 1.0)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Each group of features as shares of its own, square roots taken, times idf."""
    out, at = np.empty(counts.shape, np.float32), 0
    for size in GROUPS:
        part = counts[:, at : at + size]
        out[:, at : at + size] = np.sqrt(part / np.maximum(part.sum(1, keepdims=True), 1e-9))
        at += size
    return out * idf


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in slabs(batches, "text"):
        rows = [features.vector(t).tobytes() for t in column(batch, "text").to_pylist()]
        yield pa.RecordBatch.from_arrays([column(batch, "label"), column(batch, "hash"), pa.array(rows, pa.binary())], names=["label", "hash", "x"])


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, sample: int = SAMPLE, rank: int = RANK, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from different texts with a label that is not held out, ``sample`` of each class at most (the smallest hashes)."""
    spark = docs.sparkSession
    known = Tables(spark, "quality").write(labelled_texts(docs, labels, "quality", modulus, held_out, id_col, text_col), "labelled")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    rows = [tuple(r) for y in (0, 1) for r in least_hashed(known.where(F.col("label") == y), "hash", counts.get(y, 0), sample).select("hash", "label").collect()]
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    nothing = Model(np.ones(DIMENSIONS, np.float32), np.zeros((DIMENSIONS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), prior)
    if not rows:
        return nothing
    chosen = F.broadcast(spark.createDataFrame(rows, "chosen bigint, label int"))  # two numbers for each text of the bounded sample
    text = docs.select(named(text_col).cast("string").alias("text"), text_hash(text_col).alias("hash"))
    picked = text.join(chosen, F.col("hash") == F.col("chosen")).dropDuplicates(["hash"]).select("text", "label", "hash")
    found = picked.mapInArrow(_vectors, "label int, hash bigint, x binary").collect()  # ``sample`` rows of each class at most
    found.sort(key=lambda r: r["hash"])
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in found])
    df = (x > 0).sum(0)
    idf = np.log1p(len(x) / (1 + df)).astype(np.float32)
    weighed = weigh(x, idf)
    _, vectors = np.linalg.eigh(weighed.T.astype(np.float64) @ weighed)
    model = Model(idf, np.ascontiguousarray(vectors[:, ::-1][:, :rank]).astype(np.float32), np.zeros((0, rank), np.float32), np.zeros(0), prior)
    model.vectors = model.project(x).astype(np.float32)
    y = np.array([r["label"] for r in found])
    model.labels = y.astype(float)
    return model


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` for each row, from its whole text alone.

    Null and empty texts are scored like a text without words; equal texts
    get equal scores. Without labelled rows all get the same score. An empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in slabs(batches, "text"):
            x = np.stack([features.vector(t) for t in column(batch, "text").to_pylist()])
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(shared.value.score(x))], names=["id", "score"])

    picked = id_texts(docs, id_col, text_col)
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, score double")
