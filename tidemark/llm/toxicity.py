"""Toxicity by weak supervision.

1. Lexicons are induced from labelled texts: words and word beginnings that
   are much more frequent in toxic ones. Terms with one beginning are a
   family; families are dealt out to many small lexicons, so that what occurs
   together stays in one voter. A few pattern voters look at how many
   different terms occur, how densely, and at shouting. Each voter says toxic
   (1), clean (-1) or nothing (0).
2. A generative label model is fitted to the votes of all different texts.
   With a hidden class y the covariance of two voters is c a_i a_j, for the
   class variance c and accuracies a, plus what the voters share beyond the
   class. The accuracies are the rank-one part of the off-diagonal covariance,
   found by alternating fits that leave out the most dependent pairs; the rest
   is kept as the voters' correlations. The posterior of y weighs the votes by
   the inverse of the covariance within classes.
3. A linear classifier on term counts and votes is trained on the posterior
   labels of a bounded sample, and scores every document.

Texts are read once to induce and once to vote; scores are column expressions
over the written evidence. Copies of a text count once in everything that is
fitted (by a 64-bit hash), so no repeated text can outweigh the others.

Bounds: ``sample`` labelled texts of each class for induction, ``terms``
candidate terms and ``fit`` texts for the classifier. All documents vote and
enter the label model's statistics, as counts of vote patterns.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, bounded_batches, column, crc_mod, id_texts, least_hashed, named, slabs

SAMPLE = 2500
TERMS = 300
FIT = 8000
LEXICONS = 12
#: Lengths of word beginnings that count as terms.
BEGINNINGS = (4, 5, 6, 7)

_WORD = re.compile(r"[^\W\d_]+")
_ASCII = re.compile(r"[\x00-\x7f]+")


def terms_of(word: str) -> list[str]:
    """A word and its proper beginnings."""
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k)]


def capitals(text: str) -> int:
    """How many letters of the whole text are capitals."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = int(np.count_nonzero((raw >= 65) & (raw <= 90)))
    return n if text.isascii() else n + sum(map(str.isupper, _ASCII.sub("", text)))


@dataclass
class Lexicon:
    """Candidate terms by number; the words met last are remembered up to a bound."""

    terms: list[str]
    weights: list[float]
    memory: int = 100_000

    def __post_init__(self) -> None:
        self.number = {t: i for i, t in enumerate(self.terms)}
        families = {f: k for k, f in enumerate(dict.fromkeys(t[: BEGINNINGS[0]] for t in self.terms))}
        #: the lexicon of each term: families in the order of their best term, in turn
        self.lexicon = [families[t[: BEGINNINGS[0]]] % LEXICONS for t in self.terms]
        self.known: dict[str, tuple[int, ...]] = {}

    def hits(self, word: str) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= self.memory:
                self.known.clear()
            got = self.known[word] = tuple(self.number[t] for t in terms_of(word) if t in self.number)
        return got

    def features(self, text: str | None) -> tuple[dict[int, int], int, float, float]:
        """Counts of candidate terms, words, share of capitals and of exclamation marks."""
        if not text:
            return {}, 0, 0.0, 0.0
        counts, found = {}, _WORD.findall(text.lower())
        known, hits = self.known, self.hits
        for word, n in Counter(found).items():
            for t in known[word] if word in known else hits(word):
                counts[t] = counts.get(t, 0) + n
        return counts, len(found), capitals(text) / len(text), text.count("!") / len(text)

    def votes(self, counts: dict[int, int], n: int, capitals: float, marks: float) -> list[int]:
        out = [0] * LEXICONS
        for t in counts:
            out[self.lexicon[t]] = 1
        total, different = sum(counts.values()), len(counts)
        return [
            *out,
            1 if different >= 2 else 0,
            1 if different >= 4 else 0,
            1 if total * 50 >= n and total else 0,
            -1 if not total else 0,
            1 if capitals > 0.3 else 0,
            1 if marks > 0.01 else 0,
        ]


VOTERS = LEXICONS + 6
#: The voter that says clean: no term occurs.
SILENT = LEXICONS + 3


def code(votes: list[int]) -> int:
    """Votes as one number, two bits each."""
    return sum((v + 1) << (2 * i) for i, v in enumerate(votes))


def decode(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] >> (2 * np.arange(VOTERS)) & 3) - 1


class LabelModel:
    """Accuracies and correlations of voters, from their first and second moments alone."""

    def __init__(self, n: int, first: np.ndarray, second: np.ndarray, prior: float, rounds: int = 60, drop: float = 0.1) -> None:
        self.prior = min(max(prior, 1e-4), 1 - 1e-4)
        self.mean = first / max(n, 1)
        cov = second / max(n, 1) - np.outer(self.mean, self.mean)
        k, c = len(first), self.prior * (1 - self.prior)
        use = ~np.eye(k, dtype=bool)
        quiet = np.diag(cov) < 1e-9
        use[quiet] = use[:, quiet] = False
        value, vectors = np.linalg.eigh(np.where(use, cov, 0.0))
        a = vectors[:, -1] * math.sqrt(max(value[-1], 1e-12))
        for step in range(3):  # each time without the pairs that depend most beyond the class
            for _ in range(rounds):
                for i in range(k):
                    weight = a[use[i]]
                    if (s := float(weight @ weight)) > 1e-12:
                        a[i] = float(cov[i, use[i]] @ weight) / s
            rest = np.abs(cov - np.outer(a, a)) / np.sqrt(np.outer(np.diag(cov), np.diag(cov)) + 1e-12)
            if step < 2 and use.any():
                use &= rest <= np.quantile(rest[use], 1 - drop)
        self.accuracy = a / math.sqrt(c)  # E[v | toxic] - E[v | clean]
        if self.accuracy[:LEXICONS].sum() < 0:
            self.accuracy = -self.accuracy
        within = cov - c * np.outer(self.accuracy, self.accuracy)
        value, vectors = np.linalg.eigh((within + within.T) / 2)
        floor = max(1e-4, 0.1 * float(value.max(initial=0.0)))
        self.correlation = (vectors * np.maximum(value, floor)) @ vectors.T
        self.weights = np.linalg.solve(self.correlation, self.accuracy)
        self.weights[quiet] = 0.0
        middle = self.mean + (0.5 - self.prior) * self.accuracy
        self.bias = math.log(self.prior / (1 - self.prior)) - float(self.weights @ middle)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(votes @ self.weights + self.bias, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression on soft labels, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + keep * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(keep), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = Counter(), Counter()

    def out() -> pa.RecordBatch:
        rows = [(t, side, n) for side in (0, 1) for t, n in counts[side].items()]
        counts[0].clear(), counts[1].clear()
        term, side, n = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(term), pa.array(side, pa.int32()), pa.array(n, pa.int64())], names=["term", "label", "n"])

    for batch in slabs(batches, "text"):
        for text, label in zip(column(batch, "text").to_pylist(), column(batch, "label").to_pylist()):
            counts[label].update({t for w in set(_WORD.findall((text or "").lower())) for t in terms_of(w)})
        if len(counts[0]) + len(counts[1]) > 300_000:
            yield out()
    if counts[0] or counts[1]:
        yield out()


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(named(text_col).cast("string"), F.lit("")))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, id_col: str, text_col: str) -> DataFrame:
    """``hash, label``: the different texts with a label of a row that is not held out; of several labels the largest counts."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), modulus) != held_out))
    known = known.groupBy(F.col("doc_id").alias("known")).agg(F.max(label).cast("int").alias("label"))
    texts = docs.select(named(id_col).alias("id"), text_hash(text_col).alias("hash"))
    return texts.join(known, F.col("id") == F.col("known")).groupBy("hash").agg(F.max("label").alias("label"))


def induce(docs: DataFrame, chosen: list[tuple[int, int]], terms: int = TERMS, text_col: str = "text") -> Lexicon:
    """Terms that set the toxic texts apart, from chosen ``(hash, label)``; empty without texts of both classes."""
    total = Counter(y for _, y in chosen)
    if not total[0] or not total[1]:
        return Lexicon([], [])
    spark = docs.sparkSession
    bounded_batches(spark)
    own = F.broadcast(spark.createDataFrame(chosen, "chosen bigint, label int"))  # two numbers for each text of the bounded sample
    text = docs.select(named(text_col).cast("string").alias("text"), text_hash(text_col).alias("hash"))
    text = text.join(own, F.col("hash") == F.col("chosen")).dropDuplicates(["hash"]).select("text", "label")
    counted = text.mapInArrow(_count_terms, "term string, label int, n bigint").groupBy("term").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"),
    )
    odds = F.log((F.col("toxic") + 0.5) / (total[1] + 1)) - F.log((F.col("clean") + 0.5) / (total[0] + 1))
    least = max(3, math.ceil(0.004 * total[1]))
    best = counted.withColumn("odds", odds).where((F.col("toxic") >= least) & (F.col("odds") >= math.log(12)))
    best = best.orderBy((F.col("odds") * F.sqrt("toxic")).desc(), F.length("term"), "term").limit(terms).collect()
    return Lexicon([r["term"] for r in best], [r["odds"] for r in best])


@dataclass
class Classifier:
    lexicon: Lexicon
    weights: np.ndarray
    model: LabelModel

    def score(self) -> Column:
        """The score of a row of the evidence table."""
        terms = len(self.lexicon.terms)
        gain = F.array(*map(F.lit, self.weights[:terms].tolist() or [0.0]))
        z = F.lit(float(self.weights[-1]))
        for i, w in enumerate(self.weights[terms:-1].tolist()):
            z = z + (F.shiftright("code", 2 * i).bitwiseAND(F.lit(3)) - 1) * F.lit(w)
        parts = F.zip_with("terms", "counts", lambda t, n: F.element_at(gain, t + 1) * F.log1p(n.cast("double")))
        z = z + F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def features(terms: int, ids: list[int], counts: list[int], v: np.ndarray) -> np.ndarray:
    x = np.zeros(terms + VOTERS)
    x[ids] = np.log1p(counts)
    x[terms:] = v
    return x


_EVIDENCE = (("terms", pa.list_(pa.int32()), T.ArrayType(T.IntegerType())), ("counts", pa.list_(pa.int64()), T.ArrayType(T.LongType())), ("code", pa.int64(), T.LongType()))


def evidence(docs: DataFrame, lexicon: Lexicon, id_col: str, text_col: str, whole: bool = False) -> DataFrame:
    """What each whole text holds: ``terms, counts, code`` (of the votes) with ``hash`` and ``id``, or with the ``whole`` row as a struct."""
    if whole:
        bounded_batches(docs.sparkSession)
        picked = docs.select(F.struct(*map(named, docs.columns)).alias("row"), text_hash(text_col).alias("hash"))
        place = docs.columns.index(text_col)
    else:
        picked = id_texts(docs, id_col, text_col, text_hash(text_col).alias("hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if whole else slabs(batches, "text"):
            texts = column(batch, "row").field(place).cast(pa.string()) if whole else column(batch, "text")
            found = [lexicon.features(t) for t in texts.to_pylist()]
            values = ([list(f[0]) for f in found], [list(f[0].values()) for f in found], [code(lexicon.votes(*f)) for f in found])
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, c) for c in kept), *(pa.array(v, kind) for v, (_, kind, _) in zip(values, _EVIDENCE))], names=[*kept, *(e[0] for e in _EVIDENCE)],
            )

    schema = T.StructType([f for f in picked.schema if f.name != "text"] + [T.StructField(name, kind) for name, _, kind in _EVIDENCE])
    return picked.mapInArrow(run, schema)


def moments(patterns: list[tuple[int, int]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Texts, sums of votes and of their products, from counts of vote patterns."""
    votes = decode(np.array([p[0] for p in patterns], np.int64)).astype(float)
    n = np.array([p[1] for p in patterns], float)
    return int(n.sum()), n @ votes, (votes * n[:, None]).T @ votes


def _pattern_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, first, second = moments(list(zip(column(batch, "code").to_pylist(), column(batch, "n").to_pylist())))
        yield pa.RecordBatch.from_pydict({"n": [n], "sums": [np.concatenate([first, second.ravel()]).astype(np.int64).tolist()]})


def fit(docs: DataFrame, labels: DataFrame, tables: Tables, modulus: int = 3, held_out: int = 1, sample: int = SAMPLE, fit_rows: int = FIT, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> tuple[Classifier, DataFrame]:
    """Fit on all documents; the classifier and the evidence table."""
    known = tables.write(labelled_texts(docs, labels, "toxic", modulus, held_out, id_col, text_col), "labelled")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = [tuple(r) for y in (0, 1) for r in least_hashed(known.where(F.col("label") == y), "hash", counts.get(y, 0), sample).select("hash", "label").collect()]
    lexicon = induce(docs, chosen, TERMS, text_col)
    table = tables.write(evidence(docs, lexicon, id_col, text_col, whole), "evidence")
    # a copy has the hash and so the votes of its text
    votes = tables.write(table.groupBy("hash").agg(F.min("code").alias("code")).groupBy("code").agg(F.count("*").alias("n")), "patterns")
    sums = votes.mapInArrow(_pattern_moments, "n bigint, sums array<bigint>").select("n", F.posexplode("sums"))
    sums = sums.groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s")).orderBy("pos").collect()
    flat = np.array([r["s"] for r in sums] or [0] * (VOTERS + VOTERS**2), float)
    model = LabelModel(sums[0]["n"] if sums else 0, flat[:VOTERS], flat[VOTERS:].reshape(VOTERS, VOTERS), counts.get(1, 0) / max(1, sum(counts.values())))
    # texts with and without evidence, by their hashes, so that both kinds are there
    silent = F.shiftright("code", 2 * SILENT).bitwiseAND(F.lit(3)) == 0
    texts = {r["s"]: r["n"] for r in votes.groupBy(silent.alias("s")).agg(F.sum("n").alias("n")).collect()}
    rows = []
    for kind, n in texts.items():
        of_kind = least_hashed(table.where(silent == F.lit(kind)), "hash", n, fit_rows // 2, distinct=True)
        rows += of_kind.select("terms", "counts", "code").collect()
    if not lexicon.terms or not rows:
        return Classifier(lexicon, np.append(np.zeros(len(lexicon.terms) + VOTERS), -4.0), model), table
    v = decode(np.array([r["code"] for r in rows], np.int64))
    x = np.array([features(len(lexicon.terms), r["terms"], r["counts"], own) for r, own in zip(rows, v)])
    return Classifier(lexicon, logistic(x, model.posterior(v.astype(float))), model), table


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id, score``: one row for each document; labels, language, source and id never enter a score.

    Null and empty texts get the score of a text without evidence; equal
    texts get equal scores. Without labelled rows of both classes nothing is
    toxic. An empty table gives an empty result. Other columns may have any
    names; repeated rows come back repeated.
    """
    classifier, table = fit(docs, labels, Tables(docs.sparkSession, "toxicity"), id_col=id_col, text_col=text_col, **options)
    return table.select("id", classifier.score().alias("score"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score below ``threshold``, in the columns of ``docs``."""
    classifier, table = fit(docs, labels, Tables(docs.sparkSession, "toxicity"), id_col=id_col, text_col=text_col, whole=True)
    return table.where(classifier.score() < threshold).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
