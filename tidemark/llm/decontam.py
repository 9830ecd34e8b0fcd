"""Benchmark decontamination with a BM25 index of the test items and block-max WAND.

The items are the indexed side: postings of (item, weight) for each word, in
blocks with their largest weights. Weights are divided by the item's
threshold, so every item is retrieved at a score of one. The threshold is not
a guess: it is the least score that a passage can have which passes the final
verification (the item's full score less its ``k`` heaviest words, where
``k`` shingles may be missing), so retrieval loses nothing.

Every document is read in overlapping passages, and every passage is a query.
Items are grouped in tiers by the power of two above their length; a tier's
passages are twice that power long, so an item's text always lies inside one,
and what is found doesn't depend on the other items. A cheap first test bounds
the scores of many passages at once by the largest weights of their words and
the maxima of the blocks; only a passage that this bound lets through is
queried by WAND (pivot, block maxima, skipping cursors), and what it retrieves
is verified by word shingles (of question and answer, if marked).
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, column, id_texts, named, slabs

WIDTH = 5
SIMILARITY = 0.8
#: Items and bytes of their texts in one index that is sent to the workers, about; more are taken in several passes.
ITEMS, ITEM_BYTES = 20_000, 8 << 20
K1, B = 1.2, 0.75
BLOCK = 16
#: Cells of one table of bounds (passages by blocks).
CELLS = 1 << 19

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(ws: list[str], width: int = WIDTH) -> set[tuple[str, ...]]:
    if not ws:
        return set()
    return {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))}


_MARK = r"(?i)\banswer\s*:"


def answer_marked(text: str) -> bool:
    """Whether an item has an "Answer:" mark between words."""
    m = re.search(_MARK, text.rstrip())
    return bool(m and words(text[: m.start() + 1]) and words(text[m.end() :]))


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of an item's question and answer: cut at an "Answer:" mark, else before the last line, else the last sentence."""
    for mark in (_MARK, r"\n(?=[^\n]*\Z)", r"[.?!]\s+(?=[^.?!]*[.?!]?\s*\Z)"):
        if (m := re.search(mark, text.rstrip())) and words(text[: m.start() + 1]) and words(text[m.end() :]):
            return words(text[: m.start() + 1]), words(text[m.end() :])
    return words(text), []


@dataclass
class Tier:
    """Items of similar length with their postings."""

    length: int
    items: list[int] = field(default_factory=list)
    #: term -> places of items in the tier, weights, and the largest weight of each block
    postings: dict[int, tuple[np.ndarray, np.ndarray, dict[int, float]]] = field(default_factory=dict)
    largest: np.ndarray | None = None
    #: the blocks of all terms in a row: where each term's begin, blocks, largest weights
    begin: np.ndarray | None = None
    block: np.ndarray | None = None
    weight: np.ndarray | None = None


class Cursor:
    """A place in the postings of one term."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, blocks: dict[int, float], largest: float) -> None:
        self.places, self.weights, self.blocks, self.largest = places, weights, blocks, largest
        self.at, self.item = 0, int(places[0])

    def skip(self, item: int) -> bool:
        """Go on to the first item from ``item`` on; False at the end."""
        self.at += int(np.searchsorted(self.places[self.at :], item))
        if self.at == len(self.places):
            return False
        self.item = int(self.places[self.at])
        return True


class Index:
    """BM25 index of ``(item_id, text)``; words of all items have numbers from 1 on."""

    def __init__(self, items: list[tuple[int, str]], width: int = WIDTH, similarity: float = SIMILARITY) -> None:
        self.width, self.similarity = width, similarity
        self.ids, self.words = [], []
        self.parts: list[tuple[list[str], list[str], bool]] = []
        for i, text in items:
            ws = words(text)
            if ws:
                self.ids.append(i)
                self.words.append(ws)
                self.parts.append((*question_answer(text), answer_marked(text)))
        self.memory: dict[int, tuple[set, set, set]] = {}
        df = Counter(w for ws in self.words for w in set(ws))
        self.number = {w: n + 1 for n, w in enumerate(sorted(df))}
        n, mean = len(self.words), sum(map(len, self.words)) / max(1, len(self.words))
        idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
        tiers: dict[int, Tier] = {}
        weights: list[dict[str, float]] = []
        for k, ws in enumerate(self.words):
            own = {w: idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / mean)) for w, tf in Counter(ws).items()}
            missing = math.floor((1 - similarity) * len(shingles(ws, width)) + 1e-9)
            least = sum(sorted(own.values())[: max(1, len(own) - missing)])
            weights.append({w: x / least for w, x in own.items()})
            size = max(8, 1 << (len(ws) - 1).bit_length()) if len(ws) > 1 else 8
            tiers.setdefault(size, Tier(size)).items.append(k)
        self.tiers = [tiers[s] for s in sorted(tiers)]
        for tier in self.tiers:
            lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
            for place, k in enumerate(tier.items):
                for w, x in weights[k].items():
                    lists[self.number[w]].append((place, x))
            tier.largest = np.zeros(len(self.number) + 1)
            for t, rows in lists.items():
                at, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
                blocks, starts = np.unique(at // BLOCK, return_index=True)
                tier.postings[t] = at, x, dict(zip(blocks.tolist(), np.maximum.reduceat(x, starts).tolist()))
                tier.largest[t] = x.max()
            order = sorted(tier.postings)
            counts = np.zeros(len(self.number) + 1, np.int64)
            counts[order] = [len(tier.postings[t][2]) for t in order]
            tier.begin = np.concatenate([[0], np.cumsum(counts)])
            tier.block = np.concatenate([list(tier.postings[t][2]) for t in order])
            tier.weight = np.concatenate([list(tier.postings[t][2].values()) for t in order])

    def sets(self, item: int) -> tuple[set, set, set]:
        """Shingles of the whole item, its question and its answer; made when an item is met and kept for a while."""
        got = self.memory.get(item)
        if got is None:
            if len(self.memory) >= 1000:
                self.memory.clear()
            question, answer, _ = self.parts[item]
            got = self.memory[item] = tuple(shingles(ws, self.width) for ws in (self.words[item], question, answer))
        return got

    def hopeful(self, tier: Tier, terms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which passages may reach a score of one: by the largest weights of their distinct terms, then by block maxima."""
        size = ends - starts
        at = np.repeat(ends - np.cumsum(size), size) + np.arange(int(size.sum()))
        own = terms[at].astype(np.int64)
        known = own > 0
        width = len(tier.largest)
        pairs = np.unique(np.repeat(np.arange(len(starts)), size)[known] * width + own[known])
        passage, term = pairs // width, pairs % width
        high = np.bincount(passage, tier.largest[term], len(starts)) >= 1 - 1e-9
        if not high.any():
            return high
        blocks = int(tier.block.max()) + 1
        able, step = np.flatnonzero(high), max(1, CELLS // blocks)
        for lo in range(0, len(able), step):  # a bounded table at a time
            some = able[lo : lo + step]
            first, last = np.searchsorted(passage, [some[0], some[-1] + 1])
            row, own = np.searchsorted(some, passage[first:last]), term[first:last]
            there = some[np.minimum(row, len(some) - 1)] == passage[first:last]
            row, own = row[there], own[there]
            count = tier.begin[own + 1] - tier.begin[own]
            at = np.repeat(tier.begin[own + 1] - np.cumsum(count), count) + np.arange(int(count.sum()))
            bound = np.bincount(np.repeat(row, count) * blocks + tier.block[at], tier.weight[at], len(some) * blocks)
            high[some] = (bound.reshape(-1, blocks) >= 1 - 1e-9).any(axis=1)
        return high

    def retrieve(self, tier: Tier, terms: list[int]) -> list[int]:
        """All items whose score for the distinct ``terms`` is one or more, by block-max WAND.

        Cursors stand in the order of their items. The pivot is the first at
        which the largest weights of the terms up to it reach one: no item
        before it can. If the maxima of the blocks around the pivot's item do
        so as well, the item is scored once all cursors before it are there;
        otherwise they skip to the end of the block or to the next cursor.
        Blocks are aligned over item numbers, so they end together.
        """
        cursors = [Cursor(*tier.postings[t], float(tier.largest[t])) for t in terms if t in tier.postings]
        found, least = [], 1 - 1e-9
        while cursors:
            cursors.sort(key=lambda c: c.item)
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += c.largest
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot].item
            while pivot + 1 < len(cursors) and cursors[pivot + 1].item == item:
                pivot += 1
            block = item // BLOCK
            if sum(c.blocks.get(block, 0.0) for c in cursors[: pivot + 1]) < least:
                goal = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    goal = min(goal, cursors[pivot + 1].item)
            elif cursors[0].item == item:
                if sum(float(c.weights[c.at]) for c in cursors[: pivot + 1]) >= least:
                    found.append(tier.items[item])
                goal = item + 1
            else:
                goal = item
            cursors = [c for k, c in enumerate(cursors) if k > pivot or c.item >= goal or c.skip(goal)]
        return found

    def overlap(self, item: int, there: set) -> tuple[float, float, float] | None:
        """Shares of the item's, its question's and its answer's shingles; None if that is no leak.

        Only an item with an answer mark must show some of its question and of its answer.
        """
        sets = self.sets(item)
        whole = len(sets[0] & there) / len(sets[0])
        if whole < self.similarity - 1e-9:
            return None
        question, answer = (len(s & there) / len(s) if s else 1.0 for s in sets[1:])
        both = question > 0 and (answer > 0 or len(sets[2]) <= 1)
        return (whole, question, answer) if both or not self.parts[item][2] else None

    def search(self, text: str | None) -> dict[int, tuple[float, float, float]]:
        """Item ids found in a text, with their overlaps; of items of one id the largest."""
        best: dict[int, tuple[float, float, float]] = {}
        for place, got in self.found(text).items():
            i = self.ids[place]
            best[i] = max(got, best.get(i, got))
        return best

    def found(self, text: str | None) -> dict[int, tuple[float, float, float]]:
        """Places of the items found in a text, with their overlaps."""
        ws = words(text)
        terms = np.fromiter(map(self.number.get, ws, itertools.repeat(0)), np.int32, len(ws))
        best: dict[int, tuple[float, float, float]] = {}
        if not terms.any():
            return best
        for tier in self.tiers:
            step = tier.length
            sums = np.concatenate([[0.0], np.cumsum(tier.largest[terms])])
            starts = np.arange(0, max(1, len(ws) - step), step)
            ends = np.minimum(starts + 2 * step, len(ws))
            able = np.flatnonzero(sums[ends] - sums[starts] >= 1 - 1e-6)
            if len(able):
                able = able[self.hopeful(tier, terms, starts[able], ends[able])]
            for k in able.tolist():
                s, e = int(starts[k]), int(ends[k])
                own = [t for t in set(terms[s:e].tolist()) if t]
                there = None
                for item in self.retrieve(tier, own):
                    there = shingles(ws[s:e], self.width) if there is None else there
                    # an item of fewer words than a shingle is looked for as a whole
                    if len(self.words[item]) < self.width:
                        there = there | {tuple(ws[i : i + len(self.words[item])]) for i in range(s, e)}
                    for part in self.sets(item)[1:]:
                        for n in {len(x) for x in part if len(x) < self.width}:
                            there = there | {tuple(ws[i : i + n]) for i in range(s, e - n + 1)}
                    got = self.overlap(item, there)
                    if got and got > best.get(item, (0.0,)):
                        best[item] = got
        return best


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, items: int = ITEMS) -> DataFrame:
    """One row for each document and item whose text it holds: ``id, item_id, overlap, question, answer``.

    Items without words match nothing; equal items are reported each, also
    those of one id, which may be of any type or null. Nulls and empty texts
    hold nothing. Repeated rows are reported each. An index
    holds about ``items`` items and ``ITEM_BYTES`` of text; a larger benchmark
    is taken in several passes over the documents, with the same rows.
    """
    spark = docs.sparkSession
    slices = _slices(benchmark, items)
    picked = id_texts(docs, id_col, text_col)
    kind, item_kind = (f.schema[c].dataType.simpleString() for f, c in ((picked, "id"), (slices[0], "item_id")))
    item_type = to_arrow_type(slices[0].schema["item_id"].dataType)
    schema = f"id {kind}, item_id {item_kind}, overlap double, question double, answer double"
    out = spark.createDataFrame([], schema)
    for tests in slices:
        index = spark.sparkContext.broadcast(Index(sorted(map(tuple, tests.collect()), key=str), width, similarity))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ids, found = index.value.ids, index.value.found
            for batch in slabs(batches, "text"):
                rows = [(i, ids[place], *got) for i, text in enumerate(column(batch, "text").to_pylist()) for place, got in found(text).items()]
                if rows:
                    at, item, *shares = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [column(batch, "id").take(pa.array(at)), pa.array(item, item_type), *(pa.array(s, pa.float64()) for s in shares)],
                        names=["id", "item_id", "overlap", "question", "answer"],
                    )

        found = picked.mapInArrow(run, schema)
        out = found if len(slices) == 1 else out.union(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", items: int = ITEMS) -> DataFrame:
    """The documents that hold no item, in the columns of ``docs``, whatever their names; a null text holds none."""
    spark = docs.sparkSession
    bounded_batches(spark)
    columns, place = docs.columns, docs.columns.index(text_col)
    docs = docs.select(F.struct(*map(named, columns)).alias("row"))
    for tests in _slices(benchmark, items):
        index = spark.sparkContext.broadcast(Index(sorted(map(tuple, tests.collect()), key=str)))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(0).field(place).cast(pa.string()).to_pylist()
                yield batch.filter(pa.array([not index.value.found(text) for text in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.select(*[F.col("row").getField(c).alias(c) for c in columns])


def _slices(benchmark: DataFrame, items: int) -> list[DataFrame]:
    """The items with a text, in slices of about ``items`` items and ``ITEM_BYTES``."""
    tests = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    count, size = tests.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-count // items), -(-size // ITEM_BYTES))
    return [tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]
