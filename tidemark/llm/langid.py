"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text is
built. A document is parsed against it: each phrase is the longest prefix of
what is left that occurs in the sample, and the parse goes on at the symbol
that broke it. Few phrases mean a small cross entropy; the language that
needs the fewest wins.

The parse needs nothing but the automaton's transitions, so they are laid
out as one table (state, symbol) -> next state and a mark for a new phrase.
Texts are cut into stretches that step through it together, each from the
start state first. Then each stretch is stepped again from the state in which
the one before it ends, until it meets the states of the first pass, as it
nearly always does after a phrase or two; where it doesn't, the next stretch is
done again. The counts are those of one parse of the whole text.

Symbols are letters: the most frequent ones by themselves, any other as its
code point in five digits, so that no letter of any script is lost.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, crc_mod, id_texts, named, slabs

#: Labelled text of each language, in symbols, and documents it comes from at most.
SAMPLE = 24_000
DOCUMENTS = 60
#: Letters that are symbols of their own, and the digits that spell the others.
SYMBOLS, DIGITS, PLACES = 64, 32, 5
STRETCH = 1024


def letters(text: str) -> bool:
    return any(map(str.isalpha, text))


_OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower case; whatever is no letter is a space."""
    return _OTHER.sub(" ", unicodedata.normalize("NFC", text.lower()))


def automaton(symbols: list[int], alphabet: int) -> np.ndarray:
    """Transitions of the suffix automaton: rows are states, -1 where there is none."""
    n = 2 * len(symbols) + 2
    step = np.full((n, alphabet), -1, np.int32)
    link, length = [-1] * n, [0] * n
    goto: list[dict[int, int]] = [{}]
    last, size = 0, 1
    for c in symbols:
        cur, size = size, size + 1
        length[cur] = length[last] + 1
        goto.append({})
        p = last
        while p != -1 and c not in goto[p]:
            goto[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = goto[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone, size = size, size + 1
                length[clone] = length[p] + 1
                goto.append(dict(goto[q]))
                link[clone] = link[q]
                while p != -1 and goto[p].get(c) == q:
                    goto[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    for s, out in enumerate(goto):
        for c, t in out.items():
            step[s, c] = t
    return step[:size]


class Parser:
    """Counts phrases against each language's automaton."""

    def __init__(self, samples: dict[str, str], sample: int = SAMPLE) -> None:
        self.languages = sorted(samples)
        counts = Counter(c for t in samples.values() for c in t)
        known = sorted(counts, key=lambda c: (-counts[c], c))[:SYMBOLS]
        self.alphabet = SYMBOLS + DIGITS
        self.code = np.full(0x110000, 255, np.uint8)
        for i, c in enumerate(known):
            self.code[ord(c)] = i
        self.tables, self.bits = [], []
        for name in self.languages:
            symbols = self.symbols(samples[name])[:sample]
            step = automaton(symbols.tolist(), self.alphabet)
            start = step[0].copy()
            start[start < 0] = 0  # a symbol that the sample lacks is a phrase of its own
            table = np.where(step >= 0, step * 2, start[None, :] * 2 + 1)
            self.tables.append(table.astype(np.int32).ravel())
            #: Bits that name a phrase, about: the logarithm of the sample's length.
            self.bits.append(math.log2(max(2, len(symbols))))

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = self.code[points]
        other = code == 255
        if not other.any():
            return code
        widths = np.where(other, PLACES, 1)
        ends = np.cumsum(widths)
        out = np.empty(int(ends[-1]), np.uint8)
        out[ends[~other] - 1] = code[~other]
        for k in range(PLACES):  # the lowest digit comes last
            out[ends[other] - 1 - k] = SYMBOLS + (points[other] >> np.uint32(5 * k) & np.uint32(DIGITS - 1))
        return out

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text (rows) for each language (columns)."""
        codes = [self.symbols(plain(t)) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [-(-len(c) // STRETCH) for c in codes])
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        if not len(owner):
            return out
        parts = [c[at : at + STRETCH] for c in codes for at in range(0, len(c), STRETCH)]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        width = int(sizes.max())
        order = np.argsort(-sizes, kind="stable")
        place = np.empty(len(parts), np.int64)
        place[order] = np.arange(len(parts))
        grid = np.zeros((width, len(parts)), np.int32)
        for k, i in enumerate(order.tolist()):
            grid[: sizes[i], k] = parts[i]
        # how many stretches are still going at each step; the longest come first
        going = np.searchsorted(-sizes[order], -np.arange(width), "left")
        later = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # stretches with one before them
        there = np.bincount(owner, minlength=len(texts)) > 0
        for column_, table in enumerate(self.tables):
            path = np.zeros((width, len(parts)), np.int32)
            state = np.zeros(len(parts), np.int32)
            for t in range(width):
                n = int(going[t])
                got = table[state[:n] * self.alphabet + grid[t, :n]]
                path[t, :n] = got
                state[:n] = got >> 1
            todo = later
            while len(todo):
                todo = self._carried(table, grid, path, state, place[todo], place[todo - 1], sizes[todo])
                todo = np.intersect1d(order[todo] + 1, later)
            marks = np.zeros(len(texts), np.int64)
            np.add.at(marks, owner[order], (path & 1).sum(axis=0))
            out[:, column_] = marks + there  # the phrase that the end cuts off
        return out

    def _carried(self, table: np.ndarray, grid: np.ndarray, path: np.ndarray, state: np.ndarray, own: np.ndarray, before: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Step stretches from the end states of those before them; which of them end in another state than they did."""
        now, changed = state[before].copy(), []
        t = 0
        while len(own):
            got = table[now * self.alphabet + grid[t, own]]
            apart = got >> 1 != path[t, own] >> 1
            path[t, own] = got
            t += 1
            own, now, sizes = own[apart], got[apart] >> 1, sizes[apart]
            end = sizes == t
            if end.any():
                state[own[end]] = now[end]
                changed.append(own[end])
                own, now, sizes = own[~end], now[~end], sizes[~end]
        return np.concatenate(changed) if changed else np.zeros(0, np.int64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; ``und`` and 0 without a letter or a learned language."""
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and letters(t)]
        if not at or not self.languages:
            return langs, scores
        counts = self.phrases([texts[i] for i in at])
        cost = counts * np.array(self.bits)[None, :]
        for i, row, n in zip(at, cost, counts):
            best = int(np.argmin(row))
            langs[i] = self.languages[best]
            # the posterior if each bit of cross entropy in 32 counted
            scores[i] = float(1 / np.exp2(-(row - row[best]) / 32).sum())
        return langs, scores


@functools.lru_cache(maxsize=2)
def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    """One parser for each model in a worker process."""
    return Parser(dict(samples))


def learn(docs: DataFrame, modulus: int = 4, held_out: int = 2, sample: int = SAMPLE, documents: int = DOCUMENTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[tuple[str, str], ...]:
    """A sample of text for each language.

    It comes from the ``documents`` different labelled texts with the smallest
    hash that are not held out and have a letter. Each gives a stretch of the
    same length at most, from its middle, until ``sample`` symbols are there.
    Languages are the few values of a label, one row each on the driver.
    """
    text = named(text_col).cast("string")
    known = docs.where(named(lang_col).isNotNull() & text.isNotNull() & (F.octet_length(text) > 0) & (crc_mod(named(id_col), modulus) != held_out))
    lang = named(lang_col).cast("string").alias("lang")
    counts = {r[0]: r[1] for r in known.select(lang, F.xxhash64(text).alias("h")).distinct().groupBy("lang").count().collect()}
    each = max(1, sample * 2 // documents)
    middle = F.substring(text, F.greatest(F.lit(1), ((F.length(text) - each) / 2).cast("int")), F.lit(each))
    picked = known.select(lang, middle.alias("text"), F.xxhash64(text).alias("h"))
    limits = None
    for name, n in sorted(counts.items()):
        # hashes below this bound: about twice the texts that are needed, the rest is cut by the order
        bound = min(1.0, 2 * documents / n) * 2.0**64 - 2.0**63
        here = (F.col("lang") == name) & (F.col("h").cast("double") <= bound)
        limits = here if limits is None else limits | here
    found: dict[str, list] = {}
    if limits is not None:
        for r in picked.where(limits).dropDuplicates(["lang", "h"]).collect():  # 2 * documents short texts a language, about
            found.setdefault(r["lang"], []).append((r["h"], r["text"]))
    out = []
    for name, rows in sorted(found.items()):
        whole = " ".join(plain(t) for _, t in sorted(rows)[: 2 * documents] if letters(t))[:sample]
        if whole and name != "und":
            out.append((name, whole))
    return tuple(out)


def predict(docs: DataFrame, samples: tuple[tuple[str, str], ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` for each row, from its whole text alone.

    Null, empty and letterless texts are ``und`` with score 0; so is all if
    nothing was learned. Repeated rows get equal results. An empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = parser(samples)
        for batch in slabs(batches, "text", 1 << 21):
            langs, scores = model.predict(column(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(langs), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    picked = id_texts(docs, id_col, text_col)
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, lang_pred string, score double")
