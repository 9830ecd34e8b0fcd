"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut into words before each white-space sign that follows another
sign; no piece of the vocabulary spans such a cut (else a text is one word). Long
runs of white space are cut where their pieces end in any case. Each different
word of a slab is encoded once in a worker, many at a time, as one flat array of
symbols with the number of their word:

1. each pair of neighbours is looked up among all splits of all pieces;
2. each word's best rank is its minimum over its segment;
3. all its pairs of that rank merge at once, from the left without overlap. A
   merge may make a pair of the same or a better rank, which must be next; then
   the word's later pairs of this round wait, so the order is that of one merge
   after another;
4. words without a pair leave, the rest are compacted, and the next round
   begins.

What is left are pieces, or signs outside the vocabulary, which become bytes.
Decoding looks up the bytes of each piece and joins them flat.

Null and empty texts have no ids and decode to an empty text. The sign U+2581
stands for a space, as in the library. Repeated rows are encoded as often as
they occur, and whole texts of any length; a word is bounded by its text alone.
Other columns are not read. Models with other kinds of pieces or a normaliser
of their own are refused.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import column, id_texts, slabs, utf8

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_NEVER = np.iinfo(np.int32).max
#: Signs of words encoded at once, about; words and ids that a worker remembers before it starts anew.
CHUNK, MEMORY, MEMORY_IDS = 200_000, 400_000, 4_000_000


def _model(path: str):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    norm, kinds = model.normalizer_spec, {p.type for p in model.pieces}
    plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces and norm.add_dummy_prefix
    if model.trainer_spec.model_type != model.trainer_spec.BPE or not plain or not model.trainer_spec.byte_fallback or not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
        raise ValueError("a BPE model with byte fallback, a dummy prefix and no normaliser is needed")
    if model.trainer_spec.treat_whitespace_as_suffix or model.denormalizer_spec.precompiled_charsmap:
        raise ValueError("white space must come before a word, and no denormaliser may be given")
    return model


class Pieces:
    """The tables of one vocabulary, and what a worker remembers of it."""

    def __init__(self, path: str) -> None:
        model = _model(path)
        pieces = model.pieces
        self.size = len(pieces)
        normal = {p.piece: i for i, p in enumerate(pieces) if p.type == _NORMAL}
        self.byte_id = np.zeros(256, np.int64)
        for i, p in enumerate(pieces):
            if p.type == _BYTE:
                self.byte_id[int(p.piece[1:-1], 16)] = i
        # symbols: pieces, then signs that occur inside pieces only, then all other signs
        inner = sorted({c for p in normal for c in p} - {p for p in normal if len(p) == 1})
        symbol = normal | {c: self.size + k for k, c in enumerate(inner)}
        self.symbols = self.size + len(inner)
        self.sign_of = np.array([ord(c) for c in inner], np.int64)
        self.of_sign = np.arange(0x110000, dtype=np.int64) + self.symbols
        for c, s in symbol.items():
            if len(c) == 1:
                self.of_sign[ord(c)] = s
        self.of_sign[ord(" ")] = self.of_sign[ord(SPACE)]
        scores = sorted({pieces[i].score for i in normal.values()}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        pairs = {}
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                a, b = symbol.get(piece[:k]), symbol.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * self.symbols + b] = (rank[pieces[i].score], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.into = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self._whitespace(normal, pieces, scores)
        # what each id decodes to
        surfaces = []
        for i, p in enumerate(pieces):
            if p.type == _BYTE:
                surfaces.append(bytes([int(p.piece[1:-1], 16)]))
            elif p.type == _UNKNOWN:
                surfaces.append(model.trainer_spec.unk_surface.encode())
            else:
                surfaces.append(b"" if p.type == _CONTROL else p.piece.replace(SPACE, " ").encode())
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        self.surface_end = np.cumsum([len(s) for s in surfaces])
        self.control = np.array([p.type == _CONTROL for p in pieces])
        self.is_byte = np.array([p.type == _BYTE for p in pieces])
        self.spaced = np.array([p.type == _NORMAL and p.piece.startswith(SPACE) for p in pieces])
        self._forget()

    def _whitespace(self, normal: dict[str, int], pieces, scores: list[float]) -> None:
        """Whether texts are cut before white space, and after how many signs a run of it is."""
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in normal)
        runs = {len(p) for p in normal if len(p) > 1 and not p.strip(SPACE)}
        last = all(pieces[normal[SPACE * n]].score == scores[-1] for n in runs)
        alone = all(not p.strip(SPACE) for p, i in normal.items() if len(p) > 1 and pieces[i].score == scores[-1])
        self.run = None
        if runs and last and alone and len(scores) > 1:
            # such runs grow from the left, after all else; the longest is cut off if it always comes first
            longest = max(runs)
            sizes = np.arange(longest + 1, 2 * longest + 1)
            found, word = self.merged(np.full(int(sizes.sum()), normal.get(SPACE, -1)), np.repeat(sizes, sizes))
            if SPACE in normal and (found[np.searchsorted(word, sizes)] == normal[SPACE * longest]).all():
                self.run = longest

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.ends = np.zeros(1 << 18, np.int32), np.zeros(1 << 16, np.int64)
        self.used = self.count = 0

    # merge rounds

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; ``_NEVER`` where there is none."""
        if not len(self.keys):
            return np.full(len(a), _NEVER, np.int32), np.zeros(len(a), np.int64)
        key = np.where((a < self.symbols) & (b < self.symbols), a * self.symbols + b, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER), self.into[at]

    def _pairs(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of the pairs that begin at the places ``at``."""
        after = np.minimum(at + 1, len(symbols) - 1)
        rank, into = self._look_up(symbols[at], symbols[after])
        rank[(after == at) | (word[after] != word[at])] = _NEVER
        return rank, into

    def merged(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left of each word, and their words, in order."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, into = self._pairs(symbols, word, np.arange(len(symbols)))
        while len(symbols):
            first = np.ones(len(symbols), bool)
            first[1:] = word[1:] != word[:-1]
            segment = np.cumsum(first) - 1
            least = np.minimum.reduceat(rank, np.flatnonzero(first))
            live = least != _NEVER
            if not live.all():
                stay = live[segment]
                done.append((symbols[~stay], word[~stay]))
                symbols, word, rank, into, first = symbols[stay], word[stay], rank[stay], into[stay], first[stay]
                if not len(symbols):
                    break
                segment, least = np.cumsum(first) - 1, least[live]
            best = np.flatnonzero(rank == least[segment])
            # of best pairs in a row every second one, from the left
            new = np.ones(len(best), bool)
            new[1:] = best[1:] != best[:-1] + 1
            start = np.maximum.accumulate(np.where(new, np.arange(len(best)), 0))
            best = best[(np.arange(len(best)) - start) % 2 == 0]
            best = best[self._in_order(symbols, word, into, best, least[segment[best]])]
            symbols[best] = into[best]
            keep = np.ones(len(symbols), bool)
            keep[best + 1] = False
            place = np.cumsum(keep) - 1
            symbols, word, rank, into = symbols[keep], word[keep], rank[keep], into[keep]
            at = place[best]
            at = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[at], into[at] = self._pairs(symbols, word, at)
        symbols = np.concatenate([d[0] for d in done]) if done else symbols
        word = np.concatenate([d[1] for d in done]) if done else word
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _in_order(self, symbols: np.ndarray, word: np.ndarray, into: np.ndarray, best: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which of the pairs merge now: in each word, those up to the first whose merge makes a pair that comes before the others."""
        made = into[best]
        before = np.maximum(best - 1, 0)
        left = symbols[before]
        joined = np.zeros(len(best), bool)
        joined[1:] = best[1:] == best[:-1] + 2
        left = np.where(joined, np.concatenate([made[:1], made[:-1]]), left)
        rank, _ = self._look_up(left, made)
        urgent = (rank <= least) & (best > 0) & (word[before] == word[best])
        after = np.minimum(best + 2, len(symbols) - 1)
        rank, _ = self._look_up(made, symbols[after])
        urgent |= (rank <= least) & (best + 2 < len(symbols)) & (word[after] == word[best])
        if not urgent.any():
            return np.ones(len(best), bool)
        total = np.cumsum(urgent) - urgent  # urgent pairs before each
        new = np.ones(len(best), bool)
        new[1:] = word[best[1:]] != word[best[:-1]]
        return total == np.maximum.accumulate(np.where(new, total, 0))

    def _spelled(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids: signs outside the vocabulary become the pieces of their bytes."""
        odd = np.flatnonzero(symbols >= self.size)
        if not len(odd):
            return symbols, word
        sign = symbols[odd]
        inner = sign < self.symbols
        sign = np.where(inner, self.sign_of[np.where(inner, sign - self.size, 0)] if len(self.sign_of) else 0, sign - self.symbols)
        raw, offsets = utf8(pa.array([chr(c) for c in sign.tolist()], pa.large_string()))
        times = np.ones(len(symbols), np.int64)
        times[odd] = np.diff(offsets)
        ids = np.repeat(symbols, times)
        ids[np.repeat(symbols >= self.size, times)] = self.byte_id[raw]
        return ids, np.repeat(word, times)

    def _learn(self, words: list[str]) -> None:
        """Encode new words and remember them."""
        low = 0
        while low < len(words):
            high, signs = low, 0
            while high < len(words) and (high == low or signs + len(words[high]) <= CHUNK):
                signs += len(words[high])
                high += 1
            part = words[low:high]
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            signs = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
            ids, word = self._spelled(*self.merged(self.of_sign[signs], np.repeat(np.arange(len(part)), sizes)))
            self._append(ids, np.bincount(word, minlength=len(part)))
            self.index.update(zip(part, range(self.count - len(part), self.count)))
            low = high

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(sizes) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.ends[self.count : self.count + len(sizes)] = self.used + np.cumsum(sizes)
        self.used, self.count = self.used + len(ids), self.count + len(sizes)

    # texts

    def words(self, texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
        """The words of all texts, each behind its white space, and how many each text has."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE, " ")
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        raw, offsets = utf8(texts)
        starts = np.zeros(len(raw), bool)
        if self.cuts and len(raw):
            space = raw == 0x20
            starts[1:] = space[1:] & ~space[:-1]
        starts[offsets[:-1][np.diff(offsets) > 0]] = True
        if self.run and self.cuts and len(raw):
            self._cut_runs(space, starts)
        at = np.flatnonzero(starts)
        ends = np.append(at, len(raw)).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw)))
        return words, np.diff(np.searchsorted(at, offsets))

    def _cut_runs(self, space: np.ndarray, starts: np.ndarray) -> None:
        """Cut long runs of white space into the pieces that they become; the last sign stays with its word."""
        edge = starts | ~space
        edge[1:] |= ~space[:-1]
        begin = np.flatnonzero(edge & space)
        stop = np.append(np.flatnonzero(edge), len(space))
        length = stop[np.searchsorted(stop, begin, "right")] - begin
        for b, n in zip(begin[length > self.run].tolist(), length[length > self.run].tolist()):
            starts[b : b + n : self.run] = True

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        if len(self.index) > MEMORY or self.used > MEMORY_IDS:
            self._forget()
        words, per = self.words(texts)
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        coded = words.dictionary_encode()
        different = coded.dictionary.to_pylist()
        self._learn([w for w in different if w not in self.index])
        entry = np.fromiter(map(self.index.__getitem__, different), np.int64, len(different))[coded.indices.to_numpy()]
        stop = self.ends[entry]
        size = stop - np.where(entry > 0, self.ends[entry - 1], 0)
        total = np.cumsum(size)
        ids = self.flat[np.repeat(stop - total, size) + np.arange(int(total[-1]))]
        edges = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(per)])]
        return ids, np.diff(edges)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of the ids of all texts in a row."""
        stop = self.surface_end[ids]
        size = stop - np.where(ids > 0, self.surface_end[ids - 1], 0)
        # the dummy prefix goes: the white space of a text's first piece that is no control sign
        real = np.flatnonzero(~self.control[ids])
        owner = np.repeat(np.arange(len(counts)), counts)
        lead = real[np.unique(owner[real], return_index=True)[1]]
        lead = lead[self.spaced[ids[lead]]]
        size[lead] -= 1
        total = np.cumsum(size)
        raw = self.surface[np.repeat(stop - total, size) + np.arange(int(total[-1]) if len(total) else 0)]
        ends = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64)
        out = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(ends), pa.py_buffer(raw))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # bytes that are no UTF-8: only where ids come from elsewhere
            lists = np.split(ids, np.cumsum(counts)[:-1])
            out = pa.array([self._decode_broken(x, raw[a:b].tobytes()) for x, a, b in zip(lists, ends[:-1].tolist(), ends[1:].tolist())], pa.large_string())
        return out

    def _decode_broken(self, ids: np.ndarray, raw: bytes) -> str:
        """A text in which a byte that belongs to no sign of its run of byte pieces becomes U+FFFD."""
        out, at, left = [], 0, len(raw) - int((self.surface_end[ids] - np.where(ids > 0, self.surface_end[ids - 1], 0)).sum())
        for broken, run in itertools.groupby(ids.tolist(), lambda i: bool(self.is_byte[i])):
            n = sum(int(self.surface_end[i]) - (int(self.surface_end[i - 1]) if i else 0) for i in run)
            if not broken and left and n:  # the piece that lost its white space
                n, left = n + left, 0
            part, at = raw[at : at + n], at + n
            if not broken:
                out.append(part.decode())
                continue
            k = 0
            while k < len(part):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(part[k : k + size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    size = 1
                k += min(size, len(part) - k)
        return "".join(out)


@functools.cache
def pieces(path: str) -> Pieces:
    """One vocabulary in a worker process."""
    return Pieces(path)


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids, decoded``: each text's ids, and the text that they decode to."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        for batch in slabs(batches, "text"):
            ids, counts = table.encode(column(batch, "text"))
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            decoded = table.decode(ids, counts).cast(pa.string())
            yield pa.record_batch({"id": column(batch, "id"), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), "decoded": decoded})

    return id_texts(docs, id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
