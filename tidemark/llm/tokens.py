"""Exact, cached encoding with the ``tokenizers`` library.

Both vocabularies are applied piece by piece: a text is cut only where the
library's own pre-tokenizer always cuts, each different piece is encoded by
the library once in a worker (letters apart from the signs behind them), and the
ids of a text are joined from its pieces. For the byte-level vocabulary a run
of white space is a piece but for its last sign, which is one as well unless it
is a space that the next word takes along. Texts with control signs that count
as white space in one library and not in the other are encoded whole.
"""

from __future__ import annotations

import functools
import itertools
import os
import re

import numpy as np

#: Most strings and ids that a worker remembers; beyond either the memory starts anew.
MEMORY, MEMORY_IDS = 1_000_000, 10_000_000

#: Signs with which a text is encoded whole.
_DOUBTFUL = re.compile("[\0\x1c-\x1f\x85]")
#: White space that is more than one space or line feed between words.
_ASCII = ("  ", "\n\n", " \n", "\n ", *"\t\x0b\x0c\r")
_WIDE = (*_ASCII, *"\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_SPACES = re.compile(r"(\s+)")
#: ASCII signs that end a run of letters in either pre-tokenizer (an apostrophe may not).
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _letters(string: str) -> bool:
    """Latin letters only, which stay letters in lower case (the capital dotted I ends in a combining sign there)."""
    return string.isalpha() and (string.isascii() or (max(string) <= "\u024f" and string.lower().isalpha()))


#: Letters that signs behind them are split from.
_LAST = frozenset(c for c in map(chr, range(0x250)) if _letters(c))


def vocabulary(name: str) -> str:
    """The file of a public tokenizer; a path is used as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts to arrays of ids.

    ``leading_space``: a piece takes the space before it along (byte-level
    BPE); otherwise white space only separates (word BPE). With it, a piece
    stands for itself behind a space, unless a line feed or the mark
    ``\\0`` (no space) comes first.
    """

    def __init__(self, path: str, leading_space: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.leading = leading_space
        # the sign that begins (byte-level) or ends (word) each piece of a joined text
        edge = (lambda t: t.startswith("\u0120")) if leading_space else (lambda t: t.endswith("</w>"))
        self.edge = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.edge[number] = edge(token)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.ends = np.zeros(1 << 18, np.int64)
        self.used, self.count = 0, 1
        self.marks: dict[int, int] = {}

    def _mark(self, end: int) -> int:
        """The number of the entry that holds an end id alone."""
        if end not in self.marks:
            self.marks[end] = self._store([[end]])
        return self.marks[end]

    def _store(self, entries: list[list[int]]) -> int:
        """Append entries; the number of the first."""
        sizes = np.fromiter(map(len, entries), np.int64, len(entries))
        return self._append(np.fromiter(itertools.chain.from_iterable(entries), np.uint32, int(sizes.sum())), sizes)

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(sizes) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        first = self.count
        self.flat[self.used : self.used + len(ids)] = ids
        self.ends[first : first + len(sizes)] = self.used + np.cumsum(sizes)
        self.used, self.count = self.used + len(ids), first + len(sizes)
        return first

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _simple(self, string: str) -> bool:
        """One piece for either pre-tokenizer, wherever it stands between spaces."""
        return _letters(string)

    def _library(self, strings: list[str]) -> None:
        """Encode strings with the library: plain words many at a time, told apart by their edges, others one by one."""
        simple, rest = [], []
        for s in strings:
            (simple if self._simple(s) else rest).append(s)
        groups = [simple[i : i + 200] for i in range(0, len(simple), 200)]
        for lo in range(0, len(groups), 50):
            part = groups[lo : lo + 50]
            joined = [(" " if self.leading else "") + " ".join(g) for g in part]
            for group, found in zip(part, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
                ids = np.array(found.ids, np.uint32)
                at = np.flatnonzero(self.edge[ids])
                bounds = np.append(at, len(ids)) if self.leading else np.append(0, at + 1)
                if len(bounds) != len(group) + 1 or bounds[0] != 0 or bounds[-1] != len(ids):
                    rest += group
                    continue
                self.index.update(zip(group, range(self._append(ids, np.diff(bounds)), self.count)))
        for lo in range(0, len(rest), 10_000):
            part = rest[lo : lo + 10_000]
            texts = [p.lstrip("\0") if p[:1] in ("\0", "\n") else " " + p for p in part] if self.leading else part
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            self.index.update(zip(part, range(self._store([f.ids for f in found]), self.count)))

    def _learn(self, pieces: set[str]) -> None:
        """Encode new pieces: letters by themselves, with the signs behind them put after."""
        index, split, need = self.index, [], set()
        for piece in pieces:
            core = piece.rstrip(_SIGNS)
            if core[-1:] not in _LAST:
                need.add(piece)
                continue
            tail = piece[len(core) :]
            if tail and self.leading:
                tail = "\0" + tail
            if not self.leading and core.isascii():
                core = core.lower()
            split.append((piece, core, tail))
            need.add(core)
            if tail:
                need.add(tail)
        self._library([n for n in need if n not in index])
        ends, names = [], []
        for piece, core, tail in split:
            if not tail:
                index[piece] = index[core]
            elif piece not in index:
                names.append(piece)
                ends += (index[core], index[tail])
        if names:
            at = np.array(ends)
            stop = self.ends[at]
            size = stop - self.ends[at - 1]
            total = np.cumsum(size)
            ids = self.flat[np.repeat(stop - total, size) + np.arange(int(total[-1]))]
            index.update(zip(names, range(self._append(ids, size[::2] + size[1::2]), self.count)))

    def _pieces(self, text: str) -> list[str] | None:
        if not self.leading:
            return text.replace("\n", " ").split(" ")
        if _DOUBTFUL.search(text):
            return None
        if text[-1:].isspace() or any(x in text for x in (_ASCII if text.isascii() else _WIDE)):
            return self._spaced(text)
        words = text.replace("\n", " \n").split(" ")
        words[0] = "\0" + words[0]
        return words

    def _spaced(self, text: str) -> list[str]:
        """Pieces of a text with any white space: runs of it apart, but for a last space, which goes with the next word."""
        parts = _SPACES.split(text)
        out = ["\0" + parts[0]] if parts[0] else []
        for space, word in zip(parts[1::2], parts[2::2]):
            if not word:
                out.append("\0" + space)
                continue
            if len(space) > 1:
                out.append("\0" + space[:-1])
            if space[-1] == " ":
                out.append(word)
            else:
                out += ("\0" + space[-1], "\0" + word)
        return out

    def flat_ids(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with ``end`` behind it if given, and how many each has."""
        if len(self.index) > MEMORY or self.used > MEMORY_IDS:
            self._forget()
        get, parts, todo, wholes = self.index.get, [], [], {}
        for i, text in enumerate(texts):
            pieces = self._pieces(text)
            if not pieces:
                if pieces is None:
                    wholes[i] = self.whole(text)  # stands in this call alone
                parts.append(np.zeros(0, np.int64))
                continue
            at = np.fromiter(map(get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
            if at.min() < 0:
                missing = np.flatnonzero(at < 0).tolist()
                todo.append((at, missing, [pieces[i] for i in missing]))
            parts.append(at)
        if todo:
            self._learn(set().union(*(t[2] for t in todo)))
            for at, missing, strings in todo:
                at[missing] = [self.index[s] for s in strings]
        if end is not None:
            mark = np.array([self._mark(end)])
            parts = [x for p in parts for x in (p, mark)]
        at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        stop = self.ends[at]
        start = self.ends[np.maximum(at - 1, 0)]
        size = stop - start
        total = np.cumsum(size)
        ids = self.flat[np.repeat(stop - total, size) + np.arange(int(total[-1]) if len(total) else 0)]
        per = 2 if end is not None else 1
        edges = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])][::per] if parts else np.zeros(1, np.int64)
        counts = np.diff(edges)
        if wholes:
            lists = np.split(ids, np.cumsum(counts)[:-1])
            for i, whole in wholes.items():
                lists[i] = np.concatenate([whole, lists[i]])
            ids, counts = np.concatenate(lists), np.fromiter(map(len, lists), np.int64, len(lists))
        return ids, counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, counts = self.flat_ids(texts)
        return np.split(ids, np.cumsum(counts)[:-1]) if texts else []


@functools.cache
def encoder(path: str, leading_space: bool) -> Encoder:
    """One encoder for each vocabulary in a worker process."""
    return Encoder(path, leading_space)
