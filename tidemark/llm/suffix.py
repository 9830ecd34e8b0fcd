"""Suffix-array removal of repeated passages, built bucket by bucket with a difference cover.

A byte is removed if a string of ``DEPTH`` bytes that covers it also starts
anywhere else. Positions of such strings are found by sorting suffixes to
that depth:

1. Each window of ``DEPTH`` bytes goes to the suffix bucket named by its
   smallest k-gram hash (the leftmost smallest). Equal windows have the same
   bucket and the same offset in it. Neighbouring windows share a bucket, so
   a bucket's row is a run of windows, about 70 of them, not one.
2. Runs that are alone in their bucket are unique and end there. Runs that
   are equal byte for byte (bucket and digest, 128 bits) are collapsed to one with a count
   before anything is sorted; in a bucket of one such run all is repeated.
3. The other buckets are sorted, block after block of bounded size. A block
   ranks the substrings of ``DEPTH - 8`` bytes at the positions of a
   difference cover modulo 8 (prefix doubling over the cover sample only);
   its windows are sorted by bucket and first 8 bytes, and the long ties are
   resolved by the sample's ranks and the last 8 bytes. Equal neighbours in
   that order are repeated windows. Runs are laid out by their bucket's
   k-gram, so equal windows have one residue and one shift into the cover.
4. A bucket with more than ``hot_rows`` different runs is refined, as a radix
   sort would: its windows are halved by the place of the k-gram in them, and
   each half is dealt out by the bytes that all its windows hold on either
   side of the k-gram. Halves that are small are sorted, halves that are
   equal are repeated, and only what is still hot is halved again, seven
   times at most, so that no bucket has to fit into one task.

Documents are copied once to the shared folder with a row id (part and
place). Later passes scan that copy and read the few intervals of their part
from a small side file there, so whole texts are never shuffled.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PLACE, Side, by_part, column, id_texts, named, slabs, utf8, written

DEPTH = 200
GRAM = 64
#: Windows start positions that one k-gram can serve: those that contain it.
SPAN = DEPTH - GRAM + 1
#: Text scanned at once; positions inside a slab have 20 bits.
SLAB = 1 << 19
MODULUS = 8


def difference_cover(v: int) -> list[int]:
    """A small set D of residues such that every residue is a difference of two of D (greedy)."""
    cover, missing = [0, 1], set(range(v)) - {0, 1, v - 1}
    while missing:
        gain = {x: len(missing & {y for d in cover for y in ((x - d) % v, (d - x) % v)}) for x in range(v) if x not in cover}
        best = max(gain, key=lambda x: (gain[x], -x))
        missing -= {y for d in cover for y in ((best - d) % v, (d - best) % v)}
        cover.append(best)
    return sorted(cover)


COVER = difference_cover(MODULUS)
#: DELTA[a]: the least shift from residue a into the cover; DELTAS[a, b]: the least that serves both residues.
DELTAS = np.array([[next(d for d in range(MODULUS) if (a + d) % MODULUS in COVER and (b + d) % MODULUS in COVER) for b in range(MODULUS)] for a in range(MODULUS)])

_RNG = np.random.RandomState(7)
_BYTE = _RNG.randint(0, 2**63 - 1, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes at each position (polynomial modulo 2^64 of mixed bytes, then mixed again)."""
    n = len(raw)
    if not _TABLES or len(_TABLES[0][0]) < n + 1:
        _TABLES[:] = [_powers(max(n + 1, SLAB + DEPTH + 1))]
    up, down = _TABLES[0]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], out=total[1:])
    h = (total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(29)
    return h


def runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows that share their leftmost smallest k-gram: text, start in the text, windows, bucket, the k-gram's place after the start.

    ``raw`` holds at most 2^20 bytes; windows never cross an offset.
    """
    empty = (np.zeros(0, np.int64),) * 5
    if len(raw) < DEPTH:
        return empty
    h = gram_hashes(raw)
    packed = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype=np.uint64)
    least, width = packed, 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        rest = SPAN - width
        least = np.minimum(least[: len(least) - rest], least[rest:])
    lengths = np.diff(offsets)
    docs = np.flatnonzero(lengths >= DEPTH)
    if not len(docs):
        return empty
    text = np.repeat(np.arange(len(lengths)), lengths)
    fits = np.zeros(len(least) + 1, bool)
    ends = offsets[1:][text[: len(least)]]
    fits[: len(least)] = np.arange(len(least)) + DEPTH <= ends
    change = np.ones(len(least) + 1, bool)
    change[1:-1] = least[1:] != least[:-1]
    change[np.minimum(offsets[:-1], len(least))] = True
    change[1:] |= fits[1:] != fits[:-1]
    at = np.flatnonzero(change)
    start, size = at[:-1], np.diff(at)
    good = fits[start]
    start, size = start[good], size[good]
    where = (least[start] & np.uint64(0xFFFFF)).astype(np.int64)
    return text[start], start - offsets[text[start]], size, h[where].view(np.int64), where - start


def _digest(piece: bytes) -> int:
    return xxhash.xxh3_64_intdigest(piece)


def _runs_of(batches: Iterator[pa.RecordBatch], located: bool) -> Iterator[pa.RecordBatch]:
    for batch in slabs(batches, "text", SLAB // 2):
        raw, offsets = utf8(column(batch, "text"))
        rid = column(batch, "rid").to_numpy()
        # a text longer than a slab is scanned in overlapping pieces, which share no window
        pieces = [(0, 0, raw, offsets)] if len(raw) <= SLAB else [
            (i, s, raw[offsets[i] + s : min(offsets[i] + s + SLAB, offsets[i + 1])], None)
            for i in range(batch.num_rows) for s in range(0, max(1, int(offsets[i + 1] - offsets[i]) - DEPTH + 1), SLAB - DEPTH + 1)
        ]
        for first, shift, part, at in pieces:
            text, start, size, bucket, gram = runs(part, np.array([0, len(part)]) if at is None else at)
            if not len(start):
                continue
            base = start if at is None else start + at[text]
            data = part.tobytes()
            piece = np.fromiter((_digest(data[a : a + n]) for a, n in zip(base.tolist(), (size + DEPTH - 1).tolist())), np.uint64, len(base)).view(np.int64)
            cols = {"bucket": bucket, "piece": piece}
            if located:
                cols |= {"rid": rid[text + first], "at": ((start + shift) << 16) | (gram << 8) | size}
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in cols.items()})


def _plain_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _runs_of(batches, False)


def _located_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _runs_of(batches, True)


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of uint64 keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]])[: len(order)])
    return out


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Two columns of ranks below 2^32 as one key."""
    return (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)


class Block:
    """A block of text with windows to sort; ranks of the cover sample are made once, for all its buckets."""

    def __init__(self, raw: np.ndarray) -> None:
        n = len(raw)
        padded = np.concatenate([raw, np.zeros(DEPTH + 2 * MODULUS, np.uint8)]).astype(np.uint64)
        word = np.zeros(n + DEPTH + MODULUS, np.uint64)
        for i in range(8):
            word = (word << np.uint64(8)) | padded[i : i + len(word)]
        self.word = word
        # ranks of the DEPTH - 8 bytes at sample positions, by doubling: 8, 16, ..., 128, then 128 + 64
        sample = np.flatnonzero(np.isin(np.arange(len(word)) % MODULUS, COVER))
        place = np.zeros(len(word) + DEPTH, np.int64)
        place[sample] = np.arange(len(sample)) + 1  # 0: past the end
        rank = {8: np.concatenate([[0], _ranks(word[sample]) + 1])}
        for length in (8, 16, 32, 64):
            here = rank[length]
            rank[2 * length] = np.concatenate([[0], _ranks(_pairs(here[1:], here[place[sample + length]])) + 1])
        name = _ranks(_pairs(rank[128][1:], rank[64][place[sample + 128]]))
        self.name, self.place = name, place

    def key(self, at: np.ndarray, delta: np.ndarray | int) -> np.ndarray:
        return self.name[self.place[at + delta] - 1]

    def sort(self, bucket: np.ndarray, at: np.ndarray, aligned: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Order of windows by (bucket, their DEPTH bytes), and for each in that order whether it equals the one before.

        ``aligned``: equal windows of a bucket are known to start at equal
        residues, so ties of several residues are left side by side.
        """
        first, last = self.word[at], self.word[at + DEPTH - MODULUS]
        residue = at % MODULUS
        own = self.key(at, DELTAS[residue, residue])
        order = np.lexsort((last, own, residue, first, bucket))
        b, f, r = bucket[order], first[order], residue[order]
        tie = np.zeros(len(order), bool)
        tie[1:] = (b[1:] == b[:-1]) & (f[1:] == f[:-1])
        same = tie.copy()
        same[1:] &= (r[1:] == r[:-1]) & (own[order][1:] == own[order][:-1]) & (last[order][1:] == last[order][:-1])
        if aligned:
            return order, same
        group = np.cumsum(~tie)
        mixed = np.unique(group[1:][tie[1:] & (r[1:] != r[:-1])])
        if len(mixed):  # ties of several residues: compare each pair of positions by the shift that serves both
            lo, hi = np.searchsorted(group, mixed), np.searchsorted(group, mixed, "right")
            for a, z in zip(lo.tolist(), hi.tolist()):
                order[a:z] = self._merge(order[a:z], at, residue, last)
                x, y = order[a : z - 1], order[a + 1 : z]
                d = DELTAS[residue[x], residue[y]]
                same[a + 1 : z] = (self.key(at[x], d) == self.key(at[y], d)) & (last[x] == last[y])
        return order, same

    def _merge(self, group: np.ndarray, at: np.ndarray, residue: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Place of each window in a tie group: how many windows of each residue class come before it."""
        classes = [group[residue[group] == c] for c in range(MODULUS)]
        before = {}
        for a, xs in enumerate(classes):
            if not len(xs):
                continue
            total = np.zeros(len(xs), np.int64)
            for b, ys in enumerate(classes):
                if not len(ys):
                    continue
                d = int(DELTAS[a, b])
                kx, ky = self.key(at[xs], d), self.key(at[ys], d)
                ends = _ranks(np.concatenate([last[xs], last[ys]]))
                ranks = _ranks(_pairs(np.concatenate([kx, ky]), ends))
                rx, ry = ranks[: len(xs)], np.sort(ranks[len(xs) :])
                total += np.searchsorted(ry, rx, "right" if b < a else "left")
            place = np.lexsort((np.arange(len(xs)), total))
            before[a] = (xs[place], total[place])
        xs = np.concatenate([v[0] for v in before.values()])
        total = np.concatenate([v[1] for v in before.values()])
        return xs[np.argsort(total, kind="stable")]


def repeated_windows(pieces: list[bytes], grams: list[int], buckets: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """For each piece of a block the flags of its windows: does the window occur again in its bucket?

    Pieces are laid out so that their k-grams start at multiples of
    ``MODULUS``; equal windows then have equal residues.
    """
    starts, at, parts = [], 0, []
    for piece, gram in zip(pieces, grams):
        pad = -(at + gram) % MODULUS
        parts += [bytes(pad), piece]
        starts.append(at + pad)
        at += pad + len(piece)
    windows = np.array([len(p) for p in pieces]) - DEPTH + 1
    block = Block(np.frombuffer(b"".join(parts), np.uint8))
    piece = np.repeat(np.arange(len(pieces)), windows)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    order, same = block.sort(buckets[piece], np.array(starts)[piece] + inside, aligned=True)
    again = same.copy()
    again[:-1] |= same[1:]
    flags = np.empty(len(order), bool)
    flags[order] = again
    flags |= (counts > 1)[piece]
    return np.split(flags, np.cumsum(windows)[:-1])


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket -> a bit for each window of each run. Whole buckets are sorted, a block of about 1 MB at a time."""
    held: list[tuple] = []
    size = 0

    def out(rows: list[tuple]) -> pa.RecordBatch:
        bucket, piece, n, gram, body = zip(*rows)
        flags = repeated_windows(body, gram, np.array(bucket, np.int64), np.array(n, np.int64))
        return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int64()), "piece": pa.array(piece, pa.int64()), "bits": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())})

    for batch in batches:
        for row in zip(*(column(batch, c).to_pylist() for c in ("bucket", "piece", "n", "gram", "body"))):
            if size >= 1 << 20 and row[0] != held[-1][0]:
                yield out(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield out(held)


def _fetcher(path: str):
    """Rows of documents -> the bytes of the runs that a side table asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = Side(path, ["at", "bucket", "piece", "n", "hot"])
        for batch in slabs(batches, "text", SLAB):
            raw, offsets = utf8(column(batch, "text"))
            rids = column(batch, "rid").to_numpy()
            for part in np.unique(rids >> PLACE).tolist():
                known, table = side.at(part)
                if table is None:
                    continue
                here = np.flatnonzero(rids >> PLACE == part)  # rows of a part are in the order of their ids
                own = rids[here]
                place = np.minimum(np.searchsorted(own, known), len(own) - 1)
                hit = np.flatnonzero(own[place] == known)
                if not len(hit):
                    continue
                asked = table.take(pa.array(hit))
                at = asked["at"].to_numpy()
                begin = offsets[here[place[hit]]] + (at >> 16)
                end = begin + (at & 255) + DEPTH - 1
                data = raw.tobytes()
                body = pa.array([data[a:b] for a, b in zip(begin.tolist(), end.tolist())], pa.binary())
                cols = {c: asked[c].combine_chunks() for c in ("bucket", "piece", "n", "hot")}
                yield pa.RecordBatch.from_pydict(cols | {"gram": pa.array((at >> 8) & 255), "body": body})

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of hot buckets -> the part of each run whose windows have the k-gram in one half of the places lo to hi.

    The key is a digest of the bytes that all windows of the half hold: those
    before the k-gram up to the half's least place, those behind it up to what
    its greatest leaves. Equal windows have equal keys.
    """
    kinds = {"key": pa.int64(), "bucket": pa.int64(), "piece": pa.int64(), "n": pa.int64(), "part": pa.int64(), "lo": pa.int64(), "hi": pa.int64(), "skip": pa.int64(), "size": pa.int64(), "gram": pa.int64(), "body": pa.binary()}
    for batch in batches:
        rows: list[tuple] = []
        for bucket, piece, n, lo, hi, gram, body in zip(*(column(batch, c).to_pylist() for c in ("bucket", "piece", "n", "lo", "hi", "gram", "body"))):
            middle, end = (lo + hi + 1) // 2, gram + GRAM
            for low, high in ((lo, middle - 1), (middle, hi)) if hi > lo else ((lo, hi),):
                first, last = min(high, gram), max(low, gram - (len(body) - DEPTH))
                if first < last:
                    continue
                held = b"%d %d %d " % (bucket, low, high) + body[gram - low : gram] + b"|" + body[end : end + DEPTH - GRAM - high]
                part = body[gram - first : end + DEPTH - GRAM - last]
                rows.append((_signed(_digest(held)), bucket, piece, n, _signed(_digest(part)), low, high, gram - first, first - last + 1, gram, body))
        cols = list(zip(*rows)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values())], names=list(kinds))


def refined(hot: DataFrame, hot_rows: int) -> DataFrame:
    """``bucket, piece, skip, size, bits`` of the repeated windows of hot buckets (see 4. above)."""
    state = hot.select("bucket", "piece", "n", "gram", "body", F.lit(0).cast("bigint").alias("lo"), F.lit(SPAN - 1).cast("bigint").alias("hi"))
    schema = "key bigint, bucket bigint, piece bigint, n bigint, part bigint, lo bigint, hi bigint, skip bigint, size bigint, gram bigint, body binary"
    out = state.select("bucket", "piece", F.lit(0).cast("bigint").alias("skip"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("binary").alias("bits")).limit(0)
    while not state.isEmpty():
        parts = written(state.mapInArrow(_halves, schema), "suffix-halves")
        equal = written(parts.groupBy("key", "part").agg(F.sum("n").alias("copies")), "suffix-equal")
        sizes = equal.groupBy("key").agg(F.count("*").alias("different"), F.sum("copies").alias("total")).where("total > 1").drop("total")
        tagged = written(parts.join(written(sizes, "suffix-sizes"), "key"), "suffix-tagged")
        every = tagged.where("different = 1").select("bucket", "piece", "skip", "size", F.lit(None).cast("binary").alias("bits"))
        few = tagged.where(f"different > 1 AND different <= {hot_rows}")
        trimmed = F.expr(f"substring(body, CAST(skip + 1 AS INT), CAST(size + {DEPTH - 1} AS INT))")
        distinct = few.groupBy("key", "part").agg(F.sum("n").alias("n"), F.min(F.struct((F.col("gram") - F.col("skip")).alias("gram"), trimmed.alias("body"))).alias("one"))
        distinct = distinct.select(F.col("key").alias("bucket"), F.col("part").alias("piece"), "n", "one.gram", "one.body")
        bits = _sorted(distinct).select(F.col("bucket").alias("key"), F.col("piece").alias("part"), "bits")
        some = few.join(written(bits, "suffix-some"), ["key", "part"]).select("bucket", "piece", "skip", "size", "bits")
        out = out.union(every).union(some)
        state = tagged.where(f"different > {hot_rows} AND hi > lo").select("bucket", "piece", "n", "gram", "body", "lo", "hi")
    return out


def _sorted(bodies: DataFrame) -> DataFrame:
    """``bucket, piece, bits`` for runs whose buckets fit into a task."""
    dealt = bodies.select("bucket", "piece", "n", "gram", "body").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_sort_buckets, "bucket bigint, piece bigint, bits binary")


def with_row_ids(docs: DataFrame) -> DataFrame:
    """A copy of all rows in the shared folder with ``rid``: part << 33 | place in the part."""
    return written(docs.withColumn("rid", F.monotonically_increasing_id()), "suffix-docs", codec="snappy")


def repeats(copy: DataFrame, hot_rows: int = 200) -> str:
    """The folder (see :class:`Side`) with the repeated windows of each row: ``rid, at, bits`` (bits null: all)."""
    text = copy.select("rid", "text")
    plain = text.mapInArrow(_plain_runs, "bucket bigint, piece bigint")
    shared = plain.groupBy("bucket").agg(F.count("*").alias("n"), F.min("piece").alias("lo"), F.max("piece").alias("hi"))
    shared = written(shared.where("n > 1").select("bucket", (F.col("lo") == F.col("hi")).alias("single")), "suffix-buckets")
    located = text.mapInArrow(_located_runs, "bucket bigint, piece bigint, rid bigint, at bigint")
    found = written(located.join(shared, "bucket"), "suffix-runs")
    multi = found.where("not single")
    distinct = multi.groupBy("bucket", "piece").agg(F.count("*").alias("n"), F.min(F.struct("rid", "at")).alias("one"))
    distinct = written(distinct.select("bucket", "piece", "n", "one.rid", "one.at"), "suffix-distinct")
    sizes = written(distinct.groupBy("bucket").count(), "suffix-sizes")
    asked = distinct.join(sizes, "bucket").withColumn("hot", F.col("count") > hot_rows).drop("count")
    path = by_part(asked, "suffix-asked")
    bodies = text.mapInArrow(_fetcher(path), "bucket bigint, piece bigint, n bigint, hot boolean, gram bigint, body binary")
    bodies = written(bodies, "suffix-bodies")
    plain_bits = _sorted(bodies.where("not hot")).select("bucket", "piece", F.lit(0).cast("bigint").alias("skip"), F.lit(0).cast("bigint").alias("size"), "bits")
    bits = written(plain_bits.union(refined(bodies.where("hot"), hot_rows)), "suffix-bits")
    # a part of a run starts skip windows later; size 0 stands for the whole run
    place = F.when(F.col("size") == 0, F.col("at")).otherwise(F.shiftleft(F.shiftright("at", 16) + F.col("skip"), 16) + F.col("size"))
    several = multi.join(bits, ["bucket", "piece"]).select("rid", place.alias("at"), "bits")
    every = found.where("single").select("rid", "at", F.lit(None).cast("binary").alias("bits"))
    return by_part(several.union(every), "suffix-repeats")


def spans_of(n: int, at: np.ndarray, bits: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that repeated windows cover in a text of ``n`` bytes."""
    delta = np.zeros(n + 1, np.int32)
    for x, b in zip(at.tolist(), bits):
        start, size = x >> 16, x & 255
        if b is None:
            delta[start] += 1
            delta[start + size + DEPTH - 1] -= 1
        else:
            j = start + np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8))[:size])
            delta[j] += 1
            delta[j + DEPTH] -= 1
    covered = np.concatenate([[0], (np.cumsum(delta[:-1]) > 0).astype(np.int8), [0]])
    edge = np.diff(covered)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _whole_characters(text: pa.Array, kept: list[bytes]) -> pa.Array:
    """The remaining texts without characters that a cut has split; null stays null."""
    return pa.array([b.decode("utf-8", "ignore") if there else None for there, b in zip(text.is_valid().to_pylist(), kept)], pa.string())


def _cutter(path: str, new_text: bool):
    """Rows of the copy -> the same with ``kept`` and ``removed``; with ``new_text`` only ``other`` and the text that remains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = Side(path, ["at", "bits"])
        for batch in slabs(batches, "text", 2 * SLAB):
            raw, offsets = utf8(column(batch, "text"))
            rids = column(batch, "rid").to_numpy()
            kept, spans, data = [], [], raw.tobytes()
            for i, rid in enumerate(rids.tolist()):
                text, cuts = data[offsets[i] : offsets[i + 1]], []
                known, table = side.at(rid >> PLACE)
                lo, hi = np.searchsorted(known, [rid, rid + 1])
                if hi > lo:
                    own = table.slice(lo, hi - lo)
                    starts, ends = spans_of(len(text), own["at"].to_numpy(), own["bits"].to_pylist())
                    cuts = list(zip(starts.tolist(), ends.tolist()))
                    bounds = [0, *(x for c in cuts for x in c), len(text)]
                    text = b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
                kept.append(text)
                spans.append([{"start": a, "end": b} for a, b in cuts])
            if new_text:
                yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "other"), _whole_characters(column(batch, "text"), kept)], names=["id", "other", "text"])
                continue
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, c) for c in batch.schema.names), pa.array(kept, pa.binary()), pa.array(spans, kind)],
                names=[*batch.schema.names, "kept", "removed"],
            )

    return run


def _copied(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    others = [named(c) for c in docs.columns if c not in (id_col, text_col)]
    return with_row_ids(id_texts(docs, id_col, text_col, F.struct(*others or [F.lit(0).alias("none")]).alias("other")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = 200) -> DataFrame:
    """``id, text, kept, removed`` and the other columns of ``docs``, whatever their names, as a struct ``other``.

    ``kept`` holds the remaining UTF-8 bytes (a cut may split a character),
    ``removed`` the maximal removed spans in bytes. One row comes back for
    each row of the input, repeated rows included, which are copies of each
    other. Null and short texts have no repeated window. An empty table gives
    an empty result.
    """
    copy = _copied(docs, id_col, text_col)
    path = repeats(copy, hot_rows)
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*copy.schema.fields, T.StructField("kept", T.BinaryType()), T.StructField("removed", spans)])
    return copy.mapInArrow(_cutter(path, False), schema).drop("rid")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = 200) -> DataFrame:
    """The documents with repeated passages cut out of their texts, in the columns of ``docs``.

    A character that a cut would split goes with it. Null texts stay null.
    """
    copy = _copied(docs, id_col, text_col)
    path = repeats(copy, hot_rows)
    schema = T.StructType([copy.schema["id"], copy.schema["other"], T.StructField("text", T.StringType())])
    cut = copy.mapInArrow(_cutter(path, True), schema)
    columns = []
    for c in docs.columns:
        place = F.col("id") if c == id_col else F.col("text") if c == text_col else F.col("other").getField(c)
        columns.append(place.cast(docs.schema[c].dataType).alias(c))
    return cut.select(*columns)
