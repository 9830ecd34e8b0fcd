"""Phrase collocations by pivot partitioning, as MG-FSM mines frequent sequences.

A phrase is 2 to ``LONGEST`` words in a row within a piece of a text. Steps:

1. Words are counted by language. Each frequent word gets a number that fixes
   one order of all words: the ``top`` most frequent ones by descending count,
   all others behind them by a hash. The first are the only table that is
   broadcast (``TABLE_WORDS`` rows of ``TABLE_BYTES`` a word at most, whatever
   the input); the others are known by a bit map of fixed size, whose false
   hits cost work but change nothing. A seed is chosen under which no two words
   share a number.
2. Texts are rewritten around each word: the words beside it, three on either
   side, up to the first that is rarer than it (to the left: or the same) or
   infrequent. That fragment holds exactly the phrases whose rarest word, the
   leftmost of several, is this one, its pivot. Fragments are routed to their
   pivot, those of a frequent pivot to several salts of it by their content.
3. A task gets a pivot's (or salt's) fragments together, counts the phrases
   that the pivot owns, and emits the frequent ones. Parts of a salted pivot
   are emitted whole and summed by phrase first.
4. Frequent phrases are closed under parts, so their scores are joins of that
   table with itself: every cut of a candidate looks up its two parts, every
   longer candidate is told to the phrases in it.

Texts are read in slabs and fragments in blocks, so no task holds a pivot's
text. Exact integers throughout: products go through decimals.

A null language counts as ``und``; null and empty texts have no words; rows
that repeat count as often as they occur; languages of any name and words of
any length are kept apart. Equal scores are ordered by count, then phrase (UTF-8
bytes). Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, column, id_texts, named, slabs, utf8

LEAST, TOP = 30, 2000
LONGEST = 4
#: Per cent of a candidate's count at which a longer candidate takes its place.
TAKEN = 80
SCALE = 2_000_000
#: Bound of the broadcast table: words, and the bytes of one (longer ones count as other words).
TABLE_WORDS, TABLE_BYTES = 1 << 18, 64
#: Bits of the map of the other frequent words.
BITS = 1 << 24
#: Fragments of one pivot in a salt, about.
SALT = 1 << 17
#: Fragments mined at once, a pivot's at least.
BLOCK = 1 << 18

_REACH = LONGEST - 1
_WIDTH = 2 * _REACH + 1
_NONE = -1
#: Classes of bytes: 0 in a word, 1 between words, 2 between pieces.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 2


def words_of(text: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """All words of the texts, A-Z in lower case: the words, each one's text, and whether a piece begins with it."""
    raw, offsets = utf8(pc.ascii_lower(text))
    kind = _CLASS[raw]
    inside = kind == 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    start[edges] = inside[edges]
    at = np.flatnonzero(start)
    place = np.concatenate([np.cumsum(inside) - inside, [inside.sum()]]) if len(raw) else np.zeros(1, np.int64)
    ends = np.append(place[at], place[-1]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(raw[inside].tobytes()))
    owner = np.searchsorted(offsets, at, "right") - 1
    breaks = np.cumsum(kind == 2)
    first = np.ones(len(at), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (breaks[at[1:]] != breaks[at[:-1]])
    return words, owner, first


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """The rows of a batch, language by language."""
    langs = column(batch, "lang")
    for lang in pc.unique(langs).to_pylist():
        yield lang, batch.filter(pc.equal(langs, lang))


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    lang = F.coalesce(named(lang_col).cast("string"), F.lit("und")).alias("lang")
    return id_texts(docs, text_col, text_col, lang).select("lang", "text").where(F.length("text") > 0)


def word_counts(texts: DataFrame) -> DataFrame:
    """``lang, word, f``: counted in a batch before rows leave it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slabs(batches, "text"):
            for lang, batch in _by_lang(whole):
                found = pc.value_counts(words_of(column(batch, "text"))[0])
                if len(found):
                    yield pa.record_batch({"lang": pa.array([lang] * len(found), pa.string()), "word": found.field(0).cast(pa.string()), "f": found.field(1)})

    return texts.mapInArrow(count, "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _code(seed: int) -> Column:
    """The number of a word outside the table: 62 bits of a hash, behind all numbers of the table."""
    return (F.lit(TABLE_WORDS) + F.shiftrightunsigned(F.xxhash64(F.lit(seed), "lang", "word"), 3)).cast("bigint")


class Numbering:
    """Numbers of words in one language at a time, from the table and the bit map."""

    def __init__(self, table: list[tuple[str, str, int]], bits: np.ndarray | None, seed: int) -> None:
        self.bits, self.seed = bits, seed
        by_lang: dict[str, tuple[list[str], list[int]]] = {}
        for lang, word, number in table:
            words, numbers = by_lang.setdefault(lang, ([], []))
            words.append(word)
            numbers.append(number)
        self.tables = {lang: (pa.array(w, pa.large_string()), np.array(n, np.int64)) for lang, (w, n) in by_lang.items()}
        self.known: dict[str, dict[str, int]] = {}

    def numbers(self, lang: str, words: pa.LargeStringArray) -> np.ndarray:
        """The number of each word; ``_NONE`` where it is infrequent for sure."""
        coded = words.dictionary_encode()
        if lang not in self.known:
            own, at = self.tables.get(lang, (pa.array([], pa.large_string()), np.zeros(0, np.int64)))
            self.known[lang] = dict(zip(own.to_pylist(), at.tolist()))
        known = self.known[lang]
        different = coded.dictionary.to_pylist()
        found = np.fromiter((known.get(w, _NONE) for w in different), np.int64, len(different))
        if self.bits is not None:
            for i in np.flatnonzero(found == _NONE).tolist():
                h = _xx(self.seed, lang, different[i])
                if self.bits[(h % BITS) >> 6] >> np.uint64(h & 63) & np.uint64(1):
                    found[i] = TABLE_WORDS + (h >> 3)
        return found[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)


def _xx(seed: int, lang: str, word: str) -> int:
    """The same hash as Spark's ``xxhash64(seed, lang, word)``: each value is hashed with the last hash as seed."""
    import xxhash

    h = xxhash.xxh64_intdigest(int(seed).to_bytes(4, "little"), 42)
    h = xxhash.xxh64_intdigest(lang.encode(), h)
    return xxhash.xxh64_intdigest(word.encode(), h)


def fragments(numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows of ``_WIDTH`` numbers, the pivot in the middle, ``_NONE`` beyond the fragment; a pivot alone is left out."""
    n = len(numbers)
    # words that stand in one piece without an infrequent word between them
    piece = np.cumsum(first | (numbers == _NONE))
    out = np.full((n, _WIDTH), _NONE, np.int64)
    out[:, _REACH] = numbers
    left = right = numbers != _NONE
    for d in range(1, LONGEST):
        if n <= d:
            break
        left = left.copy()
        left[:d] = False
        left[d:] &= (piece[d:] == piece[:-d]) & (numbers[:-d] < numbers[d:]) & (numbers[:-d] != _NONE)
        out[d:, _REACH - d][left[d:]] = numbers[:-d][left[d:]]
        right = right.copy()
        right[n - d :] = False
        right[: n - d] &= (piece[d:] == piece[: n - d]) & (numbers[d:] <= numbers[: n - d]) & (numbers[d:] != _NONE)
        out[: n - d, _REACH + d][right[: n - d]] = numbers[d:][right[: n - d]]
    return out[(out[:, _REACH - 1] != _NONE) | (out[:, _REACH + 1] != _NONE)]


def _mixed(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of numbers."""
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = (h ^ rows[:, k].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def counted(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows and the sums of their weights."""
    h = _mixed(rows)
    order = np.argsort(h, kind="stable")
    ordered, h = rows[order], h[order]
    new = np.ones(len(rows), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(1)
    if (new[1:] & (h[1:] == h[:-1])).any():  # two different rows of one hash: sort by the rows themselves
        order = np.lexsort(rows.T)
        ordered = rows[order]
        new[1:] = (ordered[1:] != ordered[:-1]).any(1)
    at = np.flatnonzero(new)
    return ordered[at], np.add.reduceat(weights[order], at) if len(at) else np.zeros(0, np.int64)


class Salts:
    """The pivots that are dealt to more than one salt."""

    def __init__(self, pivots: np.ndarray, salts: np.ndarray) -> None:
        order = np.argsort(pivots)
        self.pivots, self.salts = pivots[order], salts[order].astype(np.uint64)

    def hold(self, numbers: np.ndarray) -> np.ndarray:
        return np.isin(numbers, self.pivots)

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The salt of each fragment, by its content."""
        out = np.zeros(len(rows), np.int64)
        hot = self.hold(rows[:, _REACH])
        salts = self.salts[np.searchsorted(self.pivots, rows[hot, _REACH])]
        out[hot] = (_mixed(rows[hot]) % salts).astype(np.int64)
        return out


_ROUTED = "pivot bigint, salt bigint, n int, near binary, far binary"


def _routed(numbering: Numbering, heavy: Salts):
    """Rows of one pivot's (salt's) fragments in a slab; numbers of the table take 4 bytes each, others 8."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slabs(batches, "text"):
            parts = []
            for lang, batch in _by_lang(whole):
                words, _, first = words_of(column(batch, "text"))
                parts.append(fragments(numbering.numbers(lang, words), first))
            rows = np.concatenate(parts)
            if not len(rows):
                continue
            rows, times = counted(rows, np.ones(len(rows), np.int64))
            pivot, salt = rows[:, _REACH], heavy.of(rows)
            order = np.lexsort((salt, pivot))
            rows, times, pivot, salt = rows[order], times[order], pivot[order], salt[order]
            new = np.ones(len(rows), bool)
            new[1:] = (pivot[1:] != pivot[:-1]) | (salt[1:] != salt[:-1])
            at = np.append(np.flatnonzero(new), len(rows))
            side = np.concatenate([times[:, None], np.delete(rows, _REACH, 1)], 1)
            far = pivot >= TABLE_WORDS
            n = int(np.searchsorted(pivot, TABLE_WORDS))
            small, large = side[:n].astype("<i4"), side[n:].astype("<i8")
            wide = far[at[:-1]]
            none, size = np.zeros(1, np.int64), np.diff(at)
            yield pa.record_batch(
                {
                    "pivot": pivot[at[:-1]], "salt": salt[at[:-1]], "n": size.astype(np.int32),
                    "near": _cut(small, np.concatenate([none, np.cumsum(np.where(wide, 0, size))])),
                    "far": _cut(large, np.concatenate([none, np.cumsum(np.where(wide, size, 0))])),
                }
            )

    return route


def _cut(rows: np.ndarray, at: np.ndarray) -> pa.Array:
    step = rows.itemsize * rows.shape[1]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * step).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def phrases_of(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of 2 to ``LONGEST`` words that the fragments' pivots own, padded by ``_NONE``, and their counts."""
    out, weights = [], []
    for left in range(LONGEST):
        for right in range(LONGEST - left):
            if left + right == 0:
                continue
            whole = (rows[:, _REACH - left] != _NONE) & (rows[:, _REACH + right] != _NONE)
            found = np.full((int(whole.sum()), LONGEST), _NONE, np.int64)
            found[:, : left + right + 1] = rows[whole][:, _REACH - left : _REACH + right + 1]
            out.append(found)
            weights.append(times[whole])
    return counted(np.concatenate(out), np.concatenate(weights))


_WORDS = [f"w{k}" for k in range(LONGEST)]
_MINED = ", ".join(f"{w} bigint" for w in _WORDS) + ", a bigint"


def _mined(least: int, heavy: Salts):
    """Frequent phrases of each pivot; all phrases of a salt. Rows come sorted by pivot and salt."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, times in _blocks(batches, heavy):
            phrases, a = phrases_of(rows, times)
            keep = (a >= least) | heavy.hold(phrases.max(1))
            yield pa.record_batch({w: np.ascontiguousarray(phrases[keep, k]) for k, w in enumerate(_WORDS)} | {"a": a[keep]})

    return mine


def _blocks(batches: Iterator[pa.RecordBatch], heavy: Salts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of whole pivots; those of a salted pivot may end anywhere, as their phrases are summed later."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, last = 0, None

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])

    for batch in batches:
        pivot, salt = column(batch, "pivot").to_numpy(), column(batch, "salt").to_numpy()
        n = column(batch, "n").to_numpy()
        wide = pivot >= TABLE_WORDS
        near = np.frombuffer(b"".join(column(batch, "near").to_pylist()), "<i4").reshape(-1, _WIDTH).astype(np.int64)
        far = np.frombuffer(b"".join(column(batch, "far").to_pylist()), "<i8").reshape(-1, _WIDTH)
        side = np.empty((int(n.sum()), _WIDTH), np.int64)
        each = np.repeat(wide, n)
        side[~each], side[each] = near, far
        rows = np.concatenate([side[:, 1 : _REACH + 1], np.repeat(pivot, n)[:, None], side[:, _REACH + 1 :]], 1)
        times, ends = side[:, 0].copy(), np.cumsum(n)
        cuts = np.flatnonzero((pivot[1:] != pivot[:-1]) | (salt[1:] != salt[:-1])) + 1
        start = 0
        for c in [0, *cuts.tolist()]:
            # a new pivot (salt) begins at row c of the batch
            here = int(ends[c - 1]) if c else 0
            if (c or last != (pivot[0], salt[0])) and size + here - start >= BLOCK:
                held.append((rows[start:here], times[start:here]))
                yield joined()
                held, size, start = [], 0, here
        held.append((rows[start:], times[start:]))
        size += len(rows) - start
        last = (pivot[-1], salt[-1]) if len(pivot) else last
        if size >= BLOCK and heavy.hold(np.array([last[0]]))[0]:
            yield joined()
            held, size = [], 0
        elif size >= 4 * BLOCK:
            held = [counted(*joined())]
            size = len(held[0][0])
    if size:
        yield joined()


def _bit_map(others: DataFrame) -> np.ndarray | None:
    """The bits of the frequent words outside the table: at most ``BITS`` / 64 rows come back."""
    h = F.pmod(F.col("h"), F.lit(BITS))
    rows = others.select(F.shiftright(h, 6).alias("at"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    if not rows.num_rows:
        return None
    bits = np.zeros(BITS >> 6, np.uint64)
    bits[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return bits


def _least_step(words: DataFrame, top: int) -> int:
    """The least step of counts (sixteenths of a power of two, about 1,000 at most) from which on there are ``top`` words at most."""
    steps = sorted(((r.step, r.n) for r in words.groupBy("step").agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, steps[0][0] + 1 if steps else 0
    for step, n in steps:
        total += n
        if total > top:
            break
        least = step
    return least


def mine(texts: DataFrame, tables: Tables, *, least: int = LEAST, top: int = TABLE_WORDS, salt: int = SALT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases ``w0..w3, size, a``; frequent words ``number, lang, word, f``; ``lang, n``."""
    spark = texts.sparkSession
    every = tables.write(word_counts(texts), "words")
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = every.where(F.col("f") >= least)
    short = frequent.where((F.octet_length("word") <= TABLE_BYTES) & (F.octet_length("lang") <= TABLE_BYTES)).withColumn("step", F.floor(16 * F.log2("f")))
    ranked = short.where(F.col("step") >= _least_step(short, min(top, TABLE_WORDS))).select("lang", "word", "f").toArrow()
    ranked = ranked.sort_by([("f", "descending"), ("lang", "ascending"), ("word", "ascending")])
    table = [(lang, word, i) for i, (lang, word) in enumerate(zip(ranked["lang"].to_pylist(), ranked["word"].to_pylist()))]
    if table:
        first = spark.createDataFrame(ranked.select(["lang", "word"]).append_column("place", pa.array(range(len(table)), pa.int64())))
        keyed = frequent.join(F.broadcast(first), ["lang", "word"], "left")
    else:
        keyed = frequent.withColumn("place", F.lit(None).cast("bigint"))
    seed = 1
    others = keyed.where(F.col("place").isNull())
    bits = _bit_map(others.select(F.xxhash64(F.lit(seed), "lang", "word").alias("h")))
    while bits is not None and every.groupBy(_code(seed).alias("code")).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        seed += 1
        bits = _bit_map(others.select(F.xxhash64(F.lit(seed), "lang", "word").alias("h")))
    words = tables.write(keyed.select(F.coalesce("place", _code(seed)).alias("number"), "lang", "word", "f"), "frequent")
    # a pivot of f occurrences has f fragments at most; 2^19 words at most have more than the limit
    limit = max(salt, int(totals.agg(F.sum("n")).first()[0] or 0) >> 19)
    frequent_ones = words.where(F.col("f") > limit).select("number", "f").toArrow()
    heavy = Salts(frequent_ones["number"].to_numpy(), -(-frequent_ones["f"].to_numpy() // limit))
    numbering = spark.sparkContext.broadcast(Numbering(table, bits, seed))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _routed(numbering.value, heavy)(batches)

    routed = texts.mapInArrow(route, _ROUTED)
    grouped = routed.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt")
    partial = grouped.mapInArrow(_mined(least, heavy), _MINED)
    size = sum(((F.col(w) != _NONE).cast("int") for w in _WORDS), F.lit(0))
    phrases = partial.groupBy(*_WORDS).agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return tables.write(phrases.select(*_WORDS, size.alias("size"), "a"), "phrases"), words, totals


def _part(start: int, size: int) -> list[Column]:
    """The columns of the phrase of ``size`` words from ``start``."""
    return [F.col(_WORDS[start + k]) if k < size else F.lit(_NONE).cast("bigint") for k in range(LONGEST)]


def _key(columns: list[Column]) -> Column:
    return F.array(*columns)


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``key, size, a, l, r, score`` of the candidates that no longer candidate takes the place of."""
    key = _key([F.col(w) for w in _WORDS])
    single = words.select(_key([F.col("number"), *[F.lit(_NONE).cast("bigint")] * (LONGEST - 1)]).alias("part"), "f")
    known = single.unionByName(phrases.select(key.alias("part"), F.col("a").alias("f")))
    cuts, inner = [], []
    for size in range(2, LONGEST + 1):
        for k in range(1, size):
            ends = F.struct(F.lit(k).alias("k"), _key(_part(0, k)).alias("head"), _key(_part(k, size - k)).alias("tail"))
            cuts.append(F.when(F.col("size") == size, ends))
        for part in range(2, size):
            inner += [F.when(F.col("size") == size, _key(_part(start, part))) for start in range(size - part + 1)]
    each = phrases.select(key.alias("key"), "size", "a", F.explode(F.array_compact(F.array(*cuts))).alias("cut"))
    each = each.join(known.select(F.col("part").alias("head"), F.col("f").alias("l")), F.col("cut.head") == F.col("head"))
    each = each.join(known.select(F.col("part").alias("tail"), F.col("f").alias("r")), F.col("cut.tail") == F.col("tail"))
    score = F.expr(f"cast((cast(a as decimal(20, 0)) * {SCALE}) div (cast(l as decimal(20, 0)) + r) as bigint)")
    worst = each.groupBy("key", "size", "a").agg(F.min(F.struct(score.alias("score"), F.col("cut.k").alias("k"), "l", "r")).alias("cut"))
    longer = phrases.where(F.col("size") > 2).select("a", F.explode(F.array_compact(F.array(*inner))).alias("key")).groupBy("key").agg(F.max("a").alias("longer"))
    left = worst.join(longer, "key", "left").where(F.expr(f"longer is null or cast(longer as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {TAKEN}"))
    return left.select("key", "size", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def spelled(found: DataFrame, words: DataFrame) -> DataFrame:
    """``lang, phrase`` in place of the key."""
    rest = [c for c in found.columns if c not in ("key", "size")]
    each = found.select("*", F.posexplode(F.slice("key", F.lit(1), F.col("size"))).alias("at", "number"))
    named_words = each.join(words.select("number", "lang", "word"), "number")
    whole = named_words.groupBy("key", *rest).agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    return whole.select("lang", F.concat_ws(" ", F.transform("words", lambda w: w["word"])).alias("phrase"), *rest)


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, table: int = TABLE_WORDS, salt: int = SALT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases."""
    tables = Tables(docs.sparkSession, "collocations")
    phrases, words, totals = mine(_texts(docs, text_col, lang_col), tables, least=least, top=table, salt=salt)
    found = spelled(scored(phrases, words), words)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    first = found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows by DuckDB: all runs of one to four words are counted.
ORACLE_SQL = r"""
with pieces as (
  select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w
  from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) as piece from documents)
), places as (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces
), counted as (
  select lang, k as size, w[i:i + k - 1] as p, count(*) as a from places, (values (1), (2), (3), (4)) sizes(k) where i + k - 1 <= len(w) group by all
), totals as (select lang, sum(a)::bigint as n from counted where size = 1 group by lang
), f as (select * from counted where a >= 30
), cuts as (
  select c.lang, c.p, c.size, c.a, k, h.a as l, t.a as r, (2000000::hugeint * c.a // (h.a + t.a))::bigint as score
  from (select *, unnest(range(1, size)) as k from f) c
  join f h on h.lang = c.lang and h.p = c.p[1:k] join f t on t.lang = c.lang and t.p = c.p[k + 1:c.size]
), worst as (select * from cuts qualify row_number() over (partition by lang, p order by score, k) = 1
), inner_ones as (
  select lang, p[i:i + k - 1] as p, max(a) as longer
  from (select *, unnest(range(1, size)) as i from f where size > 2), (values (2), (3)) sizes(k) where k < size and i + k - 1 <= size group by all
), left_ones as (
  select w.*, array_to_string(w.p, ' ') as phrase from worst w left join inner_ones using (lang, p) where longer is null or 100::hugeint * longer < 80 * a
)
select lang, rank::bigint as rank, phrase, a, l, r, n, score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from left_ones) join totals using (lang) where rank <= 2000
"""
