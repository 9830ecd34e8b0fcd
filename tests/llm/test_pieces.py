import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from tidemark.llm import pieces, queries
from tidemark.llm.tokens import vocabulary

PATH = vocabulary("piece_bpe_32k.model")
ALPHABET = [
    "a", "b", "e", "the", "t", "h", "er", "in", " ", "  ", "   ", "▁", "▁▁", "\n", "\t", "ing", "on", "é", "İ", "漢", "字", "🙂", "1", "23", "<s>", "<0x41>", "<unk>",
    "s", "S", "́", "\x00", "z", "abab", "aaaa", "::", "==", "--", "//", "===", "\r\n", "\xa0", "​", "ﬁ", "Ω",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def table():
    return pieces.Pieces(PATH)


def check(table, library, texts):
    ids, counts = table.encode(pa.array(texts, pa.string()))
    want = [library.encode(t or "") for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert table.decode(ids, counts).to_pylist() == [library.decode(w) for w in want]


@pytest.mark.parametrize("seed", range(6))
def test_equals_the_library(table, library, seed):
    rng = random.Random(seed)
    check(table, library, ["".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 3, 8, 30, 80]))) for _ in range(3_000)] + ["", None, " "])
    check(table, library, ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(30)) for _ in range(500)])


def test_runs_of_white_space(table, library):
    assert table.run == 16 and table.cuts
    for n in range(70):
        check(table, library, [" " * n + "x", " " * n, "a" + " " * n + "the" + " " * n, "▁" * n + " b", "\n" * n + " " * n + "\t"])


def test_long_texts(table, library):
    rng = random.Random(1)
    check(table, library, ["z" * 300_000, " " * 100_000, "abcdefghij" * 20_000, "".join(rng.choices("aehinorst", k=30_000)), "漢" * 50_000])


def test_words_are_forgotten(table, library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 50)
    monkeypatch.setattr(pieces, "CHUNK", 20)
    rng = random.Random(2)
    for _ in range(5):
        check(table, library, [" ".join("".join(rng.choices("abcdef", k=rng.randint(1, 40))) for _ in range(30)) for _ in range(9)])


def test_decodes_any_ids(table, library):
    rng = random.Random(4)
    lists = [[rng.randrange(32_000) if rng.random() < 0.6 else rng.randrange(260) for _ in range(rng.randint(0, 12))] for _ in range(4_000)] + [[0], [1], [2, 28705], []]
    got = table.decode(np.array(sum(lists, []), np.int32), np.array([len(x) for x in lists])).to_pylist()
    assert got == [library.decode(x) for x in lists]


def test_merges_that_come_before_the_rest(table):
    """A vocabulary in which a merge makes a better pair than the round's: one merge after another gives the same."""
    rng = random.Random(5)
    for _ in range(40):
        names = sorted({"".join(rng.choices("abc", k=rng.randint(2, 5))) for _ in range(14)})
        rng.shuffle(names)
        rank = {p: k // rng.choice([1, 2]) for k, p in enumerate(names)}
        own = object.__new__(pieces.Pieces)
        symbol = {c: i for i, c in enumerate("abc")} | {p: 3 + i for i, p in enumerate(names)}
        own.symbols = own.size = len(symbol)
        pairs = {symbol[p[:k]] * own.symbols + symbol[p[k:]]: (rank[p], symbol[p]) for p in names for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol}
        own.keys = np.array(sorted(pairs), np.int64)
        own.ranks = np.array([pairs[k][0] for k in own.keys.tolist()], np.int32)
        own.into = np.array([pairs[k][1] for k in own.keys.tolist()], np.int64)
        words = ["".join(rng.choices("abc", k=rng.randint(1, 30))) for _ in range(60)]
        symbols, word = own.merged(np.array([symbol[c] for w in words for c in w]), np.repeat(np.arange(60), [len(w) for w in words]))
        text_of = {i: p for p, i in symbol.items()}
        for k, w in enumerate(words):
            left = list(w)
            while True:
                best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(left, left[1:])) if a + b in rank), default=None)
                if best is None:
                    break
                left[best[1] : best[1] + 2] = ["".join(left[best[1] : best[1] + 2])]
            assert [text_of[s] for s in symbols[word == k].tolist()] == left


def test_odd_rows(spark, library):
    rows = [(1, None, "x"), (1, "", "y"), (None, "the same text", "z"), (None, "the same text", "z"), (5, "word " * 60_000, "w")]
    docs = spark.createDataFrame(rows, "`doc.id` bigint, `te.xt` string, ids string")
    found = pieces.encode(docs, PATH, id_col="doc.id", text_col="te.xt").collect()
    assert sorted((str(r.id), r.ids, r.decoded) for r in found) == sorted((str(i), library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _ in rows)
    assert pieces.encode(docs.where("false"), PATH, id_col="doc.id", text_col="te.xt").count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    found = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_sentencepiece"](spark, sf).collect()}
    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(row.text or "")
        hashed = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        assert found.pop(row.doc_id) == (len(ids), *hashed)
    assert not found
