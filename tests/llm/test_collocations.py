import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidemark.llm import collocations, queries

SCHEMA = "`te.xt` string, `la.ng` string, word string, f string, key string, pivot string, a string, size string, number string"


def plain(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, words[i : i + k]) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            gone |= {(lang, p[i : i + k]) for i in range(len(p) - k + 1) if 100 * a >= 80 * f[lang, p[i : i + k]]}
    out = {}
    for (lang, p), a in candidates.items():
        if (lang, p) in gone:
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:top]))


def texts(rng, n):
    vocabulary = ["the", "The", "of", "a", "b", "c", "été", "ÉTÉ", "x y", "漢", "word" * 30, "q", "r"]
    signs = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "; ", ":", "!", "?", "\r\n", "\x0b", "\x0c"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    return ["".join(rng.choices(vocabulary, weights)[0] + rng.choice(signs) for _ in range(rng.choice([0, 3, 60]))) for _ in range(n)]


@pytest.mark.parametrize(("table", "salt"), [(1 << 18, 1 << 17), (4, 1 << 17), (0, 1 << 17), (6, 9), (0, 5)])
def test_equals_plain_version(spark, table, salt):
    rng = random.Random(table)
    rows = [(t, rng.choice(["en", "en", None, "und", "é x"])) for t in texts(rng, 150)]
    rows += [(None, "en"), ("", None), ("the of a b " * 3_000, "long"), ("z" * 300_000, "en")] + [("copy of a row, and more of it", "en")] * 40
    docs = spark.createDataFrame([(t, lang, *"1234567") for t, lang in rows], SCHEMA).repartition(7)
    for least, top in ((5, 2000), (2, 13)):
        found = collocations.collocations(docs, text_col="te.xt", lang_col="la.ng", least=least, top=top, table=table, salt=salt)
        assert sorted(map(tuple, found.collect())) == plain(rows, least, top)


def test_small_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(t, "en") for t in texts(rng, 120)]
    monkeypatch.setattr(collocations, "BLOCK", 3)
    docs = spark.createDataFrame(rows, "text string, lang string")
    found = collocations.collocations(docs, least=3, salt=50).collect()
    assert sorted(map(tuple, found)) == plain(rows, 3, 2000)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id int, text string, lang string")
    assert collocations.collocations(docs).count() == 0
    docs = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, " ,. ", "en")], "doc_id int, text string, lang string")
    assert collocations.collocations(docs).count() == 0


def test_hashes_are_spark_s(spark):
    rows = [("en", "word"), ("und", "été"), ("", "x" * 100), ("a b", "漢字")]
    for seed in (1, 2):
        found = spark.createDataFrame(rows, "lang string, word string").select("lang", "word", collocations._code(seed).alias("code")).collect()
        assert all(r.code == collocations.TABLE_WORDS + (collocations._xx(seed, r.lang, r.word) >> 3) for r in found)


def test_equal_hashes_are_told_apart(monkeypatch):
    rng = np.random.RandomState(1)
    rows = rng.randint(0, 3, (500, 4))
    monkeypatch.setattr(collocations, "_mixed", lambda rows: (rows[:, 0] % 2).astype(np.uint64))
    found, a = collocations.counted(rows, np.ones(500, np.int64))
    assert {tuple(r): n for r, n in zip(found.tolist(), a.tolist())} == Counter(map(tuple, rows.tolist()))


def test_large_products(spark):
    many = 3 * 10**16
    words = spark.createDataFrame([(0, "en", "a", 5 * many), (1, "en", "b", many + 1)], "number bigint, lang string, word string, f bigint")
    phrases = spark.createDataFrame([(0, 1, -1, -1, 2, many), (0, 1, 1, -1, 3, many * 8 // 10 - 1)], "w0 bigint, w1 bigint, w2 bigint, w3 bigint, size int, a bigint")
    known = spark.createDataFrame([(1, 1, -1, -1, 2, many)], phrases.schema)
    found = {tuple(r.key): (r.l, r.r, r.score) for r in collocations.scored(phrases.union(known), words).collect()}
    a = many * 8 // 10 - 1
    assert found[0, 1, -1, -1] == (5 * many, many + 1, 2_000_000 * many // (6 * many + 1))
    assert found[0, 1, 1, -1] == min([(5 * many, many, 2_000_000 * a // (6 * many)), (many, many + 1, 2_000_000 * a // (2 * many + 1))], key=lambda x: x[2])


def test_oracle(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    found = queries.QUERIES["op11_pivot_collocations"](spark, sf)
    want = db.sql(queries.ORACLE_SQL["op11_pivot_collocations"])
    assert found.columns == want.columns and [t for _, t in found.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())
    assert found.select("lang").distinct().count() == 4
