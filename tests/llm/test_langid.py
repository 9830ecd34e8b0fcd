import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid
from tidemark.llm.common import crc_mod

SCHEMA = "doc_id bigint, text string, lang string, id string, score string, lang_pred string"


def plain_phrases(sample: str, text: str) -> int:
    """Greedy longest-match phrases of a whole text, the last for its end."""
    i = start = breaks = 0
    while i < len(text):
        if text[start : i + 1] not in sample:
            breaks += 1
            start = i if text[i] in sample else i + 1
        i += 1
    return breaks + bool(text)


def coded(model: langid.Parser, text: str) -> str:
    return "".join(map(chr, model.symbols(text).tolist()))


@pytest.mark.parametrize("seed", range(6))
def test_phrases_are_longest_matches(seed):
    rng = random.Random(seed)
    word = lambda abc: "".join(rng.choices(abc, k=rng.randint(1, 8)))
    samples = {"x": " ".join(word("abcd") for _ in range(200)), "y": " ".join(word("cdef") for _ in range(200))}
    model = langid.Parser(samples)
    texts = [" ".join(word("abcdefz") for _ in range(n)) for n in (1, 5, 60, 700)] + ["z", "zz a"]
    got = model.phrases(texts)
    for i, t in enumerate(texts):
        assert got[i].tolist() == [plain_phrases(coded(model, samples[k]), coded(model, langid.plain(t))) for k in model.languages]


@pytest.mark.parametrize("stretch", [3, 50, 1024])
def test_stretches_make_one_parse(monkeypatch, stretch):
    """Any stretch gives the counts of one parse of the whole text, with states that never meet as well."""
    monkeypatch.setattr(langid, "STRETCH", stretch)
    rng = random.Random(stretch)
    samples = {"x": "".join(rng.choices("ab ", k=3000)), "y": "a" * 500 + "b" * 500, "z": "".join(map(chr, rng.choices(range(0x4E00, 0x4E00 + 1500), k=2000)))}
    model = langid.Parser(samples)
    texts = ["", "".join(rng.choices("ab ", k=2500)), "a" * 2000, "ab" * 900, samples["z"][500:900] * 2, "".join(map(chr, rng.choices(range(0x4E00, 0x4E00 + 3000), k=300)))]
    got = model.phrases(texts)
    for i, t in enumerate(texts):
        assert got[i].tolist() == [plain_phrases(coded(model, samples[k])[: langid.SAMPLE], coded(model, langid.plain(t))) for k in model.languages]


def test_scripts_with_many_letters_are_told_apart():
    rng = random.Random(2)
    words = {k: ["".join(map(chr, rng.choices(range(lo, lo + 1500), k=rng.randint(1, 4)))) for _ in range(400)] for k, lo in (("p", 0x4E00), ("q", 0x5E00))}
    model = langid.Parser({k: " ".join(rng.choices(w, k=4000)) for k, w in words.items()})
    texts = [" ".join(rng.choices(w, k=60)) for w in words.values() for _ in range(10)]
    langs, scores = model.predict(texts)
    assert langs == ["p"] * 10 + ["q"] * 10 and min(scores) > 0.99


def test_copies_of_one_text_do_not_fill_the_sample(spark):
    rows = [(i, "same words again and again", "en", "", "", "") for i in range(3000)] + [(5000 + i, f"other text number {chr(97 + i % 26) * 3} here", "en", "", "", "") for i in range(200)]
    (lang, sample), = langid.learn(spark.createDataFrame(rows, SCHEMA))
    assert lang == "en" and sample.count("same words") <= 1 and "other text" in sample


def test_documents_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.predict(docs, langid.learn(docs)).withColumnRenamed("id", "doc_id")
    held = docs.where(crc_mod(F.col("doc_id"), 4) == 2).join(out, "doc_id")
    right, total = held.where("lang = lang_pred").count(), held.count()
    assert total > 100 and right / total > 0.95
    assert out.where("score < 0 or score > 1").count() == 0


def test_odd_rows(spark):
    rows = [(i, t, lang, "a", "b", "c") for i, (t, lang) in enumerate([("the cat and the dog " * 9, "en"), ("le chat et le chien " * 9, "fr")] * 12)]
    rows += [(100, None, "en", "", "", ""), (101, "", "fr", "", "", ""), (102, "12 3!", None, "", "", ""), (103, "the dog " * 40_000, None, "", "", ""), (None, "le chien et", None, "", "", ""), (104, "漢字", None, "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r for r in langid.predict(df, langid.learn(df)).collect()}
    assert len(got) == len(rows)
    assert [got[i].lang_pred for i in (0, 1, 100, 101, 102, 103, None)] == ["en", "fr", "und", "und", "und", "en", "fr"]
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.learn(empty) == () and langid.predict(empty, ()).collect() == []
    assert {r.lang_pred for r in langid.predict(df, ()).collect()} == {"und"}
