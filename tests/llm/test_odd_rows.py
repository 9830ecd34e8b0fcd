"""Tables with nulls, repeats, long texts, clashing and dotted names, and no rows."""

import pytest

import corpus_pipeline
from tidemark.llm import arrowstore, decontam, nearcopies, packing, quality, sharding, simhash, toxicity
from tidemark.llm.tokens import vocabulary

CLASHING = ["id", "rid", "row", "label", "score", "hash", "component", "fp", "cls", "words", "a.b", "te`xt"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in CLASHING)
PASSAGE = "the quick answer of this item is found near the old mill by the river where nobody has ever looked for it before today"


def odd_rows():
    more = tuple(f"{c} value" for c in CLASHING)
    texts = [
        (1, None), (2, ""), (2, ""), (None, "a text without an id that stays as it is"), (None, None), (3, "same words here " * 30), (3, "same words here " * 30),
        (4, "long " * 60_000), (5, "x" * 300_000), (6, f"before {PASSAGE} after it all"), (7, "   "), (8, "İstanbul'da BELEDİYESİ. \x00   end"),
    ]
    texts += [(100 + i, f"document number {i} about subject {i * 7} with its own words {i * 13} and end {i}") for i in range(30)]
    return [(i, t, "en" if i and i % 2 else None, None, None if t is None else len(t), *more) for i, t in texts]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("odd")
    rows = odd_rows()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{root}/full/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{root}/empty/documents.parquet")
    labels = [(100 + i, i % 2, i % 3 % 2) for i in range(25)] + [(None, 1, 1), (2, None, None)]
    for name in ("full", "empty"):
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/{name}/labels.parquet")
        spark.createDataFrame([(1, PASSAGE), (1, "another item of the same id with several words"), (2, None), (None, "")], "item_id int, text string").write.parquet(f"{root}/{name}/benchmark.parquet")
    return root


def test_pipeline(spark, folder):
    got = corpus_pipeline.run(spark, f"{folder}/full").collect()
    ids = {r.doc_id for r in got}
    assert 6 not in ids and {1, 3, 4, 5, 8, 100, 129} - {r.doc_id for r in got} <= {1}
    assert len([r for r in got if r.doc_id == 3]) == 1
    assert all(r.length > 0 for r in got)
    assert corpus_pipeline.run(spark, f"{folder}/empty").count() == 0


def test_stages_keep_rows_as_they_are(spark, folder):
    docs = spark.read.parquet(f"{folder}/full/documents.parquet")
    before = sorted(map(str, docs.collect()))
    kept = decontam.without_leaks(docs, spark.read.parquet(f"{folder}/full/benchmark.parquet"))
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == [r for r in before if "doc_id=6," not in r]
    one = simhash.keep_one(docs, find=nearcopies.near_copies)
    assert one.columns == docs.columns and set(map(str, one.collect())) <= set(before)
    assert toxicity.without_toxic(docs, spark.read.parquet(f"{folder}/full/labels.parquet")).columns == docs.columns


def test_empty_tables(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/empty/{n}.parquet") for n in ("documents", "labels"))
    assert toxicity.without_toxic(docs, labels).count() == 0
    assert nearcopies.near_copies(docs, rid_col=None).count() == 0
    assert quality.score_documents(docs, quality.fit(docs, labels)).count() == 0


def test_item_ids(spark):
    docs = spark.createDataFrame([(1, f"so {PASSAGE} it is"), (2, None)], "`a.b` int, `c.d` string")
    for kind, ids in (("int", (1, 1, 7)), ("string", ("x", "x", None)), ("smallint", (3, None, None))):
        items = spark.createDataFrame([(ids[0], PASSAGE), (ids[1], PASSAGE + " more"), (ids[2], PASSAGE)], f"item_id {kind}, text string")
        found = decontam.contaminated(docs, items, id_col="a.b", text_col="c.d")
        assert found.schema["item_id"].dataType.simpleString() == kind
        rows = found.collect()
        assert len(rows) == 3 and sorted(str(r.item_id) for r in rows) == sorted(map(str, ids)) and {r.id for r in rows} == {1}


def test_dotted_names(spark):
    docs = spark.createDataFrame([(1, "one two"), (None, None), (3, "one two")], "`a.b` bigint, `c.d` string")
    folder, manifest = arrowstore.write_store(docs, vocabulary("word_bpe_49k.json"), 1, leading_space=False, id_col="a.b", text_col="c.d")
    assert arrowstore.read_store(spark, folder, manifest).count() == 3
    assert packing.pack(docs, vocabulary("byte_bpe_50k.json"), 2, leading_space=True, id_col="a.b", text_col="c.d").count() == 3
    assert sharding.shard(docs, 2, id_col="a.b", text_col="c.d").count() == 3


def test_long_tokens_are_told_apart_to_their_end():
    """Two tokens of the same letters whose signs differ only far behind."""
    f = quality.Features()
    a, b = ("-".join("abcdefghij") + tail for tail in ("..k", "!!k"))
    assert (f.vector(a) != f.vector(b)).any() and quality.cut(a) == ["a-b-c-", "d-e-f-", "g-h-i-", "j..k"]
    assert "".join(quality.cut("x1" * 200)) == "x1" * 200 and max(map(len, quality.cut("y" * 100))) == quality.LONGEST
    assert (f.vector(a) == quality.Features(memory=1).vector(a)).all()
