import numpy as np

import corpus_pipeline
from tests.llm.test_nearcopies import plain_kept
from tests.llm.test_suffix import plain as plain_repeats
from tidemark.llm import decontam, toxicity
from tidemark.llm.common import written
from tidemark.llm.tokens import Encoder, vocabulary


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    want = {r.id for r in toxicity.score_documents(docs, labels).collect() if r.score < 0.7}
    table = None
    for name, stage in corpus_pipeline.STAGES:
        before = rows
        table = written(stage(spark, docs, sf), f"test-{name}")
        if name == "packing":
            break
        assert table.columns == columns and table.schema == docs.schema
        rows, docs = {r.doc_id: r for r in table.collect()}, table
        assert table.count() == len(rows)
        if name == "toxicity":
            assert set(rows) == want
        elif name == "simhash":
            assert set(rows) == plain_kept([(i, r.text) for i, r in before.items()]) and all(rows[i] == before[i] for i in rows)
        elif name == "suffix_array":
            removed = {x[0]: x[2] for x in plain_repeats([(i, r.text) for i, r in before.items()])}
            for i, r in before.items():
                lost = len(r.text.encode()) - len(rows[i].text.encode())
                assert removed[i] <= lost <= removed[i] + 6 * (removed[i] > 0)
                assert rows[i].n_chars == len(rows[i].text)
        elif name == "decontamination":
            items = [(r.item_id, decontam.words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            text = {i: " ".join(decontam.words(r.text)) for i, r in before.items()}
            leaked = {i for i in text for _, ws in items if ws and " ".join(ws) in text[i]}
            assert not leaked & set(rows) and len(before) - len(rows) <= len(leaked) + 2
    encoder, pieces = Encoder(vocabulary("byte_bpe_50k.json"), True), {}
    for r in table.collect():
        pieces.setdefault(r.doc_id, []).append((r.piece, np.frombuffer(r.ids, "<u2").tolist()))
    assert set(pieces) == set(rows)
    for i, parts in pieces.items():
        assert [x for _, p in sorted(parts) for x in p] == [*encoder.whole(rows[i].text or "").tolist(), 2]


def test_run_ends_with_packed_pieces(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "sequence_id" in out.columns
