"""Landed payloads: what is there, what is pushed down, restarts, broken texts, absent against null."""

import json

from pyspark.sql import functions as F

from tidemark.operators import connectors
from tidemark.sources import landing
from tidemark.streaming import streams


def land(spark, root, batch, rows):
    landing.land(spark.createDataFrame(rows, "provider string, ticker string, value string"), root, batch)


def test_batches_and_files(spark, tmp_path):
    root = f"file://{tmp_path}/in"
    assert landing.read(spark, root).collect() == [] and landing.batches(root) == []
    land(spark, root, 3, [("news", "A B/C", "one"), ("news", None, "two"), ("quote", "T", 'x\ny "é"')])
    land(spark, root, 10, [("news", "T", f"line {k}") for k in range(5000)])
    (tmp_path / "in/batch=000000000011/provider=news/ticker=T").mkdir(parents=True)
    (tmp_path / "in/batch=000000000011/provider=news/ticker=T/part-0.txt").write_text("not finished\n")
    rows = landing.read(spark, root)
    got = {(r.batch, r.provider, r.ticker, r.value) for r in rows.where("batch = 3").collect()}
    assert got == {(3, "news", "A B/C", "one"), (3, "news", None, "two"), (3, "quote", "T", 'x y "é"')}
    assert rows.count() == 5003 and [r.place for r in rows.where("batch > 3").orderBy("file", "place").collect()] == list(range(5000))
    assert rows.where("ticker = 'T' and provider in ('quote', 'other')").count() == 1 and rows.where("ticker is null").count() == 1
    assert rows.where("batch >= 4 and value like '%99'").count() == 50
    land(spark, root, 3, [("news", "T", "again")])
    assert [r.value for r in landing.read(spark, root).where("batch < 10").collect()] == ["again"]


def test_options_choose_folders(tmp_path, spark):
    root = f"file://{tmp_path}/in"
    land(spark, root, 1, [("news", "A", "a"), ("quote", "B", "b"), ("news", None, "n")])
    land(spark, root, 2, [("news", "A", "c")])
    made = lambda **o: landing.LandedPayloads({"path": root, **{k: str(v) for k, v in o.items()}}).reader(None).partitions()
    assert [(f.batch, f.ticker) for p in made(provider="news", fromBatch=2) for f in p.files] == [(2, "A")]
    assert len(made(partitionBytes=1)) == 4 and len(made()) == 1 and made(ticker="none") == []
    values = lambda **o: sorted(r.value for r in landing.read(spark, root, **o).collect())
    assert values(provider="news", toBatch=1) == ["a", "n"] and values(ticker="B") == ["b"] and values() == ["a", "b", "c", "n"]
    rows = landing.read(spark, root)
    assert rows.where("batch = 2").count() == 1 and rows.count() == 4


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    root, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    land(spark, root, 0, [("news", "T", "first")])
    for turn in range(4):
        rows = landing.read_stream(spark, root).select("batch", "value")
        streams.run(rows.writeStream.format("parquet").option("path", out), spark, "landing", state)
        want = [(0, "first")] + [(5, "second"), (7, "third")][: 2 * (turn > 1)]
        assert sorted(map(tuple, spark.read.parquet(out).collect())) == want
        if turn == 1:
            land(spark, root, 5, [("news", "T", "second")])
            land(spark, root, 7, [("quote", None, "third")])
    assert sorted(r.value for r in landing.read(spark, root).collect()) == ["first", "second", "third"]


def test_broken_texts_lose_nothing_else(spark, tmp_path):
    root = f"file://{tmp_path}/in"
    good = json.dumps({"news": [{"title": "A", "id": 7, "providerPublishTime": 1700000000}, {"title": "", "content": {"title": "B", "pubDate": "2024-01-02T10:00:00Z", "provider": {"name": "N"}}}, {"content": None}, "odd", {"title": 5}]})
    bad = ["{", "", "[1]", "null", '"text"', '{"news": 3}', '{"news": null}', "{}"]
    land(spark, root, 0, [("news", "T", v) for v in (*bad, good)])
    rows = landing.read(spark, root)
    assert sorted(r.value for r in connectors.broken(rows).collect()) == sorted(bad[:5])
    got = sorted((r["index"], r.id, r.title, r.source, r.time) for r in connectors.news(rows).collect())
    assert got == [(0, "7", "A", "Yahoo Finance", "Nov 14, 2023"), (1, "T-1", "B", "N", "Jan 2, 2024")]


def test_numbers_of_quotes_and_fundamentals(spark, tmp_path):
    root = f"file://{tmp_path}/in"
    land(spark, root, 0, [("quote", "T", v) for v in ('{"c": "1.5", "d": null, "v": 12.7}', '{"c": true, "dp": "n/a", "v": "12.7"}', '{"c": {"x": 1}, "v": "9"}', "{}", "bad")])
    got = sorted((r.price, r.price_delta_24h, r.percent_change_24h, r.volume) for r in connectors.quotes(landing.read(spark, root)).collect())
    assert got == [(0.0, 0.0, 0.0, 0), (0.0, 0.0, 0.0, 9), (1.0, 0.0, 0.0, 0), (1.5, 0.0, 0.0, 12)]
    land(spark, root, 1, [("fundamentals", k, json.dumps(v)) for k, v in {
        "A": {"info": {"marketCap": "n/a", "market_cap": 5, "longName": "", "shortName": "S"}, "fast_info": {"marketCap": 7, "currency": "EUR"}},
        "B": {"info": {"marketCap": None, "sector": ""}, "fast_info": {}}, "C": {"info": None}, "D": {"fast_info": {"beta": "2"}}}.items()])
    got = {r.ticker: (r.market_cap, r.company_name, r.currency, r.beta) for r in connectors.fundamentals(landing.read(spark, root).where("batch = 1")).collect()}
    assert got == {"A": (5.0, "S", "EUR", None), "D": (None, None, None, 2.0)}


def test_a_null_score_is_not_an_absent_one(spark):
    grouped = {"ticker": "tsla", "date": "2024-01-02", "posts": [{"text": "a", "source": "s", "post_score": None}, {"text": None, "source": None}, {"post_score": 3}, {"post_score": "x"}]}
    flat = {"ticker": "AMD", "date": "2024-01-03", "text": "b"}
    rows = [json.dumps(x) for x in (grouped, flat, {"ticker": "X", "posts": None}, {"ticker": "X", "posts": []}, {"ticker": "X"})] + ["bad", None]
    got = connectors.posts_of_records(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert sorted((r.ticker, r.post_index, r.text, str(r.source), r.post_score) for r in got[:0] + got if r.post_score is not None) == [("AMD", 0, "b", "unknown", 0.0), ("TSLA", 1, "", "None", 0.0), ("TSLA", 2, "", "unknown", 3.0)]
    assert sorted(r.post_index for r in got if r.post_score is None) == [0, 3]
    assert connectors.posts_of_records(spark.createDataFrame([], "value string")).agg(F.count("*")).first()[0] == 0
