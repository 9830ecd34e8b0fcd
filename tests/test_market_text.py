"""Golden cases and the SQL oracle for the market-text operators."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import fixed, text
from tidemark.operators import citations, market, matching, posts, sentiment, serving, signal, stories
from tidemark.plans import display_queries, market_queries, provider_queries, serving_queries, story_queries, text_queries, view_queries  # noqa: F401
from tidemark.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 5)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
    rows = sorted(repr(tuple(plain(r[i]) for i in order)) for r in want.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect()) == rows


@pytest.mark.parametrize(("headline", "label", "score", "confidence"), [
    ("Quiet session today", "neutral", 0.0, 0.7056798623),
    ("word " * 13, "neutral", 0.0, 0.6839186691),
    ("Shares jump", "positive", 0.5, 0.5925925926),
    ("jump " + "word " * 13, "positive", 0.54, 0.64),
    ("Company beats", "positive", 0.6, 0.7),
    ("Stock recall", "negative", -0.5, 0.5925925926),
    ("slump " + "word " * 13, "negative", -0.54, 0.64),
    ("weak slump", "negative", -0.6, 0.7),
    ("rally and slump", "neutral", 0.0, 0.6839186691),
    ("Enterprise executives meet again", "positive", 0.6, 0.7),
    (None, "neutral", 0.0, 0.7056798623),
])
def test_lexicon_outcomes(spark, headline, label, score, confidence):
    r = sentiment.with_sentiment(spark.createDataFrame([(headline,)], "text string")).first()
    assert r.sentiment_label == label
    assert r.sentiment_score == pytest.approx(score, abs=1e-9) and r.sentiment_confidence == pytest.approx(confidence, abs=1e-9)
    assert r.positive_prob + r.negative_prob + r.neutral_prob == pytest.approx(1)


def test_calibration_of_model_priors(spark):
    assert sentiment.calibrate(0.95, 0.02, 0.03, 0, 5)[:3] == pytest.approx((0.76, 0.0163934426, 0.2236065574))
    assert sentiment.calibrate(0.95, 0.02, 0.03, 3, 30)[:3] == pytest.approx((0.82, 0.02, 0.16))
    assert sentiment.calibrate(0.40, 0.35, 0.25, 2, 30)[5] == "neutral"
    df = spark.createDataFrame([(0.95, 0.02, 0.03)], "p double, n double, u double")
    r = sentiment.rescored(df, F.struct("p", "n", "u"), F.lit(0), F.lit(5)).first()
    assert r.positive_prob == pytest.approx(0.76) and r.sentiment_label == "positive"


@pytest.mark.parametrize(("item", "outcome", "matched"), [
    ("Tesla shares fall", "ambiguous", ["TSLA", "AMD"]), ("Tesla opens a plant", "unmatched", []), ("Nikola Tesla and Cybertruck", "unmatched", []),
    ("$AMD up", "assigned", ["AMD"]), ("AMD ships a processor", "assigned", ["AMD"]), ("AMD diagnosed", "unmatched", []),
    ("caféMETA Instagram", "assigned", ["META"]), ("xNVIDIA", "unmatched", []), ("NVIDIA, again", "assigned", ["NVDA"]), ("apple pie on an iPhone", "unmatched", []),
])
def test_ticker_mapping(spark, item, outcome, matched):
    r = matching.with_tickers(spark.createDataFrame([(item,)], "text string")).first()
    assert (r.outcome, r.matched) == (outcome, matched)


@pytest.mark.parametrize(("copy", "found"), [
    ("The stock fell because of rates", ["causal_price"]), ("Shares will move higher", ["prediction"]), ("Investors should buy", ["advisory"]),
    ("It is guaranteed to work", ["unsupported_certainty"]), ("A confidence score of 3", ["model_confidence"]), ("An analyst rated it a buy", []),
])
def test_copy_rules(spark, copy, found):
    df = spark.createDataFrame([(copy,)], "text string")
    assert matching.lint(df, F.lit("generated_summary")).first().categories == found
    assert matching.lint(df, F.lit("publisher_headline")).first().categories == []
    with pytest.raises(Exception, match="unknown content scope"):
        matching.lint(df, F.lit("other")).collect()


def test_posts(spark):
    records = spark.createDataFrame([("T", "d", [(1, None, None, None, None), (2, "x", "s", None, 3.0)]), ("U", "d", None)], "ticker string, date string, posts array<struct<event_id: bigint, text: string, source: string, content_type: string, post_score: double>>")
    assert [tuple(r) for r in posts.flatten(records).orderBy("post_index").collect()] == [("T", "d", 0, "", "unknown", None), ("T", "d", 1, "x", "s", 3.0)]
    rows = [("ok", "Mock feed"), (" \n ", "r"), (None, "r"), ("A discussion about it", "r"), ("ok", None)]
    df = spark.createDataFrame(rows, "t string, s string").select(posts.is_valid(F.col("t"), F.col("s")).alias("v"))
    assert [r.v for r in df.collect()] == [False, False, False, False, True]


def bars(spark, values):
    return spark.createDataFrame([("T", f"2024-01-{i + 1:02d}", c, c and c + 1, v) for i, (c, v) in enumerate(values)], "ticker string, date string, close double, high double, volume bigint")


@pytest.mark.parametrize(("values", "delta", "percent", "volume"), [
    ([(5.0, 7)], 0.0, 0.0, 0.0), ([(5.0, 7), (6.0, 14)], 1.0, 20.0, 1.0), ([(0.0, 0), (6.0, 4)], 6.0, 0.0, 0.0),
    ([(1.0, 100)] + [(2.0, 10)] * 5 + [(3.0, 20)], 1.0, 50.0, 1.0), ([(4.0, None), (5.0, 3)], 1.0, 25.0, 0.0),
])
def test_snapshot(spark, values, delta, percent, volume):
    r = market.snapshot(bars(spark, values)).first()
    assert (r.price_delta_24h, r.percent_change_24h, r.volume_delta) == pytest.approx((delta, percent, volume))


def test_empty_bars(spark):
    assert market.snapshot(bars(spark, [])).count() == 0 and market.history(bars(spark, [])).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([(" a  b ", "HTTP://Ex.com/A/?utm_source=x&b=2&a=1#top")], "t string, u string")
    r = df.select(text.word_count(F.col("t")).alias("n"), text.strip(F.col("t")).alias("s"), text.canonical_url(F.col("u")).alias("u"), text.percent(F.lit(0.2)).alias("p")).first()
    assert tuple(r) == (2, "a  b", "http://ex.com/A?a=1&b=2", "+20.0%")


def test_signal_round_trip(spark, tmp_path):
    models, metrics = signal.train(spark, signal.training_data(spark), trees=10)
    assert metrics["lr_accuracy"] > 0.9 and metrics["rf_auc"] > 0.9
    assert set(signal.provenance(metrics, "rf")) == {"rf_accuracy", "rf_f1", "rf_auc"}
    signal.save(models, metrics, f"file://{tmp_path}/m")
    again, kept = signal.load(spark, f"file://{tmp_path}/m")
    df = signal.prepare(signal.training_data(spark, 40))
    a, b = (signal.probability(df, m["rf"]).orderBy("row").select("probability_up").collect() for m in (models, again))
    assert a == b and kept == metrics
    with pytest.raises(ValueError, match="missing columns"):
        signal.prepare(spark.range(1))


def test_components_and_clusters(spark):
    nodes, pairs = spark.createDataFrame([(i,) for i in range(9)], "id bigint"), spark.createDataFrame([(0, 3), (3, 5), (5, 8), (1, 2)], "a bigint, b bigint")
    got = {r.id: r.root for r in stories.components(nodes, pairs).collect()}
    assert got == {0: 0, 3: 0, 5: 0, 8: 0, 1: 1, 2: 1, 4: 4, 6: 6, 7: 7}
    import pandas as pd

    rows = pd.DataFrame({"ticker": "T", "day": "d", "story_id": range(6), "embedding": [[1.0, 0.0]] * 3 + [[0.0, 1.0]] * 2 + [[-1.0, 0.0]]})
    assert stories.clusterer(0.5)(rows)["theme"].tolist() == [0, 0, 0, 1, 1, -1]
    assert set(stories.clusterer(0.5)(rows[:3])["theme"]) == {-1}


def test_summaries_resolve(spark):
    story = "struct<id: string, title: string, description: string, outlet: string, published_at: string>"
    df = spark.createDataFrame([(1, "TSLA", [("a", "One two", "d", "o", "t"), ("b", "Three", "d", "p", "t")])], f"theme_id bigint, ticker string, stories array<{story}>")
    s = citations.summarize(df).withColumn("members", F.transform("stories", lambda x: x["id"]))
    assert s.select(citations.violations(F.col("label"), F.col("sentences"), F.col("members"))).first()[0] == []
    assert [(r.id, r.outlet) for r in citations.resolved(s).orderBy("sentence").collect()] == [("a", "o"), ("b", "p")]
    with pytest.raises(Exception, match="at least one story"):
        citations.summarize(df.withColumn("stories", F.array().cast(f"array<{story}>"))).collect()


def test_batches_of_tickers():
    assert serving.batch_tickers([" tsla", "TSLA", "amd"]) == ["TSLA", "AMD"]
    for bad in ([], ["x"] * 0, [f"t{i}" for i in range(11)]):
        with pytest.raises(ValueError):
            serving.batch_tickers(bad)


def test_alias_table_is_sound():
    assert len({a.ticker for a in fixed.ALIASES}) == len(fixed.ALIASES) == len(fixed.TICKERS)
    assert {r[0] for r in fixed.RULES} == set(fixed.CATEGORIES)
