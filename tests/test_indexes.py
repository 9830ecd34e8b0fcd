"""Rule and vector indexes against brute force; feeds, sections, signed decimals and the life of a model."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import display, fixed
from tidemark.operators import artifacts, matching, rule_index, serving, signal, vector_index
from tidemark.plans import index_queries  # noqa: F401
from tidemark.plans.registry import QUERIES
from tidemark.sources import readers

SF = "/root/testdata/sf0.001"


def test_phrases_of_a_large_table(spark):
    """10,000 generated phrases against a plain pattern each, on texts that hold some of them."""
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("stock", "será", "x", "Q3", "don't", "$T", "İstan", "K9", "ſo", "data-") for b in ("", "s", "1", "é", "K")]
    phrases = [(k, rng.choice(["", " "]) .join([" ".join(rng.choices(words, k=rng.randint(1, 4)))])) for k in range(10_000)]
    texts = [(k, rng.choice(["", "(", "a"]) + rng.choice([" ", ", ", "\n"]).join(rng.choices(words + [p for _, p in phrases[:30]], k=rng.randint(0, 12))) + rng.choice(["", ".", "b"])) for k in range(60)]
    texts += [(60, None), (61, ""), (62, texts[5][1]), (63, r"back \E slash \Q and %"), (64, "STOCK SERÁ ſO kelvin K9")]
    phrases += [(20_000, None), (20_001, ""), (20_002, "%"), (20_003, r"\E slash"), (20_004, "stock será"), (20_005, "SO"), (20_006, "istan"), (5, phrases[5][1])]
    t, p = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(phrases, "rule int, phrase string")
    got = {tuple(r) for r in rule_index.phrase_hits(t, p).collect()}
    asked = p.where("phrase rlike '[A-Za-z0-9]'").distinct()
    plain = t.join(asked, F.call_function("regexp_like", "text", rule_index.phrase_pattern(F.col("phrase"))))
    want = {(r.id, r.rule) for r in plain.select("id", "rule").collect()}
    assert got == want and len(want) > 300 and {(63, 20_003), (64, 20_004), (64, 20_005)} <= got
    assert rule_index.phrase_hits(t.where("false"), p).count() == 0 and rule_index.phrase_hits(t, p.where("false")).count() == 0


def test_frequent_words_meet_only_as_neighbours(spark, monkeypatch):
    """Texts that hold the words of a phrase apart are not searched for it: with a pattern that all texts match, only neighbours are left."""
    apart = [(k, f"At noon the cat sat at a mat {k}") for k in range(200)]
    texts = spark.createDataFrame([*apart, (900, "Look: the--at"), (901, "THE"), (902, "the the at"), (903, ""), (904, None)], "id int, text string")
    phrases = spark.createDataFrame([(k, p) for k, p in enumerate(("the at", "the the", "cat sat on", "noon The cat", "mat 7", "the-at", "THE"))], "rule int, phrase string")
    hits = {tuple(r) for r in rule_index.phrase_hits(texts, phrases).collect()}
    assert hits == {(902, 0), (902, 1), (7, 4), (901, 6), (902, 6), (900, 6), *((k, r) for k in range(200) for r in (3, 6))}
    monkeypatch.setattr(rule_index, "phrase_pattern", lambda phrase: F.lit(""))
    met = {tuple(r) for r in rule_index.phrase_hits(texts, phrases).collect()}
    assert met == hits | {(900, 0), (900, 5), (902, 5)}


def test_literal_rules_equal_their_columns(spark):
    rules = [(k, p) for k, (_, kind, p) in enumerate(fixed.RULES) if kind == "literal"]
    texts = [(k, t) for k, t in enumerate([f"Analysts say {p.upper()}, maybe" for _, p in rules] + ["will risen", "unexpected to rise", None])]
    t = spark.createDataFrame(texts, "id int, text string")
    got = {tuple(r) for r in rule_index.phrase_hits(t, spark.createDataFrame(rules, "rule int, phrase string")).collect()}
    want = {(r.id, k) for k, p in rules for r in t.where(F.col("text").rlike(matching.expression("literal", p))).collect()}
    assert got == want and len(want) >= len(rules)


def embedded(spark, n=1500, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(30, dim))[rng.integers(0, 30, n)] + 0.4 * rng.normal(size=(n, dim))
    x[: n // 3] = x[0] + 0.1 * rng.normal(size=(n // 3, dim))  # one dense place
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(n, None), (7, x[7].tolist())]
    return x, spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(6)


@pytest.mark.parametrize("block", [4096, 50])
def test_search_is_exact_and_probes_recall(spark, block):
    x, df = embedded(spark)
    queries = df.where("id % 20 = 0")
    s = x.astype(np.float64) @ x.astype(np.float64).T
    want = {(q, i) for q in range(0, 1500, 20) for i in range(1500) if q != i and s[q, i] >= 0.7}
    exact = vector_index.search(df, queries, 0.7, cells=40, block=block).collect()
    assert {(r.query, r.id) for r in exact} == want and len(want) > 5000
    some = {(r.query, r.id) for r in vector_index.search(df, queries, 0.7, cells=40, probes=6, block=block).collect()}
    assert some <= want and len(some) >= 0.9 * len(want)
    assert vector_index.search(df.where("false"), queries, 0.7).count() == 0 and vector_index.search(df, queries.where("false"), 0.7).count() == 0


def test_blocks_of_queries_meet_as_matrices(spark, monkeypatch):
    """Several blocks of queries; sums are those of the elements in their order, bit by bit; pairs meet in Arrow, not one by one in a join."""
    from tidemark.operators.stories import cosine

    monkeypatch.setattr(vector_index, "ASKED", 16)
    _, df = embedded(spark, 600)
    df = df.where("embedding is not null")
    found = vector_index.search(df, df.where("id % 7 = 0"), 0.7, cells=5, block=50)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan
    x, y = df.select(F.col("id").alias("query"), F.col("embedding").alias("q")).where("query % 7 = 0"), df
    want = x.crossJoin(y).where("query <> id").select("query", "id", cosine(F.col("q"), F.col("embedding")).alias("similarity")).where("similarity >= 0.7")
    key = lambda rows: sorted(map(tuple, rows))
    assert key(found.collect()) == key(want.collect()) and want.count() > 2000


def test_cells_are_left_out_without_loss(spark):
    x, df = embedded(spark)
    c = vector_index.fit(df, 40)
    index = vector_index.assigned(df, c).groupBy("cell").agg(F.max("angle").alias("r")).collect()
    asked = vector_index.visits(df.where("id % 20 = 0"), c, {r.cell: r.r for r in index}, 0.9, None).count()
    assert asked < 0.7 * len(index) * 75


def feed(title, *items):
    return "<rss><channel><title>" + title + "</title>" + "".join(f"<item><title>{t}</title><link>{u}</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item>" for t, u in items) + "</channel></rss>"


@pytest.mark.parametrize("stream", [False, True])
def test_a_broken_feed_loses_nothing_of_another(spark, tmp_path, stream):
    from tidemark.streaming import streams

    files = {
        "source=a/1.xml": feed("one", ("A", "http://x.com/a?utm_source=q"), ("", "http://x.com/none"), ("B", "http://x.com/b")), "source=a/2.xml": feed("one", ("C", "http://x.com/c"))[:60],
        "source=b/3.xml": feed("none"), "source=b/4.xml": "no xml at all", "source=b/5.xml": "", "source=c/6.xml": feed("single", ("D &amp; E", "http://x.com/d")),
    }
    for name, text in files.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    parsed = readers.parsed_feeds(readers.feed_files(spark, f"file://{tmp_path}/in", stream=stream))
    if stream:
        out = f"file://{tmp_path}/out"
        streams.run(parsed.writeStream.format("parquet").option("path", out), spark, "feeds")
        parsed = spark.read.schema(parsed.schema).parquet(out)
    assert sorted((r.source, r.title, r.canonical_url) for r in readers.feed_rows(parsed).collect()) == [("a", "A", "http://x.com/a"), ("a", "B", "http://x.com/b"), ("c", "D & E", "http://x.com/d")]
    assert {r.file for r in parsed.where("broken is not null").collect()} - {"5.xml"} == {"2.xml", "4.xml"}


def test_no_feeds(spark, tmp_path):
    files = readers.feed_files(spark, f"file://{tmp_path}/none")
    assert readers.feed_rows(readers.parsed_feeds(files)).count() == 0


def test_signed_decimals(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (-1.5, None), (None, 0.0), (None, None), (float("nan"), float("inf"))], "d double, p double")
    got = [r[0] for r in rows.select(display.price_change(F.col("d"), F.col("p"))).collect()]
    assert got == ["$+1.00 (+2.00%)", "$-1.50", "0.00%", "Change not reported", "Change not reported"]
    assert rows.select(display.volume_delta(F.col("p"))).first()[0] == "Volume delta +200.0%"


def test_sections_of_every_state(spark):
    schema = "ticker string, sentiment_label string, price double, market_status string, market_source string, volume_delta double, movement string, real_training_data boolean, reason string, headline_count bigint, headline_status string, headline_source string, social bigint, publisher bigint, has_fundamentals boolean, fundamentals_status string, fundamentals_source string"
    none = [None] * 16
    full = ["positive", 2.0, "live", "bars", 0.2, "up", True, None, 3, "fallback", "Yahoo Finance via yfinance (stale cache)", 2, 0, True, "live", "Yahoo Finance via yfinance"]
    held = ["neutral", 0.0, "", None, None, "up", False, "not enough outcomes", 0, None, None, 0, 4, False, None, None]
    rows = serving.availability(spark.createDataFrame([("N", *none), ("F", *full), ("H", *held)], schema))
    got = {(r.ticker, r.section): (r.type, r.title, r.status, r["count"], r.message) for r in serving.alerts(rows).collect()}
    assert len(got) == 18
    assert got["F", "market_data"] == ("success", "Market data", "live", None, "Market snapshot is available from bars. Volume delta +20.0%.")
    assert got["F", "prediction"][2] == "ready" and got["H", "prediction"] == ("warning", "Experimental signal", "unavailable", None, "not enough outcomes")
    assert got["F", "headlines"][:4] == ("warning", "Headlines", "fallback", 3) and got["F", "social_posts"] == ("success", "Social posts", "ready", 2, "2 social posts are available.")
    assert got["H", "social_posts"] == ("success", "Publisher items", "cached", 4, "4 publisher headline items are available. These are not social chatter.")
    assert got["N", "market_data"][2:] == ("unavailable", None, "Market snapshot unavailable from configured providers.") and got["N", "social_posts"][2:4] == ("unavailable", 0)
    asked = rows.withColumn("headlines", F.lit(None).cast(rows.schema["headlines"].dataType))
    assert {(r.type, r.status, r.message) for r in serving.alerts(asked).where("section = 'headlines'").collect()} == {("info", "Not queried", "Backend availability has not been reported yet.")}


def test_life_of_a_model(spark, tmp_path, monkeypatch):
    got = [tuple(r) for r in QUERIES["model_lifecycle"](spark, SF).collect()]
    assert [g[:3] for g in got] == [("first start", "trained_and_persisted", 1), ("same process", "trained_and_persisted", 1), ("restart", "disk", 1), ("forced", "disk", 2)]
    data = signal.training_data(spark, 60)
    root, calls = f"file://{tmp_path}/m", []

    def train():
        calls.append(1)
        return signal.train(spark, data, trees=3)

    first = artifacts.get(spark, root, train)
    before = artifacts.manifest(spark, root)["folder"]
    artifacts.forget(root)
    again = artifacts.get(spark, root, train)
    assert len(calls) == 1 and again.metrics == first.metrics and again.provenance == {"artifact_source": "disk", "artifact_path": before}
    rows = signal.prepare(data)
    p, q = ([round(r.probability_up, 12) for r in signal.probability(rows, a.models["rf"]).orderBy("row").collect()] for a in (first, again))
    assert p == q
    artifacts.bootstrap(spark, root, train, force=True)
    assert len(calls) == 2 and artifacts.manifest(spark, root)["folder"] != before
    other = f"file://{tmp_path}/never"
    monkeypatch.setattr(artifacts, "publish", lambda *a: (_ for _ in ()).throw(OSError("read only")))
    assert artifacts.get(spark, other, train).provenance == {"artifact_source": "trained_in_memory", "artifact_path": other, "reason": "OSError"}
    for r in (root, other):
        artifacts.forget(r)
    with pytest.raises(ValueError):
        artifacts.load(spark, other)


def test_signs_are_counted_once_for_all_trainings(spark, monkeypatch):
    """Both trainings read features that are stored; they equal those of a pattern for each set."""
    real, seen = signal.train, []
    monkeypatch.setattr(signal, "train", lambda spark, data, **more: seen.append(data) or real(spark, data, trees=1))
    QUERIES["model_lifecycle"](spark, SF)
    for data in seen:
        plan = data._jdf.queryExecution().optimizedPlan().toString()
        assert not any(s in plan for s in ("regexp_replace", "MapInArrow", "Join"))
    texts, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    patterns = ("[a-m]", "[n-z]", "[A-Z]", "[0-9]", "[ \\n]", "[.,!?]")
    shares = [F.length(F.regexp_replace("text", p, "")) / F.greatest(F.length("text").cast("double"), F.lit(1.0)) for p in patterns]
    want = labels.join(texts, "doc_id").where("quality is not null").select("doc_id", *shares, F.col("quality").cast("int"))
    key = lambda rows: sorted(map(tuple, rows))
    assert len(seen) == 2 and all(key(data.collect()) == key(want.collect()) for data in seen) and want.count() > 20


def test_counts_of_signs(spark):
    from tidemark.functions.text import sign_counts

    rows = [(1, "Abz, 9\n!"), (2, None), (3, ""), (4, "é😀ſK İı a\u0000m~"), (5, "n" * 70_000 + "á"), (1, "zz")]
    df = spark.createDataFrame(rows, "id int, body string")
    sets = ("abcdefghijklm", "nopqrstuvwxyz", " \n")
    got = sorted((r.id, r.signs, r["counts"]) for r in sign_counts(df, "id", "body", sets).collect() if r.signs is not None)
    want = sorted((k, len(t), [sum(t.count(c) for c in s) for s in sets]) for k, t in rows if t is not None)
    assert got == want and sign_counts(df, "id", "body", sets).where("signs is null and counts is null").count() == 1
    assert sign_counts(df.where("false"), "id", "body", sets).count() == 0


def test_routes_are_table_functions(spark):
    from tidemark.operators import providers

    posts = [("TSLA", 0.5), ("TSLA", -0.1), ("AMD", 0.0), (None, 1.0)]
    spark.createDataFrame(posts, "ticker string, sentiment_score double").createOrReplaceTempView("scored_posts")
    spark.createDataFrame([("TSLA", "2024", 2.0, 5, 0.1, "live")], "ticker string, date string, price double, volume bigint, volume_delta double, status string").createOrReplaceTempView("snapshots")
    providers.register_routes(spark)
    asked = "VALUES ('tsla '), ('amd'), ('none'), (null) AS wanted(name)"
    say = lambda f, c: sorted(map(tuple, spark.sql(f"SELECT name, {c} FROM {asked}, LATERAL {f}(name)").collect()))
    assert say("ticker_sentiment", "posts, sentiment_score, label") == [("amd", 1, 0.0, "neutral"), ("tsla ", 2, 0.2, "positive")]
    assert say("market_snapshot", "price, status") == [("tsla ", 2.0, "live")]
    assert say("dashboard", "ticker, posts, price, status") == [("amd", "AMD", 1, None, None), ("tsla ", "TSLA", 2, 2.0, "live")]
    assert spark.sql("SELECT posts FROM ticker_sentiment('TSLA')").first()[0] == 2
