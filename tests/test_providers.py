"""Streams over several files, provider precedence, fallbacks and retries beyond what the oracles show."""

import datetime
import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import citations, providers
from tidemark.plans import connector_queries, provider_queries, serving_queries, story_queries, text_queries  # noqa: F401
from tidemark.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


STREAMS = ["stream_dedupe", "stream_sentiment", "stream_sliding_windows", "stream_sessions", "stream_merge_window", "stream_daily_totals", "stream_replay", "stream_replay_days", "stream_ttl_cache", "stream_provider_cache"]


@pytest.fixture(scope="module", params=[(5, "by id"), (12, "latest first"), (12, "earliest first")], ids=str)
def split(spark, tmp_path_factory, request):
    """The events in several files: later ids first, or cut by time, each file one that comes after those written before it."""
    files, order = request.param
    root = tmp_path_factory.mktemp("split")
    spark.read.parquet(f"{SF}/customer.parquet").write.parquet(f"{root}/customer.parquet")
    e = spark.read.parquet(f"{SF}/events.parquet")
    part = F.col("event_id") % files if order == "by id" else F.ntile(files).over(Window.orderBy("ts")) - 1
    parts = e.withColumn("part", part).cache()
    for k in range(files) if order == "earliest first" else reversed(range(files)):
        parts.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{root}/events.parquet")
        newest = max((f for f in (root / "events.parquet").glob("*.parquet")), key=lambda f: (f.stat().st_mtime_ns, f.name))
        os.utime(newest, (1_700_000_000 + len(list((root / "events.parquet").glob("*.parquet"))),) * 2)
    parts.unpersist()
    return str(root)


@pytest.fixture(scope="module")
def whole(spark):
    return {}


@pytest.mark.parametrize("name", STREAMS)
def test_streams_over_several_files_equal_one(spark, split, whole, name):
    if name not in whole:
        whole[name] = sorted(map(repr, QUERIES[name](spark, SF).collect()))
    assert sorted(map(repr, QUERIES[name](spark, split).collect())) == whole[name]


def test_ttl_cache_against_a_plain_loop(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts").orderBy("ts").collect()
    want = {}
    for user, ts in rows:
        stored, hits, misses = want.get(user, (None, 0, 0))
        hit = stored is not None and ts - stored <= datetime.timedelta(days=1)
        want[user] = (stored, hits + 1, misses) if hit else (ts, hits, misses + 1)
    got = {r.user_id: (r.hits, r.misses) for r in QUERIES["stream_ttl_cache"](spark, SF).collect()}
    assert got == {u: w[1:] for u, w in want.items()}


ITEM = "struct<title: string, id: string, publisher: string, link: string, provider_publish_time: string, summary: string, content: struct<title: string, id: string, provider: struct<display_name: string, name: string>, canonical_url: struct<url: string>, click_through_url: struct<url: string>, pub_date: string, display_time: string, summary: string>>"


def test_news_is_cut_before_untitled_items_go(spark):
    none = dict.fromkeys(("title", "id", "publisher", "link", "provider_publish_time", "summary", "content"))
    items = [none, none | {"title": "A", "provider_publish_time": "1700000000"}, none | {"title": "B", "content": {"title": "x", "id": "7", "provider": {"display_name": "", "name": "N"}, "canonical_url": None, "click_through_url": {"url": "u"}, "pub_date": "bad", "display_time": None, "summary": "s"}}, none | {"title": "C"}]
    feed = spark.createDataFrame([("T", items), ("U", []), ("V", None)], f"ticker string, items array<{ITEM}>")
    got = {r.title: r for r in providers.news(feed, 3).collect()}
    assert set(got) == {"A", "B"}
    assert (got["A"].id, got["A"].source, got["A"].time) == ("T-1", "Yahoo Finance", "Nov 14, 2023")
    assert (got["B"].id, got["B"].source, got["B"].url, got["B"].summary, got["B"].time) == ("7", "N", "u", "s", None)


def test_retry_works_on_the_failed_alone(spark):
    story = "struct<id: string, title: string, description: string, outlet: string, published_at: string>"
    themes = spark.createDataFrame([(k, "T", [("a", "One thing", "d", "o", "t"), ("b", "Another", "d", "o", "t")]) for k in range(4)], f"theme_id int, ticker string, stories array<{story}>")
    asked = []

    def generate(df, attempt):
        asked.append((attempt, sorted(r.theme_id for r in df.collect())))
        bad = F.col("theme_id") > attempt
        told = citations.summarize(df)
        return told.withColumn("sentences", F.when(bad, F.transform("sentences", lambda s: F.struct(s["text"].alias("text"), F.array(F.lit("z")).alias("citation_ids")))).otherwise(F.col("sentences")))

    got = {r.theme_id: r for r in citations.with_retry(themes, generate).collect()}
    assert asked == [(1, [0, 1, 2, 3]), (2, [2, 3])]
    assert [got[k].status for k in range(4)] == ["accepted", "accepted", "accepted_after_retry", "degraded"]
    assert got[3].label is None and got[3].sentences is None and len(got[3].stories) == 2


def test_each_theme_comes_once_from_a_generator_that_answers_at_random(spark):
    story = "struct<id: string, title: string, description: string, outlet: string, published_at: string>"
    themes = spark.createDataFrame([(k, "T", [("a", "One thing", "d", "o", "t"), ("b", "Another", "d", "o", "t")]) for k in range(400)], f"theme_id int, ticker string, stories array<{story}>")
    luck = F.udf(lambda: random.random() < 0.5, "boolean").asNondeterministic()

    def generate(df, attempt):
        return citations.summarize(df).withColumn("label", F.when(luck(), F.col("label")).otherwise(F.lit("")))

    got = [r.theme_id for r in citations.with_retry(themes, generate).collect()]
    assert sorted(got) == list(range(400))
    assert citations.with_retry(themes.limit(0), generate).count() == 0


def test_quotes_and_bars_in_order(spark):
    tickers = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    quotes = spark.createDataFrame([("A", "1.5", "x", None, "7.9")], "ticker string, c string, d string, dp string, v string")
    bars = spark.createDataFrame([("A", 2.0, 0.0, 0.0, 5, 0.1), ("B", 3.0, 1.0, 2.0, 6, 0.2)], "ticker string, price double, price_delta_24h double, percent_change_24h double, volume bigint, volume_delta double")
    got = {r.ticker: r for r in providers.quotes_or_bars(tickers, quotes, bars).collect()}
    assert (got["A"].price, got["A"].price_delta_24h, got["A"].volume, got["A"].source) == (1.5, 0.0, 0, "quote")
    assert (got["B"].price, got["B"].source) == (3.0, "bars") and (got["C"].price, got["C"].status) == (0.0, "unavailable")


def test_empty_sides(spark):
    posts = spark.createDataFrame([], "ticker string, text string, source string")
    heads = spark.createDataFrame([("T", 0, "Good news", "s"), ("T", 1, " ", "s")], "ticker string, place int, title string, source string")
    assert [r.text for r in providers.own_or_headlines(posts, heads).collect()] == ["Good news"]
    assert providers.own_or_headlines(posts, heads.limit(0)).collect() == []
    values = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "v double")
    assert [r.v for r in providers.finite(values, "v").collect()] == [1.0]
    assert {(r.source, r["rows"], r.available) for r in providers.health({"p": posts, "h": heads}).collect()} == {("p", 0, False), ("h", 2, True)}
