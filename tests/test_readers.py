import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import display
from tidemark.functions import fixed
from tidemark.functions.fixed import RULES
from tidemark.operators import posts, views
from tidemark.plans import display_queries  # noqa: F401
from tidemark.sources import readers


def test_records(spark, tmp_path):
    grouped = {"ticker": "tsla", "date": "2024-01-02", "posts": [{"text": "a", "source": "s", "post_score": 1}, {"text": None}], "market_data": {"price": 2.5}}
    flat = {"ticker": "AMD", "date": "2024-01-03", "text": "b", "source": "t", "post_score": 4}
    (tmp_path / "r.json").write_text(json.dumps([grouped, flat]))
    df = readers.records(spark, f"file://{tmp_path}/r.json")
    got = sorted((r.ticker, r.post_index, r.text, r.source) for r in posts.flatten(df).collect())
    assert got == [("AMD", 0, "b", "t"), ("TSLA", 0, "a", "s"), ("TSLA", 1, "", "unknown")]
    readers.write_records(df, f"file://{tmp_path}/out")
    assert readers.records(spark, f"file://{tmp_path}/out", array=False).count() == 2
    assert readers.records(spark, f"file://{tmp_path}/none.json").collect() == []
    assert readers.themes(spark, f"file://{tmp_path}/none.json").collect() == []


def test_feed_items(spark, tmp_path):
    item = "<item><title> A </title><link>http://X.com/a?utm_source=q</link><description>d</description><pubDate>Tue, 02 Jan 2024 10:00:00 +0000</pubDate></item><item><title></title><link>http://x.com</link></item>"
    (tmp_path / "f.xml").write_text(f"<rss><channel>{item}</channel></rss>")
    r = readers.feed_items(spark, f"file://{tmp_path}/f.xml", "feed").collect()
    assert [(x.title, x.canonical_url, str(x.published_at)[:10]) for x in r] == [("A", "http://x.com/a", "2024-01-02")]


def test_rules():
    text = "# note\n\n" + "\n".join("\t".join(r) for r in RULES)
    assert readers.rules(text) == RULES
    for bad in ("a\tb", "a\tother\tc", "# nothing"):
        with pytest.raises(ValueError):
            readers.rules(bad)


def test_display(spark):
    rows = spark.createDataFrame([(None,), (1.5,), (1500.0,), (-2.5e9,)], "v double").select(display.money(F.col("v")).alias("m"))
    assert [r.m for r in rows.collect()] == ["N/A", "$1.50", "$1.5K", "$-2.5B"]
    day = spark.sql("SELECT timestamp'2024-01-02 03:00:00' AS t").select(display.trading_day(F.col("t")).cast("string")).first()[0]
    assert day == "2024-01-01"


CONFIG = """
feeds:
  - {id: one, url: "https://a.example/rss", enabled: true, intended_role: news, expected_fields: {title: t, url: l, description: d, published_at: p}}
  - {id: one, url: "http://b.example/rss", intended_role: " ", expected_fields: {title: t}}
tickers:
  - {ticker: TSLA, cashtag: $TSLA, official_company_name: "Tesla, Inc.", strong_aliases: [Tesla], context_required_aliases: [], context_terms: [], exclusion_terms: [tesla coil]}
  - {ticker: AMD, cashtag: "", official_company_name: A, strong_aliases: [], context_required_aliases: [AMD], context_terms: [], exclusion_terms: none}
  - {ticker: XX, cashtag: $XX, official_company_name: X, strong_aliases: [x], exclusion_terms: []}
"""


def test_configuration(spark):
    pytest.importorskip("yaml")
    got = sorted(map(tuple, views.feed_problems(readers.feeds(spark, CONFIG)).collect()))
    assert got == [("one", "missing_fields"), ("one", "no_role"), ("one", "not_https"), ("one", "repeated")]
    made = readers.aliases(CONFIG)
    assert views.alias_problems(made, ("TSLA", "AMD", "META")) == [
        ("META", "missing"), ("XX", "unknown"), ("AMD", "empty cashtag"), ("AMD", "empty strong"), ("AMD", "no exclusions"), ("AMD", "context"),
    ]
    assert views.alias_problems(fixed.ALIASES) == [] and views.alias_problems(fixed.STRICT_ALIASES) == []
    for bad in ("- a", "feeds: []", "x: 1"):
        with pytest.raises(ValueError):
            readers.feeds(spark, bad)
    with pytest.raises(ValueError):
        readers.aliases("tickers: 3")


def test_false_positives(spark):
    cases = [("Nikola Tesla exhibit", ""), ("A tesla coil", ""), ("Tesla shares", "AMD,TSLA"), (None, None), ("Apple pie", "AAPL")]
    df = spark.createDataFrame(cases, "text string, expected string")
    assert {r.text for r in views.false_positives(df.where("text = 'Apple pie' or text is null")).collect()} == {"Apple pie"}
    strict = {r.text: r.matched for r in views.false_positives(df, fixed.STRICT_ALIASES).collect()}
    assert strict["Tesla shares"] == "TSLA"
