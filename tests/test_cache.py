"""The provider cache: its truth tables, lateness, ties, forgetting, and an empty input."""

import datetime
import itertools

import pytest

from tidemark.plans import connector_queries
from tidemark.plans.registry import QUERIES
from tidemark.streaming import cache
from tidemark.streaming.cache import DATASET, PROVIDER, STALE, Entry, answer

T = 1_000_000


def test_truth_table_of_headlines():
    new, old, empty = Entry(90, 3, DATASET), Entry(10, 3, PROVIDER), Entry(10, 0, PROVIDER)
    say = lambda entry, failed, items, own: answer("headlines", entry, 100, failed, items, own, 50)
    assert say(new, True, 0, 0) == ("cached", DATASET, 3, new) and say(Entry(50, 0, PROVIDER), False, 9, 9)[:3] == ("unavailable", PROVIDER, 0)
    assert say(old, True, 0, 5) == ("fallback", STALE, 3, old) and say(empty, True, 0, 5) == ("fallback", STALE, 0, empty)
    assert say(None, True, 0, 5) == ("cached", DATASET, 5, Entry(100, 5, DATASET))
    assert say(None, True, 0, 0) == ("unavailable", PROVIDER, 0, Entry(100, 0, PROVIDER))
    assert say(old, False, 0, 5) == ("cached", DATASET, 5, Entry(100, 5, DATASET)) and say(old, False, 0, 0) == ("unavailable", PROVIDER, 0, Entry(100, 0, PROVIDER))
    assert say(old, False, 4, 5) == ("live", PROVIDER, 4, Entry(100, 4, PROVIDER))


@pytest.mark.parametrize("provider", ["fundamentals", "market_history:1mo"])
def test_other_providers_cache_no_error(provider):
    assert answer(provider, None, 100, True, 0, 5, 50) == ("unavailable", PROVIDER, 0, None)
    assert answer(provider, None, 100, False, 0, 5, 50) == ("unavailable", PROVIDER, 0, Entry(100, 0, PROVIDER))
    assert answer(provider, Entry(60, 0, PROVIDER), 100, False, 1, 5, 50)[:3] == ("unavailable", cache.CACHE, 0)
    assert answer(provider, Entry(49, 2, PROVIDER), 100, True, 1, 5, 50)[:3] == ("fallback", STALE, 2)
    assert answer(provider, Entry(50, 2, PROVIDER), 100, True, 1, 5, 50)[:3] == ("cached", cache.CACHE, 2)


def requests(spark, tmp_path, files):
    for k, rows in enumerate(files):
        data = [(key, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=at), i, "headlines", failed, items, own) for key, at, i, failed, items, own in rows]
        spark.createDataFrame(data, cache.REQUEST).coalesce(1).write.parquet(f"{tmp_path}/in/f{k}")
    schema = spark.createDataFrame([], cache.REQUEST).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_answers_in_time_order(spark, tmp_path):
    """Equal times are answered by id; an entry serves up to its age limit and not beyond."""
    late = [("a", 10, 5, False, 2, 0), ("a", 910, 6, True, 0, 0), ("a", 911, 7, True, 0, 0)]
    early = [("a", 10, 4, True, 0, 3), ("b", 0, 1, False, 0, 0), ("b", 5, 2, False, 7, 0), (None, 5, 9, False, 1, 0)]
    got = {r.id: (r.status, r.source, r["items"]) for r in cache.answers(spark, requests(spark, tmp_path, [late, early]), "1 day").collect()}
    assert got == {
        4: ("cached", DATASET, 3), 5: ("cached", DATASET, 3), 6: ("cached", DATASET, 3), 7: ("fallback", STALE, 3),
        1: ("unavailable", PROVIDER, 0), 2: ("unavailable", PROVIDER, 0), 9: ("live", PROVIDER, 1),
    }


def test_stale_entries_are_forgotten(spark, tmp_path):
    rows = [("a", 0, 1, False, 2, 0), ("a", 2000, 2, True, 0, 0), ("a", 9000, 3, True, 0, 4)]
    for keep, want in ((None, "fallback"), (5000, "cached")):
        got = {r.id: r.status for r in cache.answers(spark, requests(spark, tmp_path / str(keep), [rows]), "1 second", keep=keep).collect()}
        assert got == {1: "live", 2: "fallback", 3: want}


def test_many_keys_share_a_state(spark, tmp_path):
    """State belongs to shards, not to keys, and is written packed; answers over several files are those of a plain loop."""
    rows = [(f"k{i % 700}", (i * 7919) % 5000, i, i % 3 == 0, i % 4, i % 2) for i in range(3000)]
    got = {r.id: (r.key, r.status, r.source, r["items"]) for r in cache.answers(spark, requests(spark, tmp_path, [rows[k::4] for k in range(4)]), "1 day", ttl=900).collect()}
    want, entries, zero = {}, {}, datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc).timestamp() * T
    for key, at, i, failed, items, own in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        status, source, count, entries[key] = answer("headlines", entries.get(key), int(zero) + at * T, failed, items, own, 900 * T)
        want[i] = (key, status, source, count)
    assert got == want

    class Handle:
        def getListState(self, name, schema):
            return (name, schema)

        getValueState = getListState

    one = cache.ProviderCache(900)
    one.init(Handle())
    assert one.waiting == ("waiting", "rows binary") and one.entries == ("entries", "rows binary")


def test_empty_input(spark, tmp_path):
    assert cache.answers(spark, requests(spark, tmp_path, [[]]), "1 day").count() == 0


def test_all_rows_of_the_table_occur(spark):
    """Every row of each provider's truth table is in the query's answers at sf0.01."""
    rows = QUERIES["stream_provider_cache"](spark, "/root/testdata/sf0.01").groupBy("provider", "status", "source", "available").count().collect()
    seen = {(r.provider, r.status, r.source, r.available) for r in rows}
    head = {("cached", PROVIDER), ("cached", DATASET), ("unavailable", PROVIDER), ("fallback", STALE), ("live", PROVIDER)}
    other = {("cached", cache.CACHE), ("unavailable", cache.CACHE), ("unavailable", PROVIDER), ("fallback", STALE), ("live", PROVIDER)}
    for provider, want in (("headlines", head), ("fundamentals", other), ("market_history:1mo", other)):
        assert want <= {s[1:3] for s in seen if s[0] == provider}
    assert any(s[0] == "headlines" and s[1] == "fallback" and not s[3] for s in seen)
    assert len(set(itertools.chain(s[0] for s in seen))) == 3 and connector_queries._DAY == 86_400
