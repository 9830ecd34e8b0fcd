"""Ordered work in blocks equals the same work in one window, whatever the block size; nulls, ties, repeats, empty tables."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import blocks, market, serving, signal
from tidemark.sources import adapters

SF = "/root/testdata/sf0.001"


def table(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, *range(40)]), k, rng.choice([None, rng.random()])) for k in range(n)]
    return spark.createDataFrame(rows, "key string, day int, id int, v double").repartition(5)


def test_numbers_are_places(spark):
    df = table(spark)
    w = Window.partitionBy("key").orderBy("day", F.col("id").desc())
    want = df.withColumn("number", (F.row_number().over(w) - 1).cast("bigint"))
    got = blocks.numbered(df, ["key"], ["day", F.col("id").desc()])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert sorted(r.number for r in blocks.numbered(df, [], ["day"]).collect()) == list(range(400))
    assert blocks.numbered(df.where("false"), ["key"], ["id"]).count() == 0


@pytest.mark.parametrize(("size", "halo"), [(3, 2), (7, 3), (1000, 3)])
def test_frames_and_last_values(spark, size, halo):
    df = table(spark)
    w = Window.partitionBy("key").orderBy("day", "id")
    want = df.withColumns({"s": F.count("v").over(w.rowsBetween(-halo, 0)), "p": F.lag("id", halo).over(w)})
    b = blocks.in_block("key")
    got = blocks.own(blocks.blocked(df, ["key"], ["day", "id"], halo, size).withColumns({"s": F.count("v").over(b.rowsBetween(-halo, 0)), "p": F.lag("id", halo).over(b)}))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    last = df.withColumn("v", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = blocks.last_before(blocks.blocked(df, ["key"], ["day", "id"], size=size), ["key"], "v").select(*last.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, last.collect()))


def test_a_halo_is_shorter_than_a_block(spark):
    with pytest.raises(ValueError):
        blocks.blocked(table(spark), ["key"], ["id"], 3, 3)


def rounded(df, places=6):
    return sorted(str([round(x, places) + 0.0 if isinstance(x, float) else x for x in r]) for r in df.collect())


def test_series_do_not_depend_on_blocks(spark):
    bars = adapters.bars(spark, SF).cache()
    assert rounded(market.trend(bars, size=9)) == rounded(market.trend(bars)) and rounded(market.trend(bars, size=2)) == rounded(market.trend(bars))
    assert rounded(market.indicators(bars, size=23)) == rounded(market.indicators(bars))
    assert rounded(market.delta_series(bars, size=6).select(*market.deltas(bars).columns)) == rounded(market.deltas(bars))
    posts = adapters.posts(spark, SF)
    assert rounded(market.as_of(posts, bars, size=4)) == rounded(market.as_of(posts, bars))


def test_trend_against_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [("t", f"{2000 + k // 300}-{k % 300:03d}", rng.choice([None, rng.uniform(1, 9), 5.0])) for k in range(700)] + [("one", "2000", 3.0), (None, "2000", 1.0)]
    bars = spark.createDataFrame(rows, "ticker string, date string, close double")
    state, last, want = None, None, [("one", "2000", 3.0, 3.0, 0.0, 0.0, 50.0)]
    for _, day, x in rows[:700]:
        if x is None:
            continue
        state = state or [x, x, 0.0, 0.0, 0.0]
        last = x if last is None else last
        state[0] += 2 / 13 * (x - state[0])
        state[1] += 2 / 27 * (x - state[1])
        state[2] += 2 / 10 * (state[0] - state[1] - state[2])
        state[3] += (max(x - last, 0.0) - state[3]) / 14
        state[4] += (max(last - x, 0.0) - state[4]) / 14
        last = x
        moves = state[3] + state[4]
        want.append(("t", day, state[0], state[1], state[0] - state[1], state[2], 100 * state[3] / moves if moves > 0 else 50.0))
    for size in (2, 50, 4096):
        got = sorted(map(tuple, market.trend(bars, size=size).collect()))
        assert [g[:2] for g in got] == [w[:2] for w in sorted(want)] and all(abs(a - b) < 1e-9 for g, w in zip(got, sorted(want)) for a, b in zip(g[2:], w[2:]))
    assert market.trend(bars.where("false")).count() == 0


def test_gaps_and_split(spark):
    runs = spark.sql("SELECT IF(id % 5 = 0, 'b', 'a') AS ticker, timestamp_seconds(id * id * 60) AS started_at, id AS run_id FROM range(200)")
    assert rounded(serving.run_gaps(runs, size=3)) == rounded(serving.run_gaps(runs))
    first, rest = signal.split(runs.withColumn("k", -F.col("run_id")), "k")
    assert sorted(r.run_id for r in first.collect()) == list(range(40, 200)) and sorted(r.run_id for r in rest.collect()) == list(range(40))
