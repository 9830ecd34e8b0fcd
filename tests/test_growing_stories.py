"""Stories and themes that grow over micro-batches, density clusters and one-to-one identities, against plain versions."""

import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import stories
from tidemark.streaming.stories import StoryStore, ThemeStore

STORY = "story_id bigint, ticker string, published_at timestamp, embedding array<float>"


def vectors(rng, n, groups=6, noise=0.5, dim=8):
    centers = rng.normal(size=(groups, dim))
    x = centers[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def made(seed, n=60):
    rng = np.random.default_rng(seed)
    x = vectors(rng, n)
    begin = datetime.datetime(2024, 1, 1)
    rows = [(k, ["T", "U", None][k % 7 % 3], begin + datetime.timedelta(hours=float(rng.uniform(0, 150))), x[k].tolist()) for k in range(n)]
    rows[3] = (3, "T", begin, None)
    return rows


def plain_roots(rows, threshold, hours=36):
    root = {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for p, q in itertools.combinations(rows, 2):
        if p[1] is None or p[1] != q[1] or p[3] is None or q[3] is None or abs((p[2] - q[2]).total_seconds()) // 1 > hours * 3600:
            continue
        if sum(a * b for a, b in zip(p[3], q[3])) >= threshold:
            a, b = sorted((find(p[0]), find(q[0])))
            root[b] = a
    return {i: find(i) for i in root}


@pytest.mark.parametrize("seed", [1, 2])
def test_roots_after_every_split(spark, tmp_path, seed):
    rows = made(seed)
    want = plain_roots(rows, 0.7)
    assert 3 < len(set(want.values())) < 58
    rng = random.Random(seed)
    for turn, parts in enumerate((1, 3, 6)):
        dealt = rows[:]
        rng.shuffle(dealt)
        store = StoryStore(spark, f"file://{tmp_path}/{turn}", 0.7)
        at = [len(dealt) * k // parts for k in range(parts + 1)]
        for number, (a, b) in enumerate(zip(at, at[1:])):
            batch = spark.createDataFrame(dealt[a:b] + dealt[max(0, a - 4) : a] + dealt[a : a + 2], STORY)
            store.add(batch, number)
            if number == 1:
                store.add(batch, number)  # the same batch again, as after a failure
        assert dict(map(tuple, store.roots().collect())) == want
    assert dict(map(tuple, store.roots().collect())) == want


def test_an_empty_batch_and_one_that_joins_two(spark, tmp_path):
    store = StoryStore(spark, f"file://{tmp_path}/s", 0.9, hours=10)
    at = datetime.datetime(2024, 1, 1, 5)
    a, b = (lambda h: at + datetime.timedelta(hours=h)), [1.0, 0.0]
    store.add(spark.createDataFrame([], STORY), 0)
    store.add(spark.createDataFrame([(5, "T", a(0), b), (9, "T", a(18), b)], STORY), 1)
    assert dict(map(tuple, store.roots().collect())) == {5: 5, 9: 9}
    store.add(spark.createDataFrame([(2, "T", a(9), b), (3, "U", a(9), b)], STORY), 2)
    assert dict(map(tuple, store.roots().collect())) == {5: 2, 9: 2, 2: 2, 3: 3}
    forest = {r.old: r.new for r in store.forest().collect()}
    assert forest == {5: 2, 9: 2}
    store.add(spark.createDataFrame([(1, "T", a(27), b)], STORY), 3)
    assert set(dict(map(tuple, store.roots().collect())).values()) == {1, 3}


def plain_clusters(ids, x, floor, core=2, least=4, most=6, gap=0.02):
    theme = {i: -1 for i in ids}
    if len(ids) < least:
        return theme
    near = {}
    for (p, i), (q, j) in itertools.combinations(list(enumerate(ids)), 2):
        s = sum(float(a) * float(b) for a, b in zip(x[p], x[q]))
        if s >= floor:
            near[i, j] = round(1 - s, 12)
    around = {i: sorted(d for e, d in near.items() if i in e) for i in ids}
    edges = sorted((max(d, around[i][core - 1], around[j][core - 1]), i, j) for (i, j), d in near.items() if len(around[i]) >= core and len(around[j]) >= core)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    forest = []
    for w, i, j in edges:
        a, b = sorted((find(i), find(j)))
        if a != b:
            root[b] = a
            forest.append((w, i, j))
    steps = [(q[0] - p[0], -q[0]) for p, q in zip(forest, forest[1:]) if q[0] - p[0] > gap]
    cut = -max(steps)[1] if steps else float("inf")
    root = {i: i for i in ids}
    for w, i, j in forest:
        if w < cut:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    groups = {}
    for i in ids:
        groups.setdefault(find(i), []).append(i)
    kept = sorted((g for g in groups.values() if len(g) > 1), key=lambda g: (-len(g), g[0]))[:most]
    for k, g in enumerate(kept):
        theme |= dict.fromkeys(g, k)
    return theme


@pytest.mark.parametrize("size", [7])
def test_density_clusters_on_every_day(spark, monkeypatch, size):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for d, n in enumerate([1, 3, 4, 12, 22]):
        x = vectors(rng, n, groups=1 + n // 6, noise=0.35)
        if n == 12:
            x[5] = x[4]  # equal stories
        ids = sorted(rng.choice(1000, n, replace=False).tolist())
        rows += [("T", f"d{d}", i, v.tolist()) for i, v in zip(ids, x)]
        want |= {(f"d{d}", i): t for i, t in plain_clusters(ids, x, 0.3).items()}
    plain = stories.near_in_group
    monkeypatch.setattr(stories, "near_in_group", lambda df, floor: plain(df, floor, size))
    rows += [("T", "d4", 2000, None), rows[20]]
    df = spark.createDataFrame(rows, "ticker string, day string, story_id bigint, embedding array<float>")
    got = {(r.day, r.story_id): r.theme for r in stories.density_clusters(df, 0.3).collect()}
    assert got == want | {("d4", 2000): -1}
    assert max(want.values()) >= 1
    assert stories.density_clusters(df.where("false"), 0.3).count() == 0


def test_spanning_forest(spark):
    rng = random.Random(2)
    edges = {(a, b): rng.randrange(30) for a, b in itertools.combinations(range(40), 2) if rng.random() < 0.1}
    root = list(range(40))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    want = []
    for w, a, b in sorted((w, a, b) for (a, b), w in edges.items()):
        if find(a) != find(b):
            root[find(b)] = find(a)
            want.append((a, b, w))
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a int, b int, weight int")
    assert sorted(map(tuple, stories.spanning_forest(df).collect())) == sorted(want)
    assert stories.spanning_forest(df.where("false")).count() == 0


def best_total(gain, themes):
    def go(k, used):
        if k == len(themes):
            return 0
        t = themes[k]
        return max([go(k + 1, used)] + [g + go(k + 1, used | {p}) for (q, p), g in gain.items() if q == t and p not in used])

    return go(0, frozenset())


def test_assignment_has_the_largest_total(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for run in range(30):
        n, m = rng.randint(1, 6), rng.randint(1, 6)
        pairs = {(t, 100 + p): rng.choice([round(rng.uniform(0.2, 1), 3), 0.5]) for t in range(n) for p in range(m) if rng.random() < 0.6}
        rows += [("T", run, t, p, s) for (t, p), s in pairs.items()]
        want[run] = best_total({e: round(s * 1e9) for e, s in pairs.items()}, sorted({t for t, _ in pairs}))
    df = spark.createDataFrame(rows, "ticker string, run int, theme_id int, previous_id int, similarity double")
    got = stories.one_to_one(df).collect()
    for run in want:
        own = [r for r in got if r.run == run]
        assert len({r.theme_id for r in own}) == len(own) == len({r.previous_id for r in own})
        assert sum(round(r.similarity * 1e9) for r in own) == want[run]
    assert stories.one_to_one(df.where("false")).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_identities_over_batches(spark, tmp_path, parts):
    rng = np.random.default_rng(3)
    x = vectors(rng, 42, groups=4, noise=0.3)
    rows = [("TU"[k % 2], k // 6, k, x[k].tolist()) for k in range(42)]
    df = spark.createDataFrame(rows, "ticker string, run bigint, theme_id bigint, centroid array<float>")
    want = {r.theme_id: r.identity for r in stories.identities(df, 0.5).collect()}
    assert len(want) == 42 and 4 < len(set(want.values())) < 40
    store = ThemeStore(spark, f"file://{tmp_path}/t", 0.5)
    for number in range(parts):
        batch = df.where(F.expr(f"run * {parts} div 7 = {number}"))
        store.add(batch.union(batch.limit(2)), number)
        store.add(batch, number)
    assert {r.theme_id: r.identity for r in store.identities().collect()} == want


def test_files_do_not_grow_with_the_time_stored(spark, tmp_path):
    """A batch that covers many time buckets writes no file for each of them, and one of a single time reads few of them."""
    begin = datetime.datetime(2024, 1, 1)
    rows = [(k, "T", begin + datetime.timedelta(hours=36 * k), [1.0, 0.0]) for k in range(200)]
    store = StoryStore(spark, f"file://{tmp_path}/s", 0.9, hours=36)
    store.add(spark.createDataFrame(rows, STORY).repartition(8), 0)
    store.add(spark.createDataFrame([(500, "T", begin + datetime.timedelta(hours=1), [1.0, 0.0])], STORY), 1)
    assert len(list(tmp_path.glob("s/items/batch=0/**/*.parquet"))) <= 16
    roots = dict(map(tuple, store.roots().collect()))
    assert len(roots) == 201 and set(roots.values()) == {0} and roots[500] == 0


def test_groups_of_pairs_are_gone_through_in_batches(spark):
    """Groups that go over from one Arrow batch to the next stay whole; there is no Python call for each group."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = [("T", run, t, 100 + p, s) for run in range(5) for (t, p), s in {(0, 0): 0.9, (0, 1): 0.8, (1, 0): 0.8, (2, 1): 0.3, (5, 7): 0.5}.items()]
        found = stories.one_to_one(spark.createDataFrame(rows, "ticker string, run int, theme_id int, previous_id int, similarity double"))
        assert "GroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((r.run, r.theme_id, r.previous_id) for r in found.collect()) == [(run, *e) for run in range(5) for e in ((0, 101), (1, 100), (5, 107))]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
