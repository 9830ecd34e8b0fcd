import random

from pyspark.sql import functions as F

from tidemark.operators import stories
from tidemark.plans import story_queries  # noqa: F401
from tidemark.plans.registry import QUERIES


def test_copies_share_a_component(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(60))
    near = long + " more"
    texts = [long, near, long.upper(), near + "!", "one two", "One, two", "one three", "", "!", None, long]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: r.root for r in QUERIES["story_components"](spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 9, 10: 0}
    pairs = {(r.a, r.b): r.distance for r in QUERIES["dedup_minhash"](spark, str(tmp_path)).collect()}
    assert set(pairs) == {(0, 1), (0, 2), (0, 10), (1, 3), (4, 5)}
    assert all((d == 0.0) == (p != (0, 1)) for p, d in pairs.items())


def test_band_keys_are_made_in_batches(spark):
    """Minima come from whole sets in Arrow, with no row for each shingle; equal sets have equal keys in each band, and near ones share some."""
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(400)]
    rows = [(1, base), (2, base[::-1]), (3, base[:380] + [rng.getrandbits(63) for _ in range(20)]), (4, [rng.getrandbits(63) for _ in range(400)]), (5, base[:1]), (6, [])]
    sets = spark.createDataFrame(rows, "id bigint, grams array<bigint>").coalesce(1)
    kind = "id bigint, key bigint"
    keys = {}
    for r in sets.where(F.size("grams") > 0).mapInArrow(stories._band_keys, kind).collect():
        keys.setdefault(r.id, []).append(r.key)
    assert keys[1] == keys[2] and len(set(keys[1])) == stories.BANDS and 6 not in keys
    assert set(keys[1]) & set(keys[3]) and not set(keys[1]) & (set(keys[4]) | set(keys[5]))
    assert {tuple(r) for r in stories.band_pairs(sets).collect()} == {(1, 2), (1, 3), (2, 3)}
