import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, resampling

SCHEMA = "`doc.id` bigint, `te.xt` string, rank string, words string, bucket string, gain string, place string, part string, rid string"


def features(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def plain(docs, target, percent=25, least=20):
    own, aim = Counter(), Counter()
    cut = [(i, *features(t)) for i, t in docs]
    for _, _, f in cut:
        own.update(f)
    for t in target:
        aim.update(features(t)[1])
    all_s, all_t = sum(own.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (all_s + 10_000) / ((own[b] + 1) * (all_t + 10_000)))) for b in range(10_000)}
    out = []
    for i, n, f in cut:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


def rows_of(rng, n):
    vocabulary = ["Apple", "pear", "ÉTÉ", "été", "x9", "", "漢字", "İ", "a b", "tab\there", "q'r", "-", "\x7f", "\x80z"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    ids = [rng.choice([i, i, i, 5, None]) for i in range(n)]
    return list(zip(ids, texts)) + [(900, None), (901, ""), (902, "word " * 20_000), (903, "copy of this " * 9), (903, "copy of this " * 9), (904, "z" * 300_000)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_version(spark, seed):
    rng = random.Random(seed)
    data, target = rows_of(rng, 120), ["pear apple", "été x9 pear", None, "", "漢字 q r"][: [5, 3, 0][seed]]
    docs = spark.createDataFrame([(i, t, *"abcdefg") for i, t in data], SCHEMA).repartition(5)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    found = resampling.resample(docs, aim, id_col="doc.id", text_col="te.xt").collect()
    assert sorted((tuple(r) for r in found), key=str) == plain(data, target)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert resampling.resample(docs, spark.createDataFrame([], "text string")).count() == 0


def test_ranks_do_not_depend_on_partitions(spark):
    data = [(i, f"w{i % 7} and w{i % 3} " * 12) for i in range(300)]
    aim = spark.createDataFrame([("w1 and w2",)], "text string")
    rows = [sorted(map(tuple, resampling.resample(spark.createDataFrame(data, "doc_id int, text string").repartition(n), aim).collect())) for n in (1, 7, 40)]
    assert rows[0] == rows[1] == rows[2]
    assert sorted(r[5] for r in rows[0] if r[5]) == list(range(1, 76))


def test_native_plan_and_oracle(spark):
    sf = "/root/testdata/sf0.001"
    found = queries.QUERIES["op13_importance_resampling"](spark, sf)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    want = db.sql(queries.ORACLE_SQL["op13_importance_resampling"]).fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert {k: t for k, t in found.dtypes} == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    assert found.where(F.col("rank").isNotNull()).count() > 10
