import random
from datetime import date, timedelta

import duckdb

from tidemark.plans import market_queries  # noqa: F401
from tidemark.plans.registry import ORACLE_SQL, QUERIES


def test_delta_series_rounds_ties_as_its_sql(spark, tmp_path):
    """Quantities are powers of two, so the seventh place of many changes is a last 5, up and down."""
    r = random.Random(4)
    rows = [(s, date(2024, 1, 1) + timedelta(days=d), r.randrange(100_000, 9_000_000) / 100, float(2 ** r.randrange(3, 8))) for s in range(5) for d in range(200)]
    spark.createDataFrame(rows, "l_suppkey bigint, l_shipdate date, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = QUERIES["market_delta_series"](spark, str(tmp_path))
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        want = c.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL['market_delta_series']})").fetchall()
    assert len(want) == 1000 and sorted(map(tuple, df.collect())) == sorted(want)
