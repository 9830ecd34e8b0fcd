"""Structured Streaming: file sources, windows, idempotent inserts, replay.

Each function runs a stream over what is there (``availableNow``) into the
shared folder and returns the resulting table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATENESS = "36 hours"


def folder(spark: SparkSession, label: str) -> str:
    """A new folder in ``spark.checkpoint.dir``; without one a local session uses ``/tmp/checkpoints``."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream, with a zoned event time."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parquet*")
    return source.withColumn("at", F.col("ts").cast("timestamp"))


def run(writer, spark: SparkSession, label: str, state: str | None = None) -> None:
    """Run to the end of the input, from the checkpoint ``state`` if it is given; a failure is raised here."""
    q = writer.option("checkpointLocation", state or folder(spark, f"{label}-state")).trigger(availableNow=True).start()
    q.awaitTermination()


def daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling days; in complete mode, so that windows inside the watermark are there too. The last batch is the result."""
    out = folder(spark, "daily")
    windows = events(spark, sf_dir).withWatermark("at", LATENESS).groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    run(windows.writeStream.outputMode("complete").foreachBatch(keep), spark, "daily")
    done = spark.read.parquet(out)
    return done.select(F.to_date("window.start").cast("string").alias("day"), "event_type", "events", F.round("total", 4).alias("total"))


def first_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert-once on (user, type): the state keeps the least id of each key, whatever files come in whatever order.

    Each batch logs the keys that it changes, under its number, so a batch
    that comes twice overwrites itself; the least id of the log is the result.
    """
    out = folder(spark, "dedupe")
    least = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))

    def log(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run(least.writeStream.outputMode("update").foreachBatch(log), spark, "dedupe")
    return spark.read.parquet(out).groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


def span(spark: SparkSession, sf_dir: str) -> str:
    """The time from the first event of the table to its last, as a lateness: files that are there already may then come in any order."""
    first, last = spark.read.parquet(f"{sf_dir}/events.parquet*").agg(F.min("ts").cast("timestamp").cast("long"), F.max("ts").cast("timestamp").cast("long")).first()
    return f"{(last or 0) - (first or 0) + 1} seconds"


def merge_window(spark: SparkSession, sf_dir: str, hours: int = 36, lateness: str | None = None) -> DataFrame:
    """Clicks and purchases of one user within ``hours`` of each other: a join of two streams whose state goes with the watermark.

    Rows may come ``lateness`` behind the newest, later ones are dropped, and a
    row is kept that long beside ``hours``. By default it is the span of the
    table, so no order of its files loses a pair.
    """
    out, late = folder(spark, "merge"), lateness or span(spark, sf_dir)
    side = lambda kind, name: events(spark, sf_dir).where(F.col("event_type") == kind).withWatermark("at", late).select(F.col("event_id").alias(name), F.col("user_id").alias(f"{name}_user"), F.col("at").alias(f"{name}_at"))
    a, b = side("click", "a"), side("purchase", "b")
    near = (F.col("a_user") == F.col("b_user")) & F.col("b_at").between(F.col("a_at") - F.expr(f"INTERVAL {hours} HOURS"), F.col("a_at") + F.expr(f"INTERVAL {hours} HOURS"))
    pairs = a.join(b, near).select("a", "b")
    run(pairs.writeStream.outputMode("append").format("parquet").option("path", out), spark, "merge")
    return spark.read.schema(pairs.schema).parquet(out)


def _last_of(df: DataFrame, spark: SparkSession, label: str) -> DataFrame:
    """The last batch of a query in complete mode."""
    out = folder(spark, label)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    run(df.writeStream.outputMode("complete").foreachBatch(keep), spark, label)
    return spark.read.schema(df.schema).parquet(out)


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type in windows of a day that begin each twelve hours."""
    counts = events(spark, sf_dir).groupBy(F.window("at", "1 day", "12 hours"), "event_type").agg(F.count("*").alias("events"))
    return _last_of(counts, spark, "sliding").select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "events")


def sessions(spark: SparkSession, sf_dir: str, gap: str = "6 hours") -> DataFrame:
    """Sessions of each user that a pause of ``gap`` ends."""
    counts = events(spark, sf_dir).groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("events"))
    return _last_of(counts, spark, "sessions").select("user_id", F.col("session_window.start").alias("start"), "events")


def daily_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid posts of a stream, scored and averaged by date and ticker."""
    from ..operators import posts, sentiment
    from ..sources import adapters

    rows = adapters.posts_of(events(spark, sf_dir))
    scored = sentiment.with_sentiment(rows.where(posts.is_valid(F.col("text"), F.col("source"))))
    means = scored.groupBy("date", "ticker").agg(sentiment.mean("sentiment_score").alias("avg_sentiment_score"), F.count("*").alias("posts"))
    return _last_of(means, spark, "sentiment")


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions by batch and type, written twice from the start with dynamic overwrite: the second run makes the same batches and replaces them, it does not add."""
    out = folder(spark, "replay")

    def store(batch: DataFrame, number: int) -> None:
        rows = batch.select("event_id", "value", F.lit(number).alias("batch"), "event_type")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "event_type").parquet(out)

    for turn in range(2):
        run(events(spark, sf_dir).writeStream.foreachBatch(store), spark, f"replay{turn}")
    return spark.read.parquet(out).select("event_id", F.col("event_type").cast("string").alias("event_type"), "value")


def replayed_days(spark: SparkSession, sf_dir: str, versions: tuple[int, ...] = (1, 2), again: int = 1) -> DataFrame:
    """Posts by ticker and day under a pipeline version, which a batch re-derives from the raw table: ``version, ticker, date, posts, total``.

    A batch says which tickers and days it touches. Those partitions of its
    version are made anew from all raw events and replace the stored ones, so
    files in any order, a batch that comes ``again`` and a whole replay give
    the same table, and another version leaves the first one as it is.
    """
    from ..sources import adapters

    out = folder(spark, "days")
    raw = adapters.posts_of(spark.read.parquet(f"{sf_dir}/events.parquet*"))

    def derive(version: int):
        def store(batch: DataFrame, _: int) -> None:
            touched = adapters.posts_of(batch).select("ticker", "date").distinct()
            days = raw.join(touched, ["ticker", "date"], "left_semi").groupBy("ticker", "date").agg(F.count("*").alias("posts"), F.sum(F.col("post_score").cast("decimal(18,4)")).alias("total"))
            for _ in range(1 + again):
                days.select("posts", "total", F.lit(version).alias("version"), "ticker", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "ticker", "date").parquet(out)

        return store

    for version in versions:
        run(events(spark, sf_dir).writeStream.foreachBatch(derive(version)), spark, f"days{version}")
    schema = "posts bigint, total decimal(28,4), version int, ticker string, date string"
    return spark.read.schema(schema).parquet(out).select("version", "ticker", "date", "posts", F.col("total").cast("double").alias("total"))
