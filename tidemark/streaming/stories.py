"""Stories over micro-batches: insert-once, links within 36 hours, components and identities that grow.

The store is a folder of small tables, each written under its batch's number.
A batch that comes again overwrites what it wrote and reads what was there
before it, so a restart changes nothing.

- ``items``: each story once, in files that are ranges of time buckets, with
  the root that it had when it came. A batch reads those of its own time.
- ``forest``: what became of roots. A batch appends the roots that its links
  changed, and those that pointed to them; all others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.stories import components, cosine, oldest, one_to_one, shared_checkpoints, similar_previous


class Store:
    """Tables of batches below ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        shared_checkpoints(spark)

    def _there(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def before(self, name: str, schema: str, number: int | None) -> DataFrame:
        """All rows of the batches before ``number`` (None: of all), with their ``batch``."""
        whole = StructType.fromDDL(f"{schema}, batch bigint")
        if not self._there(name):
            return self.spark.createDataFrame([], whole)
        rows = self.spark.read.schema(whole).parquet(f"{self.root}/{name}")
        return rows if number is None else rows.where(F.col("batch") < number)

    def put(self, df: DataFrame, name: str, number: int) -> None:
        """No folders by value: there would be as many files as values and tasks, which grow with the time that is stored."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={number}")


class StoryStore(Store):
    """Stories ``story_id, ticker, published_at, embedding`` and their components by similarity within ``hours``."""

    ITEMS = "story_id bigint, ticker string, published_at timestamp, embedding array<float>, first_root bigint, bucket bigint"
    FOREST = "old bigint, new bigint"

    def __init__(self, spark: SparkSession, root: str, threshold: float, hours: int = 36) -> None:
        super().__init__(spark, root)
        self.threshold, self.span = threshold, hours * 3600

    def forest(self, number: int | None = None) -> DataFrame:
        """What each root that is none any more has become."""
        return self.before("forest", self.FOREST, number).groupBy("old").agg(F.max_by("new", "batch").alias("new"))

    def roots(self) -> DataFrame:
        """``story_id, root`` of everything stored."""
        items = self.before("items", self.ITEMS, None)
        return items.join(self.forest(), F.col("first_root") == F.col("old"), "left").select("story_id", F.coalesce("new", "first_root").alias("root"))

    def _links(self, new: DataFrame, stored: DataFrame) -> DataFrame:
        """Pairs of a new story and another one of its ticker that is near in time and alike, with the root that the other has."""
        at = F.unix_timestamp("published_at")
        left = new.select("ticker", F.col("story_id").alias("a"), F.col("embedding").alias("x"), at.alias("s"), F.explode(F.sequence(F.col("bucket") - 1, F.col("bucket") + 1)).alias("bucket"))
        every = stored.select("ticker", "story_id", "embedding", "published_at", "bucket", "root", F.lit(False).alias("fresh")).unionByName(
            new.select("ticker", "story_id", "embedding", "published_at", "bucket", F.col("story_id").alias("root"), F.lit(True).alias("fresh"))
        )
        right = every.select("ticker", F.col("story_id").alias("b"), F.col("embedding").alias("y"), at.alias("t"), "bucket", "root", "fresh")
        near = (F.abs(F.col("t") - F.col("s")) <= self.span) & (F.col("a") != F.col("b")) & (~F.col("fresh") | (F.col("a") < F.col("b")))
        alike = cosine(F.col("x"), F.col("y")) >= self.threshold
        return left.join(right, ["ticker", "bucket"]).where(near & alike).select("a", F.col("root").alias("b")).distinct()

    def add(self, batch: DataFrame, number: int) -> None:
        """Insert a batch's stories that aren't stored yet, and join the components that they link."""
        bucket = F.floor(F.unix_timestamp("published_at") / self.span)
        first = batch.groupBy("story_id").agg(F.min_by(F.struct("ticker", "published_at", "embedding"), F.struct("published_at", "ticker")).alias("s")).select("story_id", "s.*").withColumn("bucket", bucket)
        known = self.before("items", self.ITEMS, number)
        new = first.join(known.select("story_id"), "story_id", "left_anti").checkpoint()
        forest = self.forest(number)
        # stored stories of the batch's time alone; files of other times are left out by their least and largest bucket
        first_bucket, last_bucket = new.agg(F.min("bucket"), F.max("bucket")).first()
        touched = new.select(F.explode(F.sequence(F.col("bucket") - 1, F.col("bucket") + 1)).alias("bucket")).distinct()
        about = F.lit(False) if first_bucket is None else F.col("bucket").between(first_bucket - 1, last_bucket + 1)
        stored = known.where(about).join(touched, "bucket", "left_semi").join(forest, F.col("first_root") == F.col("old"), "left").withColumn("root", F.coalesce("new", "first_root"))
        links = self._links(new, stored).checkpoint()
        nodes = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        moved = components(nodes, links).where("id <> root").checkpoint()
        own = new.join(moved, F.col("story_id") == F.col("id"), "left").select("story_id", "ticker", "published_at", "embedding", F.coalesce("root", "story_id").alias("first_root"), "bucket")
        self.put(own.repartitionByRange("bucket").sortWithinPartitions("bucket"), "items", number)
        fresh = new.select("story_id")
        gone = moved.join(fresh, F.col("id") == F.col("story_id"), "left_anti").select(F.col("id").alias("old"), F.col("root").alias("new"))
        followed = forest.join(gone.select(F.col("old").alias("new"), F.col("new").alias("newer")), "new").select("old", F.col("newer").alias("new"))
        self.put(gone.unionByName(followed), "forest", number)


class ThemeStore(Store):
    """Themes ``ticker, run, theme_id, centroid`` and the identities that they keep from run to run.

    A ticker's runs must come in order, some at a time; a run is compared with
    the one before it, whether that is stored or in the same batch. A batch
    may come again, a theme that is stored already is not taken anew.
    """

    THEMES = "run bigint, theme_id bigint, centroid array<float>, identity bigint, ticker string"

    def __init__(self, spark: SparkSession, root: str, threshold: float) -> None:
        super().__init__(spark, root)
        self.threshold = threshold

    def identities(self) -> DataFrame:
        return self.before("themes", self.THEMES, None).select("ticker", "run", "theme_id", "identity")

    def add(self, batch: DataFrame, number: int) -> None:
        key = ["ticker", "run", "theme_id"]
        known = self.before("themes", self.THEMES, number)
        new = batch.select(*key, "centroid").dropDuplicates(key).join(known.select(*key), key, "left_anti").checkpoint()
        last = known.join(new.select("ticker", (F.col("run") - 1).alias("run")).distinct(), ["ticker", "run"], "left_semi")
        both = last.select(*key, "centroid").unionByName(new).checkpoint()
        fresh = new.select("ticker", "run").distinct()
        pairs = one_to_one(similar_previous(both, self.threshold).join(fresh, ["ticker", "run"], "left_semi"))
        first = oldest(both.select(*key), pairs).join(new.select(*key), key, "left_semi")
        stored = last.select("ticker", F.col("run").alias("first_run"), F.col("theme_id").alias("first_id"), "identity")
        named = new.join(first, key).join(stored, ["ticker", "first_run", "first_id"], "left")
        self.put(named.select("run", "theme_id", "centroid", F.coalesce("identity", "first_id").alias("identity"), "ticker").sortWithinPartitions("run"), "themes", number)
