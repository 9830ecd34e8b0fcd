"""Stories and themes: exact, MinHash and semantic dedup, components, clustering, salience, identity."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def normalized_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}]+", " "))


def exact(df: DataFrame, key: Column) -> DataFrame:
    """Groups of equal keys: canonical row (earliest, then least id), members and outlets."""
    first = F.min(F.struct("published_at", "story_id"))
    return df.groupBy(key.alias("key")).agg(
        first["story_id"].alias("canonical_id"), F.count("*").alias("members"), F.count_distinct("outlet").alias("outlets"), F.min("published_at").alias("published_at"),
    )


def equal_texts(df: DataFrame) -> DataFrame:
    """``(id, class)`` of all stories: the least id with the same words; a title without words is a class of its own."""
    words = df.select(F.col("story_id").alias("id"), F.nullif(normalized_title(F.col("title")), F.lit("")).alias("words"))
    least = words.where(F.col("words").isNotNull()).groupBy("words").agg(F.min("id").alias("class"))
    return words.join(least, "words", "left").select("id", F.coalesce("class", "id").alias("class"))


def near_pairs(df: DataFrame, distance: float = 0.2, width: int = 5) -> DataFrame:
    """The pairs of ``minhash_pairs``, and each copy paired with the least id of its class at distance 0: all stories are reached, in rows linear in the copies."""
    copies = equal_texts(df).where("class <> id").select(F.col("class").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("distance"))
    return minhash_pairs(df, distance, width).unionByName(copies)


#: MinHash bands and minima in each: a pair of similarity 0.8 shares no band with a probability of 0.0004.
BANDS, ROWS = 20, 5
#: Rows of a band's bucket that meet in one task, about.
BUCKET = 1000


def shingle_sets(df: DataFrame, width: int = 5) -> DataFrame:
    """``(id, grams)``: the least id of each different text of ``width`` words or more, and its different shingles as hashes."""
    words = F.split(normalized_title(F.col("title")), " ")
    text = df.groupBy(words.alias("w")).agg(F.min("story_id").alias("id")).where(F.size("w") >= width)
    # the words behind each place stand beside each other, so a shingle needs no look into the whole array
    n = F.size("w") - width + 1
    beside = F.arrays_zip(*[F.slice("w", k + 1, n) for k in range(width)])
    grams = F.transform(beside, lambda x: F.xxhash64(*[x[str(k)] for k in range(width)]))
    return text.select("id", F.when(F.size("w") >= width, F.array_distinct(grams)).alias("grams"))


def _band_keys(batches):
    """``id, key`` for each band of each set: minima of ``BANDS * ROWS`` orders of the hashes, and a hash of each band's minima."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(7)
    shift, odd = (rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
    odd |= np.uint64(1)
    mix = np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        grams = batch["grams"]
        sizes = np.diff(grams.offsets.to_numpy())
        g, ends = grams.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(sizes)
        minima, at = np.empty((BANDS * ROWS, len(batch)), np.uint64), 0
        while at < len(batch):
            # as many sets as have some 100,000 hashes, which stay in the processor's cache
            begin = ends[at] - sizes[at]
            end = max(at + 1, int(np.searchsorted(ends, begin + 100_000)))
            own, starts = g[begin : ends[end - 1]], ends[at:end] - sizes[at:end] - begin
            for k in range(BANDS * ROWS):
                h = (own ^ shift[k]) * odd[k]
                h ^= h >> np.uint64(32)
                h *= mix
                minima[k, at:end] = np.minimum.reduceat(h, starts)
            at = end
        keys = np.empty((len(batch), BANDS), np.uint64)
        for b in range(BANDS):
            h = np.full(len(batch), b, np.uint64)
            for r in range(ROWS):
                h = (h ^ minima[b * ROWS + r]) * mix
                h ^= h >> np.uint64(29)
            keys[:, b] = h
        yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(np.repeat(np.arange(len(batch)), BANDS))), pa.array(keys.reshape(-1).view(np.int64))], names=["id", "key"])


def band_pairs(sets: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: different texts that share a band of their MinHash signatures; large buckets meet as pairs of blocks."""
    kind = sets.schema["id"].dataType.simpleString()
    keyed = sets.select("id", "grams").where(F.size("grams") > 0).mapInArrow(_band_keys, f"id {kind}, key bigint").checkpoint()
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = keyed.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    left = dealt.select("key", F.col("id").alias("a"), F.col("block").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("y"))
    right = dealt.select("key", F.col("id").alias("b"), F.col("block").alias("y"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("x"))
    met = left.join(right, ["key", "x", "y"]).where((F.col("x") < F.col("y")) | (F.col("a") < F.col("b")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def minhash_pairs(df: DataFrame, distance: float = 0.2, width: int = 5) -> DataFrame:
    """Pairs of different texts whose shingles of ``width`` words have a Jaccard distance below ``distance``.

    Equal texts are collapsed first (``equal_texts`` has their members). Bands
    of MinHash signatures give candidates, the whole sets decide.
    """
    shared_checkpoints(df.sparkSession)
    sets = shingle_sets(df, width).checkpoint()
    pairs = band_pairs(sets)
    x = sets.select(F.col("id").alias("a"), F.col("grams").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    both = pairs.join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    apart = 1 - F.col("common") / (F.size("x") + F.size("y") - F.col("common"))
    return both.select("a", "b", apart.alias("distance")).where(F.col("distance") < distance - 1e-12)


def cosine(a: Column, b: Column) -> Column:
    """Dot product; the cosine for unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def semantic_pairs(df: DataFrame, threshold: float, hours: int = 36) -> DataFrame:
    """Pairs of one ticker within ``hours`` whose vectors are at least ``threshold`` alike.

    Time is cut into buckets of ``hours``: a pair lies in one bucket or in
    neighbours, so the left side is joined with two buckets by equality.
    """
    span = hours * 3600
    at = F.unix_timestamp("published_at")
    left = df.select("ticker", F.col("story_id").alias("a"), F.col("embedding").alias("x"), at.alias("s"), F.explode(F.array(F.floor(at / span), F.floor(at / span) + 1)).alias("bucket"))
    right = df.select("ticker", F.col("story_id").alias("b"), F.col("embedding").alias("y"), at.alias("t"), F.floor(at / span).alias("bucket"))
    near = (F.col("t") - F.col("s") <= span) & ((F.col("t") > F.col("s")) | ((F.col("t") == F.col("s")) & (F.col("a") < F.col("b"))))
    joined = left.join(right, ["ticker", "bucket"]).where(near).withColumn("similarity", cosine(F.col("x"), F.col("y"))).where(F.col("similarity") >= threshold)
    return joined.select("ticker", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(id, root)``: the least id that can be reached. Labels spread along links and jump to their own label's label, until nothing changes; each round is a stored table, and takes the place of the one before."""
    shared_checkpoints(nodes.sparkSession)
    links = _stored(pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).distinct())
    labels = _stored(nodes.select("id", F.col("id").alias("root")))
    while True:
        least = links.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        new = labels.join(least, "id", "left").select("id", "root", F.least("root", "near").alias("low"))
        jump = new.select(F.col("id").alias("low"), F.col("low").alias("lower"))
        new = _stored(new.join(jump, "low", "left").select("id", F.least("low", "lower").alias("next"), "root"))
        _dropped(labels)
        changed = not new.where("next <> root").isEmpty()
        labels = new.select("id", F.col("next").alias("root"))
        if not changed:
            _dropped(links)
            return labels


def shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to ``spark.checkpoint.dir``; only a local master may run without that setting."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if spark.sparkContext.getCheckpointDir() is None:
        if not own and spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(own or "/tmp/checkpoints/stories")


def salience(themes: DataFrame) -> DataFrame:
    """Rank of themes in a ticker: stories, then twice the outlets, less a tenth for each hour since the newest of the ticker. Ranks are places of a distributed sort, so a ticker may have any number of themes."""
    from . import blocks

    newest = themes.groupBy("ticker").agg(F.max("latest").alias("__newest"))
    hours = (F.unix_timestamp("__newest") - F.unix_timestamp("latest")) / 3600
    scored = themes.join(newest, "ticker").withColumn("salience", F.col("stories") + 2 * F.col("outlets") - hours / 10).drop("__newest")
    ranked = blocks.numbered(scored, ["ticker"], [F.col("salience").desc(), "theme_id"], "__place")
    return ranked.withColumn("salience_rank", (F.col("__place") + 1).cast("int")).drop("__place")


def similar_previous(themes: DataFrame, threshold: float) -> DataFrame:
    """``ticker, run, theme_id, previous_id, similarity``: themes of a ticker and those of its run before (``run`` counts up) that are similar enough."""
    before = themes.select("ticker", (F.col("run") + 1).alias("run"), F.col("theme_id").alias("previous_id"), F.col("centroid").alias("old"))
    scored = themes.join(before, ["ticker", "run"]).withColumn("similarity", cosine(F.col("centroid"), F.col("old")))
    return scored.where(F.col("similarity") >= threshold).select("ticker", "run", "theme_id", "previous_id", "similarity")


def best_previous(themes: DataFrame, threshold: float) -> DataFrame:
    """For each theme the most similar theme of its ticker in the run before, if similar enough. A ticker has few themes in a run."""
    best = similar_previous(themes, threshold).groupBy("ticker", "run", "theme_id").agg(F.max(F.struct("similarity", (-F.col("previous_id")).alias("k"))).alias("m"))
    return best.select("ticker", "theme_id", (-F.col("m.k")).alias("previous_id"), F.col("m.similarity").alias("similarity"))


def _assigned(rows: list[tuple]) -> list[bool]:
    """Which pairs ``(theme, previous, similarity)`` of one connected group have the largest total similarity, each end once: augmenting paths over whole numbers (10^-9)."""
    gain = {(t, p): round(s * 1e9) for t, p, s in rows}
    themes = sorted({t for t, _ in gain})
    match: dict = {}
    for _ in themes:
        # the best alternating path from a free theme to a free predecessor, by relaxing until nothing improves
        reach = {("t", t): (0, None) for t in themes if t not in match}
        holder = {p: t for t, p in match.items()}
        better = True
        while better:
            better = False
            for (t, p), g in gain.items():
                if ("t", t) in reach and match.get(t) != p:
                    total = reach["t", t][0] + g
                    if ("p", p) not in reach or reach["p", p][0] < total:
                        reach["p", p] = total, t
                        better = True
                    if p in holder and (("t", holder[p]) not in reach or reach["t", holder[p]][0] < reach["p", p][0] - gain[holder[p], p]):
                        reach["t", holder[p]] = reach["p", p][0] - gain[holder[p], p], p
                        better = True
        free = [(v[0], p) for (kind, p), v in reach.items() if kind == "p" and p not in holder]
        if not free or max(free)[0] <= 0:
            break
        at = max(free, key=lambda f: f[0])[1]
        while at is not None:
            t = reach["p", at][1]
            match[t], at = at, reach["t", t][1]
    return [match.get(t) == p for t, p, _ in rows]


def _assigned_groups(batches):
    """Rows sorted by ``root`` in, the assigned ones of each group out; a group may go over from batch to batch, and only one is held."""
    import pyarrow as pa

    open_root, held = None, []

    def settled(held):
        table = pa.Table.from_batches(held)
        rows = sorted(zip(table["theme_id"].to_pylist(), table["previous_id"].to_pylist(), table["similarity"].to_pylist(), range(len(table))), key=lambda r: r[:2])
        keep = [r[3] for r, kept in zip(rows, _assigned([r[:3] for r in rows])) if kept]
        return table.take(pa.array(keep, pa.int64())).drop_columns(["root"]).combine_chunks().to_batches()

    for batch in batches:
        roots = batch["root"].to_pylist()
        starts = [k for k in range(len(roots)) if k == 0 or roots[k] != roots[k - 1]]
        done = []
        for at, end in zip(starts, [*starts[1:], len(roots)]):
            if held and roots[at] != open_root:
                done += settled(held)
                held = []
            open_root = roots[at]
            held.append(batch.slice(at, end - at))
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
    if held:
        yield from settled(held)


def one_to_one(similar: DataFrame) -> DataFrame:
    """Of :func:`similar_previous`, the pairs with the largest total similarity in which no theme and no predecessor comes twice.

    Pairs are grouped by what they connect, so a task gets the themes of one
    ticker's two runs that have to do with each other, and no more; a task goes
    through its groups one after another in Arrow batches.
    """
    shared_checkpoints(similar.sparkSession)
    end = lambda side, c: F.struct("ticker", "run", F.lit(side).alias("side"), F.col(c).alias("id"))
    rows = similar.withColumns({"a": end(0, "theme_id"), "b": end(1, "previous_id")})
    rows = rows.checkpoint()
    roots = components(rows.select(F.explode(F.array("a", "b")).alias("id")).distinct(), rows)
    grouped = rows.join(roots.select(F.col("id").alias("a"), F.to_json("root").alias("root")), "a").select("root", *similar.columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in similar.schema)
    return grouped.repartition("root").sortWithinPartitions("root").mapInArrow(_assigned_groups, schema)


def oldest(themes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``ticker, run, theme_id, first_run, first_id``: each theme's oldest predecessor by one-to-one ``pairs``, itself if it has none."""
    node = lambda run, c: F.struct("ticker", run.alias("run"), F.col(c).alias("id"))
    links = pairs.select(node(F.col("run"), "theme_id").alias("a"), node(F.col("run") - 1, "previous_id").alias("b"))
    nodes = themes.select(node(F.col("run"), "theme_id").alias("id"))
    roots = components(nodes, links)
    return roots.select("id.ticker", "id.run", F.col("id.id").alias("theme_id"), F.col("root.run").alias("first_run"), F.col("root.id").alias("first_id"))


def identities(themes: DataFrame, threshold: float) -> DataFrame:
    """``ticker, run, theme_id, identity``: the id of the theme with which it began, through all runs."""
    found = oldest(themes.select("ticker", "run", "theme_id"), one_to_one(similar_previous(themes, threshold)))
    return found.select("ticker", "run", "theme_id", F.col("first_id").alias("identity"))


def content_hash(ids: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.transform(ids, lambda x: x.cast("string"))), ","), 256)


def changed_only(themes: DataFrame, done: DataFrame) -> DataFrame:
    """Themes whose content has no summary yet."""
    return themes.join(done.select("theme_id", "content_hash"), ["theme_id", "content_hash"], "left_anti")


def cluster_schema(id_type: str) -> str:
    return f"ticker string, day string, story_id {id_type}, theme int"


def clusterer(cut: float, least: int = 4, most: int = 6):
    """A function for ``groupBy(ticker, day).applyInPandas``: average-link clustering of one ticker's day.

    Fewer than ``least`` stories, and stories outside the ``most`` largest
    clusters or alone, are theme -1 (other).
    """
    import numpy as np
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("story_id").reset_index(drop=True)
        n = len(rows)
        theme = np.full(n, -1)
        if n >= least:
            x = np.stack(rows["embedding"].to_numpy()).astype(float)
            similarity = x @ x.T
            groups = [[i] for i in range(n)]
            while len(groups) > 1:
                best = max(((similarity[np.ix_(groups[a], groups[b])].mean(), -a, -b) for a in range(len(groups)) for b in range(a + 1, len(groups))))
                if best[0] < cut:
                    break
                a, b = -best[1], -best[2]
                groups[a] += groups.pop(b)
            kept = sorted((g for g in groups if len(g) > 1), key=lambda g: (-len(g), min(g)))[:most]
            for k, g in enumerate(kept):
                theme[g] = k
        return pd.DataFrame({"ticker": rows["ticker"], "day": rows["day"], "story_id": rows["story_id"], "theme": theme.astype("int32")})

    return run


def near_in_group(df: DataFrame, floor: float, size: int = 512) -> DataFrame:
    """``ticker, day, a, b, distance`` (a < b): pairs of one ticker's day at least ``floor`` alike. Stories of a day are dealt into blocks of about ``size``; two blocks meet in one task."""
    sizes = df.groupBy("ticker", "day").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    dealt = df.join(sizes, ["ticker", "day"]).withColumn("block", F.pmod(F.xxhash64("story_id"), "blocks").cast("int"))
    left = dealt.select("ticker", "day", F.col("story_id").alias("a"), F.col("embedding").alias("x"), F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    right = dealt.select("ticker", "day", F.col("story_id").alias("b"), F.col("embedding").alias("y"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    both = left.join(right, ["ticker", "day", "i", "j"]).where((F.col("a") < F.col("b")) & (cosine(F.col("x"), F.col("y")) >= floor))
    return both.select("ticker", "day", "a", "b", F.round(1 - cosine(F.col("x"), F.col("y")), 12).alias("distance"))


def _stored(df: DataFrame) -> DataFrame:
    """Written to the checkpoint folder and read again: unlike a checkpoint, nothing of the old plan is handed on, which over rounds of joins grows."""
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dropped(df: DataFrame) -> None:
    """Remove the files of a stored table that nothing reads any more."""
    hadoop, spark = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs, df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = hadoop.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The least forest of ``a, b, weight`` by Boruvka rounds: every component takes its least edge to another one, all at once, until none is left.

    Edges are ordered by weight, then ends, so each round's choice has no
    cycle. A round at least halves the components that can still grow.
    """
    shared_checkpoints(edges.sparkSession)
    left = _stored(edges.select("a", "b", "weight", F.col("a").alias("p"), F.col("b").alias("q")))
    found = []
    while not left.isEmpty():
        least = F.min(F.struct("weight", "a", "b")).alias("e")
        ends = left.select(F.explode(F.array("p", "q")).alias("id"), "weight", "a", "b")
        best = ends.groupBy("id").agg(least).select("e.*").distinct()
        chosen = _stored(left.join(best, ["a", "b", "weight"]).select("a", "b", "weight", "p", "q").distinct())
        found.append(chosen.select("a", "b", "weight"))
        pairs = chosen.select(F.col("p").alias("a"), F.col("q").alias("b"))
        roots = _stored(components(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), pairs))
        for c in ("p", "q"):
            left = left.join(roots.select(F.col("id").alias(c), F.col("root").alias(f"{c}2")), c, "left").withColumn(c, F.coalesce(f"{c}2", c)).drop(f"{c}2")
        left = _stored(left.where("p <> q").select("a", "b", "weight", "p", "q"))
    out = edges.select("a", "b", "weight").limit(0) if not found else found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def density_clusters(df: DataFrame, floor: float, core: int = 2, least: int = 4, most: int = 6, gap: float = 0.02) -> DataFrame:
    """``ticker, day, story_id, theme``: density clusters of each ticker's day; theme -1 is other.

    Distances below ``1 - floor`` count. A story's core distance is that to its
    ``core``-th neighbour; stories with fewer neighbours are noise. Two stories
    are apart by the mutual reachability, the most of their distance and both
    core distances. The day's least spanning forest is cut behind the largest
    gap in its sorted weights, if that is wider than ``gap``. What stays together
    is a theme; the ``most`` largest (then least id) are kept. Days of fewer
    than ``least`` stories have none. Null vectors are noise; repeated ids are
    taken once. A day's stories and pairs may be spread over many tasks.
    """
    from . import blocks

    shared_checkpoints(df.sparkSession)
    rows = df.dropDuplicates(["ticker", "day", "story_id"]).select("ticker", "day", "story_id", "embedding").checkpoint()
    day = ["ticker", "day"]
    enough = rows.groupBy(*day).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*day)
    near = near_in_group(rows.where(F.col("embedding").isNotNull()).join(enough, day, "left_semi"), floor).checkpoint()
    both = near.select(*day, F.col("a").alias("id"), "distance").unionByName(near.select(*day, F.col("b").alias("id"), "distance"))
    # a story's nearest are kept while they are counted: at most ``core`` of them stay in any buffer
    rank = F.row_number().over(Window.partitionBy(*day, "id").orderBy("distance"))
    cores = both.withColumn("__r", rank).where(F.col("__r") == core).select(*day, "id", F.col("distance").alias("core"))
    edges = near.join(cores.select(*day, F.col("id").alias("a"), F.col("core").alias("ca")), [*day, "a"]).join(cores.select(*day, F.col("id").alias("b"), F.col("core").alias("cb")), [*day, "b"])
    edges = edges.select(*day, F.struct(*day, F.col("a").alias("id")).alias("a"), F.struct(*day, F.col("b").alias("id")).alias("b"), F.greatest("distance", "ca", "cb").alias("weight"))
    forest = spanning_forest(edges).select(F.col("a.ticker").alias("ticker"), F.col("a.day").alias("day"), "a", "b", "weight")
    steps = blocks.own(blocks.blocked(forest, day, ["weight", "a", "b"], 1).withColumn("step", F.col("weight") - F.lag("weight").over(blocks.in_block(*day))))
    cut = steps.where(F.col("step") > gap).groupBy(*day).agg(F.max_by("weight", F.struct("step", -F.col("weight"))).alias("cut"))
    kept = forest.join(cut, day, "left").where(F.col("cut").isNull() | (F.col("weight") < F.col("cut"))).select("a", "b")
    roots = components(kept.select(F.explode(F.array("a", "b")).alias("id")).distinct(), kept)
    sizes = roots.groupBy("root").agg(F.count("*").alias("n")).select("root", F.col("root.ticker").alias("ticker"), F.col("root.day").alias("day"), "n")
    place = F.row_number().over(Window.partitionBy(*day).orderBy(F.col("n").desc(), "root")) - 1
    themes = sizes.withColumn("theme", place).where(F.col("theme") < most).select("root", "theme")
    named = roots.join(themes, "root").select(F.col("id.ticker").alias("ticker"), F.col("id.day").alias("day"), F.col("id.id").alias("story_id"), "theme")
    return rows.select(*day, "story_id").join(named, [*day, "story_id"], "left").withColumn("theme", F.coalesce("theme", F.lit(-1)))


def raw_items(new: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """New items by source and canonical URL: the first of each, without those that are stored already."""
    rank = F.row_number().over(Window.partitionBy("source", "canonical_url").orderBy("item_id"))
    first = new.withColumn("__r", rank).where("__r = 1").drop("__r")
    return first if known is None else first.join(known.select("source", "canonical_url"), ["source", "canonical_url"], "left_anti")
