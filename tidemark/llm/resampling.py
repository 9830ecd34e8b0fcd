"""Importance resampling toward a target distribution, in DataFrame functions alone.

Features are runs of one and two words, hashed to ``BUCKETS`` buckets by crc32.
A bucket's gain is the smoothed log ratio of its share among the target's
features to its share among all features of the documents; a document's
weight is the mean gain of its features, and Gumbel noise on the weight draws
without replacement. Steps:

1. Each text's array of n-grams becomes an array of bucket numbers, written
   once with a row id, so that repeated ids and rows stay apart.
2. Exploded buckets are counted (partial counts of ``BUCKETS`` keys before the
   shuffle), for documents and target. The gain table has ``BUCKETS`` rows
   whatever the input, which bounds its broadcast.
3. The exploded buckets meet the gain table and are summed by row.
4. One distributed sort ranks all rows: the place in a sorted partition plus
   the rows of all partitions before it. No task or driver sees all rows.

A null or empty text has no feature: weight 0, and it is never drawn. A null
id is hashed as an empty string and comes first among equal scores; rows of one
id and score are ranked by their features, equal rows one after another. Empty tables give an empty result; an empty
target leaves only the smoothing. Other columns, whatever their names, are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PLACE, Tables, id_texts

BUCKETS = 10_000
#: Words a document needs to be drawn, and the percentage that is drawn.
LEAST_WORDS, PERCENT = 20, 25
SEED = 7

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Words of a text in order, A-Z in lower case."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), _BETWEEN), "")


def runs(of: Column) -> Column:
    """All single words and all pairs of neighbours."""
    pairs = F.greatest(F.size(of) - 1, F.lit(0))
    return F.concat(of, F.zip_with(F.slice(of, 1, pairs), F.slice(of, 2, pairs), lambda a, b: F.concat_ws(" ", a, b)))


def bucket(feature: Column) -> Column:
    return (F.crc32(feature.cast("binary")) % BUCKETS).cast("smallint")


def counts(buckets: DataFrame) -> DataFrame:
    """How often each bucket occurs in the arrays ``buckets``."""
    return buckets.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("count"))


def gain_table(spark: SparkSession, own: DataFrame, target: DataFrame) -> DataFrame:
    """``bucket, gain`` for every bucket, from counts of both sides."""
    whole = Window.partitionBy()  # BUCKETS rows
    sides = (
        spark.range(BUCKETS).select(F.col("id").cast("smallint").alias("bucket"))
        .join(own.select("bucket", F.col("count").alias("s")), "bucket", "left")
        .join(target.select("bucket", F.col("count").alias("t")), "bucket", "left")
        .fillna(0, ["s", "t"])
    )
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    all_s, all_t = F.sum("s").over(whole).cast("double"), F.sum("t").over(whole).cast("double")
    ratio = (t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS))
    return sides.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the id alone."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def place_ranks(tables: Tables, rows: DataFrame, order: list[Column], counted: Column) -> DataFrame:
    """``rows`` with ``rank`` (from 1, in ``order``) and ``counted``, how many rows of the whole table meet that condition.

    Sorted partitions are written with the places of their rows; the offsets
    of partitions are a table of one row each, which is broadcast.
    """
    placed = tables.write(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("place", PLACE)
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if(counted).alias("own"))
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("own").over(Window.partitionBy()).alias("counted"))
    rank = (F.col("offset") + F.col("place").bitwiseAND(F.lit((1 << PLACE) - 1)) + 1).alias("rank")
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").select(*rows.columns, rank, "counted")


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """``id, n_words, n_features, weight, score, rank``: every document, those that are drawn with their rank."""
    spark = docs.sparkSession
    tables = Tables(spark, "resampling")
    cut = id_texts(docs, id_col, text_col).select("id", F.monotonically_increasing_id().alias("rid"), words(F.col("text")).alias("words"))
    hashed = tables.write(cut.select("rid", "id", F.size("words").cast("bigint").alias("n_words"), F.transform(runs(F.col("words")), bucket).alias("buckets")), "buckets")
    aim = id_texts(target, target_text, target_text).select(F.transform(runs(words(F.col("text"))), bucket).alias("buckets"))
    gains = gain_table(spark, counts(hashed), counts(aim))

    each = hashed.select("rid", "id", "n_words", F.explode_outer("buckets").alias("bucket")).join(F.broadcast(gains), "bucket", "left")
    summed = each.groupBy("rid", "id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gained"))
    weight = F.expr("cast((gained - pmod(gained, greatest(n_features, 1))) div greatest(n_features, 1) as bigint)")
    scored = summed.select("rid", "id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    fit = F.col("n_words") >= least_words
    ranked = place_ranks(tables, scored, [fit.desc(), F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("n_features"), F.col("n_words"), F.col("rid")], fit)
    drawn = fit & (F.col("rank") <= F.expr(f"({percent} * counted) div 100"))
    return ranked.select("id", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("rank")).alias("rank"))


#: The same rows by DuckDB. It has no crc32: a table of 256 remainders is made by shifts, and the bytes of each
#: different feature are folded over it.
ORACLE_SQL = r"""
with tab as (
  select list(c order by b) as t from (
    select b, list_reduce(range(0, 8), lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, b) as c
    from (select unnest(range(0, 256)) as b))
), cut as (
  select rid, doc_id, side, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w
  from (
    select row_number() over () as rid, doc_id, 's' as side, text from documents
    union all select row_number() over (), null, 't', text from benchmark)
), feats as (
  select rid, side, unnest(w) as f from cut
  union all select rid, side, w[i] || ' ' || w[i + 1] from (select rid, side, w, unnest(range(1, len(w))) as i from cut)
), hashed as (
  select f, xor(list_reduce(list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::bigint),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::bigint), 4294967295) % 10000 as bucket
  from (select distinct f from feats), tab
), each as (select rid, side, bucket from feats join hashed using (f)
), tot as (select count(*) filter (side = 's') as all_s, count(*) filter (side = 't') as all_t from each
), gains as (
  select bucket, floor(1000 * ln((count(*) filter (side = 't') + 1)::double * (all_s + 10000)::double
    / ((count(*) filter (side = 's') + 1)::double * (all_t + 10000)::double)))::bigint as gain
  from each, tot group by bucket, all_s, all_t
), sums as (select rid, count(*) as n, sum(gain)::bigint as g from each join gains using (bucket) where side = 's' group by rid
), scored as (
  select cut.rid, doc_id, len(w) as words, coalesce(n, 0)::bigint as n_features,
    case when n is null then 0 else ((g - ((g % n) + n) % n) // n) end::bigint as weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h
  from cut left join sums using (rid) where side = 's'
), noisy as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from scored
), placed as (
  select *, row_number() over (partition by words >= 20 order by score desc, doc_id nulls first, n_features, words) as place, count(*) over (partition by words >= 20) as fit from noisy)
select doc_id, n_features, weight, score, case when words >= 20 and place <= 25 * fit // 100 then place end::bigint as rank from placed
"""
