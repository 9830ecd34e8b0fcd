"""The registered queries of this package: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowstore, collocations, decontam, langid, media, packing, pieces, quality, resampling, sharding, simhash, suffix, toxicity
from .common import crc_mod, documents
from .tokens import vocabulary


def op1_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = arrowstore.write_store(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), 1, leading_space=False)
    return arrowstore.read_store(spark, folder, manifest).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), 2, leading_space=True)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(documents(spark, sf_dir), 8)
    none = F.lit(None).cast("int").alias("grown_shard")
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", none)


def op4_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.predict(docs, langid.learn(docs))
    return found.select(F.col("id").alias("doc_id"), (crc_mod(F.col("id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.features(media.store(documents(spark, sf_dir)), samples=True)
    size = F.octet_length("samples").cast("bigint")
    tail = F.substring(F.col("samples"), -64, 64)
    return read.select(
        F.col("id").alias("doc_id"), "n_bytes", size.alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"), F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature", F.sha2("tile", 256).alias("tile_sha256"),
    )


def op6_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _graded(quality.score_documents(docs, model), 4, 2)


def _graded(scored: DataFrame, modulus: int, held_out: int) -> DataFrame:
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    return scored.select(F.col("id").alias("doc_id"), (crc_mod(F.col("id"), modulus) == held_out).alias("held_out"), "score", predicted)


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), F.col("component").alias("component_id"))


def op8_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "overlap", F.col("question").alias("question_overlap"), F.col("answer").alias("answer_overlap"))


def op9_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _graded(scored, 3, 1)


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return cut.select(
        F.col("id").alias("doc_id"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_pivot_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        op1_arrow_sequences, op2_best_fit_packing, op3_minimax_sharding, op4_cross_parsing_language, op5_media_columns,
        op6_knn_quality, op7_simhash_golay, op8_bm25_decontamination, op9_weak_toxicity, op10_suffix_array,
        op11_pivot_collocations, op12_sentencepiece, op13_importance_resampling,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op11_pivot_collocations": collocations.ORACLE_SQL,
    "op13_importance_resampling": resampling.ORACLE_SQL,
}
