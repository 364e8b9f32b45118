"""The registered queries: each applies one operator to its whole table and derives the
columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (alignment, centroids, decontaminate, embeddings, exact_dedup, line_dedup, mixing, pii, quality, simhash,
                            substring, toxicity, url_filter)
from ledgerline.llm.common import cut, read
from ledgerline.session import prepare


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return exact_dedup.groups(read(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _held_out(folds: int, fold: int) -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold


def _predicted(scores: DataFrame, threshold: float, folds: int, fold: int) -> DataFrame:
    return scores.select("doc_id", _held_out(folds, fold).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def training_labels(spark: SparkSession, sf_dir: str, column: str, folds: int, fold: int) -> DataFrame:
    """Labelled rows that a model may learn from."""
    rows = read(spark, sf_dir, "labels").select("doc_id", F.col(column).alias("label"))
    return rows.filter(~_held_out(folds, fold) & F.col("label").isNotNull())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    scores = toxicity.score_all(read(spark, sf_dir, "documents"), training_labels(spark, sf_dir, "toxic", 3, 1))
    return _predicted(scores, toxicity.THRESHOLD, 3, 1)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    x = cut(quality.with_statistics(read(spark, sf_dir, "documents")))
    model = quality.fit(quality.training_rows(x, training_labels(spark, sf_dir, "quality", 4, 2)))
    return _predicted(quality.scored(x, model), quality.THRESHOLD, 4, 2)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return line_dedup.drop_lines(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.groups(read(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, count_col="n_entities").select("doc_id", "n_entities", "text")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    marked = url_filter.page_labels(spark, read(spark, sf_dir, "labels"))
    return url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), marked)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return substring.drop_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return embeddings.near(read(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = alignment.alignment(read(spark, sf_dir, "documents"))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_url_filter": op9_url_filter,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_centroids": op12_centroids,
    "op13_alignment": op13_alignment,
}
