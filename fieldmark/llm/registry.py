"""The registered query of each corpus operator, over its whole table, and SQL where it can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm import decontaminate, fill_in_middle, html_text, media, merkle, mixing, neighbours, oracle, quality, simhash, substring_dedup, suffix_dedup, token_counts, warc

#: Target weights of the mix; what is not listed weighs 1.
MIX_WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.5, 4, 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = media.media_columns(table(spark, sf_dir, "documents"))
    return seen.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listing = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", listing, "contaminated")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = quality.scored(docs, table(spark, sf_dir, "labels"))
    return done.select("doc_id", quality.held_out_rows().alias("held_out"), "score", "predicted")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_earlier_windows(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MIX_SHARE, MIX_EPOCHS, MIX_WEIGHTS, MIX_SEED)
    return mixed.select("doc_id", F.col("leaf_domain").alias("domain"), F.col("leaf_lang").alias("lang"), F.col("leaf_source").alias("source"), "n_epochs")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle.filled(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_in_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = merkle.manifest(table(spark, sf_dir, "documents"))
    path, root = F.col("path"), merkle.folded(F.col("tampered"), F.col("path")).alias("folded_root")
    done = done.select("doc_id", "leaf", "subroot", "root", merkle.proof(path).alias("proof_sha256"), root)
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = [
    op1_simhash_near_dedup, op2_media_columns, op3_html_extraction, op4_token_counts, op5_benchmark_decontamination,
    op6_suffix_array_dedup, op7_quality_classifier, op8_substring_dedup, op9_mixing, op10_warc, op11_nearest_neighbours, op12_fill_in_middle, op13_merkle_manifest,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_benchmark_decontamination": oracle.DECONTAMINATION,
        "op6_suffix_array_dedup": oracle.SUFFIX_DEDUP,
        "op8_substring_dedup": oracle.SUBSTRING_DEDUP,
        "op9_mixing": oracle.mixing(MIX_SHARE, MIX_EPOCHS, MIX_WEIGHTS, MIX_SEED),
        "op10_warc": oracle.WARC,
        "op12_fill_in_middle": oracle.FILL_IN_MIDDLE,
        "op13_merkle_manifest": oracle.merkle(merkle.BRANCH),
    }
