"""The corpus pipeline: quality, near-duplicates, repeated text, benchmark leaks, then the mix.

Each stage takes what its predecessor kept. All but the last return the columns
of documents; the last adds the leaf of the mix and how often a row is taken.

In every stage a null text is empty, a null doc_id is later than any other, an
empty table stays empty, and further columns, whatever their names, come out as
they went in (the last stage's own ``leaf_*`` and ``n_epochs`` replace such).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldmark.llm import decontaminate, mixing, quality, registry, similar, suffix_dedup
from fieldmark.llm.common import free_since, made, scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; repeated rows get one verdict, an empty text the sample's, and without labels all stay."""
    return quality.accepted(docs, registry.table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word similarity of 0.8 or more) stays, that with the smallest doc_id; so does one empty text."""
    return similar.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that repeat are cut out of the texts; repeated rows lose what they share, null stays null."""
    return suffix_dedup.without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; repeated rows go or stay together, and without items all stay."""
    return decontaminate.clean_documents(docs, registry.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken to the target weights; one without words only where its leaf repeats whole epochs or the prefix passes it."""
    return mixing.mix(docs, registry.MIX_SHARE, registry.MIX_EPOCHS, registry.MIX_WEIGHTS, registry.MIX_SEED)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", mix_sources),
]
#: Hashing votes, suffix sorting and the classifier are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = registry.table(spark, sf_dir, "documents")
    for k, (_, function) in enumerate(STAGES):
        path, before = scratch(spark, f"pipeline-{k}"), made(spark)
        function(spark, docs, sf_dir).write.parquet(path)
        free_since(spark, before, path)
        docs = spark.read.parquet(path)
    return docs
