"""Read outcomes, schema frequencies, and the joins that keep failed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.scalars import fingerprint


def successes(audit: DataFrame) -> DataFrame:
    return audit.where(F.col("error") == "")


def failures(audit: DataFrame) -> DataFrame:
    return audit.where(F.col("error") != "")


def read_outcomes(audit: DataFrame) -> DataFrame:
    ok = F.col("error") == ""
    schema = F.when(ok, F.col("schema_id"))
    return audit.agg(F.count(F.lit(1)).alias("inspected"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.count_distinct(schema).alias("unique_schemas"))


def with_schema_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("schema_id", fingerprint(F.col("schema_text")))


def schema_frequency(audit: DataFrame) -> DataFrame:
    return successes(audit).groupBy("schema_id").agg(F.count(F.lit(1)).alias("files"))


def schema_examples(audit: DataFrame, ordinal: str) -> DataFrame:
    """The schema text seen first for each id."""
    return audit.groupBy("schema_id").agg(F.min_by("schema_text", ordinal).alias("schema_text"))


def footer_stats(audit: DataFrame) -> DataFrame:
    ok = successes(audit)
    return ok.agg(
        *[f(c).alias(f"{n}_{c}") for c in ("row_count", "column_count", "row_groups") for n, f in (("minimum", F.min), ("maximum", F.max))],
        F.avg("row_count").alias("mean_row_count"),
    )


def with_start_check(totals: DataFrame, start: int) -> DataFrame:
    """``totals`` ``(file, total_rows)`` with an error where a block would start past the file's end."""
    text = F.format_string("start row %d is beyond the file's %d rows", F.lit(start), F.col("total_rows"))
    return totals.withColumn("error", F.when(F.lit(start) >= F.col("total_rows"), text).otherwise(""))


def kept_left(catalog: DataFrame, audit: DataFrame, key: str, zeros: list[str]) -> DataFrame:
    """Every row of ``catalog`` with its audit; files without one get zeros in ``zeros``."""
    return catalog.join(audit, key, "left").na.fill(0, zeros)


def lacking(expected: list[str], columns: Column) -> Column:
    return F.array_sort(F.array_except(F.array(*[F.lit(c) for c in expected]), columns))


def lacking_error(lacks: Column) -> Column:
    """The error that names the columns a file lacks, "" where it lacks none."""
    return F.when(F.size(lacks) > 0, F.concat(F.lit("missing columns: "), F.array_join(lacks, ", "))).otherwise("")


def missing_columns(expected: list[str], actual: DataFrame) -> DataFrame:
    """The expected columns that each file of ``actual`` ``(path, columns)`` lacks, and the error that names them."""
    lacks = lacking(expected, F.col("columns"))
    return actual.select("path", lacks.alias("missing_columns"), lacking_error(lacks).alias("error"))
