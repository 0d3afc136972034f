"""Profiles of many self-report tables at once, from their records in one frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions import scalars
from fieldmark.operators import tables
from fieldmark.schemas import KINDS
from fieldmark.sources.readers import fits
from fieldmark.sources.shared import kept


def inferred(cells: DataFrame) -> DataFrame:
    """``(path, ordinal, kind)`` of ``cells`` ``(path, ordinal, value)``: the narrowest type that fits every value of a column; text where it has none. All columns of all tables in one aggregate."""
    every = [F.bool_and(F.col("value").isNull() | fits(F.col("value"), k)).alias(k) for k in KINDS]
    found = cells.groupBy("path", "ordinal").agg(*every, F.count("value").alias("known"))
    kind = F.lit("string")
    for k in reversed(KINDS):
        kind = F.when(F.col(k) & (F.col("known") > 0), k).otherwise(kind)
    return found.select("path", "ordinal", kind.alias("kind"))


def canonical(text: Column, kind: Column) -> Column:
    """One text for each value of a type: equal values have equal texts."""
    out = text
    for k in KINDS:
        value = text.try_cast(k)
        out = F.when(kind == k, ((value + F.lit(0.0)) if k == "double" else value).cast("string")).otherwise(out)
    return out


def exploded(rows: DataFrame, values: str) -> DataFrame:
    return rows.select("path", F.posexplode(values).alias("ordinal", "value"))


def profiles(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for each table and a row for each column of ``records`` ``(path, row, cells, error)``, whatever their number.

    The types of all columns come from one pass; then every cell is brought to
    one text a value, cells are reduced to distinct ones and counted, and rows
    are compared as wholes only where their hashes meet.
    """
    records = kept(records, "csv-records")
    broken = records.where(F.col("error").isNotNull()).select("path", "error")
    sound = records.join(broken.select("path"), "path", "left_anti")
    heads = sound.where("row = -1").select("path", F.col("cells").alias("names"))
    names = heads.select("path", F.posexplode("names").alias("ordinal", "column"))
    rows = sound.where("row >= 0")

    kinds = names.join(inferred(exploded(rows, "cells")), ["path", "ordinal"], "left").withColumn("kind", F.coalesce("kind", F.lit("string")))
    kinds = kept(kinds, "csv-kinds")
    of_table = kinds.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "kind"))), lambda x: x["kind"]).alias("kinds"))
    typed = rows.join(of_table, "path").select("path", F.zip_with("cells", "kinds", canonical).alias("values"))
    typed = kept(typed, "csv-typed")

    values = exploded(typed, "values").groupBy("path", "ordinal", "value").agg(F.count(F.lit(1)).alias("n"))
    at = scalars.parse_timestamp(F.col("value"))
    counts = values.groupBy("path", "ordinal").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"), F.count("value").alias("distinct"),
        F.min(at).alias("first"), F.max(at).alias("last"),
    )
    columns = kinds.join(counts, ["path", "ordinal"], "left")
    columns = kept(columns.na.fill(0, ["rows", "missing", "distinct"]), "csv-columns")

    named = kinds.withColumnRenamed("path", "table_name")
    likely = tables.resolve_player_column(named).join(tables.resolve_date_column(named), "table_name").withColumnRenamed("table_name", "path")
    player, dated = F.col("column") == F.col("player_column"), (F.col("column") == F.col("date_column")) & F.col("kind").isin("string", "date", "timestamp")
    day = lambda c: F.coalesce(F.date_format(F.max(F.when(dated, F.col(c))), "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    listing = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column"))), lambda x: x["column"]), ";")
    found = columns.join(likely, "path").groupBy("path").agg(
        F.first("player_column").alias("player_column"), F.first("date_column").alias("date_column"),
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns"), listing.alias("column_names"), F.max(F.when(player, F.col("distinct"))).alias("unique_players"),
        day("first").alias("first_date"), day("last").alias("last_date"), F.sum("missing").alias("total_missing_cells"),
    )
    found = found.withColumn("missing_fraction", F.coalesce(F.expr("try_divide(total_missing_cells, rows * columns)"), F.lit(0.0)))
    found = found.join(duplicates(typed), "path", "left").na.fill(0, ["duplicate_rows"]).withColumn("error", F.lit(""))
    failed = broken.select("path", *[F.lit("").alias(c) for c in ("player_column", "date_column", "column_names", "first_date", "last_date")], *[F.lit(0).cast("long").alias(c) for c in ("rows", "columns", "total_missing_cells", "duplicate_rows")], F.lit(0.0).alias("missing_fraction"), F.lit(None).cast("long").alias("unique_players"), "error")
    order = [
        "path", "player_column", "date_column", "rows", "columns", "column_names", "unique_players", "first_date", "last_date",
        "total_missing_cells", "missing_fraction", "duplicate_rows", "error",
    ]
    missing = F.col("missing").alias("missing_count")
    share = F.coalesce(F.expr("try_divide(missing, rows)"), F.lit(0.0)).alias("missing_fraction")
    return found.select(*order).unionByName(failed.select(*order)), columns.select("path", "ordinal", "column", F.col("kind").alias("dtype"), "rows", missing, share, F.col("distinct").alias("unique_non_null_values"))


def duplicates(typed: DataFrame) -> DataFrame:
    """Rows beyond the first of each in every table of ``typed`` ``(path, values)``: counted by hash, compared where hashes meet."""
    hashed = typed.withColumns({f"h{k}": tables.row_hash([F.col("path"), F.col("values")], k) for k in (1, 2)})
    shared = hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    met = hashed.join(shared, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "path", "values").agg((F.count(F.lit(1)) - 1).alias("more"))
    return met.groupBy("path").agg(F.sum("more").alias("duplicate_rows"))


def with_listing(listed: DataFrame, profile: DataFrame, how: str = "left") -> DataFrame:
    """``profile`` with the names of its files."""
    return listed.select("path", "filename", "category", "table_name").join(profile, "path", how)


def totals(found: DataFrame) -> DataFrame:
    """One row over all tables: how many, how many could be read, their categories, rows, cells that are missing and rows that repeat."""
    good = F.col("error") == ""
    whole = {"rows": "total_rows", "total_missing_cells": "total_missing_cells", "duplicate_rows": "total_duplicate_rows"}
    return found.agg(
        F.count(F.lit(1)).alias("tables"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"), F.count_distinct(F.when(good, F.col("category"))).alias("categories"),
        *[F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0)).alias(n) for c, n in whole.items()],
        F.count_if(F.col("player_column") != "").alias("with_player_column"), F.count_if(F.col("date_column") != "").alias("with_date_column"),
    )
