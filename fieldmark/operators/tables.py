"""Profiles of self-report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions import scalars
from fieldmark.schemas import DATE_COLUMNS, PLAYER_COLUMNS


def resolve_column(columns: DataFrame, priority: list[str], out: str, table: str = "table_name") -> DataFrame:
    """The most likely column of each table of ``columns`` ``(table_name, ordinal, column)``, "" where none fits.

    Case does not matter; of two that differ in case alone the later one wins.
    """
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), F.lower("column"))
    rank = F.when(place > 0, F.struct(place.alias("p"), (-F.col("ordinal")).alias("o")))
    return columns.groupBy(table).agg(F.coalesce(F.min_by("column", rank), F.lit("")).alias(out))


def resolve_player_column(columns: DataFrame) -> DataFrame:
    return resolve_column(columns, PLAYER_COLUMNS, "player_column")


def resolve_date_column(columns: DataFrame) -> DataFrame:
    return resolve_column(columns, DATE_COLUMNS, "date_column")


def table_shape(df: DataFrame) -> DataFrame:
    names = ";".join(df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(len(df.columns)).cast("long").alias("columns"), F.lit(names).alias("column_names"))


def unique_players(df: DataFrame, player_column: str) -> DataFrame:
    """Distinct players that are not null; null where the table has no player column."""
    n = F.count_distinct(F.col(player_column).cast("string")) if player_column else F.lit(None).cast("long")
    return df.agg(n.alias("unique_players"))


def date_range(df: DataFrame, date_column: str) -> DataFrame:
    """First and last valid time as text, "" where there is none; numbers are no dates."""
    kind = dict(df.dtypes).get(date_column, "")
    if not date_column or kind not in ("string", "date", "timestamp", "timestamp_ntz"):
        return df.agg(F.lit("").alias("first_date"), F.lit("").alias("last_date"))
    at = scalars.parse_timestamp(F.col(date_column)) if kind == "string" else F.col(date_column).cast("timestamp")
    text = [F.coalesce(F.date_format(f(at), "yyyy-MM-dd HH:mm:ss"), F.lit("")) for f in (F.min, F.max)]
    return df.agg(text[0].alias("first_date"), text[1].alias("last_date"))


def table_missing(df: DataFrame) -> DataFrame:
    """Missing cells, nulls and NaN, and their share of all cells (0 where there are no cells)."""
    df = scalars.nan_as_null(df)
    cells = F.sum(sum((F.col(f"`{c}`").isNull().cast("long") for c in df.columns), F.lit(0)))
    one = df.agg(F.coalesce(cells, F.lit(0)).cast("long").alias("total_missing_cells"), (F.count(F.lit(1)) * len(df.columns)).alias("n"))
    return one.select("total_missing_cells", F.expr("coalesce(try_divide(total_missing_cells, n), 0.0D)").alias("missing_fraction"))


def row_hash(columns: list[Column], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each; nulls and NaN are equal. Rows are counted by a hash of 128 bits; only rows that share one meet as a whole and are compared."""
    df = scalars.nan_as_null(df)
    columns = [F.col(f"`{c}`") for c in df.columns]
    if not columns:
        return df.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("duplicate_rows"))
    hashes = [row_hash(columns, 1).alias("h1"), row_hash(columns, 2).alias("h2")]
    shared = df.select(*hashes).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    met = df.select(F.struct(*columns).alias("row"), *hashes).join(shared, ["h1", "h2"], "left_semi")
    groups = met.groupBy("h1", "h2", "row").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def as_text(column: Column, kind: str) -> Column:
    """A value as a text that differs where the value does; -0.0 is 0.0."""
    if kind in ("double", "float"):
        column = column + F.lit(0.0)
    elif kind == "binary":
        return F.hex(column)
    elif kind.startswith(("array", "map", "struct", "variant")):
        return F.to_json(column)
    return column.cast("string")


def column_inventory(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row a column: rows, missing values and distinct values that are not null; NaN is null.

    Distinct values are counted in two levels: cells are reduced to distinct
    ``(column, value)``, with how often each stands, and then counted. With
    ``approximate`` a sketch of bounded size takes the place of the first level.
    """
    df = scalars.nan_as_null(df)
    kinds = dict(df.dtypes)
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column string, dtype string, rows long, missing_count long, missing_fraction double, unique_non_null_values long")
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("ordinal"), as_text(F.col(f"`{c}`"), kinds[c]).alias("value")) for i, c in enumerate(df.columns)])))
    if approximate:
        counts = cells.groupBy("ordinal").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("known"), F.approx_count_distinct("value").alias("distinct"))
    else:
        values = cells.groupBy("ordinal", "value").agg(F.count(F.lit(1)).alias("n"))
        counts = values.groupBy("ordinal").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("known"), F.count("value").alias("distinct"))
    names = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype")) for i, c in enumerate(df.columns)])
    columns = df.sparkSession.range(1).select(F.inline(names))
    n, missing = F.coalesce("rows", F.lit(0)), F.coalesce(F.col("rows") - F.col("known"), F.lit(0))
    return columns.join(counts, "ordinal", "left").select(
        "column", "dtype", n.alias("rows"), missing.alias("missing_count"),
        F.when(n > 0, missing / n).otherwise(0.0).alias("missing_fraction"), F.coalesce("distinct", F.lit(0)).alias("unique_non_null_values"),
    )


def category_rollup(tables: DataFrame) -> DataFrame:
    """Tables and rows of each category."""
    return tables.groupBy("category").agg(F.count(F.lit(1)).alias("tables"), F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"))
