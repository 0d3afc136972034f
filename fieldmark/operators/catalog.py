"""The file catalogue and what is counted over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark import schemas
from fieldmark.functions import scalars


def keys_of(name: Column) -> dict[str, Column]:
    """Date, team, player, year and month from a recording's file name."""
    parts = {k: scalars.filename_part(name, i) for i, k in enumerate(("date", "team", "player_id"), 1)}
    return parts | {"year": scalars.year_of(parts["date"]), "month": scalars.month_of(parts["date"])}


def with_keys(rows: DataFrame, file: str = "file") -> DataFrame:
    """``rows`` with ``filename, team, year, player_id`` from the file's own path: nothing is joined."""
    name = scalars.file_name(F.col(file))
    keys = keys_of(name)
    return rows.withColumns({"filename": name} | {k: keys[k] for k in ("team", "year", "player_id")})


def owner(sensor: DataFrame) -> tuple[Column, Column]:
    """Aggregates by ``file``: its team and player, from the readings' columns or, once a file, from its path."""
    if {"team", "player_id"} <= set(sensor.columns):
        return F.first("team"), F.first("player_id")
    keys = keys_of(scalars.file_name(F.col("file")))
    return keys["team"], keys["player_id"]


def matched(files: DataFrame) -> DataFrame:
    """The catalogue rows of ``files`` ``(path, filename, size_bytes)`` whose names have a recording's form."""
    name = F.col("filename")
    rows = files.where(name.rlike(schemas.FILE_NAME)).withColumns(keys_of(name))
    return rows.select("path", "filename", "team", "year", "month", "date", "player_id", "size_bytes")


def unmatched(files: DataFrame) -> DataFrame:
    return files.where(~F.col("filename").rlike(schemas.FILE_NAME))


def totals(files: DataFrame) -> DataFrame:
    """One row over all ``files``: matched and unmatched files, bytes, and distinct keys of the matched.

    Files are counted by date, team and player first, and the keys of what is
    left are reduced to distinct ones before they are counted, so no set of
    keys is held in one buffer and no row is multiplied before it is grouped.
    """
    name = F.col("filename")
    keys = keys_of(name)
    named = files.select("size_bytes", name.rlike(schemas.FILE_NAME).alias("ok"), *[keys[k].alias(k) for k in ("date", "team", "player_id")])
    grouped = named.groupBy("ok", "date", "team", "player_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))
    month, year = scalars.month_of(F.col("date")), scalars.year_of(F.col("date")).cast("string")
    cells = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("teams", F.col("team")), ("years", year), ("months", month), ("dates", F.col("date")), ("players", F.col("player_id")))]
    facts = [F.col(c) for c in ("ok", "n", "bytes")]
    # the sums ride on the first of the cells
    zero = [F.lit(0).cast("long").alias(c) for c in ("n", "bytes")]
    listed = grouped.select(F.inline(F.array(F.struct(F.lit("files").alias("key"), F.lit("").alias("value"), *facts), *[F.struct(c["key"].alias("key"), c["value"].alias("value"), F.col("ok"), *zero) for c in cells])))
    distinct = listed.groupBy("key", "value", "ok").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))

    def count(key: str) -> Column:
        return F.count_if((F.col("key") == key) & F.col("ok") & F.col("value").isNotNull()).alias(key)

    def total(column: str, ok: Column) -> Column:
        return F.coalesce(F.sum(F.when((F.col("key") == "files") & ok, F.col(column))), F.lit(0))

    return distinct.agg(total("n", F.col("ok")).alias("files"), total("bytes", F.col("ok")).alias("total_bytes"), *[count(k) for k in ("teams", "years", "months", "dates", "players")], total("n", ~F.col("ok")).alias("unmatched"))


def counts_by(catalog: DataFrame, *keys: str) -> DataFrame:
    return catalog.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"))


def counts_by_sets(catalog: DataFrame) -> DataFrame:
    """Counts by team, year, month and team with year in one pass; ``grouping`` tells which."""
    sets = [["team"], ["year"], ["month"], ["team", "year"]]
    keys = [F.col(k) for k in ("team", "year", "month")]
    out = catalog.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(F.count(F.lit(1)).alias("files"), F.grouping_id().alias("grouping"))
    return out.select("grouping", "team", "year", "month", "files")


def frequency_order(counted: DataFrame, count: str, first: str) -> DataFrame:
    """Most frequent first; ties by first appearance."""
    return counted.orderBy(F.desc(count), F.asc(first))


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct().orderBy(key)


def ordered(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy("team", "year", "date", "player_id")

