"""Deterministic samples and heads; all of them optional in the audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.scalars import spread_kept


#: Counts of files, under 300 bytes each, that may be broadcast.
BROADCAST_FILES = 200_000


def at_least(value: float, least: float, name: str, strict: bool = False) -> None:
    if value < least or strict and value == least:
        raise ValueError(f"{name} must be {'over' if strict else 'at least'} {least}, not {value}")


def ranked_files(catalog: DataFrame) -> DataFrame:
    """``catalog`` with its rank (from 0) in its team and year, and that group's size."""
    group = Window.partitionBy("team", "year")
    order = group.orderBy("date", "player_id", "filename", "path")
    return catalog.withColumns({"group_rank": F.row_number().over(order) - 1, "group_size": F.count(F.lit(1)).over(group)})


def spread_files(catalog: DataFrame, wanted: int) -> DataFrame:
    """Evenly spaced files of each team and year; all of a group that has no more than ``wanted``."""
    at_least(wanted, 1, "wanted")
    kept = spread_kept(F.col("group_rank"), F.col("group_size"), wanted)
    return ranked_files(catalog).where(kept).drop("group_rank", "group_size")


def rows_per_file(sensor: DataFrame, file: str = "file") -> DataFrame:
    return sensor.groupBy(file).agg(F.count(F.lit(1)).alias("total_rows"))


def spread_rows(sensor: DataFrame, wanted: int, file: str = "file", pos: str = "pos") -> DataFrame:
    """Evenly spaced rows of each file.

    Up to ``BROADCAST_FILES`` files the rows are filtered where they are and only
    the counts per file move; beyond, rows meet their count in a shuffle.
    """
    at_least(wanted, 2, "wanted")
    counts = rows_per_file(sensor, file)
    few = counts.count() <= BROADCAST_FILES
    counted = sensor.join(F.broadcast(counts) if few else counts, file)
    return counted.where(spread_kept(F.col(pos), F.col("total_rows"), wanted))


def contiguous_block(sensor: DataFrame, start: int, rows: int, pos: str = "pos") -> DataFrame:
    at_least(start, 0, "start")
    at_least(rows, 2, "rows")
    return sensor.where((F.col(pos) >= start) & (F.col(pos) < start + rows))


def head_rows(sensor: DataFrame, n: int, file: str = "file", pos: str = "pos") -> DataFrame:
    """The first ``n`` rows of each file."""
    at_least(n, 1, "n")
    return sensor.withColumn("nth", F.row_number().over(Window.partitionBy(file).orderBy(pos))).where(F.col("nth") <= n).drop("nth")
