"""The audits from a folder of files to their tables. Samples are optional; without one every file and row is read.

A file that cannot be read, lacks a column, has no rows, gives back fewer rows
than its footer states or ends before the start row is a row with its ``error``
and zeros. Files may store a column in different types; values are coerced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark import schemas
from fieldmark.functions import scalars
from fieldmark.operators import cadence, catalog, inventory, multiplicity, outcomes, reports, sampling, tables, values
from fieldmark.sources import readers, sinks
from fieldmark.sources.shared import kept

Tables = dict[str, DataFrame]
#: Rows up to which a file's time stamps are brought together in one task.
TASK_ROWS = 1 << 20


def archive(spark: SparkSession, root: str) -> Tables:
    """Catalogue, unmatched files and player inventory of the recordings below ``root``, and what is counted over both."""
    files = kept(readers.list_files(spark, root), "listing")
    found = catalog.matched(files)
    players = inventory.player_inventory(found)
    counts = {f"files_by_{'_'.join(k)}": catalog.counts_by(found, *k).orderBy(*k) for k in (["team"], ["year"], ["month"], ["team", "year"])}
    return {
        "catalog": catalog.ordered(found), "unmatched": catalog.unmatched(files), "totals": catalog.totals(files), **counts,
        "files_by_player": catalog.counts_by(found, "player_id").orderBy(F.desc("files"), "player_id"),
        "inventory": inventory.ordered(players), "multi_team_players": inventory.multi_team_players(found), "players_by_team": inventory.players_by_team(players).orderBy("team"),
        "session_counts": inventory.session_count_stats(players), "inventory_totals": inventory.inventory_totals(players),
    }


def chosen_files(spark: SparkSession, root: str, files_per_group: int | None = None) -> DataFrame:
    found = catalog.matched(readers.list_files(spark, root))
    return found if files_per_group is None else sampling.spread_files(found, files_per_group)


def known_files(spark: SparkSession, root: str, files_per_group: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """The chosen files with the facts of their footers; no other footer is opened.

    With ``columns``, a file that lacks one of them has an error that names it,
    and ``kind`` tells how it stores them. The table is written once and all of
    an audit starts from it.
    """
    chosen = kept(chosen_files(spark, root, files_per_group), "chosen-files")
    tasks = readers.tasks_for(spark, chosen.count())
    known = chosen.join(readers.footers(chosen.select("path").repartition(tasks, "path")), "path")
    if columns is not None:
        lacks = outcomes.lacking(columns, F.col("columns"))
        known = known.withColumn("error", F.when(F.col("error") != "", F.col("error")).otherwise(outcomes.lacking_error(lacks))).withColumn("kind", readers.kind_of(columns))
    return kept(known, "known-files")


def schema_audit(spark: SparkSession, root: str, files_per_group: int | None = None) -> Tables:
    """Footer facts and schema id of the catalogued files; unreadable ones keep their error. What is counted over them, and a text for each schema."""
    known = outcomes.with_schema_id(known_files(spark, root, files_per_group))
    good = outcomes.successes(known)
    return {
        "files": known.drop("columns").orderBy("team", "year", "date", "player_id", "path"), "outcomes": outcomes.read_outcomes(known), "statistics": outcomes.footer_stats(known),
        "frequency": outcomes.schema_frequency(known).orderBy(F.desc("files"), "schema_id"), "definitions": outcomes.schema_examples(good, "path").orderBy("schema_id"),
        "failures": outcomes.failures(known).select("path", "filename", "error"),
    }


def readings(known: DataFrame, columns: list[str], start: int = 0, rows_per_file: int | None = None, spread: int | None = None) -> DataFrame:
    """Readings of the good files of ``known`` with their place and parsed time; NaN is null.

    Whole files are scanned by kind. Of a block of rows or evenly spaced ones
    only these are read. A file's team and player come from its own path.
    """
    if rows_per_file is not None or spread is not None:
        rows = readers.parts_of(known, columns, start, rows_per_file, spread)
    else:
        rows = readers.recordings(known.sparkSession, known, columns).where(F.col("pos") >= start)
    return timed(rows)


def timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("time_us", scalars.time_of_day_us(F.col("time")))


def readings_once(known: DataFrame, columns: list[str], start: int = 0, rows_per_file: int | None = None, spread: int | None = None) -> DataFrame:
    """As ``readings``, written in one pass in which each small file is opened once: an audit goes over the rows many times, and opening files costs more than their rows."""
    if rows_per_file is not None or spread is not None:
        return kept(readings(known, columns, start, rows_per_file, spread), "readings")
    return kept(timed(readers.recordings(known.sparkSession, known, columns, open_small=True).where(F.col("pos") >= start)), "readings")


def with_errors(audit: DataFrame, known: DataFrame, count: str, start: int = 0, n: int | None = None) -> DataFrame:
    """``audit`` with a row for every one of the ``known`` files; failed ones have their ``error`` and zeros. ``count`` is the audit's number of rows."""
    facts = known.select(F.col("path").alias("file"), "team", "player_id", F.col("row_count").alias("total_rows"), F.col("error").alias("known_error"))
    facts = outcomes.with_start_check(facts.join(audit.drop("team", "player_id"), "file", "left"), start).withColumnRenamed("error", "start_error")
    left = F.col("total_rows") - start
    wanted, got = left if n is None else F.least(left, F.lit(n)), F.coalesce(count, F.lit(0))
    error = (
        F.when(F.coalesce("known_error", F.lit("")) != "", F.col("known_error"))
        .when(F.col("total_rows") == 0, "the file has no rows")
        .when(F.coalesce("start_error", F.lit("")) != "", F.col("start_error"))
        .when(got < wanted, F.format_string("%d of %d rows could be read", got, wanted))
        .otherwise("")
    )
    facts = facts.withColumn("error", error)
    failed, numbers = F.col("error") != "", [f.name for f in audit.schema if f.dataType.typeName() in ("long", "integer", "double") and f.name != "file"]
    flags = [f.name for f in audit.schema if f.dataType.typeName() == "boolean"]
    zeros = {c: F.when(failed, F.lit(0).cast(audit.schema[c].dataType)).otherwise(F.col(c)) for c in numbers} | {c: ~failed & F.col(c) for c in flags}
    return facts.withColumns(zeros).select("file", "team", "player_id", *[c for c in audit.columns if c not in ("file", "team", "player_id")], "error")


def examples(rows: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """The first ``n`` rows of each file with the keys of their file."""
    return catalog.with_keys(sampling.head_rows(rows, n)).select("file", "filename", "team", "year", "player_id", "pos", *columns)


def value_audit(spark: SparkSession, root: str, files_per_group: int | None = None, rows_per_file: int | None = None) -> Tables:
    if rows_per_file is not None:
        sampling.at_least(rows_per_file, 2, "rows_per_file")
    known = known_files(spark, root, files_per_group, schemas.SENSOR_COLUMNS)
    rows = readings_once(known, schemas.SENSOR_COLUMNS, spread=rows_per_file)
    files = kept(with_errors(values.file_audit(rows, schemas.SENSOR_COLUMNS), known, "rows_sampled", n=rows_per_file), "value-audit")
    good = outcomes.successes(files)
    most = known.agg(F.max("row_count")).first()[0]
    most = most if rows_per_file is None else min(most or 0, rows_per_file)
    return {
        "files": files, "columns": values.numeric_profile(rows, schemas.SENSOR_VALUES, ["file"], most), "examples": examples(rows, schemas.EXAMPLE_ROWS, schemas.SENSOR_COLUMNS),
        "rollup": values.rollup(good), "intervals": cadence.spread_of(good, "median_interval_seconds"),
    }


def cadence_audit(spark: SparkSession, root: str, files_per_group: int | None = None, start: int = 0, rows_per_file: int | None = None, multiplier: float = schemas.GAP_MULTIPLIER) -> Tables:
    check_block(start, rows_per_file)
    columns = ["player_name", "time", "heart_rate"]
    known = known_files(spark, root, files_per_group, columns)
    rows = readings_once(known, columns, start, rows_per_file)
    files = kept(with_errors(cadence.file_audit(rows, multiplier), known, "rows_inspected", start, rows_per_file), "cadence-audit")
    good = outcomes.successes(files)
    return {
        "files": files, "examples": examples(cadence.adjacent_intervals(rows), schemas.INTERVAL_ROWS, [*columns, "interval_us"]), "rollup": cadence.rollup(good),
        "modes": cadence.mode_histogram(good), "spread": cadence.spread_of(good, "estimated_frequency_hz", "median_interval_seconds"),
    }


def multiplicity_audit(spark: SparkSession, root: str, files_per_group: int | None = None, start: int = 0, rows_per_file: int | None = None) -> Tables:
    check_block(start, rows_per_file)
    known = known_files(spark, root, files_per_group, schemas.SENSOR_COLUMNS)
    rows = readings_once(known, schemas.SENSOR_COLUMNS, start, rows_per_file)
    files = kept(with_errors(multiplicity.file_audit(rows), known, "rows_inspected", start, rows_per_file), "multiplicity-audit")
    small = (known.agg(F.max("row_count")).first()[0] or 0) <= TASK_ROWS
    columns, good = kept(multiplicity.column_variation(rows, schemas.SENSOR_VALUES, small), "variation"), outcomes.successes(files)
    return {
        "files": files, "columns": columns, "examples": examples(rows.where(F.col("time_us").isNotNull()), schemas.VALID_ROWS, schemas.SENSOR_COLUMNS), "rollup": multiplicity.rollup(good),
        "modes": multiplicity.mode_histogram(good), "variation": multiplicity.variation_by_column(columns), "spread": cadence.spread_of(good, "unique_timestamps_per_second", "estimated_rows_per_second"),
    }


def check_block(start: int, rows_per_file: int | None) -> None:
    sampling.at_least(start, 0, "start")
    if rows_per_file is not None:
        sampling.at_least(rows_per_file, 2, "rows_per_file")


def subjective_audit(spark: SparkSession, root: str) -> Tables:
    """Every self-report CSV below ``root``: a row for each table, a row for each of its columns, tables by category and the totals of all.

    A table that cannot be read is a row with its ``error``. All tables are
    parsed by one job and profiled together; how many jobs run does not depend
    on how many tables there are.
    """
    listed = kept(readers.csv_tables(spark, root), "csv-listing")
    found, columns = reports.profiles(readers.csv_records(listed))
    of_tables = kept(reports.with_listing(listed, found), "csv-tables")
    good = outcomes.successes(of_tables)
    return {"tables": of_tables.orderBy("category", "path"), "categories": tables.category_rollup(good), "columns": reports.with_listing(listed, columns, "inner"), "totals": reports.totals(of_tables)}


def save(results: Tables, folder: str) -> None:
    """Write an audit's tables as CSV and publish them below ``folder`` in one step (``sinks.publish``)."""
    sinks.publish(results, folder)
