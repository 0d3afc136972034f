"""The audits as users call them, over files that are written from the test tables first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark import schemas
from fieldmark.functions import scalars
from fieldmark.operators import outcomes as out
from fieldmark.plans import audits
from fieldmark.queries.fixtures import BRIDGED, LABELLED, MEDIANS, MODES, SENSOR, documents_cut, documents_labelled, orders_as_report, r6, register, sensor
from fieldmark.sources import readers
from fieldmark.sources.shared import fresh_folder

#: Files of a user are one recording. They store the heart rate as numbers, whole numbers or text in turn, and every tenth lacks it.
LACKS = "file % 10 = 9"


def recordings(spark, d) -> str:
    """One recording a user of ``events``, as an archive has them; the other channels repeat the speed."""
    root = fresh_folder(spark, "recordings")
    rows = sensor(spark, d).withColumns({c: F.col("speed") for c in schemas.SENSOR_VALUES if c not in ("lat", "lon", "speed", "heart_rate")})

    def write(parts: list[pa.RecordBatch]) -> str:
        group = pa.Table.from_batches(parts)
        user, team = group.column("file")[0].as_py(), group.column("team")[0].as_py()
        rate = group.column("heart_rate").to_numpy()
        rate = pa.array(rate, pa.float64(), from_pandas=True)
        columns = {c: group.column(c) for c in schemas.SENSOR_COLUMNS}
        columns["heart_rate"] = (rate, rate.cast(pa.int32()), rate.cast(pa.int64()).cast(pa.string()))[user % 3]
        if user % 10 == 9:
            columns.pop("heart_rate")
        path = f"{root}/{team}/2020-01-{user % 28 + 1:02d}-{team}-{user}.parquet"
        with readers.opened_for_writing(path) as sink:
            pq.write_table(pa.table(columns), sink, use_dictionary=False)
        return path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            users, paths = batch.column("file").to_numpy(), []
            edges = [0, *(np.flatnonzero(users[1:] != users[:-1]) + 1).tolist(), len(users)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if held and held[0].column("file")[0].as_py() != users[lo]:
                    paths.append(write(held))
                    held = []
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([write(held)], pa.string())], ["path"])

    # a file's rows lie together in order, so a task writes many files without a group of Python's for each
    rows.repartition("file").sortWithinPartitions("file", "pos").mapInArrow(run, "path string").count()
    return root


def named(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.col("player_id"), *columns)


FAILED = f"CASE WHEN {LACKS} THEN 'missing columns: heart_rate' ELSE '' END AS error"


def or_zero(expr: str, name: str) -> str:
    return f"CASE WHEN {LACKS} THEN 0 ELSE {expr} END AS {name}"


@register("plan_cadence_audit", f"""WITH {SENSOR}, {BRIDGED}, {MEDIANS}, {MODES},
  base AS (SELECT file, min(player_id) AS player_id, count(*) AS n, count(time_us) AS ok, count(*) FILTER (WHERE heart_rate = 0) AS z FROM sensor GROUP BY file),
  steps AS (SELECT b.file, count(*) FILTER (WHERE d > 0) AS pos, count(*) FILTER (WHERE d < 0) AS neg, count(*) FILTER (WHERE d > m * 2) AS gaps FROM bridged b LEFT JOIN medians USING (file) GROUP BY b.file)
  SELECT player_id, {or_zero('n', 'rows_inspected')}, {or_zero('ok', 'valid_timestamp_rows')}, {or_zero('z', 'heart_rate_zero_rows')}, {or_zero('coalesce(pos, 0)', 'positive_intervals')}, {or_zero('coalesce(neg, 0)', 'backward_intervals')},
    {or_zero('coalesce(gaps, 0)', 'large_gap_count')}, {or_zero('round(m / 1000000.0, 6)', 'median_interval_seconds')}, {or_zero('mode_interval_seconds', 'mode_interval_seconds')}, {FAILED}
  FROM base LEFT JOIN steps USING (file) LEFT JOIN medians USING (file) LEFT JOIN modes USING (file)""")  # fmt: skip
def _(spark, d):
    files = audits.cadence_audit(spark, recordings(spark, d), multiplier=2.0)["files"]
    counts = "rows_inspected", "valid_timestamp_rows", "heart_rate_zero_rows", "positive_intervals", "backward_intervals", "large_gap_count"
    return named(files, *counts, r6("median_interval_seconds").alias("median_interval_seconds"), "mode_interval_seconds", "error")


CELLS = ["player_name", "time", "lat", "lon", "heart_rate", *["speed"] * 12]
MISSING = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in CELLS)


@register("plan_value_audit", f"""WITH {SENSOR}, base AS (SELECT file, min(player_id) AS player_id, count(*) AS n, sum({MISSING}) AS miss, count(*) FILTER (WHERE heart_rate < 30 OR heart_rate > 240) AS rate, count(*) FILTER (WHERE speed < 0) AS slow FROM sensor GROUP BY file)
  SELECT player_id, {or_zero('n', 'rows_sampled')}, CAST({or_zero('miss', 'm').removesuffix(' AS m')} AS BIGINT) AS missing_cells, {or_zero('rate', 'suspicious_heart_rate_rows')}, {or_zero('slow', 'negative_speed_rows')}, {FAILED} FROM base""")  # fmt: skip
def _(spark, d):
    files = audits.value_audit(spark, recordings(spark, d))["files"]
    return named(files, "rows_sampled", "missing_cells", "suspicious_heart_rate_rows", "negative_speed_rows", "error")


@register("plan_value_columns", f"""WITH {SENSOR} SELECT player_id, count(heart_rate) AS "count", count(*) - count(heart_rate) AS missing, min(heart_rate) AS minimum, max(heart_rate) AS maximum, median(heart_rate) AS median
  FROM sensor WHERE NOT ({LACKS}) GROUP BY player_id""")  # fmt: skip
def _(spark, d):
    """The profile of the channel that files store in three types."""
    columns = audits.value_audit(spark, recordings(spark, d))["columns"].where("column = 'heart_rate'")
    name = scalars.filename_part(scalars.file_name(F.col("file")), 3)
    return columns.select(name.alias("player_id"), "count", "missing", "minimum", "maximum", "median")


@register("plan_multiplicity_audit", f"""WITH {SENSOR}, base AS (SELECT file, min(player_id) AS player_id, count(*) AS n, count(DISTINCT time_us) AS u, count(*) - count(time_us) AS bad FROM sensor GROUP BY file)
  SELECT player_id, {or_zero('n', 'rows_inspected')}, {or_zero('u', 'unique_timestamps')}, {or_zero('bad', 'invalid_timestamp_rows')}, {FAILED} FROM base""")  # fmt: skip
def _(spark, d):
    files = audits.multiplicity_audit(spark, recordings(spark, d))["files"]
    return named(files, "rows_inspected", "unique_timestamps", "invalid_timestamp_rows", "error")


@register("plan_archive_inventory", "SELECT CASE WHEN user_id % 2 = 0 THEN 'TeamA' ELSE 'TeamB' END AS team, count(DISTINCT user_id) AS files FROM events GROUP BY 1")
def _(spark, d):
    return audits.archive(spark, recordings(spark, d))["files_by_team"]


@register("plan_schema_frequency", f"""SELECT count(DISTINCT user_id) AS files FROM events GROUP BY CASE WHEN {LACKS.replace('file', 'user_id')} THEN 3 ELSE user_id % 3 END""")
def _(spark, d):
    return audits.schema_audit(spark, recordings(spark, d))["frequency"].select("files")


def reports(spark, d) -> str:
    """The labelled documents as one CSV a source, each in a folder of its own."""
    root = fresh_folder(spark, "reports")
    labelled = scalars.nan_as_null(documents_labelled(spark, d))
    labelled.repartition("source").write.partitionBy("source").option("header", True).csv(root)
    return root


@register("plan_subjective_audit", f"""WITH {LABELLED} SELECT 'source=' || source AS category, count(*) AS rows, 5 AS columns, count(DISTINCT lang) AS languages, CAST(sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END + CASE WHEN toxic IS NULL THEN 1 ELSE 0 END + CASE WHEN score IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS total_missing_cells, 0 AS duplicate_rows
  FROM documents_labelled GROUP BY source""")  # fmt: skip
def _(spark, d):
    found = audits.subjective_audit(spark, reports(spark, d))
    languages = found["columns"].where("column = 'lang'").select("path", F.col("unique_non_null_values").alias("languages"))
    return found["tables"].join(languages, "path").select("category", "rows", "columns", "languages", "total_missing_cells", "duplicate_rows")


WANTED = ["doc_id", "text", "quality"]


@register("check_table_columns", f"""WITH wanted AS (SELECT unnest({WANTED}) AS name), tables AS (SELECT table_name, list(column_name) AS have FROM information_schema.columns
    WHERE table_name IN ('documents', 'labels', 'benchmark', 'pages', 'orders', 'events') GROUP BY table_name)
  SELECT table_name, coalesce(string_agg(name, ', ' ORDER BY name) FILTER (WHERE NOT list_contains(have, name)), '') AS missing FROM tables CROSS JOIN wanted GROUP BY table_name""")  # fmt: skip
def _(spark, d):
    """The required-column check on the footers of the tables themselves."""
    lacks = out.missing_columns(WANTED, readers.footer_catalog(spark, d))
    name = F.regexp_extract("path", r"/(documents|labels|benchmark|pages|orders|events)\.parquet", 1)
    return lacks.select(name.alias("table_name"), F.array_join("missing_columns", ", ").alias("missing")).where("table_name <> ''").distinct()


@register("agg_table_rows", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS total_rows FROM {t}" for t in ("customer", "orders", "lineitem", "events", "documents", "labels")))
def _(spark, d):
    """Rows of the tables from their footers alone."""
    name = F.regexp_extract("path", r"/(customer|orders|lineitem|events|documents|labels)\.parquet", 1)
    return readers.footer_catalog(spark, d).groupBy(name.alias("name")).agg(F.sum("row_count").alias("total_rows")).where("name <> ''")


@register("src_csv_types_of_all", "SELECT 'documents_cut' AS name, 'lang' AS \"column\", 'string' AS dtype UNION ALL SELECT 'documents_cut', 'source', 'string' UNION ALL SELECT 'documents_cut', 'size', 'bigint' UNION ALL SELECT 'orders_as_report', 'player', 'bigint' UNION ALL SELECT 'orders_as_report', 'date', 'date' UNION ALL SELECT 'orders_as_report', 'price', 'double'")
def _(spark, d):
    """Types of the columns of several CSV tables, inferred in one pass over all of them."""
    root = fresh_folder(spark, "reports")
    for name, df in (("documents_cut", documents_cut(spark, d)), ("orders_as_report", orders_as_report(spark, d).withColumn("date", F.col("date").cast("date")))):
        df.write.option("header", True).csv(f"{root}/{name}")
    columns = audits.subjective_audit(spark, root)["columns"]
    return columns.select(F.col("category").alias("name"), "column", "dtype").distinct()
