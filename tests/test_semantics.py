"""Hand-made cases of what is easy to get wrong."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fieldmark.functions import flags, scalars
from fieldmark.operators import cadence, catalog, multiplicity, outcomes, sampling, tables, values
from fieldmark.plans import audits
from fieldmark.sources import readers, sinks


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("text", "us"),
    [("13:48:39.6", 49719600000), ("1:2:3.000001", 3723000001), ("13:48:39", None), ("24:00:00.0", None), ("00:00:60.5", 60500000), ("00:00:00.123456789", 123456), ("x", None), (None, None), ("", None)],
)
def test_time_of_day(spark, text, us):
    assert one(spark, text, scalars.time_of_day_us) == us


def test_lenient_parse_takes_clock_without_fraction(spark):
    assert one(spark, "13:48:39", scalars.parse_clock_or_timestamp) is not None
    assert one(spark, "13:48:39.6", scalars.parse_clock_or_timestamp) is not None
    assert one(spark, "nothing", scalars.parse_clock_or_timestamp) is None


@pytest.mark.parametrize(("text", "number"), [("1.5", 1.5), ("x", None), ("NaN", None), ("", None), ("-0", 0.0), (None, None)])
def test_to_numeric(spark, text, number):
    assert one(spark, text, scalars.to_numeric) == number


@pytest.mark.parametrize(("size", "text"), [(0, "0.00 B"), (1023, "1023.00 B"), (1024, "1.00 KB"), (5 << 40, "5.00 TB"), (3 << 50, "3072.00 TB")])
def test_human_size(spark, size, text):
    assert one(spark, size, scalars.human_size, "long") == text


@pytest.mark.parametrize(("size", "text"), [(128 * 9, "1.12 KB"), (128 * 11, "1.38 KB"), (128 * 13, "1.62 KB"), (9 << 37, "1.12 TB"), ((1 << 20) - 1, "1024.00 KB"), (-5, "-5.00 B"), (None, None)])
def test_human_size_rounds_half_to_even(spark, size, text):
    assert one(spark, size, scalars.human_size, "long") == text


@pytest.mark.parametrize(("path", "folder"), [("/raw/a/b/c.csv", "a/b"), ("/raw/c.csv", "."), ("/raw/a/c.csv", "a")])
def test_category(spark, path, folder):
    assert one(spark, path, lambda c: scalars.category(c, "/raw")) == folder


def test_filename_parts_keep_hyphens(spark):
    name = "2020-99-99-TeamA-1846d424-c17c.parquet"
    assert one(spark, name, lambda c: scalars.filename_part(c, 3)) == "1846d424-c17c"
    assert one(spark, "2020-01-01-teamA-x.parquet", lambda c: scalars.filename_part(c, 2)) is None


def test_rounding_is_half_even(spark):
    assert one(spark, 500, scalars.round_ms, "long") == 0.0
    assert one(spark, 1500, scalars.round_ms, "long") == 0.002


def spread(n, wanted):
    if n <= wanted:
        return list(range(n))
    return [0] if wanted == 1 else sorted({round(i * (n - 1) / (wanted - 1)) for i in range(wanted)})


def test_spread_equals_index_list(spark):
    cases = [(n, w) for n in (0, 1, 2, 3, 7, 10, 99, 100, 101, 1234) for w in (1, 2, 3, 5, 20, 100)]
    cases += [(random.Random(i).randrange(1, 5000), random.Random(-i).randrange(2, 200)) for i in range(15)]
    for n, wanted in cases:
        rows = spark.range(n).where(scalars.spread_kept(F.col("id"), F.lit(n), wanted)).orderBy("id").collect()
        assert [r.id for r in rows] == spread(n, wanted), (n, wanted)


def readings(spark, times, file=1):
    rows = [(file, i, t, 0.0 if i == 0 else 100.0, "TeamA-7", "TeamA", "7") for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "file long, pos long, time string, heart_rate double, player_name string, team string, player_id string")
    return df.withColumn("time_us", scalars.time_of_day_us(F.col("time")))


def test_intervals_bridge_or_not(spark):
    rows = readings(spark, ["00:00:01.0", None, "00:00:03.0", "00:00:02.0"])
    bridged = [r.interval_us for r in cadence.bridged_intervals(rows).orderBy("pos").collect()]
    adjacent = [r.interval_us for r in cadence.adjacent_intervals(rows).orderBy("pos").collect()]
    ordered = [r.interval_us for r in cadence.sorted_intervals(rows).orderBy("time_us").collect()]
    assert bridged == [None, 2_000_000, -1_000_000]
    assert adjacent == [None, None, None, -1_000_000]
    assert ordered == [None, 1_000_000, 1_000_000]


def test_chunks_do_not_change_intervals(spark, monkeypatch):
    times = [None if i % 7 == 0 or 20 <= i < 29 else f"00:{i * 13 % 60:02d}:01.{i}" for i in range(60)]
    rows = readings(spark, times)
    kinds = (cadence.bridged_intervals, cadence.adjacent_intervals, cadence.sorted_intervals)
    whole = [[r.interval_us for r in f(rows).orderBy("pos").collect()] for f in kinds]
    monkeypatch.setattr(cadence, "CHUNK_ROWS", 4)
    monkeypatch.setattr(cadence, "CHUNK_US", 70_000_000)
    assert [[r.interval_us for r in f(rows).orderBy("pos").collect()] for f in kinds] == whole


def test_durations_signed_and_sorted(spark):
    rows = readings(spark, ["00:00:05.0", "00:00:01.0", "00:00:02.0"])
    assert cadence.signed_duration(rows).first().block_duration_seconds == -3.0
    assert multiplicity.sorted_duration(rows).first().block_duration_seconds == 4.0
    single = readings(spark, ["00:00:05.0", None])
    assert cadence.signed_duration(single).first().block_duration_seconds is None


def test_mode_ties_go_to_first_seen(spark):
    rows = readings(spark, ["00:00:00.0", "00:00:02.0", "00:00:03.0", "00:00:05.0", "00:00:06.0"])  # 2 1 2 1
    assert cadence.mode_interval(cadence.bridged_intervals(rows)).first().mode_interval_seconds == 2.0
    tiny = readings(spark, ["00:00:00.0", "00:00:00.0002"])
    audit = cadence.file_audit(tiny).first()
    assert audit.mode_interval_seconds == 0.0 and audit.estimated_frequency_hz is None


def test_file_audit_equals_its_parts(spark):
    rows = readings(spark, ["00:00:01.0", "x", "00:00:03.0", "00:00:02.0", "00:00:02.0", "00:10:00.0"])
    audit, intervals = cadence.file_audit(rows, 2.0).first().asDict(), cadence.bridged_intervals(rows)
    for part in (cadence.interval_signs(intervals), cadence.positive_interval_stats(intervals), cadence.large_gaps(intervals, 2.0), cadence.time_validity(rows), cadence.identity_prefixed(rows), cadence.heart_rate_quality(rows), cadence.first_last_time(rows), cadence.signed_duration(rows)):
        got = part.first().asDict()
        assert got == {k: audit[k] for k in got}
    assert audit["duplicate_intervals"] + audit["backward_intervals"] + audit["positive_intervals"] == audit["valid_timestamp_rows"] - 1


def test_identity_bare_and_prefixed_disagree(spark):
    rows = readings(spark, ["00:00:01.0"])
    assert cadence.identity_prefixed(rows).first().player_name_matches is True
    assert values.identity_bare(rows).first().player_name_matches_filename is False


def test_heart_rate_zero_counts_once_only(spark):
    assert one(spark, 0.0, flags.bad_heart_rate, "double") is True
    assert one(spark, 0.0, flags.bad_heart_rate_nonzero, "double") is False


def test_null_is_one_value_inside_a_timestamp(spark):
    rows = readings(spark, ["00:00:01.0", "00:00:01.0"]).withColumn("x", F.when(F.col("pos") == 0, 1.0))
    r = multiplicity.column_variation(rows, ["x"]).first()
    assert (r.varying_groups, r.constant_groups, r.missing_rows, r.maximum_unique_values_per_timestamp) == (1, 0, 1, 2)


def test_file_without_valid_times(spark):
    r = multiplicity.file_audit(readings(spark, [None, "x"])).first()
    assert (r.unique_timestamps, r.maximum_rows_per_timestamp, r.mode_rows_per_timestamp, r.block_duration_seconds) == (0, 0, 0, None)


def test_single_value_has_no_deviation(spark):
    r = values.numeric_profile(readings(spark, ["00:00:01.0"]), ["heart_rate"], ["file"]).first()
    assert r.standard_deviation is None and r["count"] == 1


def test_columns_equal_but_for_case_last_wins(spark):
    rows = spark.createDataFrame([("t", 0, "Player"), ("t", 1, "PLAYER"), ("u", 0, "x")], "table_name string, ordinal int, column string")
    got = {r.table_name: r.player_column for r in tables.resolve_player_column(rows).collect()}
    assert got == {"t": "PLAYER", "u": ""}


def test_table_profiles(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a long, b string")
    assert tables.duplicate_rows(df).first().duplicate_rows == 1
    assert tables.table_missing(df).first() == (2, pytest.approx(2 / 6))
    assert tables.table_missing(df.limit(0)).first() == (0, 0.0)
    assert tables.date_range(df, "a").first() == ("", "")
    assert tables.unique_players(df, "").first().unique_players is None
    assert {r.column: r.unique_non_null_values for r in tables.column_inventory(df).collect()} == {"a": 2, "b": 1}


def test_arguments_are_checked(spark):
    rows = readings(spark, ["00:00:01.0"])
    for call in (lambda: sampling.spread_files(rows, 0), lambda: sampling.spread_rows(rows, 1), lambda: sampling.contiguous_block(rows, -1, 5), lambda: cadence.large_gaps(rows, 1.0)):
        with pytest.raises(ValueError):
            call()


def test_start_row_check(spark):
    rows = spark.createDataFrame([(1, 5), (2, 6)], "file long, total_rows long")
    got = {r.file: bool(r.error) for r in outcomes.with_start_check(rows, 5).collect()}
    assert got == {1: True, 2: False}


def test_archive_with_corrupt_junk_and_empty_files(spark, tmp_path):
    columns = "player_name string, time string, " + ", ".join(f"{c} double" for c in audits.schemas.SENSOR_VALUES)
    rows = [("TeamA-p1", f"00:00:0{i}.5", *[float(i)] * 15) for i in range(5)]
    for name, data in (("2020-06-01-TeamA-p1", rows), ("2020-06-02-TeamA-p1", []), ("notes", rows)):
        out = tmp_path / "work"
        spark.createDataFrame(data, columns).coalesce(1).write.mode("overwrite").parquet(str(out))
        next(out.glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
        for p in out.glob("*"):
            p.unlink()
        for p in out.glob(".*"):
            p.unlink()
    (tmp_path / "2020-06-03-TeamA-p2.parquet").write_bytes(b"damaged")
    (tmp_path / "2020-06-04-TeamA-p2.parquet").write_bytes(b"")
    root = f"file://{tmp_path}"
    found = audits.archive(spark, root)
    assert found["catalog"].count() == 4 and found["unmatched"].count() == 1
    assert found["totals"].first().players == 2
    schema = audits.schema_audit(spark, root)
    footers = {r.filename: r for r in schema["files"].collect()}
    assert schema["outcomes"].first() == (4, 2, 2, 1) and schema["frequency"].first().files == 2 and schema["definitions"].count() == 1 and schema["failures"].count() == 2
    assert schema["statistics"].first().maximum_row_count == 5
    assert footers["2020-06-01-TeamA-p1.parquet"].row_count == 5 and footers["2020-06-03-TeamA-p2.parquet"].error
    assert footers["2020-06-02-TeamA-p1.parquet"].row_count == 0 and footers["2020-06-02-TeamA-p1.parquet"].column_count == 17
    found = audits.cadence_audit(spark, root)
    r = {x.file.rsplit("/", 1)[1][:10]: x for x in found["files"].collect()}
    assert len(r) == 4 and r["2020-06-04"].error and r["2020-06-01"].mode_interval_seconds == 1.0 and r["2020-06-01"].player_name_matches and not r["2020-06-01"].error
    assert r["2020-06-02"].error == "the file has no rows" and r["2020-06-03"].error and r["2020-06-03"].player_id == "p2"
    assert all(x.rows_inspected == 0 and x.large_gap_count == 0 and x.mode_interval_seconds == 0.0 and not x.player_name_matches for k, x in r.items() if k != "2020-06-01")
    assert found["rollup"].first().files == 1
    late = {x.file.rsplit("/", 1)[1][:10]: x.error for x in audits.cadence_audit(spark, root, start=5)["files"].collect()}
    assert late["2020-06-01"] == "start row 5 is beyond the file's 5 rows"
    value = audits.value_audit(spark, root, rows_per_file=3)
    assert sorted(x.rows_sampled for x in value["files"].collect()) == [0, 0, 0, 3] and value["rollup"].first().files == 1
    multiple = audits.multiplicity_audit(spark, root, rows_per_file=4)
    assert sorted(x.unique_timestamps for x in multiple["files"].collect()) == [0, 0, 0, 4]
    for k, audit in enumerate((value, multiple, found, schema, audits.archive(spark, root))):
        audits.save(audit, f"file://{tmp_path}/saved-{k}")
        saved = sinks.published(spark, f"file://{tmp_path}/saved-{k}")
        assert {n: (x.columns, x.count()) for n, x in saved.items()} == {n: (x.columns, x.count()) for n, x in audit.items()}


def test_half_readable_file_is_an_error(spark):
    known = spark.createDataFrame([("a", "T", "p", 5, ""), ("b", "T", "q", 5, "")], "path string, team string, player_id string, row_count long, error string")
    audit = spark.createDataFrame([("a", "T", "p", 5, True), ("b", "T", "q", 3, True)], "file string, team string, player_id string, n long, ok boolean")
    got = {r.file: (r.n, r.ok, r.error) for r in audits.with_errors(audit, known, "n").collect()}
    assert got == {"a": (5, True, ""), "b": (0, False, "3 of 5 rows could be read")}
    assert {r.error for r in audits.with_errors(audit, known, "n", n=3).collect()} == {""}


def test_subjective_audit(spark, tmp_path):
    (tmp_path / "well" / "being").mkdir(parents=True)
    (tmp_path / "well" / "being" / "fatigue.csv").write_text("Player,date,score\np1,2020-01-02,1\np2,2020-01-01,NA\np2,2020-01-01,NA\n")
    (tmp_path / "notes.csv").write_text("x,y\n1,2.5\n")
    (tmp_path / "empty.csv").write_text("")
    found = audits.subjective_audit(spark, f"file://{tmp_path}")
    r = {x.table_name: x for x in found["tables"].collect()}
    f = r["fatigue"]
    assert (f.category, f.player_column, f.date_column, f.rows, f.columns, f.unique_players, f.total_missing_cells, f.duplicate_rows, f.error) == ("well/being", "Player", "date", 3, 3, 2, 2, 1, "")
    assert f.first_date.startswith("2020-01-01") and f.last_date.startswith("2020-01-02")
    assert (r["notes"].player_column, r["notes"].unique_players, r["notes"].first_date) == ("", None, "")
    assert r["empty"].error and r["empty"].rows == 0
    assert {(x.table_name, x.column): x.missing_count for x in found["columns"].collect()}["fatigue", "score"] == 2
    assert {x.category: x.tables for x in found["categories"].collect()} == {"well/being": 1, ".": 1}


def test_nan_is_null(spark):
    nan = float("nan")
    rows = readings(spark, ["00:00:01.0", "00:00:01.0", "00:00:02.0"]).withColumn("heart_rate", F.when(F.col("pos") == 0, nan).when(F.col("pos") == 2, 100.0))
    assert values.missing_cells(rows, ["heart_rate", "time"]).first().missing_cells == 2
    varied = multiplicity.column_variation(rows, ["heart_rate"]).first()
    assert (varied.varying_groups, varied.maximum_unique_values_per_timestamp, varied.missing_rows) == (0, 1, 2)
    assert cadence.heart_rate_quality(rows).first().suspicious_nonzero_heart_rate_rows == 0
    assert cadence.file_audit(rows).first().suspicious_nonzero_heart_rate_rows == 0
    table = spark.createDataFrame([(1.0,), (nan,), (None,)], "x double")
    assert tables.table_missing(table).first().total_missing_cells == 2
    assert tables.column_inventory(table).first()[3:] == (2, pytest.approx(2 / 3), 1)


def test_audits_scan_a_file_few_times(spark, tmp_path):
    """Scans and exchanges that adaptive execution really runs."""
    out = str(tmp_path / "rows")
    readings(spark, [f"00:00:{i % 60:02d}.{i}" for i in range(200)]).write.parquet(out)
    for audit, scans, exchanges in ((cadence.file_audit, 1, 8), (multiplicity.file_audit, 2, 4)):
        df = audit(spark.read.parquet(out))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        read = sum("FileScan" in x and "time_us#" in x for x in plan.splitlines())  # of the readings, not of the counted intervals
        assert read <= scans and plan.count("Exchange hashpartitioning") <= exchanges, plan


def test_listing_of_nothing_raises(spark, tmp_path):
    (tmp_path / "x.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        readers.list_files(spark, f"file://{tmp_path}")


def test_csv_missing_values_and_types(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "t.csv").write_text("player,when,n,x\np,2020-01-01,1,NA\nNULL,2020-01-02,2,1.5\n")
    listed = readers.csv_tables(spark, f"file://{tmp_path}").first()
    assert (listed.category, listed.table_name) == ("a", "t")
    df = readers.read_csv_table(spark, str(tmp_path / "a" / "t.csv"))
    assert dict(df.dtypes) == {"player": "string", "when": "date", "n": "bigint", "x": "double"}
    assert df.where("x is null").count() == 1 and df.where("player is null").count() == 1


def test_examples_without_frames_write_nothing(spark, tmp_path):
    sinks.write_examples([], str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_catalog_totals_of_nothing(spark):
    empty = spark.createDataFrame([], "path string, filename string, size_bytes long")
    assert catalog.totals(empty).first().files == 0
