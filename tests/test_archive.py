"""Audits over files as they come: mixed types, missing columns, samples that open few files, many tables."""

from __future__ import annotations

import random
import statistics
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fieldmark import schemas
from fieldmark.operators import multiplicity, ranks, reports, tables, values
from fieldmark.plans import audits
from fieldmark.sources import readers, sinks


def recording(folder: Path, name: str, n: int = 20, heart_rate=None, without: str = "", row_group: int | None = None) -> None:
    rate = [100.0 + i for i in range(n)] if heart_rate is None else heart_rate
    columns = {"player_name": [name[11:].split(".")[0]] * n, "time": [f"00:00:{i % 60:02d}.{i}" for i in range(n)]} | {c: [float(i) for i in range(n)] for c in schemas.SENSOR_VALUES}
    columns["heart_rate"] = rate
    columns.pop(without, None)
    pq.write_table(pa.table(columns), folder / f"{name}.parquet", row_group_size=row_group or max(n, 1))


RATES = {"double": None, "integer": list(range(100, 120)), "float": pa.array([100.0 + i for i in range(20)], pa.float32()), "text": [str(100 + i) if i != 3 else "none" for i in range(20)]}


@pytest.mark.parametrize("first", ["integer", "missing"])
def test_files_of_many_kinds(spark, tmp_path, first):
    """Whichever kind is listed first, every file is read, coerced, or named with what it lacks."""
    order = [first, *[k for k in (*RATES, "missing") if k != first]]
    for i, kind in enumerate(order):
        recording(tmp_path, f"2020-06-{i + 1:02d}-TeamA-{kind}", heart_rate=RATES.get(kind), without="heart_rate" if kind == "missing" else "")
    root = f"file://{tmp_path}"
    for rows in (None, 20) if first == "integer" else (None,):
        for audit, count in ((audits.value_audit, "rows_sampled"), (audits.cadence_audit, "rows_inspected"), (audits.multiplicity_audit, "rows_inspected")):
            got = {r.player_id: r for r in audit(spark, root, rows_per_file=rows)["files"].collect()}
            assert {k: r.error for k, r in got.items()} == {k: "missing columns: heart_rate" if k == "missing" else "" for k in order}
            assert {k: r[count] for k, r in got.items()} == {k: 0 if k == "missing" else 20 for k in order}
    for rows in (None, 20):
        found = audits.value_audit(spark, root, rows_per_file=rows)
        of = {r.file.rsplit("-", 1)[1].split(".")[0]: r for r in found["columns"].where("column = 'heart_rate'").collect()}
        assert {k: (r["count"], r.missing, r.minimum, r.maximum) for k, r in of.items()} == {k: (19 if k == "text" else 20, int(k == "text"), 100.0, 119.0) for k in RATES}
        assert of["double"].median == 109.5 and of["text"].median == 110.0
        assert {r.player_id: r.missing_cells for r in found["files"].collect()} == dict.fromkeys(order, 0)  # a text that is no number is not missing


def plan_of(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def files_read(df) -> int:
    """Files that the scans of an executed plan have read."""
    df.collect()
    nodes, total = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            nodes.append(node.plan())
        if node.metrics().contains("numFiles"):
            total += node.metrics().apply("numFiles").value()
        kids = node.children()
        nodes += [kids.apply(i) for i in range(kids.length())]
    return total


def test_samples_open_only_their_files(spark, tmp_path):
    for day in range(1, 13):
        recording(tmp_path, f"2020-06-{day:02d}-TeamA-p{day % 3}")
    known = audits.known_files(spark, f"file://{tmp_path}", 3, schemas.SENSOR_COLUMNS)
    assert known.count() == 3
    scan = audits.readings(known, schemas.SENSOR_COLUMNS)
    assert files_read(scan.select("lat")) == 3 and scan.count() == 60
    whole = audits.readings(audits.known_files(spark, f"file://{tmp_path}", None, schemas.SENSOR_COLUMNS), schemas.SENSOR_COLUMNS)
    assert files_read(whole.select("lat")) == 12


def test_nothing_is_moved_between_scan_and_first_aggregate(spark, tmp_path):
    for i, kind in enumerate(RATES):
        recording(tmp_path, f"2020-06-{i + 1:02d}-TeamA-{kind}", heart_rate=RATES[kind])
    known = audits.known_files(spark, f"file://{tmp_path}", None, schemas.SENSOR_COLUMNS)
    rows = audits.readings(known, schemas.SENSOR_COLUMNS)
    for df in (rows.groupBy("file").agg(F.count("lat")), values.missing_cells(rows, ["lat"])):
        below = plan_of(df).split("HashAggregate")[-1]
        assert "Exchange" not in below and "Join" not in below and "FileScan" in below


def test_special_names_are_no_patterns(spark, tmp_path):
    recording(tmp_path, "2020-06-01-TeamA-p[1]{a,b}")
    recording(tmp_path, "2020-06-02-TeamA-p 1%20x")
    got = audits.cadence_audit(spark, f"file://{tmp_path}")["files"].collect()
    assert sorted((r.player_id, r.rows_inspected, r.error) for r in got) == [("p 1%20x", 20, ""), ("p[1]{a,b}", 20, "")]


def test_blocks_equal_a_filter(spark, tmp_path):
    recording(tmp_path, "2020-06-01-TeamA-p1", n=100, row_group=7)
    recording(tmp_path, "2020-06-02-TeamA-p1", n=100)
    known = audits.known_files(spark, f"file://{tmp_path}", None, schemas.SENSOR_COLUMNS)
    whole = sorted(readers.recordings(spark, known, schemas.SENSOR_COLUMNS).select("file", "pos", "lat", "time", "raw_missing").collect())
    for start, rows in ((0, 10), (37, 25), (95, 10), (0, 100)):
        part = readers.parts_of(known, schemas.SENSOR_COLUMNS, start, rows)
        assert sorted(part.select("file", "pos", "lat", "time", "raw_missing").collect()) == [r for r in whole if start <= r.pos < start + rows]


def test_blocks_read_no_later_batch(tmp_path, monkeypatch):
    recording(tmp_path, "2020-06-01-TeamA-p1", n=50_000)
    path, read = f"file:{tmp_path}/2020-06-01-TeamA-p1.parquet", []
    real = pq.ParquetFile.iter_batches

    def watched(self, *a, **k):
        for batch in real(self, *a, **k):
            read.append(len(batch))
            yield batch

    monkeypatch.setattr(pq.ParquetFile, "iter_batches", watched)
    got = list(readers.some_rows(path, ["lat"], readers.wanted_rows(50_000, 5000, 10_000, None), 1000))
    assert sum(len(p) for p, _ in got) == 10_000 and sum(read) == 15_000


def test_evenly_spaced_rows_equal_the_row_filter(spark, tmp_path):
    from fieldmark.operators import sampling

    for i, n in enumerate((1, 2, 5, 10, 137)):
        recording(tmp_path, f"2020-06-{i + 1:02d}-TeamA-p", n=n)
    known = audits.known_files(spark, f"file://{tmp_path}", None, schemas.SENSOR_COLUMNS)
    whole = sampling.spread_rows(readers.recordings(spark, known, schemas.SENSOR_COLUMNS), 10)
    part = readers.parts_of(known, schemas.SENSOR_COLUMNS, spread=10)
    assert sorted(part.select("file", "pos", "lat").collect()) == sorted(whole.select("file", "pos", "lat").collect())


def test_medians_by_rank(spark, monkeypatch):
    rng = random.Random(3)
    groups = {"empty": [None] * 3, "one": [4.0], "two": [1.0, 2.0], "ties": [5.0] * 999 + [7.0], "wide": [rng.uniform(-1e9, 1e9) for _ in range(5000)], "steps": [float(i % 7) for i in range(3001)], "signs": [-0.0, 0.0, -1.0, float("nan")]}
    df = spark.createDataFrame([(k, v, -v if v is not None else None) for k, vs in groups.items() for v in vs], "file string, x double, y double").repartition(4)
    want = {k: [v for v in vs if v is not None and v == v] for k, vs in groups.items()}
    for off in (False, True):
        if off:  # a sketch that brackets wrongly must not decide
            monkeypatch.setattr(values, "brackets", lambda columns: [F.array(F.max(x), F.max(x)).alias(f"{c}:bracket") for c, x in columns.items()])
        got = {(r.file, r.column): r.median for r in values.numeric_profile(df, ["x", "y"], ["file"]).collect()}
        assert got == {(k, c): None if not v else (statistics.median(v) if c == "x" else -statistics.median(v)) for k, v in want.items() for c in "xy"}
    whole = values.numeric_profile(df, ["x"], ["file"])
    assert "percentile(" not in plan_of(whole) and "median(" not in plan_of(whole)


def test_weighted_medians(spark):
    rng = random.Random(4)
    rows = [(g, v, rng.randrange(1, 9)) for g in range(20) for v in rng.sample(range(10**6), 1 + g * 7)]
    df = spark.createDataFrame(rows, "g int, v long, n long").repartition(3)
    got = {r.g: r.median for r in ranks.weighted_medians(df, ["g"], "v", "n", F.floor(F.col("v") / 1000)).collect()}
    assert got == {g: statistics.median([v for h, v, n in rows if h == g for _ in range(n)]) for g in range(20)}


def test_weak_hashes_do_not_decide(spark, monkeypatch):
    df = spark.createDataFrame([(i % 37, None if i % 5 else "x", float(i % 3)) for i in range(500)], "a int, b string, c double")
    want = 500 - df.distinct().count()
    for bits in (64, 1, 0):
        monkeypatch.setattr(tables, "row_hash", lambda columns, seed, bits=bits: F.xxhash64(F.lit(seed), *columns) if bits == 64 else F.pmod(F.xxhash64(*columns), F.lit(bits + 1)))
        assert tables.duplicate_rows(df).first().duplicate_rows == want
        typed = df.select(F.lit("t").alias("path"), F.array(F.col("a").cast("string"), "b", F.col("c").cast("string")).alias("values"))
        assert reports.duplicates(typed).first().duplicate_rows == want


def test_distinct_counts_without_expand(spark):
    df = spark.createDataFrame([(i % 7, None if i % 3 else f"v{i % 11}", -0.0 if i % 2 else 0.0, [i % 2]) for i in range(100)], "a int, b string, c double, d array<int>")
    got = tables.column_inventory(df)
    assert {r.column: (r.rows, r.missing_count, r.unique_non_null_values) for r in got.collect()} == {"a": (100, 0, 7), "b": (100, 66, 11), "c": (100, 0, 1), "d": (100, 0, 2)}
    assert "Expand" not in plan_of(got)
    assert {r.column: r.unique_non_null_values for r in tables.column_inventory(df, approximate=True).collect()} == {"a": 7, "b": 11, "c": 1, "d": 2}
    assert [tuple(r) for r in tables.column_inventory(df.limit(0)).where("column = 'a'").collect()] == [("a", "int", 0, 0, 0.0, 0)]


def csv_folder(folder: Path, n: int) -> None:
    for i in range(n):
        (folder / f"c{i % 5}").mkdir(exist_ok=True)
        (folder / f"c{i % 5}" / f"t{i}.csv").write_text(f"player,date,score,note\np{i},2020-01-{i % 28 + 1:02d},{i},\"a\nb\"\np{i},2020-01-01,1.5,NA\np{i},2020-01-01,1.50,NA\n")


def jobs(spark, f) -> int:
    spark.sparkContext.setJobGroup(name := f"count-{random.random()}", "")
    try:
        f()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_many_tables_take_no_more_jobs(spark, tmp_path):
    counts, found = [], None
    for n in (2, 100):
        folder = tmp_path / str(n)
        folder.mkdir()
        csv_folder(folder, n)

        def run(folder=folder):
            nonlocal found
            found = audits.subjective_audit(spark, f"file://{folder}")
            found["tables"].collect()

        counts.append(jobs(spark, run))
    assert counts[1] <= counts[0] + 12, counts  # listing and adaptive plans differ by a few, not by the tables
    got = {r.table_name: r for r in found["tables"].collect()}
    assert len(got) == 100 and not any(r.error for r in got.values())
    r = got["t7"]
    assert (r.category, r.rows, r.columns, r.column_names, r.player_column, r.unique_players, r.date_column, r.first_date, r.last_date) == ("c2", 3, 4, "player;date;score;note", "player", 1, "date", "2020-01-01 00:00:00", "2020-01-08 00:00:00")
    assert (r.total_missing_cells, r.missing_fraction, r.duplicate_rows) == (2, pytest.approx(2 / 12), 1)  # 1.5 and 1.50 are one value
    kinds = {r.column: (r.dtype, r.unique_non_null_values, r.missing_count) for r in found["columns"].where("table_name = 't7'").collect()}
    assert kinds == {"player": ("string", 1, 0), "date": ("date", 2, 0), "score": ("double", 2, 0), "note": ("string", 1, 2)}
    total = found["totals"].first()
    assert (total.tables, total.failed, total.categories, total.total_rows, total.total_missing_cells) == (100, 0, 5, 300, 200)


def test_odd_tables(spark, tmp_path):
    texts = {
        "ragged": "a,b\n1,2\n1,2,3\n", "short": "a,b,c\n1\n2,3\n", "header": "player,date\n", "blank": "\n\na,b\n\n1,2\n \n3,4\n", "twice": "a,a,,a\n1,2,3,4\n",
        "kinds": "i,d,b,t,ts,s,none,mix\n1,1.5,true,2020-01-01,2020-01-01 10:00:00,x,NA,1\n-2,2,false,2020-01-02,2020-01-02 11:00:00,7,,x\n", "zeros": "x\n-0.0\n0.0\n0\n",
        "unicode": "﻿player,é\np,ü\n", "long": "x\n" + "y" * 300_000 + "\n", "nothing": "",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    (tmp_path / "bytes.csv").write_bytes(b"a,b\n\xff\xfe,1\n")
    found = audits.subjective_audit(spark, f"file://{tmp_path}")
    got = {r.table_name: r for r in found["tables"].collect()}
    assert {k for k, r in got.items() if r.error} == {"ragged", "nothing", "bytes"} and "3 fields" in got["ragged"].error
    assert all((r.rows, r.columns, r.category, r.duplicate_rows) == (0, 0, ".", 0) and r.unique_players is None for r in got.values() if r.error)
    assert (got["short"].rows, got["short"].total_missing_cells) == (2, 3)
    assert (got["header"].rows, got["header"].columns, got["header"].missing_fraction, got["header"].player_column, got["header"].unique_players, got["header"].first_date) == (0, 2, 0.0, "player", 0, "")
    assert (got["blank"].rows, got["twice"].column_names, got["unicode"].column_names) == (2, "a;a.1;Unnamed: 2;a.2", "player;é")
    assert got["zeros"].duplicate_rows == 2 and got["long"].rows == 1
    kinds = {r.column: r.dtype for r in found["columns"].where("table_name = 'kinds'").collect()}
    assert kinds == {"i": "bigint", "d": "double", "b": "boolean", "t": "date", "ts": "timestamp", "s": "string", "none": "string", "mix": "string"}
    assert (found["totals"].first().succeeded, found["totals"].first().failed) == (8, 3)


def test_types_equal_those_of_a_table_alone(spark, tmp_path):
    """The lattice over all tables and the reader of one table agree."""
    rng = random.Random(5)
    pool = ["1", "-3", "2.5", "1e3", "true", "False", "2020-02-01", "2020-02-01 01:02:03", "x", "NA", "", "007", "yes"]
    for i in range(12):
        lines = [",".join(rng.choice(pool[k % 3 * 4 : k % 3 * 4 + 5]) for k in range(4)) for _ in range(4)]
        (tmp_path / f"t{i}.csv").write_text("a,b,c,d\n" + "\n".join(lines) + "\n")
    got = {}
    for r in audits.subjective_audit(spark, f"file://{tmp_path}")["columns"].collect():
        got.setdefault(r.table_name, {})[r.column] = r.dtype
    assert got == {f"t{i}": dict(readers.read_csv_table(spark, f"{tmp_path}/t{i}.csv").dtypes) for i in range(12)}


def test_failed_audit_leaves_the_last_one(spark, tmp_path):
    folder = f"file://{tmp_path}/saved"
    good = spark.createDataFrame([(1, 'a,"b"\nc', None), (2, "x", 1.5)], "k long, s string, x double")
    audits.save({"one": good, "two": good.limit(1)}, folder)
    bad = good.withColumn("k", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        audits.save({"one": good.limit(0), "two": good, "three": bad}, folder)
    now = sinks.published(spark, folder)
    assert sorted(now) == ["one", "two"] and sorted(now["one"].collect()) == sorted(good.collect()) and now["two"].count() == 1
    audits.save({"one": good.limit(0)}, folder)
    assert list(sinks.published(spark, folder)) == ["one"] and sinks.published(spark, folder)["one"].count() == 0
    assert len(sinks.forget(spark, folder)) == 2 and sinks.published(spark, folder)["one"].dtypes == good.dtypes
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, f"file://{tmp_path}/nothing")
    with pytest.raises(ValueError):
        audits.save({}, folder)


def test_summaries_of_catalogue_and_players(spark, tmp_path):
    for day, team, player in ((1, "A", "p1"), (2, "A", "p1"), (1, "B", "p1"), (3, "B", "p2")):
        recording(tmp_path, f"2020-0{day}-01-Team{team}-{player}", n=2)
    recording(tmp_path, "notes", n=2)
    found = audits.archive(spark, f"file://{tmp_path}")
    assert [tuple(r) for r in found["files_by_team"].collect()] == [("TeamA", 2), ("TeamB", 2)] and [tuple(r) for r in found["files_by_team_year"].collect()] == [("TeamA", 2020, 2), ("TeamB", 2020, 2)]
    assert [tuple(r) for r in found["files_by_player"].collect()] == [("p1", 3), ("p2", 1)] and [tuple(r) for r in found["multi_team_players"].collect()] == [("p1", 2, "TeamA;TeamB")]
    total = found["totals"].first()
    assert (total.files, total.teams, total.years, total.months, total.dates, total.players, total.unmatched) == (4, 2, 1, 3, 3, 2, 1)
    assert tuple(found["session_counts"].first()) == (1, 2, pytest.approx(4 / 3)) and tuple(found["inventory_totals"].first()) == (2, 3, 1)
    assert [tuple(r) for r in found["players_by_team"].collect()] == [("TeamA", 1), ("TeamB", 2)]


def test_an_audit_opens_small_files_once(spark, tmp_path, monkeypatch):
    """Its tables come from what was read once, equal to what scans give, and damaged files are told."""
    for i, (kind, rate) in enumerate(RATES.items()):
        recording(tmp_path, f"2020-06-{i + 1:02d}-TeamA-{kind}", heart_rate=rate)
    recording(tmp_path, "2020-06-09-TeamA-p 1%20x")
    root = f"file://{tmp_path}"
    columns = audits.value_audit(spark, root)["columns"]
    assert not [f for f in columns.inputFiles() if str(tmp_path) in f]
    known = audits.known_files(spark, root, None, schemas.SENSOR_COLUMNS)
    order = ["file", "pos", "raw_missing", "time_us", *schemas.SENSOR_COLUMNS]
    want = sorted(audits.readings(known, schemas.SENSOR_COLUMNS, 3).select(order).collect(), key=repr)
    assert sorted(audits.readings_once(known, schemas.SENSOR_COLUMNS, 3).select(order).collect(), key=repr) == want and len(want) == 17 * 5
    monkeypatch.setattr(readers, "SMALL_FILE", 0)
    assert sorted(audits.readings_once(known, schemas.SENSOR_COLUMNS, 3).select(order).collect(), key=repr) == want


def test_tasks_grow_with_the_files(spark):
    assert [readers.tasks_for(spark, n) for n in (0, 2, 1000)] == [1, 2, 4]
    assert readers.tasks_for(spark, 540_000) == 1080 and readers.tasks_for(spark, 100, 100 << 25) == 25


def test_files_of_few_rows_need_no_sketch(spark, tmp_path):
    recording(tmp_path, "2020-06-01-TeamA-p1")
    plan = audits.value_audit(spark, f"file://{tmp_path}")["columns"]._jdf.queryExecution().toString()
    assert "bracket" not in plan and "median" in plan


def test_a_clock_text_is_not_tried_as_a_date(spark):
    from fieldmark.functions import scalars

    texts = ["13:48:39.6", "2020-01-02 03:04:05", "2020-01-02T03:04:05.5", "2020-01-02", " 2020-01-02 ", "-", "20200102", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "v string").select(scalars.parse_timestamp(F.col("v")).cast("string")).collect()]
    assert got == [None, "2020-01-02 03:04:05", "2020-01-02 03:04:05.5", "2020-01-02 00:00:00", "2020-01-02 00:00:00", None, None, None, None]
    plan = spark.createDataFrame([("x",)], "v string").select(scalars.parse_timestamp(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert "contains" in plan.lower()


def test_tasks_list_folders_as_a_scan_does(spark, tmp_path, monkeypatch):
    """Hidden names are passed over, files of 0 bytes are not, and the driver asks for no names."""
    for name in ("a/x.parquet", "a/b c%20/[y].parquet", "_hidden/z.parquet", ".dot/z.parquet", "_k=1/z.parquet", "a/_tmp.parquet", "a/.x.parquet", "a/x.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"abc")
    root = f"file://{tmp_path}"
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root)
    want = sorted((r.path, r.length) for r in scan.select("path", "length").collect())
    (tmp_path / "empty.parquet").touch()
    (tmp_path / "none").mkdir()
    monkeypatch.setattr(type(scan), "inputFiles", lambda self: 1 / 0)
    for given in (root, str(tmp_path), f"{root}/"):
        got = sorted((r.path, r.size_bytes) for r in readers.list_files(spark, given).collect())
        assert got == sorted([*want, (f"file:{tmp_path}/empty.parquet", 0)])
    monkeypatch.undo()
    for given in (f"{root}/a", f"{root}/[a]"):  # a pattern is left to a scan
        assert sorted(r.filename for r in readers.list_files(spark, given).collect()) == ["[y].parquet", "x.parquet"]


def test_written_recordings_need_no_group_of_python(spark, tmp_path, monkeypatch):
    """A user's rows over several batches make one file, in order."""
    from pyspark.sql import GroupedData

    from fieldmark.queries import archives

    rows = "SELECT id AS event_id, timestamp'2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts, id * id % 7 AS user_id, CAST(id AS DOUBLE) AS value FROM range(200)"
    spark.sql(rows).repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda *a: 1 / 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        root = archives.recordings(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    known = audits.known_files(spark, root, None, ["time"])
    got = {}
    for r in audits.readings(known, ["time"]).orderBy("file", "pos").collect():
        got.setdefault(int(r.file.rsplit("-", 1)[1].split(".")[0]), []).append(r.time and int(r.time[3:5]) * 60 + int(r.time[6:8]))
    assert got == {u: [None if i % 101 == 0 else i for i in range(200) if i * i % 7 == u] for u in (0, 1, 2, 4)}


@pytest.mark.parametrize("small", [False, True])
def test_variation_equals_brute_force(spark, small):
    """Time stamps of one, two and more rows, with nulls, NaN, text and both zeros; one set a column only where there are more."""
    rng = random.Random(5)
    rows = [(f"f{rng.randrange(3)}", rng.choice([None, *range(40)]), rng.choice([None, float("nan"), 0.0, -0.0, 1.5, 2.5]), rng.choice([None, "0", "7", "x"])) for _ in range(260)]
    df = spark.createDataFrame(rows, "file string, time_us long, x double, t string").repartition(5)
    found = multiplicity.column_variation(df, ["x", "t"], small)
    got = {(r.file, r.column): tuple(r)[2:] for r in found.collect()}
    for f in ("f0", "f1", "f2"):
        for i, c in ((2, "x"), (3, "t")):
            groups = {}
            for r in rows:
                if r[0] == f and r[1] is not None:
                    groups.setdefault(r[1], []).append(None if r[i] is None or r[i] != r[i] else r[i] + 0.0 if i == 2 else r[i])
            u = [len(set(g)) for g in groups.values()]
            cells = [v for g in groups.values() for v in g]
            n, varying = len(u), sum(k > 1 for k in u)
            zero, missing = sum(v in (0.0, "0") for v in cells), sum(v is None or v == "x" for v in cells)
            assert got[f, c] == (n, n - varying, varying, varying / n, sum(u) / n, statistics.median(u), max(u), zero, missing)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" in plan and any("Aggregate [file" in line and "min(x" in line and "collect_set" not in line for line in plan.splitlines())
