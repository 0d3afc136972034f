"""Time stamp cadence of recordings.

A frame of readings has ``file``, ``pos`` (position in the file) and
``time_us`` (microseconds of day, null where invalid). Clock times carry no
date: a recording that crosses midnight shows one backward interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions import flags, scalars
from fieldmark.operators.catalog import owner
from fieldmark.operators.ranks import weighted_medians
from fieldmark.operators.sampling import at_least
from fieldmark.schemas import GAP_MULTIPLIER
from fieldmark.sources.shared import kept


#: Rows of a recording, and microseconds of a sorted one, that one window holds; a long recording is many windows.
CHUNK_ROWS, CHUNK_US = 1 << 20, 600_000_000
#: Microseconds of different intervals whose counts are ordered in one task.
BUCKET_US = 1 << 16


def with_interval(rows: DataFrame, chunk: Column, order: list[str], bridge: bool = False) -> DataFrame:
    """``rows`` with the difference to the row before in ``order``, which ``chunk`` must follow.

    Windows run inside a chunk of a file, so no recording is one task. A
    chunk's first row takes the last time of the chunk before, from a summary of
    one row a chunk. With ``bridge`` the row before is the last valid one.
    """
    rows = rows.withColumn("chunk", chunk)
    place = F.struct(*order)
    last = F.max_by("time_us", F.when(F.col("time_us").isNotNull(), place)) if bridge else F.max_by("time_us", place)
    ends = rows.groupBy("file", "chunk").agg(last.alias("end"))
    ends = ends.where(F.col("end").isNotNull()) if bridge else ends
    ends = ends.select("file", "chunk", F.lag("end").over(Window.partitionBy("file").orderBy("chunk")).alias("carried"))
    inside = Window.partitionBy("file", "chunk").orderBy(*order)
    nth = F.row_number().over(inside)
    if bridge:
        before = F.coalesce(F.last("time_us", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("carried"))
    else:
        before = F.when(nth == 1, F.col("carried")).otherwise(F.lag("time_us").over(inside))
    joined = rows.join(ends, ["file", "chunk"], "left")
    return joined.withColumn("interval_us", F.col("time_us") - before).drop("chunk", "carried")


def bridged_intervals(sensor: DataFrame) -> DataFrame:
    """Valid rows with the difference to the valid row before; invalid rows are bridged."""
    valid = sensor.where(F.col("time_us").isNotNull())
    return with_interval(valid, F.floor(F.col("pos") / CHUNK_ROWS), ["pos"], bridge=True)


def adjacent_intervals(sensor: DataFrame) -> DataFrame:
    """All rows with the difference to the row before; null beside an invalid row."""
    return with_interval(sensor, F.floor(F.col("pos") / CHUNK_ROWS), ["pos"])


def sorted_intervals(sensor: DataFrame) -> DataFrame:
    """Valid rows with the difference to the next smaller time of their file."""
    valid = sensor.where(F.col("time_us").isNotNull())
    return with_interval(valid, F.floor(F.col("time_us") / CHUNK_US), ["time_us", "pos"])


def interval_counts(intervals: DataFrame) -> DataFrame:
    """How often each difference stands in each file and where first: far fewer rows than the readings of a steady sensor."""
    known = intervals.where(F.col("interval_us").isNotNull())
    return known.groupBy("file", "interval_us").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("seen"))


def median_of_counts(counts: DataFrame) -> DataFrame:
    """``(file, median_us)`` of the positive differences of ``counts``, by rank selection."""
    positive = counts.where("interval_us > 0")
    return weighted_medians(positive, ["file"], "interval_us", "n", F.floor(F.col("interval_us") / BUCKET_US)).withColumnRenamed("median", "median_us")


def time_validity(sensor: DataFrame) -> DataFrame:
    ok = F.col("time_us").isNotNull()
    return sensor.groupBy("file").agg(F.count_if(ok).alias("valid_timestamp_rows"), F.count_if(~ok).alias("invalid_timestamp_rows"))


def interval_signs(intervals: DataFrame) -> DataFrame:
    d = F.col("interval_us")
    counts = {"duplicate_intervals": d == 0, "backward_intervals": d < 0, "positive_intervals": d > 0}
    return intervals.groupBy("file").agg(*[F.count_if(c).alias(k) for k, c in counts.items()])


def positive_interval_stats(intervals: DataFrame) -> DataFrame:
    counts, d = interval_counts(intervals), F.when(F.col("interval_us") > 0, F.col("interval_us"))
    ends = counts.groupBy("file").agg(scalars.seconds(F.min(d)).alias("minimum_interval_seconds"), scalars.seconds(F.max(d)).alias("maximum_interval_seconds"))
    found = ends.join(median_of_counts(counts), "file", "left").withColumn("median_interval_seconds", scalars.seconds(F.col("median_us"))).drop("median_us")
    return intervals.select("file").distinct().join(found, "file", "left")


def mode_interval(intervals: DataFrame) -> DataFrame:
    """The most frequent positive interval in whole milliseconds; ties go to the first seen. Null where there is none."""
    return mode_of_counts(interval_counts(intervals), intervals.select("file").distinct())


def mode_of_counts(counts: DataFrame, files: DataFrame) -> DataFrame:
    rounded = counts.where("interval_us > 0").groupBy("file", scalars.round_ms(F.col("interval_us")).alias("ms")).agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
    modes = rounded.groupBy("file").agg(F.min_by("ms", F.struct(-F.col("n"), F.col("seen"))).alias("mode_interval_seconds"))
    return files.join(modes, "file", "left").select("file", "mode_interval_seconds")


def frequency(modes: DataFrame) -> DataFrame:
    """``modes`` with the frequency they stand for; null where the mode rounds to 0."""
    return modes.withColumn("estimated_frequency_hz", scalars.frequency_hz(F.col("mode_interval_seconds")))


def large_gaps(intervals: DataFrame, multiplier: float = GAP_MULTIPLIER) -> DataFrame:
    """Positive intervals longer than ``multiplier`` times their file's median: how many, and the longest."""
    at_least(multiplier, 1, "multiplier", strict=True)
    found = gaps_of_counts(interval_counts(intervals), multiplier)
    files = intervals.select("file").distinct().join(found, "file", "left")
    return files.select("file", F.coalesce("large_gap_count", F.lit(0)).alias("large_gap_count"), "largest_gap_seconds")


def gaps_of_counts(counts: DataFrame, multiplier: float) -> DataFrame:
    positive = counts.where("interval_us > 0")
    medians = median_of_counts(counts)
    gap = F.col("interval_us") > F.col("median_us") * multiplier
    found = positive.join(medians, "file").where(gap).groupBy("file")
    return found.agg(F.sum("n").alias("large_gap_count"), scalars.seconds(F.max("interval_us")).alias("largest_gap_seconds"))


def signed_duration(sensor: DataFrame) -> DataFrame:
    """Last valid time less the first in file order, in seconds; it can be negative. Null with under two valid rows."""
    at = F.when(F.col("time_us").isNotNull(), F.col("pos"))
    length = F.when(F.count("time_us") >= 2, F.max_by("time_us", at) - F.min_by("time_us", at))
    return sensor.groupBy("file").agg(scalars.seconds(length).alias("block_duration_seconds"))


def first_last_time(sensor: DataFrame) -> DataFrame:
    """The raw time texts of each file's first and last row."""
    return sensor.groupBy("file").agg(F.min_by("time", "pos").alias("first_time"), F.max_by("time", "pos").alias("last_time"))


def identity_prefixed(sensor: DataFrame) -> DataFrame:
    """Whether one name alone was observed and is ``team-player``; the names observed are listed."""
    name = scalars.clean_identity(F.col("player_name"))
    expected = scalars.expected_identity(*owner(sensor))
    match = (F.count_distinct(name) == 1) & (F.min(name) == expected)
    return sensor.groupBy("file").agg(expected.alias("expected_player_name"), scalars.joined_set(name).alias("observed_player_names"), F.coalesce(match, F.lit(False)).alias("player_name_matches"))


def heart_rate_quality(sensor: DataFrame) -> DataFrame:
    rate = F.col("heart_rate")
    odd = flags.bad_heart_rate_nonzero(rate)
    return sensor.groupBy("file").agg(F.count_if(flags.zero_heart_rate(rate)).alias("heart_rate_zero_rows"), F.count_if(odd).alias("suspicious_nonzero_heart_rate_rows"))


def file_audit(sensor: DataFrame, multiplier: float = GAP_MULTIPLIER) -> DataFrame:
    """The cadence record of every file: one aggregate over the rows, the others over the counted intervals."""
    at_least(multiplier, 1, "multiplier", strict=True)
    valid, rate, name = F.col("time_us").isNotNull(), F.col("heart_rate"), scalars.clean_identity(F.col("player_name"))
    at, names = F.when(valid, F.col("pos")), F.array_sort(F.collect_set(name))
    team, player = owner(sensor)
    expected = scalars.expected_identity(team, player)
    base = sensor.groupBy("file").agg(
        team.alias("team"), player.alias("player_id"),
        expected.alias("expected_player_name"), F.array_join(names, ";").alias("observed_player_names"),
        F.coalesce((F.size(names) == 1) & (F.get(names, F.lit(0)) == expected), F.lit(False)).alias("player_name_matches"),
        F.count(F.lit(1)).alias("rows_inspected"),
        F.min_by("time", "pos").alias("first_time"), F.max_by("time", "pos").alias("last_time"),
        scalars.seconds(F.when(F.count("time_us") >= 2, F.max_by("time_us", at) - F.min_by("time_us", at))).alias("block_duration_seconds"),
        F.count_if(valid).alias("valid_timestamp_rows"), F.count_if(~valid).alias("invalid_timestamp_rows"),
        F.count_if(flags.zero_heart_rate(rate)).alias("heart_rate_zero_rows"),
        F.count_if(flags.bad_heart_rate_nonzero(rate)).alias("suspicious_nonzero_heart_rate_rows"),
    )
    # all statistics of a file's intervals come from its counts, which are written once
    counts, d, n = kept(interval_counts(bridged_intervals(sensor)), "interval-counts"), F.col("interval_us"), F.col("n")
    positive, gap = F.when(d > 0, d), (d > 0) & (d > F.col("median_us") * multiplier)

    def total(c: Column) -> Column:
        return F.sum(F.when(c, n).otherwise(0))

    # by whole milliseconds first, which gives the modes; then by file
    by_ms = counts.join(median_of_counts(counts), "file", "left").groupBy("file", scalars.round_ms(positive).alias("ms")).agg(
        F.first("median_us").alias("median_us"), F.sum("n").alias("ms_n"), F.min("seen").alias("ms_seen"), F.min(positive).alias("lo"), F.max(positive).alias("hi"),
        total(d == 0).alias("duplicates"), total(d < 0).alias("backward"), total(d > 0).alias("positives"), total(gap).alias("gaps"), F.max(F.when(gap, d)).alias("longest"),
    )
    stats = by_ms.groupBy("file").agg(
        F.sum("duplicates").alias("duplicate_intervals"), F.sum("backward").alias("backward_intervals"), F.sum("positives").alias("positive_intervals"),
        scalars.seconds(F.first("median_us")).alias("median_interval_seconds"),
        scalars.seconds(F.min("lo")).alias("minimum_interval_seconds"), scalars.seconds(F.max("hi")).alias("maximum_interval_seconds"),
        F.sum("gaps").alias("large_gap_count"), scalars.seconds(F.max("longest")).alias("largest_gap_seconds"),
        F.min_by("ms", F.when(F.col("ms").isNotNull(), F.struct(-F.col("ms_n"), F.col("ms_seen")))).alias("mode_interval_seconds"),
    )
    base = base.join(frequency(stats), "file", "left")
    return base.na.fill(0, ["duplicate_intervals", "backward_intervals", "positive_intervals", "large_gap_count"])


def rollup(audit: DataFrame) -> DataFrame:
    """How many files match their name and how many show each kind of trouble."""
    some = {"invalid": "invalid_timestamp_rows", "duplicate": "duplicate_intervals", "backward": "backward_intervals", "gap": "large_gap_count", "zero_heart_rate": "heart_rate_zero_rows", "odd_heart_rate": "suspicious_nonzero_heart_rate_rows"}
    return audit.agg(F.count(F.lit(1)).alias("files"), F.count_if("player_name_matches").alias("matching"), *[F.count_if(F.col(c) > 0).alias(f"with_{k}") for k, c in some.items()])


def mode_histogram(audit: DataFrame) -> DataFrame:
    mode = F.bround("mode_interval_seconds", 6)
    return audit.where(mode.isNotNull()).groupBy(mode.alias("mode_interval_seconds")).agg(F.count(F.lit(1)).alias("files"))


def spread_of(audit: DataFrame, *columns: str) -> DataFrame:
    """Minimum, maximum and median of each column over all files, one row a column."""
    stats = [f(c).alias(f"{c}:{n}") for c in columns for n, f in (("minimum", F.min), ("maximum", F.max), ("median", F.median))]
    one = audit.agg(*stats)
    rows = [F.struct(F.lit(c).alias("metric"), *[F.col(f"`{c}:{n}`").cast("double").alias(n) for n in ("minimum", "maximum", "median")]) for c in columns]
    return one.select(F.inline(F.array(*rows)))
