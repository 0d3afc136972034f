"""Rows per time stamp, and which columns vary inside one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions import flags, scalars
from fieldmark.functions.scalars import to_numeric
from fieldmark.operators.catalog import owner

VARIATION = [
    "timestamp_groups", "constant_groups", "varying_groups", "varying_group_fraction", "mean_unique_values_per_timestamp",
    "median_unique_values_per_timestamp", "maximum_unique_values_per_timestamp", "zero_rows", "missing_rows",
]


def or_zero(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def rows_per_timestamp(sensor: DataFrame) -> DataFrame:
    """Group sizes by file and valid time, over the whole block rather than runs; ``seen`` is the first position."""
    valid = sensor.where(F.col("time_us").isNotNull())
    return valid.groupBy("file", "time_us").agg(F.count(F.lit(1)).alias("rows"), F.min("pos").alias("seen"))


def timestamp_groups(sizes: DataFrame) -> DataFrame:
    return sizes.groupBy("file").agg(F.count(F.lit(1)).alias("unique_timestamps"), F.count_if(F.col("rows") > 1).alias("duplicate_timestamp_groups"))


def group_size_stats(files: DataFrame, sizes: DataFrame) -> DataFrame:
    """Minimum, maximum, median and mean size for every file of ``files``; zeros where it has no valid time."""
    n = F.col("rows")
    stats = sizes.groupBy("file").agg(F.min(n).alias("lo"), F.max(n).alias("hi"), F.median(n).alias("mid"), F.avg(n).alias("mean"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return files.select("file").distinct().join(stats, "file", "left").select(
        "file", count("lo").alias("minimum_rows_per_timestamp"), count("hi").alias("maximum_rows_per_timestamp"),
        or_zero(F.col("mid")).alias("median_rows_per_timestamp"), or_zero(F.col("mean")).alias("mean_rows_per_timestamp"),
    )


def group_size_mode(sizes: DataFrame) -> DataFrame:
    """The most frequent size; ties go to the size seen first."""
    counted = sizes.groupBy("file", "rows").agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("first"))
    return counted.groupBy("file").agg(F.min_by("rows", F.struct(-F.col("n"), F.col("first"))).alias("mode_rows_per_timestamp"))


def sorted_duration(sensor: DataFrame) -> DataFrame:
    """Largest less smallest valid time; null with under two valid rows."""
    t = F.col("time_us")
    return sensor.groupBy("file").agg(scalars.seconds(F.when(F.count(t) >= 2, F.max(t) - F.min(t))).alias("block_duration_seconds"))


def timestamp_rates(sensor: DataFrame) -> DataFrame:
    """Distinct times and valid rows a second; null unless the duration is over 0."""
    per = sensor.where(F.col("time_us").isNotNull()).groupBy("file", "time_us").agg(F.count(F.lit(1)).alias("rows"))
    per = per.groupBy("file").agg(F.count(F.lit(1)).alias("u"), F.sum("rows").alias("v"), ((F.max("time_us") - F.min("time_us")) / 1_000_000).alias("s"))
    rate = lambda c: F.when(F.col("s") > 0, F.col(c) / F.col("s"))
    return per.select("file", rate("u").alias("unique_timestamps_per_second"), rate("v").alias("estimated_rows_per_second"))


def heart_rate_zero_fraction(sensor: DataFrame) -> DataFrame:
    """Over all rows of the block; missing rates count below the line."""
    zero = F.count_if(flags.zero_heart_rate(to_numeric(F.col("heart_rate"))))
    return sensor.groupBy("file").agg((zero / F.count(F.lit(1))).alias("heart_rate_zero_fraction"))


def column_variation(sensor: DataFrame, columns: list[str], small: bool = False) -> DataFrame:
    """For each file and column, how many values its time stamps hold; a missing value, null or NaN, counts as one more value.

    A time stamp of one or two rows, as most are, needs no set: least and
    largest value tell. The others have one set per column. Time stamps of a file that are alike in
    all columns are counted together, so no row is multiplied by the number of
    columns. With ``small``, files fit a task and their rows are brought together once.
    """
    valid = scalars.nan_as_null(sensor, *columns).where(F.col("time_us").isNotNull()).select("file", "time_us", *columns)
    if small:
        valid = valid.repartition("file")
    met = valid.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("file", "time_us")))

    def unique(c: Column, sets: bool) -> Column:
        values = F.size(F.collect_set(c)) if sets else F.when(F.count(c) == 0, 0).when(F.min(c) == F.max(c), 1).otherwise(2)
        return (values + F.max(c.isNull().cast("int"))).cast("long")

    parts = []
    for sets in (False, True):
        inner = []
        for c in columns:
            x = to_numeric(F.col(c))
            inner += [unique(F.col(c), sets).alias(f"{c}:u"), F.count_if(x == 0).alias(f"{c}:z"), F.count_if(x.isNull()).alias(f"{c}:m")]
        parts.append(met.where(F.col("size") > 2 if sets else F.col("size") <= 2).groupBy("file", "time_us").agg(*inner))
    groups = parts[0].unionByName(parts[1])
    sums = [F.sum(f"`{c}:{k}`").alias(f"{c}:{k}") for c in columns for k in "zm"]
    alike = groups.groupBy("file", *[F.col(f"`{c}:u`") for c in columns]).agg(F.count(F.lit(1)).alias("n"), *sums)
    outer, n = [], F.sum("n")
    for c in columns:
        u = F.col(f"`{c}:u`")
        varying = F.sum(F.when(u > 1, F.col("n")).otherwise(0))
        stats = n, n - varying, varying, varying / n, F.sum(u * F.col("n")) / n, F.percentile(u, 0.5, F.col("n")).cast("double"), F.max(u).cast("int"), F.sum(f"`{c}:z`"), F.sum(f"`{c}:m`")
        outer += [s.alias(f"{c}:{name}") for name, s in zip(VARIATION, stats, strict=True)]
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}:{name}`").alias(name) for name in VARIATION]) for c in columns]
    return alike.groupBy("file").agg(*outer).select("file", F.inline(F.array(*rows)))


def variation_by_column(variation: DataFrame) -> DataFrame:
    return variation.groupBy("column").agg(F.avg("varying_group_fraction").alias("mean_varying_fraction"))


def file_audit(sensor: DataFrame) -> DataFrame:
    """The multiplicity record of every file: group sizes once, then one aggregate a file."""
    sizes, n = rows_per_timestamp(sensor), F.col("rows")
    same = Window.partitionBy("file", "rows")
    sizes = sizes.repartition("file").withColumns({"often": F.count(F.lit(1)).over(same), "first": F.min("seen").over(same)})
    span = F.max("time_us") - F.min("time_us")
    second = F.when(span > 0, span / 1_000_000)
    stats = sizes.groupBy("file").agg(
        F.count(F.lit(1)).alias("unique_timestamps"), F.count_if(n > 1).alias("duplicate_timestamp_groups"),
        F.min(n).alias("minimum_rows_per_timestamp"), F.max(n).alias("maximum_rows_per_timestamp"),
        F.median(n).alias("median_rows_per_timestamp"), F.avg(n).alias("mean_rows_per_timestamp"),
        F.min_by("rows", F.struct(-F.col("often"), F.col("first"))).alias("mode_rows_per_timestamp"),
        scalars.seconds(F.when(F.sum(n) >= 2, span)).alias("block_duration_seconds"),
        (F.count(F.lit(1)) / second).alias("unique_timestamps_per_second"), (F.sum(n) / second).alias("estimated_rows_per_second"),
    )
    team, player = owner(sensor)
    base = sensor.groupBy("file").agg(
        team.alias("team"), player.alias("player_id"), F.count(F.lit(1)).alias("rows_inspected"),
        F.min_by("time", "pos").alias("first_time"), F.max_by("time", "pos").alias("last_time"),
        F.count_if(F.col("time_us").isNull()).alias("invalid_timestamp_rows"),
        (F.count_if(flags.zero_heart_rate(F.col("heart_rate"))) / F.count(F.lit(1))).alias("heart_rate_zero_fraction"),
    ).join(stats, "file", "left")
    counts = ["unique_timestamps", "duplicate_timestamp_groups", "minimum_rows_per_timestamp", "maximum_rows_per_timestamp", "mode_rows_per_timestamp"]
    return base.na.fill(0, counts).na.fill(0.0, ["median_rows_per_timestamp", "mean_rows_per_timestamp"])


def rollup(audit: DataFrame) -> DataFrame:
    counts = {"with_duplicate_groups": "duplicate_timestamp_groups", "with_invalid_timestamps": "invalid_timestamp_rows"}
    return audit.agg(F.count(F.lit(1)).alias("files"), *[F.count_if(F.col(c) > 0).alias(k) for k, c in counts.items()])


def mode_histogram(audit: DataFrame) -> DataFrame:
    """Files by mode (over 0 only), and the median of the modes on every row, which comes from the histogram itself."""
    mode = F.col("mode_rows_per_timestamp")
    counted = audit.where(mode > 0).groupBy("mode_rows_per_timestamp").agg(F.count(F.lit(1)).alias("files"))
    median = counted.agg(F.percentile(mode, 0.5, F.col("files")).cast("double").alias("median_mode"))
    return counted.join(F.broadcast(median))
