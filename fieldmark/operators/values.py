"""Value quality of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions import flags, scalars
from fieldmark.operators.cadence import interval_counts, median_of_counts, sorted_intervals
from fieldmark.operators.catalog import owner
from fieldmark.operators.ranks import brackets, medians
from fieldmark.sources.shared import kept

STATS = ["count", "missing", "minimum", "maximum", "mean", "median", "standard_deviation", "zero_count", "negative_count"]


#: Rows of a group up to which its median is taken from one buffer.
BUFFERED_ROWS = 1 << 16


def numeric_profile(sensor: DataFrame, columns: list[str], keys: list[str], most_rows: int | None = None) -> DataFrame:
    """One row for each group of ``keys`` and column: counts, spread and exact median, from one wide aggregate.

    The median comes from rank selection (``ranks``), unless ``most_rows`` states
    that no group has more rows than a buffer may hold.
    """
    buffered = most_rows is not None and most_rows <= BUFFERED_ROWS
    numbers, wide = {c: scalars.to_numeric(F.col(c)) for c in columns}, []
    for c, x in numbers.items():
        stats = F.count(x), F.count(F.lit(1)) - F.count(x), F.min(x), F.max(x), F.avg(x), F.median(x) if buffered else F.lit(None).cast("double"), F.stddev_samp(x), F.count_if(x == 0), F.count_if(x < 0)
        wide += [s.alias(f"{c}:{n}") for n, s in zip(STATS, stats, strict=True)]
    grouped = sensor.groupBy(*keys).agg(*wide, *([] if buffered else brackets(numbers)))
    grouped = grouped if buffered else kept(grouped, "profiles")
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}:{n}`").alias(n) for n in STATS]) for c in columns]
    long = grouped.select(*keys, F.inline(F.array(*rows)))
    if not buffered:
        long = long.drop("median").join(medians(sensor, keys, numbers, grouped), [*keys, "column"], "left").select(*keys, "column", *STATS)
    return long.withColumn("standard_deviation", F.when(F.col("count") > 1, F.col("standard_deviation")))


def missing_cells(sensor: DataFrame, columns: list[str]) -> DataFrame:
    """Raw missing cells of each file, nulls and NaN, before any coercion."""
    return scalars.nan_as_null(sensor, *columns).groupBy("file").agg(F.sum(sum(F.col(c).isNull().cast("long") for c in columns)).alias("missing_cells"))


def time_parse_rate(sensor: DataFrame) -> DataFrame:
    return sensor.groupBy("file").agg(F.avg(scalars.parse_clock_or_timestamp(F.col("time")).isNotNull().cast("double")).alias("time_parse_rate"))


def flag_counts(sensor: DataFrame) -> DataFrame:
    return sensor.groupBy("file").agg(*[F.count_if(c).alias(k) for k, c in flag_columns().items()])


def flag_columns() -> dict[str, Column]:
    number = {c: scalars.to_numeric(F.col(c)) for c in ("lat", "lon", "speed", "heart_rate")}
    return {
        "suspicious_latitude_rows": flags.bad_latitude(number["lat"]),
        "suspicious_longitude_rows": flags.bad_longitude(number["lon"]),
        "negative_speed_rows": flags.negative_speed(number["speed"]),
        "suspicious_speed_rows": flags.high_speed(number["speed"]),
        "suspicious_heart_rate_rows": flags.bad_heart_rate(number["heart_rate"]),
    }


def identity_bare(sensor: DataFrame) -> DataFrame:
    """Whether some name was observed and all are the player's id without a prefix."""
    name = scalars.clean_identity(F.col("player_name"))
    _, player = owner(sensor)
    match = (F.count(name) > 0) & (F.min(name) == player) & (F.max(name) == player)
    return sensor.groupBy("file").agg(F.coalesce(match, F.lit(False)).alias("player_name_matches_filename"))


def sorted_median_interval(sensor: DataFrame) -> DataFrame:
    """The median positive interval of each file's sorted times, in seconds."""
    found = median_of_counts(interval_counts(sorted_intervals(sensor))).select("file", scalars.seconds(F.col("median_us")).alias("median_interval_seconds"))
    timed = sensor.where(F.col("time_us").isNotNull()).select("file").distinct()
    return timed.join(found, "file", "left")


def file_audit(sensor: DataFrame, columns: list[str]) -> DataFrame:
    """The value record of every file. Missing cells are those of the stored values (``raw_missing``) where the scan has told them."""
    name, (team, player) = scalars.clean_identity(F.col("player_name")), owner(sensor)
    match = (F.count(name) > 0) & (F.min(name) == player) & (F.max(name) == player)
    missing = F.col("raw_missing") if "raw_missing" in sensor.columns else sum(F.col(c).isNull().cast("long") for c in columns)
    audit = scalars.nan_as_null(sensor, *columns).groupBy("file").agg(
        team.alias("team"), player.alias("player_id"), F.count(F.lit(1)).alias("rows_sampled"),
        F.avg(scalars.parse_clock_or_timestamp(F.col("time")).isNotNull().cast("double")).alias("time_parse_rate"),
        F.coalesce(match, F.lit(False)).alias("player_name_matches_filename"),
        F.sum(missing).alias("missing_cells"),
        *[F.count_if(c).alias(k) for k, c in flag_columns().items()],
    )
    median = median_of_counts(interval_counts(sorted_intervals(sensor)))
    return audit.join(median, "file", "left").withColumn("median_interval_seconds", scalars.seconds(F.col("median_us"))).drop("median_us")


def rollup(audit: DataFrame) -> DataFrame:
    some = ["missing_cells", *flag_columns()]
    return audit.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("time_parse_rate") == 1).alias("fully_parseable"), F.count_if("player_name_matches_filename").alias("matching"),
        *[F.count_if(F.col(c) > 0).alias(f"with_{c}") for c in some],
    )
