"""Queries on readings: flags, cadence, values and multiplicity."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.functions import flags, scalars
from fieldmark.operators import cadence, multiplicity, sampling, values
from fieldmark.operators import outcomes as out
from fieldmark.queries.catalog import sink_folder, written
from fieldmark.queries.fixtures import BRIDGED, COARSE, MEDIANS, MODES, SENSOR, SIZES, VALUES, r6, register, rounded, sensor, table
from fieldmark.sources import readers, sinks

GAP = 2.0
TOTAL = "totals AS (SELECT file, count(*) AS total_rows FROM sensor GROUP BY file)"


@register("src_sensor_projection", f"WITH {SENSOR} SELECT file, pos, time, heart_rate FROM sensor")
def _(spark, d):
    return scalars.nan_as_null(sensor(spark, d)).select("file", "pos", "time", "heart_rate")


@register("src_sensor_scan", "SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events")
def _(spark, d):
    """The scan itself, over the file of events, which is in the order of event_id."""
    return readers.scan_sensor(spark, [f"{d}/events.parquet"], ["event_id", "user_id"]).select("event_id", "user_id", "pos")


@register("src_rows_per_parquet", "SELECT 'events' AS name, count(*) AS total_rows FROM events UNION ALL SELECT 'orders', count(*) FROM orders")
def _(spark, d):
    found = [readers.rows_per_file(spark, [f"{d}/{n}.parquet"]).agg(F.lit(n).alias("name"), F.sum("total_rows").alias("total_rows")) for n in ("events", "orders")]
    return found[0].unionByName(found[1])


@register("src_rows_per_file", f"WITH {SENSOR} SELECT file, count(*) AS total_rows FROM sensor GROUP BY file")
def _(spark, d):
    return sampling.rows_per_file(sensor(spark, d))


@register("proj_expected_identity", f"WITH {SENSOR} SELECT DISTINCT file, team || '-' || player_id AS expected FROM sensor")
def _(spark, d):
    return sensor(spark, d).select("file", scalars.expected_identity(F.col("team"), F.col("player_id")).alias("expected")).distinct()


@register("proj_clean_identity", f"WITH {SENSOR} SELECT file, pos, player_name AS name FROM sensor WHERE player_name IS NOT NULL")
def _(spark, d):
    padded = F.concat(F.lit(" \t"), "player_name", F.lit("\n"))
    return sensor(spark, d).where("player_name is not null").select("file", "pos", scalars.clean_identity(padded).alias("name"))


@register("proj_provenance", f"WITH {SENSOR} SELECT 'user ' || file AS source_filename, team AS source_team, pos AS row_number, time AS raw_time FROM sensor")
def _(spark, d):
    name = F.concat(F.lit("user "), F.col("file").cast("string"))
    return sensor(spark, d).select(name.alias("source_filename"), F.col("team").alias("source_team"), F.col("pos").alias("row_number"), F.col("time").alias("raw_time"))


@register("filter_valid_time", f"WITH {SENSOR} SELECT file, pos, time FROM sensor WHERE time_us IS NOT NULL")
def _(spark, d):
    return sensor(spark, d).where("time_us is not null").select("file", "pos", "time")


def flagged(name, flag, sql):
    register(name, f"WITH {SENSOR} SELECT file, pos FROM sensor WHERE {sql}")(lambda spark, d: sensor(spark, d).where(flag()).select("file", "pos"))


flagged("flag_latitude", lambda: flags.bad_latitude(F.col("lat")), "lat < -90 OR lat > 90")
flagged("flag_longitude", lambda: flags.bad_longitude(F.col("lon")), "lon < -180 OR lon > 180")
flagged("flag_negative_speed", lambda: flags.negative_speed(F.col("speed")), "speed < 0")
flagged("flag_high_speed", lambda: flags.high_speed(F.col("speed")), "speed > 15")
flagged("flag_heart_rate", lambda: flags.bad_heart_rate(F.col("heart_rate")), "heart_rate < 30 OR heart_rate > 240")
flagged("flag_heart_rate_nonzero", lambda: flags.bad_heart_rate_nonzero(F.col("heart_rate")), "(heart_rate > 0 AND heart_rate < 30) OR heart_rate > 240")
flagged("flag_heart_rate_zero", lambda: flags.zero_heart_rate(F.col("heart_rate")), "heart_rate = 0")


@register("check_start_row", f"""WITH {SENSOR}, {TOTAL} SELECT file, total_rows,
  CASE WHEN 60 >= total_rows THEN 'start row 60 is beyond the file''s ' || total_rows || ' rows' ELSE '' END AS error FROM totals""")  # fmt: skip
def _(spark, d):
    return out.with_start_check(sampling.rows_per_file(sensor(spark, d)), 60)


@register("fn_time_of_day_us", f"WITH {SENSOR} SELECT file, pos, time_us FROM sensor")
def _(spark, d):
    return sensor(spark, d).select("file", "pos", "time_us")


@register("fn_to_numeric", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 9 = 0 THEN 'x' || value WHEN event_id % 7 = 0 THEN NULL ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS number FROM events")
def _(spark, d):
    text = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("x"), F.col("value").cast("string"))).when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value").cast("string"))
    return table(spark, d, "events").select("event_id", scalars.to_numeric(text).alias("number"))


@register("fn_parse_timestamp_utc", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events")
def _(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, F.lit("no time")).when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return table(spark, d, "events").select("event_id", F.date_format(scalars.parse_timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@register("fn_interval_seconds", f"WITH {SENSOR}, {BRIDGED} SELECT file, pos, round(d / 1000000.0, 6) AS seconds FROM bridged")
def _(spark, d):
    return cadence.bridged_intervals(sensor(spark, d)).select("file", "pos", r6(scalars.seconds(F.col("interval_us"))).alias("seconds"))


@register("fn_round_ms", f"WITH {SENSOR}, {BRIDGED} SELECT file, pos, round_even(d / 1000.0, 0) / 1000 AS rounded FROM bridged")
def _(spark, d):
    return cadence.bridged_intervals(sensor(spark, d)).select("file", "pos", scalars.round_ms(F.col("interval_us")).alias("rounded"))


@register("fn_frequency_hz", f"WITH {SENSOR}, {BRIDGED} SELECT file, pos, CASE WHEN d > 0 THEN round(1 / (d / 1000000.0), 6) END AS hz FROM bridged")
def _(spark, d):
    return cadence.bridged_intervals(sensor(spark, d)).select("file", "pos", r6(scalars.frequency_hz(scalars.seconds(F.col("interval_us")))).alias("hz"))


@register("sample_rows_spread", f"""WITH {SENSOR}, {TOTAL}, wanted AS (SELECT file, CAST(round_even(i * (total_rows - 1) / 19.0, 0) AS BIGINT) AS r FROM totals CROSS JOIN range(20) t(i))
  SELECT file, pos FROM sensor s JOIN totals USING (file) WHERE total_rows <= 20 OR EXISTS (SELECT 1 FROM wanted w WHERE w.file = s.file AND w.r = s.pos)""")  # fmt: skip
def _(spark, d):
    return sampling.spread_rows(sensor(spark, d), 20).select("file", "pos")


@register("sample_contiguous_block", f"WITH {SENSOR} SELECT file, pos FROM sensor WHERE pos >= 10 AND pos < 50")
def _(spark, d):
    return sampling.contiguous_block(sensor(spark, d), 10, 40).select("file", "pos")


HEADS = "SELECT file, pos, time FROM (SELECT s.*, row_number() OVER (PARTITION BY file ORDER BY pos) AS k FROM sensor s {where}) h WHERE k <= {n}"


@register("head_example_rows", f"WITH {SENSOR} {HEADS.format(where='', n=5)}")
def _(spark, d):
    return sampling.head_rows(sensor(spark, d), 5).select("file", "pos", "time")


@register("head_interval_rows", f"WITH {SENSOR} {HEADS.format(where='', n=40)}")
def _(spark, d):
    return sampling.head_rows(cadence.adjacent_intervals(sensor(spark, d)), 40).select("file", "pos", "time")


@register("head_valid_rows", f"WITH {SENSOR} {HEADS.format(where='WHERE time_us IS NOT NULL', n=30)}")
def _(spark, d):
    return sampling.head_rows(sensor(spark, d).where("time_us is not null"), 30).select("file", "pos", "time")


@register("set_union_examples", f"""WITH {SENSOR} SELECT file, pos, time, NULL AS heart_rate FROM sensor WHERE pos < 2 UNION ALL SELECT file, pos, NULL, heart_rate FROM sensor WHERE pos = 2""")
def _(spark, d):
    rows = scalars.nan_as_null(sensor(spark, d))
    return sinks.union_examples([rows.where("pos < 2").select("file", "pos", "time"), rows.where("pos = 2").select("file", "pos", "heart_rate")])


# --- windows

@register("win_interval_bridged", f"WITH {SENSOR}, {BRIDGED} SELECT file, pos, d AS interval_us FROM bridged")
def _(spark, d):
    return cadence.bridged_intervals(sensor(spark, d)).select("file", "pos", "interval_us")


@register("win_interval_adjacent", f"WITH {SENSOR} SELECT file, pos, time_us - lag(time_us) OVER (PARTITION BY file ORDER BY pos) AS interval_us FROM sensor")
def _(spark, d):
    return cadence.adjacent_intervals(sensor(spark, d)).select("file", "pos", "interval_us")


SORTED = "sorted AS (SELECT file, pos, time_us - lag(time_us) OVER (PARTITION BY file ORDER BY time_us, pos) AS d FROM sensor WHERE time_us IS NOT NULL)"


@register("win_interval_sorted", f"WITH {SENSOR}, {SORTED} SELECT file, pos, d AS interval_us FROM sorted")
def _(spark, d):
    return cadence.sorted_intervals(sensor(spark, d)).select("file", "pos", "interval_us")


# --- cadence

@register("agg_time_validity", f"WITH {SENSOR} SELECT file, count(time_us) AS valid_timestamp_rows, count(*) - count(time_us) AS invalid_timestamp_rows FROM sensor GROUP BY file")
def _(spark, d):
    return cadence.time_validity(sensor(spark, d))


SIGNS = "SELECT file, count(*) FILTER (WHERE d = 0) AS duplicate_intervals, count(*) FILTER (WHERE d < 0) AS backward_intervals, count(*) FILTER (WHERE d > 0) AS positive_intervals FROM bridged GROUP BY file"


@register("agg_interval_signs", f"WITH {COARSE}, {BRIDGED} {SIGNS}")
def _(spark, d):
    return cadence.interval_signs(cadence.bridged_intervals(sensor(spark, d, coarse=True)))


@register("agg_positive_interval_stats", f"""WITH {SENSOR}, {BRIDGED} SELECT file, round(median(p) / 1000000.0, 6) AS median_interval_seconds, round(min(p) / 1000000.0, 6) AS minimum_interval_seconds,
  round(max(p) / 1000000.0, 6) AS maximum_interval_seconds FROM (SELECT file, CASE WHEN d > 0 THEN d END AS p FROM bridged) b GROUP BY file""")  # fmt: skip
def _(spark, d):
    found = cadence.positive_interval_stats(cadence.bridged_intervals(sensor(spark, d)))
    return rounded(found, "median_interval_seconds", "minimum_interval_seconds", "maximum_interval_seconds")


@register("agg_mode_interval", f"WITH {COARSE}, {BRIDGED}, {MODES} SELECT file, mode_interval_seconds FROM modes")
def _(spark, d):
    return cadence.mode_interval(cadence.bridged_intervals(sensor(spark, d, coarse=True)))


@register("agg_frequency", f"WITH {COARSE}, {BRIDGED}, {MODES} SELECT file, CASE WHEN mode_interval_seconds > 0 THEN round(1 / mode_interval_seconds, 9) END AS estimated_frequency_hz FROM modes")
def _(spark, d):
    found = cadence.frequency(cadence.mode_interval(cadence.bridged_intervals(sensor(spark, d, coarse=True))))
    return found.select("file", F.round("estimated_frequency_hz", 9).alias("estimated_frequency_hz"))


@register("agg_large_gaps", f"""WITH {SENSOR}, {BRIDGED}, {MEDIANS} SELECT b.file, count(*) FILTER (WHERE d > m * 2) AS large_gap_count,
  round(max(CASE WHEN d > m * 2 THEN d END) / 1000000.0, 6) AS largest_gap_seconds FROM bridged b JOIN medians USING (file) GROUP BY b.file""")  # fmt: skip
def _(spark, d):
    return rounded(cadence.large_gaps(cadence.bridged_intervals(sensor(spark, d)), GAP), "largest_gap_seconds")


@register("agg_block_duration_signed", f"""WITH {SENSOR} SELECT file, CASE WHEN count(time_us) >= 2 THEN
  round((arg_max(time_us, pos) FILTER (WHERE time_us IS NOT NULL) - arg_min(time_us, pos) FILTER (WHERE time_us IS NOT NULL)) / 1000000.0, 6) END AS block_duration_seconds FROM sensor GROUP BY file""")  # fmt: skip
def _(spark, d):
    return rounded(cadence.signed_duration(sensor(spark, d)), "block_duration_seconds")


@register("agg_first_last_time", f"""WITH {SENSOR} SELECT file, max(CASE WHEN up = 1 THEN time END) AS first_time, max(CASE WHEN down = 1 THEN time END) AS last_time FROM (
  SELECT file, time, row_number() OVER (PARTITION BY file ORDER BY pos) AS up, row_number() OVER (PARTITION BY file ORDER BY pos DESC) AS down FROM sensor) r GROUP BY file""")  # fmt: skip
def _(spark, d):
    return cadence.first_last_time(sensor(spark, d))


IDENTITY = "SELECT file, min(team || '-' || player_id) AS expected_player_name, string_agg(DISTINCT player_name, ';' ORDER BY player_name) AS observed_player_names, count(DISTINCT player_name) = 1 AND min(player_name) = min(team || '-' || player_id) AS player_name_matches FROM sensor GROUP BY file"


@register("agg_identity_match_prefixed", f"WITH {SENSOR} {IDENTITY}")
def _(spark, d):
    return cadence.identity_prefixed(sensor(spark, d))


@register("agg_heart_rate_quality", f"""WITH {SENSOR} SELECT file, count(*) FILTER (WHERE heart_rate = 0) AS heart_rate_zero_rows,
  count(*) FILTER (WHERE (heart_rate > 0 AND heart_rate < 30) OR heart_rate > 240) AS suspicious_nonzero_heart_rate_rows FROM sensor GROUP BY file""")  # fmt: skip
def _(spark, d):
    return cadence.heart_rate_quality(sensor(spark, d))


CADENCE = f"""{COARSE}, {BRIDGED}, {MEDIANS}, {MODES}, intervals AS (SELECT b.file, count(*) FILTER (WHERE d = 0) AS dup, count(*) FILTER (WHERE d < 0) AS back, count(*) FILTER (WHERE d > 0) AS pos_n,
    count(*) FILTER (WHERE d > m * 2) AS gaps, max(m) / 1000000.0 AS med, max(CASE WHEN d > m * 2 THEN d END) / 1000000.0 AS longest FROM bridged b JOIN medians USING (file) GROUP BY b.file),
  audit AS (SELECT s.file, min(s.team) AS team, count(*) AS rows_inspected, count(time_us) AS valid_timestamp_rows, count(*) - count(time_us) AS invalid_timestamp_rows,
    count(DISTINCT player_name) = 1 AND min(player_name) = min(team || '-' || player_id) AS player_name_matches, count(*) FILTER (WHERE heart_rate = 0) AS heart_rate_zero_rows,
    count(*) FILTER (WHERE (heart_rate > 0 AND heart_rate < 30) OR heart_rate > 240) AS suspicious_nonzero_heart_rate_rows FROM sensor s GROUP BY s.file),
  cadence AS (SELECT a.*, coalesce(dup, 0) AS duplicate_intervals, coalesce(back, 0) AS backward_intervals, coalesce(pos_n, 0) AS positive_intervals, coalesce(gaps, 0) AS large_gap_count,
    med AS median_interval_seconds, longest AS largest_gap_seconds, mode_interval_seconds, CASE WHEN mode_interval_seconds > 0 THEN 1 / mode_interval_seconds END AS estimated_frequency_hz
    FROM audit a LEFT JOIN intervals i ON a.file = i.file LEFT JOIN modes m ON a.file = m.file)"""
RECORD = ["file", "team", "rows_inspected", "valid_timestamp_rows", "invalid_timestamp_rows", "player_name_matches", "heart_rate_zero_rows", "suspicious_nonzero_heart_rate_rows", "duplicate_intervals", "backward_intervals", "positive_intervals", "large_gap_count"]
RECORD_SQL = ", ".join(RECORD)


def audited(spark, d):
    return cadence.file_audit(sensor(spark, d, coarse=True), GAP)


@register("cadence_audit", f"""WITH {CADENCE} SELECT {RECORD_SQL}, round(median_interval_seconds, 6) AS median_interval_seconds, round(largest_gap_seconds, 6) AS largest_gap_seconds,
  mode_interval_seconds, round(estimated_frequency_hz, 9) AS estimated_frequency_hz FROM cadence""")  # fmt: skip
def _(spark, d):
    a = audited(spark, d)
    return a.select(*RECORD, r6("median_interval_seconds").alias("median_interval_seconds"), r6("largest_gap_seconds").alias("largest_gap_seconds"), "mode_interval_seconds", F.round("estimated_frequency_hz", 9).alias("estimated_frequency_hz"))


@register("sink_file_audit", f"WITH {CADENCE} SELECT {RECORD_SQL} FROM cadence")
def _(spark, d):
    a = audited(spark, d).select(*RECORD)
    return written(a, "cadence", RECORD, a.schema)


ROLLUP = """SELECT count(*) AS files, count(*) FILTER (WHERE player_name_matches) AS matching, count(*) FILTER (WHERE invalid_timestamp_rows > 0) AS with_invalid,
  count(*) FILTER (WHERE duplicate_intervals > 0) AS with_duplicate, count(*) FILTER (WHERE backward_intervals > 0) AS with_backward, count(*) FILTER (WHERE large_gap_count > 0) AS with_gap,
  count(*) FILTER (WHERE heart_rate_zero_rows > 0) AS with_zero_heart_rate, count(*) FILTER (WHERE suspicious_nonzero_heart_rate_rows > 0) AS with_odd_heart_rate FROM cadence"""


@register("agg_sampling_rollup", f"WITH {CADENCE} {ROLLUP}")
def _(spark, d):
    return cadence.rollup(audited(spark, d))


NAMES = ["files", "matching", "with_invalid", "with_duplicate", "with_backward", "with_gap", "with_zero_heart_rate", "with_odd_heart_rate"]


@register("sink_summary_metrics", f"WITH {CADENCE}, one AS ({ROLLUP}) " + " UNION ALL ".join(f"SELECT 'cadence' AS section, '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM one" for n in NAMES))
def _(spark, d):
    rows = sinks.metrics(cadence.rollup(audited(spark, d)), "cadence")
    return written(rows, "summary", ["section", "metric", "value"], "section string, metric string, value double")


@register("agg_mode_histogram", f"WITH {CADENCE} SELECT round_even(mode_interval_seconds, 6) AS mode_interval_seconds, count(*) AS files FROM cadence WHERE mode_interval_seconds IS NOT NULL GROUP BY 1")
def _(spark, d):
    return cadence.mode_histogram(audited(spark, d))


def spread_sql(source, places, *columns):
    return " UNION ALL ".join(f"SELECT '{c}' AS metric, round(min({c}), {places}) AS minimum, round(max({c}), {places}) AS maximum, round(median({c}), {places}) AS median FROM {source}" for c in columns)


def spread(df, places, *columns):
    found = cadence.spread_of(df, *columns)
    return found.select("metric", *[F.round(c, places).alias(c) for c in ("minimum", "maximum", "median")])


@register("agg_frequency_rollup", f"WITH {CADENCE} {spread_sql('cadence', 9, 'estimated_frequency_hz', 'median_interval_seconds')}")
def _(spark, d):
    return spread(audited(spark, d), 9, "estimated_frequency_hz", "median_interval_seconds")


# --- values

PROFILE = ", ".join(
    f"count({c}) AS {c}_count, count(*) - count({c}) AS {c}_missing, min({c}) AS {c}_min, max({c}) AS {c}_max, avg({c}) AS {c}_mean, median({c}) AS {c}_median, stddev_samp({c}) AS {c}_std, "
    f"count(*) FILTER (WHERE {c} = 0) AS {c}_zero, count(*) FILTER (WHERE {c} < 0) AS {c}_neg"
    for c in VALUES
)
PROFILE_SQL = f"WITH {SENSOR}, wide AS (SELECT file, {PROFILE} FROM sensor GROUP BY file) " + " UNION ALL ".join(
    f"SELECT file, '{c}' AS \"column\", {c}_count AS count, {c}_missing AS missing, round({c}_min, 9) AS minimum, round({c}_max, 9) AS maximum, round({c}_mean, 9) AS mean, round({c}_median, 9) AS median, "
    f"round({c}_std, 9) AS standard_deviation, {c}_zero AS zero_count, {c}_neg AS negative_count FROM wide"
    for c in VALUES
)
PROFILE_DOUBLES = "minimum", "maximum", "mean", "median", "standard_deviation"


@register("agg_numeric_profile", PROFILE_SQL)
def _(spark, d):
    return rounded(values.numeric_profile(sensor(spark, d), VALUES, ["file"]), *PROFILE_DOUBLES, places=9)


@register("sink_column_audit", PROFILE_SQL)
def _(spark, d):
    rows = rounded(values.numeric_profile(sensor(spark, d), VALUES, ["file"]), *PROFILE_DOUBLES, places=9)
    return written(rows, "columns", rows.columns, rows.schema)


@register("sink_examples", f"WITH {SENSOR} {HEADS.format(where='', n=5)}")
def _(spark, d):
    path = f"{sink_folder(spark)}/examples"
    sinks.write_examples([sampling.head_rows(sensor(spark, d), 5).select("file", "pos", "time")], path)
    return spark.read.schema("file long, pos long, time string").option("header", True).csv(path)


CELLS = ["player_name", "time", *VALUES]
MISSING = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in CELLS)


@register("agg_missing_cells", f"WITH {SENSOR} SELECT file, CAST(sum({MISSING}) AS BIGINT) AS missing_cells FROM sensor GROUP BY file")
def _(spark, d):
    return values.missing_cells(sensor(spark, d), CELLS)


@register("agg_time_parse_rate", f"WITH {SENSOR} SELECT file, round(count(time) / CAST(count(*) AS DOUBLE), 6) AS time_parse_rate FROM sensor GROUP BY file")
def _(spark, d):
    return rounded(values.time_parse_rate(sensor(spark, d)), "time_parse_rate")


FLAGS = """count(*) FILTER (WHERE lat < -90 OR lat > 90) AS suspicious_latitude_rows, count(*) FILTER (WHERE lon < -180 OR lon > 180) AS suspicious_longitude_rows,
  count(*) FILTER (WHERE speed < 0) AS negative_speed_rows, count(*) FILTER (WHERE speed > 15) AS suspicious_speed_rows, count(*) FILTER (WHERE heart_rate < 30 OR heart_rate > 240) AS suspicious_heart_rate_rows"""


@register("agg_value_flags", f"WITH {SENSOR} SELECT file, {FLAGS} FROM sensor GROUP BY file")
def _(spark, d):
    return values.flag_counts(sensor(spark, d))


BARE = "count(player_name) > 0 AND min(player_name) = min(player_id) AND max(player_name) = min(player_id)"


@register("agg_identity_match_bare", f"WITH {SENSOR} SELECT file, {BARE} AS player_name_matches_filename FROM sensor GROUP BY file")
def _(spark, d):
    return values.identity_bare(sensor(spark, d))


@register("agg_sorted_median_interval", f"WITH {SENSOR}, {SORTED} SELECT file, round(median(CASE WHEN d > 0 THEN d END) / 1000000.0, 6) AS median_interval_seconds FROM sorted GROUP BY file")
def _(spark, d):
    return rounded(values.sorted_median_interval(sensor(spark, d)), "median_interval_seconds")


VALUE_AUDIT = f"""{SENSOR}, {SORTED}, mid AS (SELECT file, median(CASE WHEN d > 0 THEN d END) / 1000000.0 AS median_interval_seconds FROM sorted GROUP BY file),
  audit AS (SELECT s.file, count(time) / CAST(count(*) AS DOUBLE) AS time_parse_rate, {BARE} AS matches, sum({MISSING}) AS missing_cells, {FLAGS}, max(median_interval_seconds) AS median_interval_seconds
  FROM sensor s LEFT JOIN mid ON s.file = mid.file GROUP BY s.file)"""
SOME = ["missing_cells", "suspicious_latitude_rows", "suspicious_longitude_rows", "negative_speed_rows", "suspicious_speed_rows", "suspicious_heart_rate_rows"]


@register("agg_value_rollup", f"WITH {VALUE_AUDIT} SELECT count(*) AS files, count(*) FILTER (WHERE time_parse_rate = 1) AS fully_parseable, count(*) FILTER (WHERE matches) AS matching, " + ", ".join(f"count(*) FILTER (WHERE {c} > 0) AS with_{c}" for c in SOME) + " FROM audit")
def _(spark, d):
    return values.rollup(values.file_audit(sensor(spark, d), CELLS))


@register("agg_interval_rollup", f"WITH {VALUE_AUDIT} {spread_sql('audit', 6, 'median_interval_seconds')}")
def _(spark, d):
    return spread(values.file_audit(sensor(spark, d), CELLS), 6, "median_interval_seconds")


# --- multiplicity

@register("agg_rows_per_timestamp", f"WITH {COARSE}, {SIZES} SELECT file, time_us, n AS rows FROM sizes")
def _(spark, d):
    return multiplicity.rows_per_timestamp(sensor(spark, d, coarse=True)).select("file", "time_us", "rows")


@register("agg_timestamp_groups", f"WITH {COARSE}, {SIZES} SELECT file, count(*) AS unique_timestamps, count(*) FILTER (WHERE n > 1) AS duplicate_timestamp_groups FROM sizes GROUP BY file")
def _(spark, d):
    return multiplicity.timestamp_groups(multiplicity.rows_per_timestamp(sensor(spark, d, coarse=True)))


@register("agg_group_size_stats", f"""WITH {COARSE}, {SIZES} SELECT f.file, coalesce(min(n), 0) AS minimum_rows_per_timestamp, coalesce(max(n), 0) AS maximum_rows_per_timestamp,
  coalesce(round(median(n), 6), 0) AS median_rows_per_timestamp, coalesce(round(avg(n), 6), 0) AS mean_rows_per_timestamp FROM (SELECT DISTINCT file FROM sensor) f LEFT JOIN sizes s ON f.file = s.file GROUP BY f.file""")  # fmt: skip
def _(spark, d):
    rows = sensor(spark, d, coarse=True)
    return rounded(multiplicity.group_size_stats(rows, multiplicity.rows_per_timestamp(rows)), "median_rows_per_timestamp", "mean_rows_per_timestamp")


SIZE_MODE = """smode AS (SELECT file, n AS mode_rows_per_timestamp FROM (SELECT file, n, row_number() OVER (PARTITION BY file ORDER BY count(*) DESC, min(seen)) AS k FROM sizes GROUP BY file, n) c WHERE k = 1)"""


@register("agg_group_size_mode", f"WITH {COARSE}, {SIZES}, {SIZE_MODE} SELECT * FROM smode")
def _(spark, d):
    return multiplicity.group_size_mode(multiplicity.rows_per_timestamp(sensor(spark, d, coarse=True)))


@register("agg_block_duration_sorted", f"WITH {COARSE} SELECT file, CASE WHEN count(time_us) >= 2 THEN round((max(time_us) - min(time_us)) / 1000000.0, 6) END AS block_duration_seconds FROM sensor GROUP BY file")
def _(spark, d):
    return rounded(multiplicity.sorted_duration(sensor(spark, d, coarse=True)), "block_duration_seconds")


RATES = """rates AS (SELECT file, CASE WHEN s > 0 THEN u / s END AS unique_timestamps_per_second, CASE WHEN s > 0 THEN v / s END AS estimated_rows_per_second FROM (
  SELECT file, count(*) AS u, sum(n) AS v, (max(time_us) - min(time_us)) / 1000000.0 AS s FROM sizes GROUP BY file) z)"""


@register("agg_timestamp_rates", f"WITH {COARSE}, {SIZES}, {RATES} SELECT file, round(unique_timestamps_per_second, 9) AS unique_timestamps_per_second, round(estimated_rows_per_second, 9) AS estimated_rows_per_second FROM rates")
def _(spark, d):
    found = multiplicity.timestamp_rates(sensor(spark, d, coarse=True))
    return found.select("file", *[F.round(c, 9).alias(c) for c in ("unique_timestamps_per_second", "estimated_rows_per_second")])


@register("agg_heart_rate_zero_fraction", f"WITH {COARSE} SELECT file, round(count(*) FILTER (WHERE heart_rate = 0) / CAST(count(*) AS DOUBLE), 6) AS heart_rate_zero_fraction FROM sensor GROUP BY file")
def _(spark, d):
    return rounded(multiplicity.heart_rate_zero_fraction(sensor(spark, d, coarse=True)), "heart_rate_zero_fraction")


INNER = ", ".join(f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS {c}_u, count(*) FILTER (WHERE {c} = 0) AS {c}_z, count(*) - count({c}) AS {c}_m" for c in VALUES)
VARIATION = f"{COARSE}, inside AS (SELECT file, time_us, {INNER} FROM sensor WHERE time_us IS NOT NULL GROUP BY file, time_us), variation AS (" + " UNION ALL ".join(
    f"SELECT file, '{c}' AS \"column\", count(*) AS timestamp_groups, count(*) FILTER (WHERE {c}_u <= 1) AS constant_groups, count(*) FILTER (WHERE {c}_u > 1) AS varying_groups, "
    f"count(*) FILTER (WHERE {c}_u > 1) / CAST(count(*) AS DOUBLE) AS varying_group_fraction, avg({c}_u) AS mean_unique_values_per_timestamp, median({c}_u) AS median_unique_values_per_timestamp, "
    f"max({c}_u) AS maximum_unique_values_per_timestamp, CAST(sum({c}_z) AS BIGINT) AS zero_rows, CAST(sum({c}_m) AS BIGINT) AS missing_rows FROM inside GROUP BY file"
    for c in VALUES
) + ")"


@register("agg_column_variation", f"""WITH {VARIATION} SELECT file, "column", timestamp_groups, constant_groups, varying_groups, round(varying_group_fraction, 6) AS varying_group_fraction,
  round(mean_unique_values_per_timestamp, 6) AS mean_unique_values_per_timestamp, round(median_unique_values_per_timestamp, 6) AS median_unique_values_per_timestamp,
  CAST(maximum_unique_values_per_timestamp AS BIGINT) AS maximum_unique_values_per_timestamp, zero_rows, missing_rows FROM variation""")  # fmt: skip
def _(spark, d):
    found = multiplicity.column_variation(sensor(spark, d, coarse=True), VALUES)
    found = found.withColumn("maximum_unique_values_per_timestamp", F.col("maximum_unique_values_per_timestamp").cast("long"))
    return rounded(found, "varying_group_fraction", "mean_unique_values_per_timestamp", "median_unique_values_per_timestamp")


@register("agg_variation_by_column", f"""WITH {VARIATION} SELECT "column", round(avg(varying_group_fraction), 6) AS mean_varying_fraction FROM variation GROUP BY 1""")
def _(spark, d):
    return rounded(multiplicity.variation_by_column(multiplicity.column_variation(sensor(spark, d, coarse=True), VALUES)), "mean_varying_fraction")


@register("agg_multiplicity_modes", f"""WITH {COARSE}, {SIZES}, {SIZE_MODE} SELECT mode_rows_per_timestamp, count(*) AS files, (SELECT median(mode_rows_per_timestamp) FROM smode WHERE mode_rows_per_timestamp > 0) AS median_mode
  FROM smode WHERE mode_rows_per_timestamp > 0 GROUP BY 1""")  # fmt: skip
def _(spark, d):
    return multiplicity.mode_histogram(multiplicity.file_audit(sensor(spark, d, coarse=True)))


@register("agg_rate_rollup", f"WITH {COARSE}, {SIZES}, {RATES} {spread_sql('rates', 9, 'unique_timestamps_per_second', 'estimated_rows_per_second')}")
def _(spark, d):
    return spread(multiplicity.timestamp_rates(sensor(spark, d, coarse=True)), 9, "unique_timestamps_per_second", "estimated_rows_per_second")


@register("agg_multiplicity_rollup", f"""WITH {COARSE}, {SIZES} SELECT (SELECT count(DISTINCT file) FROM sensor) AS files, (SELECT count(DISTINCT file) FROM sizes WHERE n > 1) AS with_duplicate_groups,
  (SELECT count(DISTINCT file) FROM sensor WHERE time_us IS NULL) AS with_invalid_timestamps""")  # fmt: skip
def _(spark, d):
    return multiplicity.rollup(multiplicity.file_audit(sensor(spark, d, coarse=True)))
