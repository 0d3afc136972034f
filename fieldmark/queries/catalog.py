"""Queries on the catalogue: scans, sinks, projections, samples, joins, counts and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.functions import scalars
from fieldmark.operators import catalog as ops
from fieldmark.operators import inventory as inv
from fieldmark.operators import outcomes as out
from fieldmark.operators import sampling
from fieldmark.queries.fixtures import CATALOG, FILES, SENSOR, catalog, files, r6, register, sensor, table
from fieldmark.schemas import CATALOG as CATALOG_DDL
from fieldmark.sources import readers, sinks
from fieldmark.sources.shared import fresh_folder

COLUMNS = "path, filename, team, year, month, date, player_id, size_bytes"


def written(df, kind, columns, schema):
    """``df`` through a sink and back: what a later step reads."""
    spark = df.sparkSession
    path = f"{sink_folder(spark)}/{kind}"
    sinks.write_table(df, path, columns)
    return spark.read.schema(schema).option("header", True).csv(path)


def sink_folder(spark):
    return fresh_folder(spark, "sinks")


@register("src_file_listing")
def _(spark, d):
    return readers.list_files(spark, d)


@register("src_catalog_roundtrip", f"WITH {CATALOG} SELECT {COLUMNS} FROM catalog")
def _(spark, d):
    path = f"{sink_folder(spark)}/manifest"
    sinks.write_table(catalog(spark, d), path, sinks.MANIFEST)
    return readers.read_catalog(spark, path)


@register("sink_manifest", f"WITH {CATALOG} SELECT {COLUMNS} FROM catalog")
def _(spark, d):
    return written(catalog(spark, d), "manifest", sinks.MANIFEST, CATALOG_DDL)


INVENTORY = f"""{CATALOG}, inventory AS (SELECT player_id, team, count(*) AS session_files, min(date) AS first_date, max(date) AS last_date,
  string_agg(DISTINCT CAST(year AS VARCHAR), ';' ORDER BY CAST(year AS VARCHAR)) AS years, count(DISTINCT month) AS months, count(DISTINCT date) AS active_dates,
  CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes FROM catalog GROUP BY player_id, team)"""
INVENTORY_DDL = "player_id string, team string, session_files long, first_date string, last_date string, years string, months long, active_dates long, total_size_bytes long"


@register("agg_player_inventory", f"WITH {INVENTORY} SELECT * FROM inventory")
def _(spark, d):
    return inv.player_inventory(catalog(spark, d))


@register("sink_inventory", f"WITH {INVENTORY} SELECT * FROM inventory")
def _(spark, d):
    return written(inv.player_inventory(catalog(spark, d)), "inventory", sinks.INVENTORY, INVENTORY_DDL)


@register("agg_multi_team_players", f"""WITH {CATALOG} SELECT player_id, count(DISTINCT team) AS n_teams, string_agg(DISTINCT team, ';' ORDER BY team) AS teams
  FROM catalog GROUP BY player_id HAVING count(DISTINCT team) > 1""")  # fmt: skip
def _(spark, d):
    return inv.multi_team_players(catalog(spark, d))


@register("agg_players_by_team", f"WITH {INVENTORY} SELECT team, count(DISTINCT player_id) AS players FROM inventory GROUP BY team")
def _(spark, d):
    return inv.players_by_team(inv.player_inventory(catalog(spark, d)))


@register("agg_session_count_stats", f"WITH {INVENTORY} SELECT min(session_files) AS minimum, max(session_files) AS maximum, round(avg(session_files), 6) AS mean FROM inventory")
def _(spark, d):
    return inv.session_count_stats(inv.player_inventory(catalog(spark, d))).withColumn("mean", r6("mean"))


@register("agg_inventory_totals", f"""WITH {INVENTORY} SELECT count(DISTINCT player_id) AS players, count(*) AS player_team_rows,
  (SELECT count(*) FROM (SELECT player_id FROM inventory GROUP BY player_id HAVING count(*) > 1) m) AS multi_team_players FROM inventory""")  # fmt: skip
def _(spark, d):
    return inv.inventory_totals(inv.player_inventory(catalog(spark, d)))


@register("proj_filename_parse", f"WITH {CATALOG} SELECT path, date, team, player_id FROM catalog")
def _(spark, d):
    return catalog(spark, d).select("path", "date", "team", "player_id")


@register("proj_date_parts", f"WITH {CATALOG} SELECT path, year, month FROM catalog")
def _(spark, d):
    return catalog(spark, d).select("path", "year", "month")


@register("filter_unmatched_names", f"WITH {CATALOG} SELECT path, filename FROM files WHERE path NOT IN (SELECT path FROM catalog)")
def _(spark, d):
    return ops.unmatched(files(spark, d)).select("path", "filename")


@register("proj_human_size", f"""WITH {FILES} SELECT path, CASE WHEN size_bytes < 1024 THEN printf('%.2f B', size_bytes / 1.0) WHEN size_bytes < 1048576 THEN printf('%.2f KB', size_bytes / 1024.0)
  WHEN size_bytes < 1073741824 THEN printf('%.2f MB', size_bytes / 1048576.0) ELSE printf('%.2f GB', size_bytes / 1073741824.0) END AS size FROM files""")  # fmt: skip
def _(spark, d):
    return files(spark, d).select("path", scalars.human_size(F.col("size_bytes")).alias("size"))


@register("proj_file_stem", f"WITH {FILES} SELECT path, filename AS name, regexp_replace(filename, '\\.parquet$', '') AS stem, '.parquet' AS extension FROM files")
def _(spark, d):
    p = F.col("path")
    return files(spark, d).select("path", scalars.file_name(p).alias("name"), scalars.file_stem(p).alias("stem"), scalars.file_extension(p).alias("extension"))


@register("proj_category", f"WITH {FILES} SELECT path, CAST(ordinal AS VARCHAR) AS category FROM files")
def _(spark, d):
    return files(spark, d).select("path", scalars.category(F.col("path"), "/raw").alias("category"))


@register("fn_schema_fingerprint", f"WITH {FILES} SELECT path, substr(sha256(filename), 1, 12) AS fingerprint FROM files")
def _(spark, d):
    return files(spark, d).select("path", scalars.fingerprint(F.col("filename")).alias("fingerprint"))


@register("fn_joined_set", f"WITH {CATALOG} SELECT player_id, string_agg(DISTINCT month, ';' ORDER BY month) AS months FROM catalog GROUP BY player_id")
def _(spark, d):
    return catalog(spark, d).groupBy("player_id").agg(scalars.joined_set(F.col("month")).alias("months"))


@register("fn_spread_index", """SELECT o_orderkey AS i, CAST(round_even(CAST(o_orderkey AS DOUBLE) * 99 / 14999.0, 0) AS BIGINT) AS at FROM orders""")
def _(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("i"), scalars.spread_index(F.col("o_orderkey"), 100, 15000).alias("at"))


RANKED = f"""{CATALOG}, ranked AS (SELECT catalog.*, row_number() OVER (PARTITION BY team, year ORDER BY date, player_id, filename, path) - 1 AS group_rank,
  count(*) OVER (PARTITION BY team, year) AS group_size FROM catalog)"""
SPREAD = f"""{RANKED}, wanted AS (SELECT g.team, g.year, CAST(round_even(i * (g.n - 1) / 24.0, 0) AS BIGINT) AS r FROM
  (SELECT team, year, count(*) AS n FROM catalog GROUP BY team, year) g CROSS JOIN range(25) t(i)),
  chosen AS (SELECT ranked.* FROM ranked WHERE group_size <= 25 OR EXISTS (SELECT 1 FROM wanted w WHERE w.team = ranked.team AND w.year = ranked.year AND w.r = ranked.group_rank))"""


@register("sample_files_spread", f"WITH {SPREAD} SELECT {COLUMNS} FROM chosen")
def _(spark, d):
    return sampling.spread_files(catalog(spark, d), 25)


@register("win_group_rank", f"WITH {RANKED} SELECT path, group_rank FROM ranked")
def _(spark, d):
    return sampling.ranked_files(catalog(spark, d)).select("path", F.col("group_rank").cast("long").alias("group_rank"))


@register("win_group_size", f"WITH {RANKED} SELECT path, group_size FROM ranked")
def _(spark, d):
    return sampling.ranked_files(catalog(spark, d)).select("path", "group_size")


@register("join_catalog_sensor", f"""WITH {CATALOG}, {SENSOR} SELECT path, pos, heart_rate FROM catalog c JOIN sensor s ON c.ordinal = s.file""")
def _(spark, d):
    keyed = catalog(spark, d).withColumn("file", scalars.category(F.col("path"), "/raw").cast("long"))
    return keyed.join(scalars.nan_as_null(sensor(spark, d)), "file").select("path", "pos", "heart_rate")


LEFT = f"""{CATALOG}, {SENSOR}, audit AS (SELECT file, count(*) AS n FROM sensor GROUP BY file)"""


@register("join_catalog_left", f"WITH {LEFT} SELECT path, coalesce(n, 0) AS rows_inspected FROM catalog c LEFT JOIN audit a ON c.ordinal = a.file")
def _(spark, d):
    keyed = catalog(spark, d).withColumn("file", scalars.category(F.col("path"), "/raw").cast("long"))
    audit = sensor(spark, d).groupBy("file").agg(F.count(F.lit(1)).alias("rows_inspected"))
    return out.kept_left(keyed, audit, "file", ["rows_inspected"]).select("path", "rows_inspected")


@register("proj_empty_defaults", f"WITH {LEFT} SELECT path, coalesce(n, 0) AS n, coalesce(n * 0.5, 0.0) AS half, CASE WHEN n IS NULL THEN '' ELSE 'read' END AS state FROM catalog c LEFT JOIN audit a ON c.ordinal = a.file")
def _(spark, d):
    keyed = catalog(spark, d).withColumn("file", scalars.category(F.col("path"), "/raw").cast("long"))
    audit = sensor(spark, d).groupBy("file").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * 0.5).alias("half"), F.lit("read").alias("state"))
    return keyed.join(audit, "file", "left").na.fill(0, ["n"]).na.fill(0.0, ["half"]).na.fill("", ["state"]).select("path", "n", "half", "state")


@register("join_selected_semi", f"WITH {SPREAD}, {SENSOR} SELECT file, pos FROM sensor WHERE file IN (SELECT ordinal FROM chosen)")
def _(spark, d):
    chosen = sampling.spread_files(catalog(spark, d), 25).select(scalars.category(F.col("path"), "/raw").cast("long").alias("file"))
    return sensor(spark, d).join(chosen, "file", "left_semi").select("file", "pos")


TOTALS = f"""WITH {CATALOG} SELECT count(*) AS files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes, count(DISTINCT team) AS teams, count(DISTINCT year) AS years, count(DISTINCT month) AS months,
  count(DISTINCT date) AS dates, count(DISTINCT player_id) AS players, (SELECT count(*) FROM files) - count(*) AS unmatched FROM catalog"""


@register("agg_catalog_totals", TOTALS)
def _(spark, d):
    return ops.totals(files(spark, d))


def counted(name, *keys):
    k = ", ".join(keys)
    register(name, f"WITH {CATALOG} SELECT {k}, count(*) AS files FROM catalog GROUP BY {k}")(lambda spark, d: ops.counts_by(catalog(spark, d), *keys))


counted("agg_files_by_team", "team")
counted("agg_files_by_year", "year")
counted("agg_files_by_month", "month")
counted("agg_files_by_team_year", "team", "year")


@register("agg_files_by_sets", f"WITH {CATALOG} SELECT team, year, month, count(*) AS files FROM catalog GROUP BY GROUPING SETS ((team), (year), (month), (team, year))")
def _(spark, d):
    return ops.counts_by_sets(catalog(spark, d)).drop("grouping")


@register("agg_files_by_player", f"WITH {CATALOG} SELECT player_id, count(*) AS files FROM catalog GROUP BY player_id ORDER BY files DESC, min(ordinal)")
def _(spark, d):
    first = F.min(scalars.category(F.col("path"), "/raw").cast("long")).alias("first")
    found = catalog(spark, d).groupBy("player_id").agg(F.count(F.lit(1)).alias("files"), first)
    return ops.frequency_order(found, "files", "first").drop("first")


@register("sort_catalog", f"WITH {CATALOG} SELECT {COLUMNS} FROM catalog ORDER BY team, year, date, player_id")
def _(spark, d):
    return ops.ordered(catalog(spark, d))


@register("sort_inventory", f"WITH {INVENTORY} SELECT * FROM inventory ORDER BY team, session_files DESC, player_id")
def _(spark, d):
    return inv.ordered(inv.player_inventory(catalog(spark, d)))


@register("sort_frequency", f"WITH {CATALOG} SELECT month, count(*) AS files FROM catalog GROUP BY month ORDER BY files DESC, min(ordinal)")
def _(spark, d):
    first = F.min(scalars.category(F.col("path"), "/raw").cast("long")).alias("first")
    found = catalog(spark, d).groupBy("month").agg(F.count(F.lit(1)).alias("files"), first)
    return ops.frequency_order(found, "files", "first").drop("first")


@register("sort_distinct_keys", f"WITH {CATALOG} SELECT DISTINCT date FROM catalog ORDER BY date")
def _(spark, d):
    return ops.distinct_keys(catalog(spark, d), "date")


@register("set_distinct", f"WITH {CATALOG} SELECT DISTINCT player_id FROM catalog")
def _(spark, d):
    return catalog(spark, d).select("player_id").distinct()
