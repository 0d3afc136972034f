"""The test tables seen as an archive: in Spark, and as common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldmark.functions import scalars
from fieldmark.operators import catalog as catalogs
from fieldmark.schemas import FILE_NAME

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under ``name`` with its SQL twin."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = " ".join(sql.split())
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six decimals: sums differ in their last bits between engines."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- files and catalogue, from orders

FILES = """files AS (
  SELECT '/raw/' || o_orderkey || '/' || filename AS path, filename, size_bytes, o_orderkey AS ordinal FROM (
    SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS size_bytes,
      CASE WHEN o_orderkey % 50 = 0 THEN 'junk-' || o_orderkey || '.parquet'
        ELSE strftime(o_orderdate, '%Y-%m-%d') || '-Team' || o_orderstatus || '-' || o_custkey || '.parquet' END AS filename
    FROM orders) o)"""
CATALOG = f"""{FILES}, catalog AS (
  SELECT path, filename, ordinal, regexp_extract(filename, '{FILE_NAME}', 2) AS team, CAST(substr(filename, 1, 4) AS INTEGER) AS year,
    substr(filename, 1, 7) AS month, regexp_extract(filename, '{FILE_NAME}', 1) AS date, regexp_extract(filename, '{FILE_NAME}', 3) AS player_id, size_bytes
  FROM files WHERE regexp_matches(filename, '{FILE_NAME}'))"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    name = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-Team"), "o_orderstatus", F.lit("-"), F.col("o_custkey").cast("string"), F.lit(".parquet"))
    name = F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.lit("junk-"), key, F.lit(".parquet"))).otherwise(name)
    rows = o.select(name.alias("filename"), F.round(F.col("o_totalprice") * 100).cast("long").alias("size_bytes"), "o_orderkey")
    path = F.concat(F.lit("/raw/"), F.col("o_orderkey").cast("string"), F.lit("/"), "filename")
    return rows.select(path.alias("path"), "filename", "size_bytes", F.col("o_orderkey").alias("ordinal"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.matched(files(spark, sf_dir))


# --- readings, from events

TIME_RX = scalars.TIME_OF_DAY


def us_sql(column: str) -> str:
    part = lambda i: f"CAST(regexp_extract({column}, '{TIME_RX}', {i}) AS BIGINT)"
    return f"""CASE WHEN regexp_matches({column}, '{TIME_RX}') THEN ({part(1)} * 3600 + {part(2)} * 60 + {part(3)}) * 1000000
      + CAST(rpad(substr(regexp_extract({column}, '{TIME_RX}', 4), 1, 6), 6, '0') AS BIGINT) END"""


def sensor_sql(coarse: bool = False) -> str:
    clock = "date_trunc('hour', ts)" if coarse else "ts"
    return f"""raw AS (
      SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, event_id,
        CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 97 = 0 THEN strftime({clock}, '%H:%M:%S') ELSE strftime({clock}, '%H:%M:%S.%f') END AS time,
        CASE WHEN event_id % 13 = 0 THEN 0.0 WHEN event_id % 17 = 0 OR event_id % 19 = 0 THEN NULL ELSE floor(value) END AS heart_rate,
        value / 10 - 1 AS speed, value - 95 AS lat, value - 200 AS lon,
        CASE WHEN user_id % 2 = 0 THEN 'TeamA' ELSE 'TeamB' END AS team, CAST(user_id AS VARCHAR) AS player_id,
        CASE WHEN user_id % 7 = 0 THEN CAST(user_id AS VARCHAR) WHEN user_id % 2 = 0 THEN 'TeamA-' || user_id ELSE 'TeamB-' || user_id END AS player_name
      FROM events), sensor AS (SELECT raw.*, {us_sql('time')} AS time_us FROM raw)"""


SENSOR, COARSE = sensor_sql(), sensor_sql(True)
VALUES = ["heart_rate", "speed", "lat", "lon"]
#: Differences between valid rows in file order.
BRIDGED = "bridged AS (SELECT sensor.*, time_us - lag(time_us) OVER (PARTITION BY file ORDER BY pos) AS d FROM sensor WHERE time_us IS NOT NULL)"
MEDIANS = "medians AS (SELECT file, median(CASE WHEN d > 0 THEN d END) AS m FROM bridged GROUP BY file)"
MODES = """counted AS (SELECT file, CASE WHEN d > 0 THEN round_even(d / 1000.0, 0) / 1000 END AS ms, count(*) AS n, min(pos) AS seen FROM bridged GROUP BY 1, 2),
  modes AS (SELECT file, max(CASE WHEN k = 1 THEN ms END) AS mode_interval_seconds FROM (
    SELECT file, ms, row_number() OVER (PARTITION BY file ORDER BY (ms IS NULL), n DESC, seen) AS k FROM counted) c GROUP BY file)"""
SIZES = "sizes AS (SELECT file, time_us, count(*) AS n, min(pos) AS seen FROM sensor WHERE time_us IS NOT NULL GROUP BY 1, 2)"


def sensor(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "events")
    clock = F.date_trunc("hour", F.col("ts").cast("timestamp")) if coarse else F.col("ts").cast("timestamp")
    i, user = F.col("event_id"), F.col("user_id")
    time = F.when(i % 101 == 0, None).when(i % 97 == 0, F.date_format(clock, "HH:mm:ss")).otherwise(F.date_format(clock, "HH:mm:ss.SSSSSS"))
    # NaN must count as null everywhere, as the SQL twins have it
    rate = F.when(i % 13 == 0, 0.0).when(i % 17 == 0, None).when(i % 19 == 0, float("nan")).otherwise(F.floor("value").cast("double"))
    team = F.when(user % 2 == 0, "TeamA").otherwise("TeamB")
    name = F.when(user % 7 == 0, user.cast("string")).otherwise(F.concat_ws("-", team, user.cast("string")))
    rows = e.select(
        user.alias("file"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("pos"), "event_id", time.alias("time"),
        rate.alias("heart_rate"), (F.col("value") / 10 - 1).alias("speed"), (F.col("value") - 95).alias("lat"), (F.col("value") - 200).alias("lon"),
        team.alias("team"), user.cast("string").alias("player_id"), name.alias("player_name"),
    )
    return rows.withColumn("time_us", scalars.time_of_day_us(F.col("time")))


# --- self-report tables, from documents and labels

CUT = "documents_cut AS (SELECT lang, source, nullif(n_chars // 1000, 3) AS size FROM documents)"
LABELLED = "documents_labelled AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic, CASE WHEN d.doc_id % 5 <> 0 THEN CAST(d.doc_id % 7 AS DOUBLE) END AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
TOKENS = "documents_tokens AS (SELECT doc_id, CASE WHEN lang = 'es' THEN 'NA' WHEN lang = 'fr' THEN 'null' ELSE lang END AS lang FROM documents)"


def documents_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", "source", F.expr("nullif(n_chars div 1000, 3)").alias("size"))


def documents_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("score", F.when(F.col("doc_id") % 5 == 0, float("nan")).otherwise((F.col("doc_id") % 7).cast("double")))


def documents_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.when(F.col("lang") == "es", "NA").when(F.col("lang") == "fr", "null").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", token.alias("lang"))


def orders_as_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("player"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("price"))


REPORT = "report AS (SELECT o_custkey AS player, o_orderdate AS date, o_totalprice AS price FROM orders)"

# --- read outcomes, from events

OUTCOMES = """outcomes AS (SELECT event_id AS ordinal, 'event:' || event_type AS schema_text, substr(sha256('event:' || event_type), 1, 12) AS schema_id,
  CASE WHEN event_id % 211 = 0 THEN 'unreadable' ELSE '' END AS error FROM events)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("event:"), "event_type")
    error = F.when(F.col("event_id") % 211 == 0, "unreadable").otherwise("")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), text.alias("schema_text"), error.alias("error"))
    return rows.withColumn("schema_id", scalars.fingerprint(F.col("schema_text")))
