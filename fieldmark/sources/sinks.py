"""Sinks: each writes the columns of its table in their fixed order."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of the tables that are written (fixed values).
MANIFEST = ["path", "filename", "team", "year", "month", "date", "player_id", "size_bytes"]
INVENTORY = ["player_id", "team", "session_files", "first_date", "last_date", "years", "months", "active_dates", "total_size_bytes"]


def write_table(df: DataFrame, path: str, columns: list[str], form: str = "csv") -> None:
    """``columns`` of ``df`` in that order, as CSV with a header or as Parquet."""
    writer = df.select(*columns).write.mode("overwrite")
    writer.options(header=True, escape='"').csv(path) if form == "csv" else writer.format(form).save(path)


def write_examples(frames: list[DataFrame], path: str) -> None:
    """The union of example rows; without any frame nothing is written."""
    if frames:
        union_examples(frames).write.mode("overwrite").option("header", True).csv(path)


def union_examples(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_schema_definitions(examples: DataFrame, path: str) -> None:
    """One text per schema id, sorted by id."""
    text = F.concat_ws("\n", F.concat(F.lit("schema "), F.col("schema_id")), F.col("schema_text"), F.lit(""))
    examples.dropDuplicates(["schema_id"]).orderBy("schema_id").select(text.alias("value")).write.mode("overwrite").text(path)


def metrics(one: DataFrame, section: str) -> DataFrame:
    """The single row of ``one`` as rows ``(section, metric, value)``."""
    rows = [F.struct(F.lit(section).alias("section"), F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns]
    return one.select(F.inline(F.array(*rows)))


#: The file that names the tables that are published in a folder.
PUBLISHED = "published.json"


def publish(results: dict[str, DataFrame], folder: str, form: str = "csv") -> None:
    """Write all tables of an audit below ``folder`` and make them its tables in one step.

    Tables go to a folder of this run; only when all are written does one small
    file that names them replace the last one. An audit that fails on the way
    leaves the folder's tables as they were. Runs before the last stay until
    ``forget`` removes them.
    """
    if not results:
        raise ValueError("there are no tables to publish")
    spark, run = next(iter(results.values())).sparkSession, f"run-{uuid.uuid4().hex[:12]}"
    for name, df in results.items():
        write_table(df, f"{folder}/{run}/{name}", df.columns, form)
    fs, path = _store(spark, f"{folder}/{PUBLISHED}")
    told = {"run": run, "form": form, "tables": {name: df.schema.jsonValue() for name, df in results.items()}}
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{run}/{PUBLISHED}")
    out = fs.create(draft, True)
    out.write(json.dumps(told, indent=1).encode())
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, path, over)


def _store(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(where)


def _told(spark: SparkSession, folder: str) -> dict:
    fs, path = _store(spark, f"{folder}/{PUBLISHED}")
    if not fs.exists(path):
        raise FileNotFoundError(f"nothing is published in {folder}")
    return json.loads("".join(r.value for r in spark.read.option("wholetext", True).text(path.toString()).collect()))


def published(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables that were last published in ``folder``, with their column types."""
    told = _told(spark, folder)
    out = {}
    for name, types in told["tables"].items():
        reader = spark.read.schema(StructType.fromJson(types)).format(told["form"])
        out[name] = (reader.options(header=True, multiLine=True, escape='"') if told["form"] == "csv" else reader).load(f"{folder}/{told['run']}/{name}")
    return out


def forget(spark: SparkSession, folder: str) -> list[str]:
    """Remove the runs in ``folder`` that are not the published one, and name them."""
    fs, _ = _store(spark, folder)
    run, gone = _told(spark, folder)["run"], []
    for status in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder)):
        if (name := status.getPath().getName()).startswith("run-") and name != run:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)
