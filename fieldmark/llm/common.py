"""What the corpus operators share: scratch tables, row keys, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key that holds more than one in so many of all rows is hot; there are at most so many of them.
HOT_KEYS = 4096
#: Bytes of raw files that a task reads.
READ_BYTES = 64 << 20
#: Rows of a narrow table (keys and numbers, under 200 bytes each) that may be broadcast.
NARROW_ROWS = 100_000
#: The row key of a null doc_id: later than any other.
NO_ID = 2**63 - 1
_no_folder: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's scratch folder below ``spark.checkpoint.dir``.

    The cluster names that folder; a path without a scheme is in the cluster's
    default store. Where none is named (local mode) one temporary folder is
    used for the application.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if app not in _no_folder:
            _no_folder[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        base = _no_folder[app]
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return f"{store.makeQualified(path).toString().rstrip('/')}/{app}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free(*staged: DataFrame) -> None:
    """Delete staged tables that nothing will read again: all that was made of them is written."""
    for df in staged:
        _delete(df.sparkSession, df.scratch)


def made(spark: SparkSession) -> int:
    """How many scratch paths this application has had; for ``free_since``."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def free_since(spark: SparkSession, count: int, keep: str) -> None:
    """Delete the scratch paths made after the first ``count``, but ``keep``."""
    for path in _made.get(spark.sparkContext.applicationId, [])[count:]:
        if path != keep:
            _delete(spark, path)


def clean(spark: SparkSession) -> None:
    """Delete every scratch table of this application; results that still read them end."""
    _delete(spark, shared_dir(spark))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI of the shared folder and the path in it, for tasks that write raw bytes."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow``. Spark bounds a batch by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB), so long texts come a few at a time."""
    return df.mapInArrow(fn, schema)


def dealt(df: DataFrame, rows: int, size: int, *keys: str) -> DataFrame:
    """``df``, ``rows`` places that name ``size`` bytes to read, over as many tasks as those bytes and the cluster ask for.

    The number is stated because adaptive execution would go by the bytes of
    the names and fold them into one task; a stated number is kept.
    """
    tasks = max(-(-size // READ_BYTES), 2 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartitionByRange(max(1, min(rows, tasks)), *keys)


def row_key(text: str = "text") -> list[Column]:
    """``rk_id`` and ``rk_text``: what tells rows apart even where a doc_id is repeated or null."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("rk_id"), F.xxhash64(F.col(text).cast("string")).alias("rk_text")]


def keyed_texts(docs: DataFrame) -> DataFrame:
    """``(rk_id, rk_text, text)`` of every row of ``docs``."""
    return docs.select(*row_key(), F.col("text").cast("string").alias("text"))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``(rk_id, rk_text, row)``: the caller's columns nested in one, so that no name of theirs meets one of ours."""
    return docs.select(*row_key(), F.struct("*").alias("row"))


def doc_id() -> Column:
    return F.when(F.col("rk_id") != NO_ID, F.col("rk_id")).alias("doc_id")


def split_join(rows: DataFrame, table: DataFrame, keys: list[str], times: str, how: str = "inner", narrow: bool = False) -> DataFrame:
    """``rows`` joined (inner or left) with ``table``, which has each key once and says in ``times`` how many rows have it.

    Hot keys, of which there are at most ``HOT_KEYS``, are broadcast, so their
    rows stay where they are; the others meet in a shuffle. A ``narrow`` table
    of at most ``NARROW_ROWS`` is broadcast as a whole.
    """
    total, count = table.agg(F.coalesce(F.sum(times), F.lit(0)), F.count(F.lit(1))).first()
    if narrow and count <= NARROW_ROWS:
        return rows.join(F.broadcast(table), keys, how)
    hot = F.col(times) * HOT_KEYS > F.lit(total).cast("long")
    met = rows.join(F.broadcast(table.where(hot)), keys)
    rest = rows.join(F.broadcast(table.where(hot).select(*keys)), keys, "left_anti")
    return met.unionByName(rest.join(table.where(~hot), keys, how))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII takes the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def one_task_round(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step over few ``edges(a, b)``, in one task: minima over windows, so nothing is broadcast and no step is made twice."""
    least, b = F.min("b").over(Window.partitionBy("a")), F.col("b").alias("a")
    both = edges.coalesce(1).select(F.inline(F.array(F.struct("a", "b"), F.struct(b, F.col("a").alias("b")))))
    large = both.withColumn("m", F.least(least, "a")).where("b > a").select(b, F.col("m").alias("b")).distinct().withColumn("m", least)
    small = large.select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(b, F.col("m").alias("b")))))
    return small.where("a != b").distinct()


def shuffled_round(edges: DataFrame) -> DataFrame:
    """The same over any number of edges: grouped minima, and joins with the hubs' labels broadcast and the others' shuffled."""
    count = F.count(F.lit(1)).alias("n")
    both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), count)
    large = split_join(both.where("b > a"), least, ["a"], "n").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"), count)
    joined = split_join(large, least, ["a"], "n").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` of longs, as ``(node, root)``; root is the least node.

    Alternates the large-star and small-star steps. Both are a grouped minimum
    (combined before the shuffle) and a join, so no large neighbourhood is held
    in one task's memory. Each round is written to the shared folder. Self
    loops are ignored; an empty input gives an empty result. The rounds end by
    themselves: each either lowers a label or is the last. A round of at most
    ``NARROW_ROWS`` edges is one small task, which needs no shuffle and no broadcast.
    """
    now = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        after = stage(one_task_round(now) if state[0] <= NARROW_ROWS else shuffled_round(now), "edges")
        free(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
