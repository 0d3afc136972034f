"""Scans: file listings, recordings, footers, catalogues and CSV tables."""

from __future__ import annotations

import csv
import fnmatch
import io
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark import schemas
from fieldmark.functions import scalars
from fieldmark.sources.shared import kept


#: Stored types that are numbers as they are.
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "string")
#: Files whose paths one scan is given.
FILES_PER_SCAN = 20_000
#: Bytes up to which a file is read whole by the task that has its path.
SMALL_FILE = 32 << 20
#: Small files, and bytes of them, that a task opens.
FILES_PER_TASK, BYTES_PER_TASK = 500, 128 << 20
#: Stored types that tasks hand on as they are.
PLAIN = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def list_files(spark: SparkSession, root: str, glob: str = "*.parquet") -> DataFrame:
    """``(path, filename, size_bytes)`` of every file below ``root``; contents are not read. Raises if there is none.

    Tasks list the folders where Arrow opens the store, so the driver holds no
    names. Elsewhere, and where ``root`` is a file or a pattern, a scan lists;
    it leaves out files of 0 bytes, so their names are added from the listing
    that the driver has made for it.
    """
    folder = qualified(spark, root)
    if is_folder(folder):
        files = below(spark, folder, glob)
        if files.isEmpty():
            raise FileNotFoundError(f"no {glob} below {root}")
        return files.select("path", scalars.file_name(F.col("path")).alias("filename"), F.col("length").alias("size_bytes"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    names = found.inputFiles()
    if not names:
        raise FileNotFoundError(f"no {glob} below {root}")
    # asked for once; a scan would have a task for every few files, and a part of the listing for each
    files = kept(found.select("path", "length").coalesce(tasks_for(spark, len(names))), "listed")
    if files.count() < len(names):
        seen = {r.path for r in files.select("path").toLocalIterator()}
        blank = [(n, 0) for n in names if n not in seen and n.replace("file:///", "file:/") not in seen]
        files = files.unionByName(spark.createDataFrame(blank, "path string, length long"))
    return files.select("path", scalars.file_name(F.col("path")).alias("filename"), F.col("length").alias("size_bytes"))


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its store, as scans name files; one without a scheme is in the cluster's default store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    return (pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else pafs.FileSystem.from_uri(uri)


def is_folder(uri: str) -> bool:
    """Whether a URI, no pattern, is a folder in a store that Arrow opens."""
    if as_given(uri) != uri:
        return False
    try:
        fs, name = store_of(uri)
        return uri.endswith(name) and fs.get_file_info(name).type == pafs.FileType.Directory
    except (OSError, ValueError, NotImplementedError):  # another store, or one that Arrow was built without
        return False


def hidden(name: str) -> bool:
    """Names that a scan passes over."""
    kept_ones = name.startswith(("_metadata", "_common_metadata"))
    return not kept_ones and (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def below(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """``(path, length)`` of the files below the folder ``root``, level by level; a folder is listed by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for folder in (p for batch in batches for p in batch.column("path").to_pylist()):
            fs, name = store_of(folder)
            store = folder.removesuffix(name)
            found = [f for f in fs.get_file_info(pafs.FileSelector(name)) if not hidden(f.base_name)]
            found = [f for f in found if f.type == pafs.FileType.Directory or fnmatch.fnmatchcase(f.base_name, glob)]
            lengths = [None if f.type == pafs.FileType.Directory else f.size for f in found]
            table = pa.table({"path": pa.array([store + f.path for f in found], pa.string()), "length": pa.array(lengths, pa.int64())})
            yield from table.to_batches(8192)

    folders, levels, n = spark.createDataFrame([(root,)], "path string"), [], 1
    while n:
        seen = kept(folders.repartition(tasks_for(spark, n * FILES_PER_TASK)).mapInArrow(run, "path string, length long"), "listed")
        levels.append(seen.where(F.col("length").isNotNull()))
        folders = seen.where(F.col("length").isNull()).select("path")
        n = folders.count()
    return reduce(DataFrame.unionByName, levels)


def as_given(path: str) -> str:
    """A path of a listing for a scan, which would take some characters for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def plain_path(path: Column) -> Column:
    """A scan's file path as a listing has it: without percent codes."""
    return F.when(F.contains(path, F.lit("%")), F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CATALOG).option("header", True).csv(path)


def scan_sensor(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Recordings with ``path`` and ``pos``, the row's place in its file; only ``columns`` are read. Unreadable files are skipped."""
    rows = spark.read.option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).parquet(*paths)
    return rows.select(*columns, plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.row_index").alias("pos"))


def rows_per_file(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of each file from a scan that reads no column."""
    rows = spark.read.option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).parquet(*paths)
    return rows.select(plain_path(F.col("_metadata.file_path")).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("total_rows"))


def opened(path: str) -> pa.NativeFile:
    """A file for executor-side range reads, in any store that Arrow opens."""
    fs, name = store_of(path)
    return fs.open_input_file(name)


def opened_for_writing(path: str) -> pa.NativeFile:
    fs, name = store_of(path)
    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(name)


def footer_of(path: str, content: bytes | None) -> dict:
    source = opened(path) if content is None else pa.BufferReader(content)
    with source:
        file = pq.ParquetFile(source)
        fields, m = [f"{f.name}:{f.type}" for f in file.schema_arrow], file.metadata
        return {"row_count": m.num_rows, "column_count": m.num_columns, "row_groups": m.num_row_groups, "schema_text": "\n".join(fields), "columns": file.schema_arrow.names, "error": ""}


def footers(files: DataFrame) -> DataFrame:
    """Footer facts of the files in column ``path``; a file that cannot be read is a row with its error.

    Spark has no view of footers, so executors read them, as ranges of the
    file. Where ``files`` has a column ``content`` that is taken instead.
    """
    blank = {"row_count": 0, "column_count": 0, "row_groups": 0, "schema_text": "", "columns": []}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"] if "content" in frame else [None] * len(frame), strict=True):
                try:
                    rows.append({"path": path} | footer_of(path, content))
                except Exception as e:  # any damage is the file's, and is reported in its row
                    rows.append({"path": path} | blank | {"error": f"{type(e).__name__}: {e}"[:300]})
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schemas.FOOTERS.split(", ")])

    return files.mapInPandas(run, schemas.FOOTERS)


def footer_catalog(spark: SparkSession, root: str, through_spark: bool = False) -> DataFrame:
    """Footer facts of each Parquet file below ``root``. ``through_spark`` takes whole files from Spark's reader, for small files in a store that nothing else opens."""
    if through_spark:
        return footers(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root).select("path", "content"))
    return footers(list_files(spark, root).select("path"))


def kind_of(columns: list[str]) -> Column:
    """How a file stores ``columns``: a line ``name:type`` of its schema for each, in their order."""
    lines = F.split("schema_text", "\n")
    return F.array_join(F.transform(F.array(*[F.lit(f"{c}:") for c in columns]), lambda c: F.get(F.filter(lines, lambda line: F.startswith(line, c)), F.lit(0))), "\n")


def coerced(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` as text (``schemas.SENSOR_TEXTS``) or double whatever their stored type, and ``raw_missing``, how many of a row's cells were missing before."""
    rows = scalars.nan_as_null(rows, *columns)
    types = dict(rows.dtypes)
    out = []
    for c in columns:
        plain = F.col(f"`{c}`") if types[c] in NUMBERS or types[c].startswith("decimal") else F.col(f"`{c}`").cast("string")
        out.append((F.col(f"`{c}`").cast("string") if c in schemas.SENSOR_TEXTS else scalars.to_numeric(plain)).alias(c))
    missing = sum((F.col(f"`{c}`").isNull().cast("int") for c in columns), F.lit(0))
    return rows.select(*[c for c in rows.columns if c not in columns], *out, missing.alias("raw_missing"))


def tasks_for(spark: SparkSession, files: int, size: int = 0) -> int:
    """Tasks that open so many files of so many bytes: their number grows with both, and each has enough files to be worth its start."""
    return max(1, min(files, spark.sparkContext.defaultParallelism), -(-files // FILES_PER_TASK), min(files, size // BYTES_PER_TASK))


def recordings(spark: SparkSession, facts: DataFrame, columns: list[str], open_small: bool = False) -> DataFrame:
    """The readings of the good files of ``facts`` ``(path, kind, error)``, with ``file``, ``pos`` and ``raw_missing``.

    Files are grouped by ``kind``, the stored types of ``columns``: each kind
    has a scan of its own with its own schema and casts, so no file's types
    decide over another's. A scan is given the paths of its files and opens no
    other; nothing is joined. The driver holds the paths, as every scan does.
    With ``open_small``, files of up to ``SMALL_FILE`` bytes (``size_bytes`` of
    ``facts``) and plain types are left to ``small_files`` instead, so that many
    of them need no list on the driver.
    """
    good = facts.where(F.col("error") == "")
    small = F.col("size_bytes") <= SMALL_FILE if open_small else F.lit(False)
    size = F.sum(F.when(small, F.col("size_bytes"))) if open_small else F.lit(0)
    kinds = good.groupBy("kind").agg(F.min("path").alias("one"), F.count_if(small).alias("small"), size.alias("size")).orderBy("kind").collect()
    scans = []
    for kind in kinds:
        schema = spark.read.parquet(as_given(kind.one)).select(*[f"`{c}`" for c in columns]).schema
        files = good.where(F.col("kind") == kind.kind)
        if kind.small and all(f.dataType.simpleString() in PLAIN for f in schema):
            scans.append(coerced(small_files(files.where(small), tasks_for(spark, kind.small, kind.size), {f.name: f.dataType.simpleString() for f in schema}), columns))
            files = files.where(~small)
        paths = [as_given(r.path) for r in files.select("path").orderBy("path").toLocalIterator()]
        for at in range(0, len(paths), FILES_PER_SCAN):
            rows = spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(*paths[at : at + FILES_PER_SCAN])
            rows = rows.select(*[f"`{c}`" for c in columns], plain_path(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("pos"))
            scans.append(coerced(rows, columns))
    return reduce(DataFrame.unionByName, scans) if scans else spark.createDataFrame([], part_schema(columns))


def small_files(files: DataFrame, tasks: int, types: dict[str, str]) -> DataFrame:
    """The stored columns of small files, with ``file`` and ``pos``. Each is opened once; what can be read of a damaged one is read.

    A scan of Spark's is planned from a list of files that the driver holds,
    and has a task for every few of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for path in (p for batch in batches for p in batch.column("path").to_pylist()):
            try:
                with opened(path) as source:
                    at = 0
                    for part in pq.ParquetFile(source).iter_batches(8192, columns=list(types), use_threads=False):
                        data = [part.column(part.schema.get_field_index(c)).cast(PLAIN[t]) for c, t in types.items()]
                        held.append(pa.RecordBatch.from_arrays([*data, pa.array([path] * len(part), pa.string()), pa.array(np.arange(at, at + len(part)), pa.int64())], [*types, "file", "pos"]))
                        at, rows = at + len(part), rows + len(part)
                        if rows >= 8192:
                            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                            held, rows = [], 0
            except Exception:  # noqa: BLE001, S110  the rows that are lacking tell of the damage
                pass
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return files.select("path").repartition(tasks, "path").mapInArrow(run, ", ".join([*[f"`{c}` {t}" for c, t in types.items()], "file string", "pos long"]))


def part_schema(columns: list[str]) -> str:
    return "file string, pos long, " + ", ".join(f"`{c}` {'string' if c in schemas.SENSOR_TEXTS else 'double'}" for c in columns) + ", raw_missing int"


def wanted_rows(total: int, start: int, rows: int | None, spread: int | None) -> np.ndarray:
    """The places of a file's rows that are asked for: from ``start`` on, ``rows`` of them, or ``spread`` evenly spaced ones of all."""
    if spread is None or total <= spread:
        return np.arange(start, total if rows is None else min(total, start + rows))
    return np.unique(np.rint(np.arange(spread) * (total - 1) / max(1, spread - 1)).astype(np.int64))


def some_rows(path: str, columns: list[str], places: np.ndarray, batch_rows: int = 4096) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """The rows of a file at ``places`` (ascending). Row groups without one are passed over, and nothing is read behind the last."""
    with opened(path) as source:
        file = pq.ParquetFile(source, buffer_size=1 << 16)  # column chunks come as streams, so what follows the last batch is not fetched
        at = 0
        for g in range(file.metadata.num_row_groups):
            stop = at + file.metadata.row_group(g).num_rows
            if len(inside := places[(places >= at) & (places < stop)]):
                for batch in file.iter_batches(batch_rows, row_groups=[g], columns=columns):
                    here = inside[(inside >= at) & (inside < at + len(batch))]
                    if len(here):
                        yield here, batch.take(pa.array(here - at))
                    at += len(batch)
                    if at > inside[-1]:
                        break
            at = stop


def as_stored(column: pa.Array, text: bool) -> pa.Array:
    """A column as text or as numbers; what is no number is null."""
    if text or not (pa.types.is_floating(column.type) or pa.types.is_integer(column.type) or pa.types.is_boolean(column.type) or pa.types.is_decimal(column.type)):
        column = column.cast(pa.string())
        return column if text else pa.array(pd.to_numeric(column.to_pandas(), errors="coerce").astype(float), pa.float64(), from_pandas=True)
    return pa.array(column.cast(pa.float64()).to_numpy(zero_copy_only=False), from_pandas=True)


def parts_of(facts: DataFrame, columns: list[str], start: int = 0, rows: int | None = None, spread: int | None = None, tasks: int | None = None) -> DataFrame:
    """As ``recordings``, but of each file only a contiguous block or evenly spaced rows, without a scan of the whole file.

    Each row of ``facts`` ``(path, row_count, error)`` is a file and the rows it
    is read for, so nothing is joined or shuffled after the read, and files
    that differ in their types need no scan of their own.
    """
    spark, names = facts.sparkSession, [x.split()[0].strip("`") for x in part_schema(columns).split(", ")]
    tasks = tasks or 2 * spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, total in zip(batch.column("path").to_pylist(), batch.column("row_count").to_pylist(), strict=True):
                try:
                    for places, part in some_rows(path, columns, wanted_rows(total, start, rows, spread)):
                        data, missing = [], np.zeros(len(part), np.int32)
                        for c in columns:
                            raw = part.column(part.schema.get_field_index(c))
                            missing += raw.is_null(nan_is_null=True).to_numpy(zero_copy_only=False)
                            data.append(as_stored(raw, c in schemas.SENSOR_TEXTS))
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(places, pa.int64()), *data, pa.array(missing)], names)
                except Exception:  # noqa: BLE001, S110  the rows that are lacking tell of the damage
                    pass

    good = facts.where(F.col("error") == "").select("path", "row_count")
    return good.repartition(tasks, "path").mapInArrow(run, part_schema(columns))


def csv_tables(spark: SparkSession, root: str) -> DataFrame:
    """``(path, filename, category, table_name)`` of the CSV files below ``root``, by path. Raises if there is none."""
    files = list_files(spark, root, "*.csv")
    path = F.regexp_replace("path", r"^file:/+", "/")
    folder = root.removeprefix("file://")
    return files.select("path", "filename", scalars.category(path, folder).alias("category"), scalars.file_stem(F.col("path")).alias("table_name")).orderBy("path")


def csv_rows(lines: Iterator[str]) -> Iterator[list[str]]:
    """The records of a CSV text, the header first; blank lines are none. Raises where a record has more fields than the header, or where there is no header."""
    csv.field_size_limit(2**31 - 1)
    width = None
    for record in csv.reader(lines):
        if not record or len(record) == 1 and record[0] and not record[0].strip(" \t"):
            continue
        if width is None:
            width, seen = len(record), {}
            names = [c or f"Unnamed: {i}" for i, c in enumerate(record)]
            for i, c in enumerate(names):
                seen[c] = seen.get(c, -1) + 1
                names[i] = f"{c}.{seen[c]}" if seen[c] else c
            yield names
        elif len(record) > width:
            raise ValueError(f"a record has {len(record)} fields, the header {width}")
        else:
            yield record + [None] * (width - len(record))
    if width is None:
        raise ValueError("the file has no columns")


def csv_records(listed: DataFrame, tasks: int | None = None) -> DataFrame:
    """``(path, row, cells, error)`` of the CSV files in column ``path``, all parsed by one job.

    Row -1 is the header; missing-value texts are null. A file is a stream, of
    which a batch of records is held at a time, so neither a large file nor
    many of them ask for memory. What makes a file unreadable is its ``error``,
    in a row -2 of its own.
    """
    names = ["path", "row", "cells", "error"]
    missing = frozenset(schemas.NA_TOKENS)

    def batch_of(path: str, first: int, cells: list, error: str | None = None) -> pa.RecordBatch:
        n = len(cells)
        return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(range(first, first + n), pa.int64()), pa.array(cells, pa.list_(pa.string())), pa.array([error] * n, pa.string())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    with opened(path) as source:
                        first, cells, held = -1, [], 0
                        for record in csv_rows(io.TextIOWrapper(source, "utf-8-sig", newline="")):
                            cells.append(record if first + len(cells) < 0 else [None if c is None or c in missing else c for c in record])
                            held += sum(len(c) for c in record if c is not None)
                            if len(cells) >= 4096 or held > 8 << 20:
                                yield batch_of(path, first, cells)
                                first, cells, held = first + len(cells), [], 0
                        yield batch_of(path, first, cells)
                except Exception as e:  # any damage is the file's, and is reported in its row
                    yield batch_of(path, -2, [None], f"{type(e).__name__}: {e}"[:300])

    tasks = tasks or 4 * listed.sparkSession.sparkContext.defaultParallelism
    return listed.select("path").repartition(tasks, "path").mapInArrow(run, "path string, row long, cells array<string>, error string")


def read_csv_table(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """One CSV table. Missing-value texts become null first, then types are inferred from what is left."""
    text = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    text = text.select(*[scalars.missing_if_token(F.col(f"`{c}`")).alias(c) for c in text.columns])
    return typed(text) if infer else text


def fits(text: Column, kind: str) -> Column:
    """Whether a text is a value of a type; a date with a time is no date."""
    ok = text.try_cast(kind).isNotNull()
    return ok & ~text.rlike(r"\d[ T]\s*\d") if kind == "date" else ok


def typed(text: DataFrame) -> DataFrame:
    """Text columns as the narrowest of ``schemas.KINDS`` that fits every value."""
    every = [F.coalesce(F.bool_and(F.col(f"`{c}`").isNull() | fits(F.col(f"`{c}`"), k)), F.lit(True)).alias(f"{i}:{k}") for i, c in enumerate(text.columns) for k in schemas.KINDS]
    if not every:
        return text
    found = text.agg(*every, *[F.count(F.col(f"`{c}`")).alias(f"{i}:n") for i, c in enumerate(text.columns)]).first()
    kind = [next((k for k in schemas.KINDS if found[f"{i}:{k}"] and found[f"{i}:n"]), "string") for i in range(len(text.columns))]
    return text.select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in zip(text.columns, kind, strict=True)])
