"""Token counts from flat, unindexed token files by scanning for separators.

A token file is a run of little-endian ids, every document ended by the
end-of-document id; nothing says where documents begin. Files are cut into
blocks of equal size, each block is one range read and one vectorised search,
and yields a small row: separators, the lengths between them, and how many
tokens stand before the first. What a document that crosses blocks has in the
blocks before is found by a prefix scan over those rows (separators so far, and
the place of the last one). The scan has two levels, runs of blocks and the
blocks of a run, so one huge file is no single task.

Cases: an empty document counts 0; tokens after the last separator are an
unterminated last document (``ended`` is false); a document longer than many
blocks is stitched over all of them; an empty file has no documents; a null
text is empty; long texts, runs of blanks too, are encoded as a whole; repeated
rows are counted each; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import dealt, filesystem, free, map_batches, scratch, stage

#: Where every executor finds the vocabulary; clusters have their own path, see ``write_token_files``.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The split pattern that goes with the vocabulary file (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_DOCUMENT = 50256
#: A run of white space (the Unicode property, as the pattern has it) that is taken out before the pattern, which overflows its stack on a long one.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
BLOCK_BYTES = 4 << 20
#: Blocks in a run of the prefix scan.
RUN = 1024


@cache
def encoding(vocabulary: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, vocabulary: str) -> list[int]:
    """The text's ids. A long run of white space is a piece of its own in the pattern, without its last character if more text follows, so it is encoded as such."""
    enc, out, at = encoding(vocabulary), [], 0
    for run in BLANKS.finditer(text):
        stop = run.end() - (run.end() < len(text))
        out += enc.encode_ordinary(text[at : run.start()]) + enc._encode_single_piece(text[run.start() : stop])
        at = stop
    return out + enc.encode_ordinary(text[at:])


def write_token_files(docs: DataFrame, vocabulary: str = VOCABULARY, separator: int = END_OF_DOCUMENT, width: int = 2) -> tuple[DataFrame, DataFrame]:
    """Tokenise ``docs`` into flat files: ``(file, bytes)`` and the order they were written in, ``(file, ordinal, doc_id)``."""
    folder = scratch(docs.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        out, ordinal = None, 0
        for b in batches:
            out = out or fs.open_output_stream(filesystem(name)[1], compression=None)
            for text in b.column("text"):
                out.write(np.array([*encode(text.as_py() or "", vocabulary), separator], f"<u{width}").tobytes())
            ordinals = pa.array(range(ordinal, ordinal + b.num_rows), pa.int64())
            ordinal += b.num_rows
            ends = pa.array([out.tell()] * b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows, pa.string()), ordinals, b.column("doc_id"), ends], ["file", "ordinal", "doc_id", "end"])
        if out is not None:
            out.close()

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = stage(map_batches(texts, run, "file string, ordinal long, doc_id long, end long"), "token-order")
    return order.groupBy("file").agg(F.max("end").alias("bytes")), order.drop("end")


def blocks_of(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(file, block, at, bytes)`` for ``files`` ``(file, bytes)``."""
    cut = files.where("bytes > 0").select("file", F.col("bytes").alias("all"), F.explode(F.expr(f"sequence(0L, (bytes - 1) div {block_bytes})")).alias("block"))
    at = F.col("block") * block_bytes
    return cut.select("file", "block", at.alias("at"), F.least(F.lit(block_bytes), F.col("all") - at).alias("bytes"))


def scan(files: DataFrame, separator: int = END_OF_DOCUMENT, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(file, ordinal, n_tokens, ended)`` for every document of ``files`` ``(file, bytes)``, separators not counted."""
    block_bytes -= block_bytes % width

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, block, at, size in zip(*(b.column(c).to_pylist() for c in ("file", "block", "at", "bytes")), strict=True):
                fs, path = filesystem(file)
                with fs.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(size, at), f"<u{width}")
                found = np.flatnonzero(ids == separator)
                inner = np.diff(found, prepend=-1) - 1
                last = int(found[-1]) if len(found) else None
                row = {"file": [file], "block": [block], "first_token": [at // width], "n": [len(ids)], "seps": [len(found)], "last": [last], "lengths": [inner.astype(np.int64)]}
                yield pa.RecordBatch.from_pydict(row, schema)

    fields = {"file": pa.string(), "block": pa.int64(), "first_token": pa.int64(), "n": pa.int64(), "seps": pa.int64(), "last": pa.int64(), "lengths": pa.list_(pa.int64())}
    schema = pa.schema(list(fields.items()))
    blocks = blocks_of(files, block_bytes)
    count, size_of_all = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    seen = stage(map_batches(dealt(blocks, count, size_of_all, "file", "block"), search, "file string, block long, first_token long, n long, seps long, last long, lengths array<long>"), "block-scan")

    rows = seen.drop("lengths").withColumns({"run": F.expr(f"block div {RUN}"), "last_at": F.col("first_token") + F.col("last")})
    runs = rows.groupBy("file", "run").agg(F.sum("seps").alias("seps"), F.max("last_at").alias("last_at"), F.max("block").alias("end"))
    before = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("file", "run", F.sum("seps").over(before).alias("run_seps"), F.max("last_at").over(before).alias("run_last"), (F.max("end").over(Window.partitionBy("file")) == F.col("end")).alias("final"), "end")
    inside = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    seps = F.coalesce("run_seps", F.lit(0)) + F.coalesce(F.sum("seps").over(inside), F.lit(0))
    last = F.coalesce(F.greatest("run_last", F.max("last_at").over(inside)), F.lit(-1))
    carried = rows.join(runs, ["file", "run"]).withColumns({"so_far": seps, "carry": F.col("first_token") - last - 1})

    state = carried.select("file", "block", "so_far", "carry")
    closed = seen.where("seps > 0").join(state, ["file", "block"]).select("file", "so_far", "carry", F.posexplode("lengths").alias("i", "inner"))
    closed = closed.select("file", (F.col("so_far") + F.col("i")).alias("ordinal"), (F.col("inner") + F.expr("if(i = 0, carry, 0L)")).alias("n_tokens"), F.lit(True).alias("ended"))
    open_end = carried.where("final and block = end").withColumn("left", F.expr("if(seps > 0, n - last - 1, carry + n)")).where("left > 0")
    return closed.unionByName(open_end.select("file", (F.col("so_far") + F.col("seps")).alias("ordinal"), F.col("left").alias("n_tokens"), F.lit(False).alias("ended")))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, separator: int = END_OF_DOCUMENT, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_tokens)`` for every row of ``docs``, counted in the token files made of them."""
    files, order = write_token_files(docs, vocabulary, separator, width)
    return order.join(scan(files, separator, width, block_bytes), ["file", "ordinal"]).select("doc_id", "n_tokens")
