"""Removal of byte strings that repeat, by prefix-free parsing.

The dictionary of phrases and the order of the parse give corpus order, where
equal strings are neighbours (see ``prefix_free``).

Cases: a null text is empty; a text shorter than ``width`` keeps all its bytes;
matches never cross documents; a repeated row is a document of its own, so both
lose what they share; a null doc_id is no different from any; further columns,
whatever their names, are kept by ``without_repeats`` and ignored otherwise; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import doc_id, keyed_rows, keyed_texts, map_batches
from fieldmark.llm.prefix_free import packed_texts, removed, repeated_spans, unzip


def stripped(text: bytes, open_: pa.Scalar, once: pa.Scalar, width: int) -> tuple[int, int, int, bytes]:
    """A text's bytes, removed bytes, removed runs, and what is kept."""
    start, stop = removed(len(text), open_, once, width)
    edges = [0, *(x for span in zip(start.tolist(), stop.tolist(), strict=True) for x in span), len(text)]
    kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
    return len(text), len(text) - len(kept), len(start), kept


def remove_repeats(docs: DataFrame, width: int = 200) -> DataFrame:
    """``(doc_id, rk_id, rk_text, n_bytes, n_removed, n_spans, kept)`` for every row of ``docs``.

    Every byte covered by a ``width``-byte string that also starts anywhere
    else is removed, the first copy included; ``kept`` has the others in order.
    """
    texts = keyed_texts(docs)
    names = ["rk_id", "rk_text", "n_bytes", "n_removed", "n_spans", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [stripped(unzip(z.as_py()), o, s, width) for z, o, s in zip(b.column("z"), b.column("open"), b.column("once"), strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * 4
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("rk_id"), b.column("rk_text"), *made], names)

    joined = packed_texts(texts).join(repeated_spans(texts, width), ["rk_id", "rk_text"], "left")
    done = map_batches(joined, run, "rk_id long, rk_text long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.select(doc_id(), *names)


def without_repeats(docs: DataFrame, width: int = 200) -> DataFrame:
    """Every row and column of ``docs``, its ``text`` without repeated strings and ``n_chars``, if there, to match.

    A character that a removed run cuts through is removed whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column("text").cast(pa.large_binary())
            kept = [stripped(t.as_py(), o, s, width)[3].decode("utf-8", "ignore") if t.is_valid else None for t, o, s in zip(given, b.column("open"), b.column("once"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(kept, pa.string())], ["row", "text"])

    # the text travels once: not in the row too
    rows = keyed_rows(docs).withColumn("text", F.col("row.text").cast("string")).withColumn("row", F.col("row").dropFields("text"))
    joined = rows.join(repeated_spans(keyed_texts(docs), width), ["rk_id", "rk_text"], "left").select("row", "text", "open", "once")
    done = map_batches(joined, run, joined.select("row", "text").schema)
    new = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return done.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
