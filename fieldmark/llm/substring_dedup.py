"""Removal of word windows that an earlier document has, by super-k-mers.

Consecutive windows that share a minimiser are one super-k-mer. It travels as
one packed string to its minimiser's bucket, where sorting its windows brings
equal ones together, with the smallest doc_id that has them (see ``super_kmers``).

Cases: a null text has no words; a text of fewer words than ``width`` keeps
all; a null doc_id counts as later than any other; rows with equal doc_id are
not earlier than each other; further columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldmark.llm.common import doc_id, keyed_texts, map_batches
from fieldmark.llm.prefix_free import packed_texts, unzip
from fieldmark.llm.super_kmers import earlier_spans, span_lists


def remove_earlier_windows(docs: DataFrame, width: int = 50, gram: int = 8) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` for every row of ``docs``; ``kept`` has the kept words joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a window that
    covers it also starts in a document with a smaller doc_id.
    """
    texts = keyed_texts(docs)
    spans = earlier_spans(texts, width, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for z, (start, stop) in zip(b.column("z").to_pylist(), span_lists(b.column("spans")), strict=True):
                words = unzip(z).split()
                edges = [0, *np.stack((start, stop), 1).ravel().tolist(), len(words)]
                kept = [w for i in range(0, len(edges), 2) for w in words[edges[i] : edges[i + 1]]]
                rows.append((len(words), len(words) - len(kept), b" ".join(kept)))
            n_words, n_removed, kept = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [b.column("rk_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["rk_id", "n_words", "n_removed", "kept"])

    joined = packed_texts(texts).join(spans, ["rk_id", "rk_text"], "left")
    done = map_batches(joined, run, "rk_id long, n_words long, n_removed long, kept binary")
    return done.select(doc_id(), "n_words", "n_removed", "kept")
