"""Windows of words by super-k-mers.

A *window* is ``width`` consecutive words of one document. The gram of ``gram``
words with the least hash (the leftmost of equals) is its minimiser, which the
window's words alone decide. Consecutive windows that share one are a
*super-k-mer*; each window lies in exactly one.

1. Minimisers are counted by documents. Windows of one that a single document
   has cannot stand in another.
2. The other super-k-mers travel as one packed string each. Equal strings are
   combined before the shuffle, with the smallest doc_id that has them, so a
   passage repeated a million times arrives once a task at most.
3. Each minimiser's bucket sorts its windows by their words, which finds the
   smallest doc_id of every window. Buckets of over ``max_bucket`` strings would
   outgrow a task; their windows are grouped by their words, one row each.
4. What was found for a string goes back to its places, hot strings by broadcast.

Hashes only route: strings and windows are compared by their words. Segments of
long documents overlap by ``width - 1`` words, which only splits super-k-mers.
Nothing is capped, sampled or left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import free, map_batches, split_join, stage
from fieldmark.llm.prefix_free import mixed, packed_texts, unzip

#: Words handled at once, and windows sorted at once.
BLOCK, SORTED = 1 << 20, 1 << 16
_BASE = 0x9E3779B97F4A7C15
_POSITION = np.uint64((1 << 24) - 1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * BLOCK)
        _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, x, np.uint64)))) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def hashed(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    """Rolling hashes of all grams, the same wherever a gram stands."""
    up, down = powers(len(units))
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * up[: len(units)], out=sums[1:])
    at = np.arange(len(units) - gram + 1)
    return mixed((sums[at + gram] - sums[at]) * down[at])


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` consecutive values, in time that does not depend on ``size``."""
    n = len(x) - size + 1
    rows = np.concatenate((x, np.full(-len(x) % size, ~np.uint64(0)))).reshape(-1, size)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[size - 1 : size - 1 + n])


def parse(segments: list[np.ndarray], width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Super-k-mers of hashed segments, each of ``width`` words at least: segment, start, windows, minimiser."""
    lengths = np.array([len(s) for s in segments])
    units = np.concatenate(segments)
    n, grams = len(units), gram_hashes(units, gram)
    least = sliding_least((grams & ~_POSITION) | np.arange(len(grams)).astype(np.uint64), width - gram + 1)
    ends = np.cumsum(lengths)
    segment = np.repeat(np.arange(len(lengths)), lengths)[: n - width + 1]
    whole = np.arange(n - width + 1) + width <= ends[segment]
    new = np.ones(n - width + 1, bool)
    new[1:] = (least[1:] != least[:-1]) | (segment[1:] != segment[:-1]) | (whole[1:] != whole[:-1])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], n - width + 1)
    start, stop = start[whole[start]], stop[whole[start]]
    segment = segment[start]
    return segment, start - (ends - lengths)[segment], stop - start, grams[(least[start] & _POSITION).astype(np.int64)].view(np.int64)


def segments_of(words: list[bytes], width: int) -> Iterator[int]:
    return iter(range(0, len(words) - width + 1, BLOCK))


def lone_minimisers(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """``(rk_id, rk_text, lone)``: minimisers of a document that no other row has."""

    def rows(keys: list[tuple], segments: list[np.ndarray]) -> pa.RecordBatch:
        segment, _, _, minimiser = parse(segments, width, gram)
        row = np.array([k[2] for k in keys])[segment]
        pairs = np.unique(np.stack((row, minimiser), 1), axis=0)
        of = np.searchsorted([k[2] for k in keys], pairs[:, 0])
        ids, texts = (np.array([k[i] for k in keys], np.int64)[of] for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts), pa.array(pairs[:, 1])], ["rk_id", "rk_text", "minimiser"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, segments, held, row = [], [], 0, 0
        for b in batches:
            for rk_id, rk_text, text in zip(*(b.column(c).to_pylist() for c in ("rk_id", "rk_text")), b.column("text").cast(pa.large_binary()), strict=True):
                words = (text.as_py() or b"").split()
                row += 1
                for at in segments_of(words, width):
                    segments.append(hashed(words[at : at + BLOCK + width - 1]))
                    keys.append((rk_id, rk_text, row))
                    held += len(segments[-1])
                    if held >= BLOCK:
                        yield rows(keys, segments)
                        keys, segments, held = [], [], 0
        if keys:
            yield rows(keys, segments)

    seen = map_batches(docs, run, "rk_id long, rk_text long, minimiser long")
    # what is counted once has one row, so first() is of that row
    counted = seen.groupBy("minimiser").agg(F.count(F.lit(1)).alias("n"), F.first("rk_id").alias("rk_id"), F.first("rk_text").alias("rk_text"))
    return counted.where("n = 1").groupBy("rk_id", "rk_text").agg(F.collect_list("minimiser").alias("lone"))


def packed(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """``(minimiser, piece, rk_id, rk_text, start)``: the super-k-mers whose minimisers several rows have, as packed strings with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(0, np.int64)
        kinds = pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()
        for b in batches:
            rows, held = [], 0
            for rk_id, rk_text, z, lone in zip(*(b.column(c).to_pylist() for c in ("rk_id", "rk_text")), b.column("z"), b.column("lone"), strict=True):
                words = unzip(z.as_py()).split()
                for at in segments_of(words, width):
                    _, start, n, minimiser = parse([hashed(words[at : at + BLOCK + width - 1])], width, gram)
                    take = np.flatnonzero(~np.isin(minimiser, lone.values.to_numpy() if lone.is_valid else nothing))
                    for s, k, m in zip((start[take] + at).tolist(), n[take].tolist(), minimiser[take].tolist(), strict=True):
                        rows.append((m, b" ".join(words[s : s + k + width - 1]), rk_id, rk_text, s))
                        held += len(rows[-1][1])
                if held >= 16 << 20:
                    yield batch(rows, kinds)
                    rows, held = [], 0
            if rows:
                yield batch(rows, kinds)

    def batch(rows: list[tuple], kinds: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["minimiser", "piece", "rk_id", "rk_text", "start"])

    joined = packed_texts(docs).join(lone_minimisers(docs, width, gram), ["rk_id", "rk_text"], "left")
    return map_batches(joined, run, "minimiser long, piece binary, rk_id long, rk_text long, start long")


def content_order(pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The piece of every window, and its place among the distinct windows sorted by their words (numbered as first seen)."""
    known: dict[bytes, int] = {}
    codes = [np.array([known.setdefault(w, len(known)) for w in p.split()], np.int32) for p in pieces]
    counts = np.array([len(c) - width + 1 for c in codes])
    base = np.cumsum([0, *(len(c) for c in codes)])[:-1]
    owner = np.repeat(np.arange(len(codes)), counts)
    at = base[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.concatenate(codes), width)[at])
    return owner, np.unique(windows.view(f"V{4 * width}").ravel(), return_inverse=True)[1].ravel()


def settle(pieces: DataFrame, width: int) -> DataFrame:
    """``(h, piece, off, len, least)``: runs of a piece's windows and the smallest doc_id that has them, where that can matter."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        owner, rank = content_order([r[1] for r in rows], width)
        first = np.array([r[3] for r in rows])[owner]
        least = np.full(rank.max() + 1, 2**63 - 1, np.int64)
        np.minimum.at(least, rank, first)
        value = least[rank]
        new = np.ones(len(rank), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(rank)))
        opens = np.searchsorted(owner, np.arange(len(rows)))
        matter = (np.array([r[4] for r in rows])[owner[start]] > 1) | (value[start] < first[start])
        start, size = start[matter], size[matter]
        of = owner[start]
        columns = np.array([r[2] for r in rows], np.int64)[of], [rows[i][1] for i in of.tolist()], (start - opens[of]).astype(np.int32), size.astype(np.int32), value[start]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["h", "piece", "off", "len", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("minimiser", "piece", "h", "first", "times")), strict=True):
                if row[0] != last and size >= SORTED:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += row[1].count(b" ") - width + 2
                last = row[0]
        if held:
            yield solve(held)

    bucketed = pieces.select("minimiser", "piece", "h", "first", "times").repartition("minimiser").sortWithinPartitions("minimiser")
    return map_batches(bucketed, run, "h long, piece binary, off int, len int, least long")


def settle_by_words(pieces: DataFrame, width: int) -> DataFrame:
    """As ``settle`` for buckets that are too large for one task: a row for each window, grouped by its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, h, first in zip(*(b.column(c).to_pylist() for c in ("piece", "h", "first")), strict=True):
                words = piece.split()
                n = len(words) - width + 1
                windows = pa.array([b" ".join(words[i : i + width]) for i in range(n)], pa.binary())
                same = pa.array(np.full(n, h, np.int64)), pa.array([piece] * n, pa.binary()), pa.array(np.full(n, first, np.int64))
                yield pa.RecordBatch.from_arrays([windows, *same, pa.array(np.arange(n, dtype=np.int32))], ["window", "h", "piece", "first", "off"])

    windows = map_batches(pieces.select("piece", "h", "first"), run, "window binary, h long, piece binary, first long, off int")
    windows = stage(windows, "windows")
    least = stage(windows.groupBy("window").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n")), "least")
    found = split_join(windows, least, ["window"], "n")
    return found.select("h", "piece", "off", F.lit(1).alias("len"), "least")


def string_hash() -> Column:
    return F.xxhash64("piece")


def earlier_spans(docs: DataFrame, width: int, gram: int, max_bucket: int = 1 << 14) -> DataFrame:
    """``(rk_id, rk_text, spans)``: the words ``[start, stop)`` covered by windows that also start in a document with a smaller ``rk_id``.

    ``docs`` has ``(rk_id, rk_text, text)``. Spans are sorted and may overlap;
    documents without any are left out.
    """
    places = stage(packed(docs, width, gram).withColumn("h", string_hash()), "super-k-mers")
    pieces = places.groupBy("minimiser", "h", "piece").agg(F.min("rk_id").alias("first"), F.count(F.lit(1)).alias("times"))
    pieces = stage(pieces, "pieces")
    # the hash alone names a string where all strings have different ones; else the string itself is compared too
    clash = not pieces.groupBy("h").agg(F.count_distinct("piece").alias("n")).where("n > 1").isEmpty()
    name = ["h", "piece"] if clash else ["h"]
    large = pieces.groupBy("minimiser").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_bucket).select("minimiser")
    large = stage(large, "large-buckets")  # few or none: Spark sees its size
    found = settle(pieces.join(large, "minimiser", "left_anti"), width).unionByName(settle_by_words(pieces.join(large, "minimiser", "left_semi"), width))
    ranges = found.groupBy(*name).agg(F.collect_list(F.struct("off", "len", "least")).alias("ranges"))
    ranges = stage(ranges.join(pieces.groupBy(*name).agg(F.sum("times").alias("times")), name), "ranges")
    met = split_join(places.select(*name, "rk_id", "rk_text", "start"), ranges, name, "times")
    spans = F.expr(f"transform(filter(ranges, r -> r.least < rk_id), r -> struct(start + r.off as start, start + r.off + r.len + {width - 1} as stop))")
    spans = met.select("rk_id", "rk_text", spans.alias("spans")).where(F.size("spans") > 0)
    out = stage(spans.groupBy("rk_id", "rk_text").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans")), "spans")
    free(places, pieces, large, ranges)
    return out


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of sorted spans."""
    if not len(start):
        return start, stop
    reach = np.maximum.accumulate(stop)
    new = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    return start[new], reach[np.append(new[1:], len(start)) - 1]


def span_lists(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The merged spans of each row of an array of lists of ``(start, stop)``; null is none."""
    empty = np.zeros(0, np.int64)
    for row in column:
        values = row.values if row.is_valid else None
        yield merged(values.field("start").to_numpy(), values.field("stop").to_numpy()) if values is not None else (empty, empty)
