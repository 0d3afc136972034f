"""Strings that repeat, by prefix-free parsing.

A rolling hash over grams of ``GRAM`` bytes picks the *triggers* of a text, one
gram in ``EVERY``. A *phrase* runs from one trigger to the end of the next, so
phrases overlap by a trigger and no suffix of a phrase that is longer than a
trigger begins another: the parse is prefix-free. What a gram is decides alone,
so equal strings are cut alike wherever they stand.

A corpus suffix is a suffix of its phrase up to and with the closing trigger
(dictionary) and the text that the parse goes on with. Two of them agree on
``width`` bytes exactly if they agree on the dictionary part, of ``k`` bytes
say, and on ``width - k`` bytes of the rest. So corpus order is got from two
arrays: the dictionary's phrases, ordered from their closing trigger backwards
with the lengths of their common suffixes (a run of those of at least ``k`` is
one class of dictionary suffixes), and the parse's continuations in text order
with the lengths of their common prefixes. A suffix's place is the pair of its
classes; a place that is taken twice is a string that repeats.

1. A document is cut into *pieces*, the windows with one first trigger. Every
   window of a piece holds the same ``SHARED`` bytes at the trigger, whose hash
   is its *bucket*. Pieces are counted by bucket and by the hash of all their
   bytes, combined in the task before the shuffle. Only these numbers move.
2. A bucket with one piece that stands once repeats nowhere: equal hashes of
   different bytes only leave a window to be looked at. A bucket with one piece
   that stands more often repeats whole: here two 64-bit hashes, of the shared
   bytes and of the piece, decide. All other buckets hold ends of repeats.
3. Of those buckets one copy of each piece is sent with its bytes, and the two
   arrays are built and joined: here bytes decide. Buckets that outgrow
   ``max_bucket`` pieces are counted window by window instead, by bytes. Windows
   without any trigger, rare in text, are pieces of one window.
4. Only what does *not* repeat is sent back, each to the one document that has
   it, so no passage of many documents is ever joined to all of them.

A text of any length is cut, hashed and told of block by block, so a task needs
about three bytes a byte of its longest text and a fixed rest, also where every
gram is a trigger or none is (a run of one byte, a short period).

Nothing is capped. The choice of the copy that is sent is written down before it
is used, so a lost executor cannot change it halfway.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import free, map_batches, stage

#: Bytes of a trigger; one gram in EVERY is one; bytes at a trigger that a bucket's windows share.
GRAM, EVERY, SHARED = 8, 32, 100
#: Bytes hashed at once, triggers cut at once, windows ordered at once, pieces combined before the shuffle, bytes of pieces in a batch.
BLOCK, CUT, ORDERED, COMBINED, HELD = 1 << 20, 1 << 16, 1 << 18, 1 << 17, 16 << 20
#: What is said of a piece: it stands once in a bucket of its own; or it shares its bucket, and stands once or more often.
LONE, EDGE_ONCE, EDGE_MORE = 0, 1, 2


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def triggers(text: bytes) -> Iterator[np.ndarray]:
    """Where the triggers of ``text`` begin, ascending, a block of the text at a time."""
    units = np.frombuffer(text, np.uint8)
    for at in range(0, len(units) - GRAM + 1, BLOCK):
        x = units[at : at + BLOCK + GRAM - 1].astype(np.uint64)
        for k in (1, 2, 4):  # grams of 2, 4 and 8 bytes
            x = x[:-k] | x[k:] << np.uint64(8 * k)
        yield np.flatnonzero(mixed(x) < np.uint64(2**64 // EVERY)) + at


def unzip(packed: bytes | None) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed) if packed else b""


def packed_texts(docs: DataFrame) -> DataFrame:
    """``docs`` of ``(rk_id, rk_text, text)`` with the text compressed, for a shuffle that carries every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3)
        for b in batches:
            z = pa.array([press.compress(t.as_py()) if t.is_valid and len(t.as_py()) else None for t in b.column("text").cast(pa.large_binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("rk_id"), b.column("rk_text"), z], ["rk_id", "rk_text", "z"])

    return map_batches(docs, run, "rk_id long, rk_text long, z binary")


def cuts(text: bytes, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pieces of a text in order, CUT triggers at a time: first window, one past the last, trigger; runs of windows without a trigger have -1."""
    many, near = len(text) - width + 1, min(SHARED, width // 2)
    if many <= 0:
        return
    begin, blocks = 0, triggers(text)
    at = next(blocks, np.zeros(0, np.int64))
    for following in chain(blocks, (None,)):
        if following is None:
            at = np.append(at, len(text) + width)
        for k in range(0, len(at), CUT):
            part = at[k : k + CUT]
            first = np.append(begin, part[:-1] + 1)
            begin = int(part[-1]) + 1
            # no trigger up to the first edge, then far before it, then near it
            bare = np.clip(part + GRAM - width, first, part + 1)
            far = np.clip(part - near + 1, bare, part + 1)
            lo = np.stack((first, bare, far), 1).ravel()
            hi = np.minimum(np.stack((bare, far, part + 1), 1).ravel(), many)
            trigger = np.stack((np.full(len(part), -1), part, part), 1).ravel()
            some = lo < hi
            if some.any():
                yield lo[some], hi[some], trigger[some]
        at = following


def shared_bytes(text: bytes, start: int, trigger: int, width: int) -> bytes:
    """What every window of a piece holds: it begins near its trigger, or far before it, or is a single window."""
    near = min(SHARED, width // 2)
    if trigger < 0:
        return text[start : start + width]
    return text[trigger : trigger + near] if start > trigger - near else text[trigger - near : trigger + GRAM]


def bucket_of(text: bytes, start: int, trigger: int, width: int) -> int:
    return xxhash.xxh64_intdigest(shared_bytes(text, start, trigger, width)) - (1 << 63)


def hashed_pieces(text: bytes, width: int) -> Iterator[np.ndarray]:
    """``(bucket, hash of all bytes, first window)`` of each piece of a text, windows without a trigger one by one; some COMBINED rows at a time."""
    digest, rows = xxhash.xxh64_intdigest, []
    for part in cuts(text, width):
        for a, e, t in zip(*(x.tolist() for x in part), strict=True):
            if t >= 0:
                rows.append((bucket_of(text, a, t, width), digest(text[a : e - 1 + width], 1) - (1 << 63), a))
                continue
            for k in range(a, e, COMBINED):
                rows += [(bucket_of(text, x, t, width), digest(text[x : x + width], 1) - (1 << 63), x) for x in range(k, min(k + COMBINED, e))]
                if len(rows) >= COMBINED:
                    yield np.array(rows, np.int64)
                    rows = []
        if len(rows) >= COMBINED:
            yield np.array(rows, np.int64)
            rows = []
    if rows:
        yield np.array(rows, np.int64)


_SEEN = "bucket long, hash long, n long, rk_id long, rk_text long, start long"


def seen_pieces(docs: DataFrame, width: int) -> DataFrame:
    """Pieces by bucket and hash with how often they stand, combined in the task, and one place of each."""
    names = [x.split()[0] for x in _SEEN.split(", ")]

    def batch(ids: list[tuple], found: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(found)
        keys = np.repeat(np.array(ids, np.int64), [len(f) for f in found], axis=0)
        order = np.lexsort((rows[:, 1], rows[:, 0]))
        first = np.flatnonzero(np.append(True, (rows[order[1:], :2] != rows[order[:-1], :2]).any(axis=1)))
        times = np.diff(np.append(first, len(order)))
        take = np.argsort(order[first])  # in text order, in which a document's key packs well
        kept, times = order[first][take], times[take]
        columns = rows[kept, 0], rows[kept, 1], times, keys[kept, 0], keys[kept, 1], rows[kept, 2]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, held = [], [], 0
        for b in batches:
            for rk_id, rk_text, text in zip(*(b.column(c).to_pylist() for c in ("rk_id", "rk_text")), b.column("text").cast(pa.large_binary()), strict=True):
                for rows in hashed_pieces(text.as_py() or b"", width):
                    ids.append((rk_id, rk_text))
                    found.append(rows)
                    held += len(rows)
                    if held >= COMBINED:
                        yield batch(ids, found)
                        ids, found, held = [], [], 0
        if held:
            yield batch(ids, found)

    return map_batches(docs, run, _SEEN)


def told_pieces(docs: DataFrame, width: int) -> DataFrame:
    """``(rk_id, rk_text, code)``: the first window of a piece, times four, and what is said of it; of pieces that share a bucket one copy each is named."""
    dealt = seen_pieces(docs, width).repartition("bucket")
    counted = dealt.groupBy("bucket", "hash").agg(F.sum("n").alias("times"), *[F.first(c).alias(c) for c in ("rk_id", "rk_text", "start")])
    beside = counted.withColumn("kinds", F.count(F.lit(1)).over(Window.partitionBy("bucket")))
    said = F.when(F.col("kinds") > 1, F.when(F.col("times") > 1, EDGE_MORE).otherwise(EDGE_ONCE)).otherwise(LONE)
    return beside.where("kinds > 1 or times = 1").select("rk_id", "rk_text", (F.col("start") * 4 + said).alias("code"))


def true_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``[start, stop)`` of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False]))))
    return edges[::2], edges[1::2]


_PARSED = "rk_id long, rk_text long, open array<struct<lo: long, hi: long>>, bucket long, piece binary, at int, times long, start long"


def parsed(docs: DataFrame, told: DataFrame, width: int) -> DataFrame:
    """Rows of two kinds: a document's windows that may repeat, as ``[lo, hi)`` in ``open``, and the named copy of each piece that shares its bucket.

    ``at`` is the trigger's place in the piece (-1: a single window without one).
    """
    names = "rk_id", "rk_text", "open", "bucket", "piece", "at", "times", "start"
    spans = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    kinds = pa.int64(), pa.int64(), spans, pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for rk_id, rk_text, z, codes in zip(*(b.column(c).to_pylist() for c in ("rk_id", "rk_text")), b.column("z"), b.column("codes"), strict=True):
                text = unzip(z.as_py())
                if len(text) < width:
                    continue
                code = np.sort(codes.values.to_numpy()) if codes.is_valid else np.zeros(0, np.int64)
                lone = np.zeros(len(text) - width + 2, np.int8)  # where a run of windows that repeat nowhere begins and ends
                for lo, hi, trigger in cuts(text, width):
                    mine = code[np.searchsorted(code, lo[0] * 4) : np.searchsorted(code, hi[-1] * 4)]
                    starts, of = mine // 4, np.searchsorted(lo, mine // 4, "right") - 1
                    ends = np.where(trigger[of] < 0, starts + 1, hi[of])
                    alone = mine % 4 == LONE
                    np.add.at(lone, starts[alone], 1)
                    np.add.at(lone, ends[alone], -1)
                    for x, a, e, t in zip(*(c[~alone].tolist() for c in (mine % 4, starts, ends, trigger[of])), strict=True):
                        piece = text[a : e - 1 + width]
                        rows.append((rk_id, rk_text, None, bucket_of(text, a, t, width), piece, -1 if t < 0 else t - a, x, a))
                        held += len(piece)
                        if held >= HELD:
                            yield batch(rows)
                            rows, held = [], 0
                first, last = true_runs(np.cumsum(lone, dtype=np.int8, out=lone)[:-1] == 0)
                if len(first):
                    rows.append((rk_id, rk_text, [{"lo": x, "hi": y} for x, y in zip(first.tolist(), last.tolist(), strict=True)], None, None, None, None, None))
            if rows:
                yield batch(rows)
                rows, held = [], 0

    codes = told.groupBy("rk_id", "rk_text").agg(F.collect_list("code").alias("codes"))
    return map_batches(packed_texts(docs).join(codes, ["rk_id", "rk_text"], "left"), run, _PARSED)


def ordered_classes(strings: list[bytes], bucket: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort ``strings`` inside their buckets; ``(place, first)``: a string's place, and for each place and length ``k`` the first place of the run that agrees on ``k`` bytes."""
    rows = np.frombuffer(b"".join(s[:size].ljust(size, b"\0") for s in strings), np.uint8).reshape(-1, size)
    keyed = np.concatenate((bucket.astype(">i8").view(np.uint8).reshape(-1, 8), rows), axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{size + 8}").ravel(), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    rows, same = rows[order], bucket[order][1:] == bucket[order][:-1]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
    common = np.concatenate(([-1], np.where(same, common, -1)))
    opens = np.where(common[:, None] < np.arange(size + 1), np.arange(len(order), dtype=np.int32)[:, None], 0)
    return place, np.maximum.accumulate(opens, axis=0)


def taken_once(held: list[tuple], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows ``(bucket, piece, at, times)`` of whole buckets: for each that stands once, runs ``[lo, hi)`` of its windows that repeat nowhere."""
    bucket, at, times = (np.array([r[i] for r in held], np.int64) for i in (0, 2, 3))
    windows = np.array([len(r[1]) for r in held]) - width + 1
    back, backs = ordered_classes([r[1][: r[2]][::-1] for r in held], bucket, width)
    on, ons = ordered_classes([r[1][r[2] :] for r in held], bucket, width)
    owner = np.repeat(np.arange(len(held)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    k = at[owner] - offset  # bytes of the window before its trigger
    place = (backs[back[owner], k].astype(np.int64) * len(held) + ons[on[owner], width - k]) * (width + 1) + k
    inverse = np.unique(place, return_inverse=True)[1].ravel()
    total = np.bincount(inverse, times[owner])
    once = total[inverse] < 2
    opens = np.cumsum(windows) - windows
    for i in np.unique(owner[once]).tolist():
        yield i, *true_runs(once[opens[i] : opens[i] + windows[i]])


_SINGLE = "rk_id long, rk_text long, lo long, hi long"


def single(distinct: DataFrame, width: int) -> DataFrame:
    """``(rk_id, rk_text, lo, hi)``: the open windows that repeat nowhere, from the buckets of distinct pieces."""

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["rk_id", "rk_text", "lo", "hi"])

    def solve(held: list[tuple]) -> list[tuple]:
        return [(*held[i][4:6], held[i][6] + a, held[i][6] + b) for i, lo, hi in taken_once(held, width) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("bucket", "piece", "at", "times", "rk_id", "rk_text", "start")), strict=True):
                if row[0] != last and size >= ORDERED:
                    if found := solve(held):
                        yield batch(found)
                    held, size = [], 0
                held.append(row)
                size += len(row[1]) - width + 1
                last = row[0]
        if held and (found := solve(held)):
            yield batch(found)

    bucketed = distinct.repartition("bucket").sortWithinPartitions("bucket")
    return map_batches(bucketed, run, _SINGLE)


def single_by_bytes(distinct: DataFrame, width: int) -> DataFrame:
    """As ``single``, each window for itself: for windows without a trigger and for buckets that are too large to order in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, times, rk_id, rk_text, start in zip(*(b.column(c).to_pylist() for c in ("piece", "times", "rk_id", "rk_text", "start")), strict=True):
                n = len(piece) - width + 1
                windows = pa.array([piece[i : i + width] for i in range(n)], pa.binary())
                same = [pa.array(np.full(n, x, np.int64)) for x in (times, rk_id, rk_text)]
                yield pa.RecordBatch.from_arrays([windows, *same, pa.array(np.arange(start, start + n))], ["window", "times", "rk_id", "rk_text", "lo"])

    windows = map_batches(distinct.select("piece", "times", "rk_id", "rk_text", "start"), run, "window binary, times long, rk_id long, rk_text long, lo long")
    counted = windows.groupBy("window").agg(F.sum("times").alias("n"), *[F.first(c).alias(c) for c in ("rk_id", "rk_text", "lo")])
    return counted.where("n = 1").select("rk_id", "rk_text", "lo", (F.col("lo") + 1).alias("hi"))


def repeated_spans(docs: DataFrame, width: int, max_bucket: int = 1 << 14) -> DataFrame:
    """``(rk_id, rk_text, open, once)``: ``[lo, hi)`` of the window starts that may repeat, and of those among them that do not.

    ``docs`` has ``(rk_id, rk_text, text)``. Documents of which no window repeats may be left out.
    """
    told = stage(told_pieces(docs, width), "pieces")
    cut_up = stage(parsed(docs, told, width), "open-windows")
    free(told)
    distinct = cut_up.where("piece is not null").drop("open")
    large = distinct.where("at >= 0").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_bucket)
    large = stage(large.select("bucket"), "large-buckets")  # few or none: Spark sees its size
    usual = distinct.where("at >= 0").join(large, "bucket", "left_anti")
    others = distinct.where("at < 0").unionByName(distinct.where("at >= 0").join(large, "bucket", "left_semi"))
    once = single(usual, width).unionByName(single_by_bytes(others, width))
    once = stage(once.groupBy("rk_id", "rk_text").agg(F.collect_list(F.struct("lo", "hi")).alias("once")), "single-windows")
    free(large)
    opened = cut_up.where("open is not null").select("rk_id", "rk_text", "open").dropDuplicates(["rk_id", "rk_text"])
    return opened.join(once, ["rk_id", "rk_text"], "left")


def removed(size: int, open_: pa.Scalar, once: pa.Scalar, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs ``[start, stop)`` of bytes that repeated windows cover, in a text of ``size`` bytes."""
    if not open_.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.zeros(size + 1, np.int32)
    for spans, sign in ((open_, 1), (once, -1)):
        if spans.is_valid:
            np.add.at(change, spans.values.field("lo").to_numpy(), sign)
            np.add.at(change, spans.values.field("hi").to_numpy(), -sign)
    lo, hi = true_runs(np.cumsum(change, dtype=np.int32, out=change)[:-1] > 0)
    stop = hi - 1 + width
    new = np.append(True, lo[1:] > stop[:-1]) if len(lo) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return lo[first], stop[np.append(first[1:], len(lo)) - 1] if len(lo) else lo
