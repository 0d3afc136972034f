"""SimHash near-duplicates found with pivot distance tables.

A table holds, for every distinct fingerprint, its Hamming distances to many
reference fingerprints (pivots). By the triangle inequality two fingerprints
within ``d`` bits differ by at most ``d`` in every coordinate, on all bits and
on any part of them. Distances on all 64 bits crowd around 32 and would leave
nearly all pairs, so the table has coordinates on parts too: the bits are cut
into blocks, more of them than ``d``, and a pair within ``d`` bits differs by 0
in all coordinates on the blocks that its differing bits spare. Those
coordinates, packed, are what pairs are looked up by: candidates come out of
the table alone. Of them pairs with a larger difference than ``d`` in some
coordinate on all bits are discarded and survivors are compared bit by bit.

The more fingerprints there are the more blocks are taken (``blocks_for``), so
parts grow with the number of fingerprints and chance candidates do not grow
with its square. Where many fingerprints share coordinates, one side of their
pairs is dealt over tasks.

Cases: a null or empty text has fingerprint zero and is linked like any other;
equal texts share a fingerprint and are one row of the table whatever their
number; a null doc_id is never the smallest unless its component holds no
other; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import NO_ID, components, doc_id, free, keyed_texts, map_batches, split_join, stage
from fieldmark.llm.prefix_free import mixed

SEED = 42
#: Pivots on all bits, and on each part; six bits a distance there.
N_PIVOTS, PART_PIVOTS = 16, 10
#: Distances of 6 bits that a long holds.
PACKED = 10
#: Shingles hashed at once, so that a very long text takes bounded memory.
CHUNK = 1 << 16
#: Fingerprints that share coordinates beyond which their pairs are dealt over tasks.
FRAGMENT = 2048


def shingle_hashes(text: bytes | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the word shingles of a UTF-8 text, repeats included, in chunks."""
    words = (text or b"").lower().split()  # bytes: A-Z alone are lower-cased and only \x20 \x09-\x0D separate
    if not words:
        return
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1]
    ends, digest = ends[size - 1 :], xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        yield np.array([digest(joined[s:e], SEED) for s, e in spans], np.uint64)


def majority(chunks: list[np.ndarray], seed: int = 0) -> int:
    """The bits set in over half of the hashes; each ``seed`` has its own bits made of the same hashes."""
    votes, n = np.zeros(64, np.int64), 0
    for hashes in chunks:
        own = mixed(hashes + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) if seed else hashes
        votes += np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprint_of(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text."""
    return majority(list(shingle_hashes(text, shingle)))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(rk_id, rk_text, fp)`` of every row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            fps = np.array([fingerprint_of(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("rk_id"), batch.column("rk_text"), pa.array(fps, pa.int64())], ["rk_id", "rk_text", "fp"])

    return map_batches(keyed_texts(docs), run, "rk_id long, rk_text long, fp long")


def pivots(n: int, name: str = "pivot") -> np.ndarray:
    """Reference fingerprints, from a seeded rule."""
    return np.array([xxhash.xxh64_intdigest(f"{name} {i}", SEED) for i in range(n)], np.uint64)


def blocks_for(count: int, max_bits: int) -> int:
    """How many blocks: so many that the spared ones have as many bits as the number of fingerprints, as far as that goes."""
    n = max_bits + 2
    while n < max_bits + 5 and 64 * (n - max_bits) / n < count.bit_length():
        n += 1
    return n


def part_masks(max_bits: int, blocks: int) -> np.ndarray:
    """Masks of which at least one holds no differing bit of a pair within ``max_bits``."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return np.array([sum(c) for c in combinations(block, blocks - max_bits)], np.uint64)


def part_coordinates(fps: np.ndarray, masks: np.ndarray, n_pivots: int | None = None) -> np.ndarray:
    """For each fingerprint and part the distances to the part's pivots, packed in a long; where there are more than fit, the longs are hashed into one."""
    out = np.zeros((len(fps), len(masks)), np.uint64)
    for k, mask in enumerate(masks):
        for i, pivot in enumerate(pivots(PART_PIVOTS if n_pivots is None else n_pivots, f"part {k} pivot")):
            if i and i % PACKED == 0:
                out[:, k] = mixed(out[:, k])
            distance = np.bitwise_count((fps ^ pivot) & mask).astype(np.uint64)
            out[:, k] ^= distance << np.uint64(6 * (i % PACKED))
    return out


def table(distinct: DataFrame, masks: np.ndarray, column: str = "fp", n_pivots: int = PART_PIVOTS) -> DataFrame:
    """The pivot table: ``distinct`` with ``parts``, the packed coordinates of each part of its fingerprints (a long or a list of longs)."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in distinct.schema)}, parts array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(column)
            fps = (given.flatten() if pa.types.is_list(given.type) else given).to_numpy().view(np.uint64)
            width = len(fps) // max(1, batch.num_rows) * len(masks)
            # one-to-one for each part of each fingerprint; what two different parts share by chance is told apart when pairs are verified
            keys = mixed(part_coordinates(fps, masks, n_pivots)).reshape(batch.num_rows, width) ^ pivots(width, "part")
            parts = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts], [*batch.schema.names, "parts"])

    return map_batches(distinct, run, schema)


def shared_parts(rows: DataFrame) -> DataFrame:
    """A row for each part of the table's ``rows`` whose coordinates ``m`` rows, two or more, share; ``parts`` gives way to ``key, m``."""
    keys = rows.select("*", F.explode("parts").alias("key")).drop("parts")
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return split_join(keys, stage(counts, "shared-coordinates"), ["key"], "m", narrow=True)


def packed_distances(fp: Column, refs: np.ndarray) -> list[Column]:
    """The distances to the pivots on all bits, eight to a long."""
    distance = [F.bit_count(fp.bitwiseXOR(F.lit(int(p)))).cast("long") for p in refs.view(np.int64)]
    return [reduce(Column.bitwiseOR, [F.shiftleft(d, 8 * i) for i, d in enumerate(distance[at : at + 8])]) for at in range(0, len(distance), 8)]


def coordinates_within(a: Column, b: Column, most: int, n: int = 8) -> Column:
    """Whether no coordinate packed in ``a`` and ``b`` differs by more than ``most``."""

    def at(x: Column, i: int) -> Column:
        return F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255))

    return reduce(Column.__and__, [F.abs(at(a, i) - at(b, i)) <= most for i in range(n)])


def links(distinct: DataFrame, max_bits: int = 3, n_pivots: int = N_PIVOTS, blocks: int | None = None) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of the distinct fingerprints ``fp`` that differ by at most ``max_bits`` bits."""
    masks = part_masks(max_bits, blocks or blocks_for(distinct.count(), max_bits))
    rows = shared_parts(table(distinct.select("fp"), masks))
    rows = rows.select("*", *[c.alias(f"p{i}") for i, c in enumerate(packed_distances(F.col("fp"), pivots(n_pivots)))])
    fragments = F.ceil(F.col("m") / FRAGMENT).cast("long")
    a = rows.withColumn("f", F.pmod(F.xxhash64("fp"), fragments)).alias("a")
    b = rows.withColumn("f", F.explode(F.sequence(F.lit(0).cast("long"), fragments - 1))).alias("b")
    near = [coordinates_within(F.col(f"a.p{i}"), F.col(f"b.p{i}"), max_bits, min(8, n_pivots - 8 * i)) for i in range((n_pivots + 7) // 8)]
    on = [F.col("a.key") == F.col("b.key"), F.col("a.f") == F.col("b.f"), F.col("a.fp") < F.col("b.fp"), *near]
    verified = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits
    return a.join(b, reduce(Column.__and__, [*on, verified])).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, n_pivots: int = N_PIVOTS) -> DataFrame:
    """``(doc_id, fingerprint, component_id, rk_id, rk_text, class_fp)``, one row per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``max_bits`` differing bits. ``class_fp`` tells components apart even
    where doc_ids are repeated.
    """
    fps = stage(fingerprints(docs, shingle), "fingerprints")
    reps = stage(fps.groupBy("fp").agg(F.min("rk_id").alias("rep"), F.count(F.lit(1)).alias("times")), "distinct-fingerprints")
    member = components(links(reps.select("fp"), max_bits, n_pivots)).withColumnRenamed("node", "fp")
    member = stage(member.join(reps.select("fp", "rep"), "fp"), "members")
    least = stage(member.groupBy("root").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n")), "least")
    linked = split_join(member, least, ["root"], "n", narrow=True).select("fp", "root", "least")
    classes = reps.join(linked, "fp", "left")
    classes = stage(classes.select("fp", "times", F.coalesce("root", "fp").alias("class_fp"), F.coalesce("least", "rep").alias("component")), "classes")
    free(reps, member, least)
    return split_join(fps, classes, ["fp"], "times", narrow=True).select(
        doc_id(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"),
        "rk_id", "rk_text", "class_fp",
    )
