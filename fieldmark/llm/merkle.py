"""Merkle manifest of a dataset: a digest of every row, of every language and of the whole, with proofs.

A row is a leaf. Leaves of a language, by doc_id, and then the languages'
subroots are the bottoms of trees of ``BRANCH`` children. Each level is one
sibling-shift self-join: a node's slot is its place modulo ``BRANCH``, its
siblings' places follow from slot offsets, and nodes meet their siblings by an
equijoin on language and place. From what has met, the rows of slot zero emit
the parents. So no language, however large, is one task: a key of any join has
at most ``BRANCH`` rows.

Places are counted without a window over a language: rows are range-partitioned
and sorted, and a row's place is its place in its partition plus what the
partitions before it hold. Each level is written to the shared folder. Proofs
come down again: a node's path is its siblings and then its parent's path.

Cases: a null field is ``-``; an empty text is ``0:``; long texts are hashed
where they are and never moved; null languages come first and are a tree of
their own, as are empty ones; null doc_ids come last in their language; of equal
doc_ids the smaller leaf comes first, and repeated rows are leaves each, with
proofs of their own places; a lone leaf is its language's subroot, a lone
subroot the root, and a path without siblings has the digest of the empty text;
further columns, whatever their names, are no part of a leaf; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import NARROW_ROWS, ascii_lower, stage

#: Children of a node.
BRANCH = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: A row of places and digests, under 200 bytes, and one of whole paths, under 4,000, is broadcast up to so many.
PATH_ROWS = 5_000
#: Rows of one partition that ``monotonically_increasing_id`` counts.
_PART = 1 << 33


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def as_text(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    """The leaf of a row whose text is ``text``, as 32 bytes."""
    return F.unhex(digest(F.concat(*[field(F.col(c)) for c in FIELDS[:-1]], field(text))))


def tampering() -> Column:
    """The rows whose text is changed to try the proofs: 3 divides crc32 of their doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``place`` (from 0) in their ``group`` by ``order``, and the group's ``size``."""
    by = [F.col("group"), *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    ranged = stage(ranged.withColumns({"part": F.floor(F.col("at") / _PART), "at": F.col("at") % _PART}), "ranged")
    parts = ranged.groupBy("group", "part").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    parts = stage(parts, "parts")
    of_group = Window.partitionBy("group")
    before = F.sum("n").over(of_group.orderBy("part")) - F.col("n") - F.col("low")
    starts = parts.select("group", "part", before.alias("start"), F.sum("n").over(of_group).alias("size"))
    starts = F.broadcast(starts) if parts.count() <= NARROW_ROWS else starts
    return ranged.join(starts, ["group", "part"]).withColumn("place", F.col("at") + F.col("start")).drop("at", "part", "start")


def siblings(nodes: DataFrame, small: bool) -> DataFrame:
    """``nodes`` with the digests ``left`` and ``right`` of them in their run of siblings; both are null where a group has one node."""
    slot, shift = F.col("place") % BRANCH, F.col("shift")
    asks = nodes.where("size > 1").withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(BRANCH - 1))))
    asks = asks.select("group", "place", "size", (F.col("place") - slot + (slot + shift) % BRANCH).alias("other"), F.when(shift == 0, F.struct("digest", "own")).alias("self"))
    given = nodes.where("size > 1").select("group", F.col("place").alias("other"), F.col("digest").alias("theirs"))
    met = asks.join(F.broadcast(given) if small else given, ["group", "other"])  # the last run of a level is short
    run = F.array_sort(F.collect_list(F.struct("other", "theirs")))
    met = met.groupBy("group", "place", "size").agg(run.alias("run"), F.first("self", ignorenulls=True).alias("self"))

    def side(keep: Callable[[Column], Column]) -> Column:
        return F.unhex(F.array_join(F.transform(F.filter("run", keep), lambda x: F.hex(x["theirs"])), ""))

    met = met.select("group", "place", "size", "self.digest", "self.own", side(lambda x: x["other"] < F.col("place")).alias("left"), side(lambda x: x["other"] > F.col("place")).alias("right"))
    alone = nodes.where("size = 1").select("group", "place", "size", "digest", "own", *[F.lit(None).cast("binary").alias(c) for c in ("left", "right")])
    return met.unionByName(alone)


def parents(level: DataFrame) -> DataFrame:
    """The next level, emitted by the rows of slot zero."""
    whole = digest(F.concat(as_text(F.col("digest")), as_text(F.col("right"))))
    first = level.where((F.col("size") > 1) & (F.col("place") % BRANCH == 0))
    up = F.expr(f"place div {BRANCH}").alias("place"), F.ceil(F.col("size") / BRANCH).alias("size")
    return first.select("group", *up, F.unhex(whole).alias("digest"), F.lit(None).cast(level.schema["own"].dataType).alias("own"))


def climbed(nodes: DataFrame) -> list[tuple[DataFrame, int]]:
    """The levels of every group's tree from the leaves up, each with its number of nodes; each is written."""
    levels = []
    while (count := (nodes := stage(nodes, "nodes")).count()) > 0:
        levels.append((stage(siblings(nodes, count <= NARROW_ROWS), "level"), count))
        nodes = parents(levels[-1][0])
    return levels


def tops(levels: list[tuple[DataFrame, int]]) -> DataFrame:
    """``(group, digest)`` of each group's last node."""
    found = [level.where("size = 1").select("group", "digest") for level, _ in levels]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def descended(levels: list[tuple[DataFrame, int]], above: DataFrame) -> DataFrame:
    """``(digest, own, path)`` of the lowest level and the further columns of ``above`` ``(group, path, ...)``, which has a path for each group's top."""
    more, below = [c for c in above.columns if c not in ("group", "path")], None
    for level, count in reversed(levels):
        found = level.where("size = 1").join(above, "group").select("group", "place", "digest", "own", "path", *more)
        if below is not None:
            parent = below[0].select("group", F.col("place").alias("up"), F.col("path").alias("rest"), *more)
            met = level.where("size > 1").withColumn("up", F.expr(f"place div {BRANCH}")).join(F.broadcast(parent) if below[1] <= PATH_ROWS else parent, ["group", "up"])
            path = F.concat(F.array(F.struct("left", "right")), "rest").alias("path")
            found = found.unionByName(met.select("group", "place", "digest", "own", path, *more))
        below = found, count
    return below[0]


def manifest(docs: DataFrame) -> DataFrame:
    """``(doc_id, leaf, tampered, subroot, root, path)`` of every row of ``docs``.

    ``path`` lists, level by level up to the root, the digests ``left`` and
    ``right`` of the node; ``tampered`` is the leaf of the row as ``tampering``
    changes it, or the leaf itself.
    """
    lang, text = F.col("lang").cast("string"), F.col("text").cast("string")
    group = F.coalesce(F.concat(F.lit("="), lang), F.lit("")).alias("group")  # null is before all, then by bytes
    changed = F.when(tampering(), leaf_of(ascii_lower(text))).otherwise(F.col("leaf"))
    leaves = docs.withColumn("leaf", leaf_of(text)).select(group, F.col("doc_id").cast("long").alias("doc_id"), "leaf", changed.alias("changed"))
    leaves = stage(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")  # hashed once; row tells repeated rows apart
    nodes = placed(leaves, F.col("doc_id").asc_nulls_last(), F.col("leaf"), F.col("row"))
    levels = climbed(nodes.select("group", "place", "size", F.col("leaf").alias("digest"), F.struct("doc_id", "changed").alias("own")))
    if not levels:
        return leaves.select("doc_id", *[F.lit("").alias(c) for c in ("leaf", "tampered", "subroot", "root")], F.expr("cast(null as array<struct<left: binary, right: binary>>)").alias("path"))

    subroots = tops(levels).select(F.lit("").alias("group"), F.col("group").alias("lang"), "digest")
    upper = climbed(placed(subroots, F.col("lang")).select("group", "place", "size", "digest", F.struct("lang").alias("own")))
    root = tops(upper).select("group", F.col("digest").alias("root"), F.expr("cast(array() as array<struct<left: binary, right: binary>>)").alias("path"))
    above = stage(descended(upper, root).select(F.col("own.lang").alias("group"), "path", F.col("digest").alias("subroot"), "root"), "subroots")
    found = descended(levels, above)
    return found.select("own.doc_id", as_text(F.col("digest")).alias("leaf"), as_text(F.col("own.changed")).alias("tampered"), as_text(F.col("subroot")).alias("subroot"), as_text(F.col("root")).alias("root"), "path")


def proof(path: Column) -> Column:
    """The digest of a path's siblings, level by level."""
    return digest(F.array_join(F.flatten(F.transform(path, lambda x: F.array(as_text(x["left"]), as_text(x["right"])))), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to among the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda below, x: digest(F.concat(as_text(x["left"]), below, as_text(x["right"]))))
