"""SimHash near-duplicates by similarity: the pivot tables find candidates, exact Jaccard similarity decides.

Texts with a similarity of 0.8 over five-word shingles are up to about 16 of 64
bits apart, too far for the bound on one fingerprint's bits. So each text has
several fingerprints, made of the same shingle hashes, and two texts are
candidates where some part of one of them has equal coordinates in the pivot
table (see ``simhash``). Candidates whose fingerprints are far apart on all bits
are chance and go; the others are compared by their whole shingle sets and linked
from the similarity on, so nothing else is ever linked. How many of
the pairs at the similarity are found depends on the number of fingerprints;
the README has the measured share.

Texts that share coordinates are first compared with a few leaders: texts from
the middle of a group, the closest of those that their coordinates name. After
that only pairs in different components are looked at, of all coordinates: what
texts of one component alone share makes no rows, and what two texts share is a
pair once it is counted. Of pairs in large groups those go that cannot be similar:
shingles that no other text of the groups has (edits, mostly) are in no other's
set, and of the others two sets have, in each class of hashes, no more in common
than the smaller number there; both bound the similarity from above, so no link is
left out. Pairs are tested where they meet; of a group of texts a little below the
similarity hardly any are compared by their sets.

Cases: a null text is empty, and texts without words have the empty set and are
copies of each other; texts of fewer words than a shingle are one shingle;
equal sets are one node; of a group the row with the smallest doc_id stays, a
null one being the largest; a repeated row stays once; further columns, whatever
their names, are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import NARROW_ROWS, components, free, keyed_rows, keyed_texts, map_batches, split_join, stage
from fieldmark.llm.simhash import SEED, majority, part_masks, shingle_hashes, table

SHINGLE, SIMILARITY = 5, 0.8
#: Fewest blocks of a fingerprint; a part is what three of them spare. Fingerprints where there are so few blocks.
BLOCKS, SPARED, FINGERPRINTS = 5, 3, 16
#: Pivots on each part: so many that different bits hardly ever have equal coordinates.
PIVOTS = 20
#: Share of bits in which texts of the similarity differ.
DIFFERING = 0.15
#: Texts that share coordinates beyond which those of the largest component are not compared with each other.
BIG = 16
#: Texts are first compared with so many leaders of one in so many of their keys.
LEADERS, LED = 3, 4
#: Leaders of all its keys that a text is compared with: the closest, by steps of so many bits.
TRIED, STEP = 6, 4
#: Share of differing bits from which a pair is chance: a similarity of 0.8 gives 0.15 on average, and all fingerprints together hardly stray from it.
FAR = 0.35
#: Differing bits of the first fingerprint beyond which a candidate is chance: half of 64 on average there, about 10 at the similarity.
FIRST_FAR = 24
#: Classes of shingle hashes by which what two sets can have in common is bounded.
CLASSES = 64
#: Parts that the pairs of one text are spread over.
SALT = 64


def found_by_one(blocks: int) -> float:
    """The chance that one fingerprint's parts find a pair of the similarity: that its differing bits lie in the spared blocks."""
    same = (1 - DIFFERING) ** (64 / blocks)
    return sum(comb(blocks, k) * (1 - same) ** k * same ** (blocks - k) for k in range(SPARED + 1))


def plan_for(texts: int) -> tuple[int, int]:
    """Blocks and fingerprints for so many texts.

    The bits of a part grow with the number of texts, so that chance candidates
    of a text do not grow with it; as longer parts find fewer pairs, there are
    more fingerprints, so that as many pairs are found.
    """
    blocks = BLOCKS
    while 64 * (blocks - SPARED) / blocks < texts.bit_length() and blocks < 12:
        blocks += 1
    missed = (1 - found_by_one(BLOCKS)) ** FINGERPRINTS
    return blocks, max(FINGERPRINTS, ceil(log(missed) / log(1 - found_by_one(blocks))))


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending."""
    chunks = list(shingle_hashes(text, SHINGLE))
    return np.unique(np.concatenate(chunks)) if chunks else np.zeros(0, np.uint64)


def fingerprinted(keyed: DataFrame, fingerprints: int) -> DataFrame:
    """``(rk_id, rk_text, h1, h2, n, fps)``: the row, the name and size of its shingle set, and its fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column("text").cast(pa.large_binary())]
            names = np.array([[xxhash.xxh64_intdigest(s.tobytes(), k) for k in (1, 2)] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            fps = np.array([[majority([s], k) for k in range(fingerprints)] for s in sets], np.uint64).view(np.int64).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * fingerprints, pa.int32()), pa.array(fps, pa.int64()))
            columns = [batch.column("rk_id"), batch.column("rk_text"), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(map(len, sets), pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["rk_id", "rk_text", "h1", "h2", "n", "fps"])

    return map_batches(keyed, run, "rk_id long, rk_text long, h1 long, h2 long, n long, fps array<long>")


def whole_sets(rows: DataFrame) -> DataFrame:
    """``(node, shingles, held)`` of ``rows`` ``(node, text)``; ``held`` is how many shingles are in each class."""
    classes_of = CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()).view(np.int64) for t in batch.column("text").cast(pa.large_binary())]
            held = [np.bincount(s % classes_of, minlength=classes_of) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64())), pa.array(held, pa.list_(pa.int32()))], ["node", "shingles", "held"])

    return map_batches(rows.select("node", "text"), run, "node long, shingles array<long>, held array<int>")


def possible(a: str, b: str, similarity: float) -> Column:
    """Whether the sizes of two sets leave the similarity possible, and their first fingerprints are not as far apart as those of chance pairs."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    near = F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= FIRST_FAR
    return (F.least(n, m) >= F.greatest(n, m) * F.lit(similarity) - 1e-6) & near


def pair(a: str, b: str) -> list[Column]:
    x, y = F.col(f"{a}.node"), F.col(f"{b}.node")
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def attached(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``pairs`` with ``column`` of ``table`` for both nodes, as ``of_a`` and ``of_b``; a node with very many pairs is spread over SALT parts."""
    salted = both = pairs.withColumns({"sa": F.pmod(F.xxhash64("b"), F.lit(SALT)), "sb": F.pmod(F.xxhash64("a"), F.lit(SALT))})
    for side in "ab":
        spread = salted.select(side, f"s{side}").distinct().join(table.select(F.col("node").alias(side), F.col(column).alias(f"of_{side}")), side)
        both = both.join(spread, [side, f"s{side}"])
    return both.drop("sa", "sb")


def close(pairs: DataFrame, nodes: DataFrame, fingerprints: int) -> DataFrame:
    """Those of ``pairs`` whose fingerprints differ in less than FAR of all their bits: chance candidates differ in half."""
    differ = F.aggregate(F.zip_with("of_a", "of_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return attached(pairs, nodes, "fps").where(differ < int(64 * fingerprints * FAR)).select("a", "b")


def verified(pairs: DataFrame, nodes: DataFrame, keyed: DataFrame, similarity: float, fingerprints: int) -> DataFrame:
    """Those of ``pairs`` ``(a, b)`` whose sets have the Jaccard similarity. Only texts of close fingerprints are looked at, by their whole sets."""
    near = stage(close(pairs, nodes, fingerprints), "close-pairs")
    sets = sets_of(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), nodes, keyed)
    common = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - common
    found = stage(attached(near, sets, "shingles").where(common >= union * F.lit(similarity) - 1e-6).select("a", "b"), "links")
    free(near, sets)
    return found


def sets_of(wanted: DataFrame, nodes: DataFrame, keyed: DataFrame) -> DataFrame:
    """``(node, shingles, held)`` of the nodes in ``wanted``, from one text of each."""
    names = stage(nodes.join(wanted, "node").select("node", "rep.*"), "names")
    few = names.count() <= NARROW_ROWS
    texts = keyed.join(F.broadcast(names) if few else names, ["rk_id", "rk_text"]).select("node", "text").dropDuplicates(["node"])
    sets = stage(whole_sets(texts), "sets")
    free(names)
    return sets


def own_shingles(wanted: DataFrame, nodes: DataFrame, keyed: DataFrame) -> DataFrame:
    """``(node, own, held)``: how many shingles of a node in ``wanted`` no other of them has, and how many of the rest are in each class."""
    sets = sets_of(wanted, nodes, keyed)
    alone = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("k")).where("k = 1")
    alone = alone.groupBy("node", F.pmod("s", F.lit(CLASSES)).cast("int").alias("i")).agg(F.count(F.lit(1)).cast("int").alias("k"))
    alone = alone.groupBy("node").agg(F.sum("k").alias("own"), F.map_from_entries(F.collect_list(F.struct("i", "k"))).alias("by"))
    rest = F.transform("held", lambda k, i: k - F.coalesce(F.try_element_at("by", i), F.lit(0)))
    own = sets.select("node", "held").join(alone, "node", "left")
    own = stage(own.select("node", F.coalesce("own", F.lit(0)).alias("own"), rest.alias("held")), "own-shingles")
    free(sets)
    return own


def reachable(a: str, b: str, similarity: float) -> Column:
    """Whether two sets can have the similarity if neither has its own shingles in common with the other. Where one's are not counted (null) they can."""
    common = F.least(F.col(f"{a}.n") - F.col(f"{a}.own"), F.col(f"{b}.n") - F.col(f"{b}.own"))
    uncounted = F.col(f"{a}.own").isNull() | F.col(f"{b}.own").isNull()  # least() would pass over a null
    return uncounted | (common >= (F.col(f"{a}.n") + F.col(f"{b}.n") - common) * F.lit(similarity) - 1e-6)


def meeting(a: str, b: str, similarity: float) -> Column:
    """Whether two sets can have the similarity if in no class more is common than the smaller number there (``held``). Where one's is not counted (null) they can."""
    common = F.aggregate(F.zip_with(f"{a}.held", f"{b}.held", lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)
    return F.coalesce(common >= (F.col(f"{a}.n") + F.col(f"{b}.n") - common) * F.lit(similarity) - 1e-6, F.lit(True))


def coordinates(nodes: DataFrame, blocks: int) -> DataFrame:
    """A row for each part of the fingerprints of ``nodes``: ``parts`` of the pivot table and ``fps`` give way to ``key``."""
    rows = table(nodes, part_masks(SPARED, blocks), "fps", PIVOTS).drop("fps")
    return rows.select("*", F.explode("parts").alias("key")).drop("parts")


def ends() -> list[Column]:
    """The least and the greatest node of a key: where it has two rows, both of them."""
    return [F.min("node").alias("lo"), F.max("node").alias("hi")]


def of_two(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(a, b)``, the ``nodes`` of the keys that two texts share (``key, lo, hi, m``), once each: these need no row by key."""
    found, row = groups.where("m = 2 and lo != hi").select("lo", "hi").distinct(), F.struct(*[c for c in nodes.columns if c != "fps"])
    for side, end in (("a", "lo"), ("b", "hi")):
        found = found.join(nodes.select(F.col("node").alias(end), row.alias(side)), end)
    return found.select("a", "b")


def classes(docs: DataFrame, similarity: float = SIMILARITY, fingerprints: int | None = None) -> DataFrame:
    """``(rk_id, rk_text, class)`` of every row of ``docs``: rows of one class are linked by texts of the similarity."""
    keyed = keyed_texts(docs)
    blocks, planned = plan_for(keyed.count())
    fingerprints = fingerprints or planned
    rows = stage(fingerprinted(keyed, fingerprints), "fingerprints")
    row = F.struct("rk_id", "rk_text")
    nodes = rows.groupBy("h1", "h2").agg(F.min(row).alias("rep"), F.first("n").alias("n"), F.first("fps").alias("fps"), F.count(F.lit(1)).alias("times"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # texts without words are one node and have no bits to be looked up by
    looked_up = nodes.where("n > 0").select("node", "n", F.get("fps", F.lit(0)).alias("fp"), "fps")
    some = coordinates(looked_up, blocks).where(F.pmod("key", F.lit(LED)) == 0)
    groups = stage(some.groupBy("key").agg(*ends(), F.count(F.lit(1)).alias("m")).where("m > 1"), "led-keys")
    two = of_two(groups, looked_up).where(possible("a", "b", similarity)).select(*pair("a", "b"))
    shared = stage(split_join(some, groups.where("m > 2").select("key", "m"), ["key"], "m", narrow=True), "shared")
    # a text near the middle of a group shares the most coordinates with the others, and is likeliest to be similar to them
    weight = shared.groupBy("node").agg(F.sum("m").alias("w"))
    some = shared.join(weight, "node")
    first = [F.max(F.when(F.pmod(F.xxhash64("node"), F.lit(LEADERS)) == k, F.struct("w", "node", "n", "fp"))) for k in range(LEADERS)]
    leaders = some.groupBy("key").agg(F.array_compact(F.array(*first)).alias("l"), F.count(F.lit(1)).alias("times"))
    led = split_join(some.select("key", F.struct("node", "n", "fp").alias("b")), stage(leaders, "leaders"), ["key"], "times", narrow=True)
    led = led.select("b", F.explode("l").alias("a")).where("a.node != b.node").where(possible("a", "b", similarity))
    apart_by = F.floor(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) / STEP)
    # texts that are as close to many leaders choose the same ones; what is not tried is looked at below
    choice = F.struct(apart_by.alias("d"), (-F.col("a.w")).alias("w"), F.col("a.node").alias("node"))
    tried = led.groupBy(F.col("b.node").alias("node")).agg(F.slice(F.array_sort(F.collect_set(choice)), 1, TRIED).alias("l"))
    tried = tried.select(F.struct("node").alias("b"), F.explode("l").alias("a"))
    pairs = stage(tried.select(*pair("a", "b")).union(two).distinct(), "pairs")
    links = verified(pairs, nodes, keyed, similarity, fingerprints)
    free(groups, shared)

    root = stage(components(links), "roots")
    root = F.broadcast(root) if root.count() <= NARROW_ROWS else root
    # written, so that the roots are broadcast once and not for each of the tables below
    placed = stage(looked_up.join(root, "node", "left").withColumn("c", F.coalesce("root", "node")).drop("root"), "placed")
    every = coordinates(placed, blocks)
    several = every.groupBy("key").agg(*ends(), F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("m"))
    groups = stage(several.where("c0 != c1").select("key", "lo", "hi", "m"), "apart-keys")
    # nodes are numbered without regard to their texts, so the least one is in a component as likely as that is large there
    most = groups.where("m > 2").select("key", "m", "lo").join(placed.select(F.col("node").alias("lo"), F.col("c").alias("most")), "lo").drop("lo")
    part = stage(split_join(every, stage(most, "most"), ["key"], "m", narrow=True), "parts")
    big = part.where(F.col("m") > BIG)
    own = own_shingles(big.select("node").distinct(), nodes, keyed)
    narrow_own = F.broadcast(own) if own.count() <= NARROW_ROWS // 2 else own
    met = stage(big.join(narrow_own, "node"), "apart")
    alike = [F.col("a.c") != F.col("b.c"), possible("a", "b", similarity), reachable("a", "b", similarity), meeting("a", "b", similarity)]
    apart = [F.col("a.key") == F.col("b.key"), *alike]
    few = part.where(F.col("m") <= BIG).join(narrow_own, "node", "left")
    # each kind of pairs is a plan of its own: one plan of all is planned anew, whole, after each of its shuffles
    by_few = stage(few.alias("a").join(few.alias("b"), [*apart, F.col("a.node") < F.col("b.node")]).select(*pair("a", "b")), "pairs-by-few")
    by_two = stage(of_two(groups, placed.join(narrow_own, "node", "left")).where(reduce(Column.__and__, alike)).select(*pair("a", "b")), "pairs-by-two")
    # of two texts in different components one at least is outside any given one
    outside = met.where("c != most").alias("a")
    once = (F.col("b.c") == F.col("a.most")) | (F.col("a.node") < F.col("b.node"))
    by_many = stage(outside.join(met.alias("b"), [*apart, once]).select(*pair("a", "b")), "pairs-by-many")
    left = stage(by_few.unionByName(by_two).unionByName(by_many).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(verified(left, nodes, keyed, similarity, fingerprints))
    free(groups, part, pairs, met, own, by_few, by_two, by_many, left, placed)

    named = stage(nodes.select("h1", "h2", "node", "times").join(components(links), "node", "left").select("h1", "h2", "times", F.coalesce("root", "node").alias("class")), "classes")
    return split_join(rows.select("rk_id", "rk_text", "h1", "h2"), named, ["h1", "h2"], "times", narrow=True).select("rk_id", "rk_text", "class")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, fingerprints: int | None = None) -> DataFrame:
    """The rows of ``docs`` with one document of each class: that with the smallest doc_id, once."""
    row = F.struct("rk_id", "rk_text")
    kept = classes(docs, similarity, fingerprints).groupBy("class").agg(F.min(row).alias("k")).select("k.*")
    chosen = keyed_rows(docs).join(kept, ["rk_id", "rk_text"], "left_semi")
    return chosen.dropDuplicates(["rk_id", "rk_text"]).select("row.*")
