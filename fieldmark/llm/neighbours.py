"""Approximate nearest neighbours by cosine: few stable projections, a kd-tree over them, and a chi-square stopping test.

A vector of length one is projected on ``PROJECTIONS`` Gaussian directions. The
normal law is 2-stable: of two vectors at distance d, the squared distance of
the projections is d^2 times a chi-square variable of that many degrees. A query
takes candidates in the order in which their projections lie away from its own
and verifies each by its cosine. With r the projected distance reached and d the
distance of the last neighbour kept, it stops once chi-square(r^2 / d^2) is at
least ``CONFIDENCE``: a candidate nearer than d and not yet seen is then less
likely than the rest of that probability.

The kd-tree has two levels of blocks. Above, a bounded sample (``SAMPLE`` rows,
the first by hash) is split at medians into cells, and every vector goes to its
cell; a cell is a unit of work, one of more than ``UNIT`` vectors is several by
hash. In a unit the tree goes on down to leaves of ``LEAF`` vectors. Each cell
and leaf has a box, whose distance from the query bounds its members', so the
order in which cells and leaves are opened is that of the candidates, a few
leaves at a time, and the test closes whole leaves and cells.

First every query is searched in its own cell; with what it has found it goes
on to those cells that the test does not close. Units that many queries come
to are dealt over several tasks; a task holds one unit and streams queries by.

Only distinct vectors are indexed and searched; equal ones are one node with
the smallest ids of its rows, as many as can be asked for, so a vector that
stands in a third of all rows costs no more than another, and none of its rows
is left out of a result.

Cases: a vector that is null, zero or has a null or non-finite component takes
no part, nor does a row without an id, nor vectors of another length than most;
ties in score go to the smaller vec_id; each row is a candidate, so repeated
rows are each other's neighbours and each gets results as a query; with fewer
candidates than asked for all are returned; very large and very small
components are scaled by a power of two first; further columns, whatever their
names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import map_batches, split_join, stage

NEAREST, EVERY = 5, 50
PROJECTIONS, CONFIDENCE, SEED = 8, 0.95, 7
#: Rows of the sample that the upper tree is made from, and how many of them a cell needs.
SAMPLE, PER_CELL = 65_536, 64
#: Distinct vectors of a unit, at about 1 KB each; vectors of a leaf.
UNIT, LEAF = 8_192, 64
#: Squared distance below which vectors are taken as equally near.
LEAST = 1e-12
#: Queries that one task takes for a unit.
QUERIES = 20_000


def chi_square(x: float, degrees: int) -> float:
    """The distribution function for an even number of degrees."""
    term = total = 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def stop_at(confidence: float, degrees: int) -> float:
    """The ratio r^2 / d^2 from which the stopping test holds."""
    low, high = 0.0, 1.0
    while chi_square(high, degrees) < confidence:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < confidence else (low, middle)
    return high


def usable(vector: Column) -> Column:
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda c: c != 0), F.lit(False))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors whose largest component is near 1, by powers of two alone."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0.0))[1][:, None])


def directions(dimensions: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dimensions, PROJECTIONS))


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


class Splits:
    """A kd-tree's upper levels: places of the median splits of a sample, in the order of a heap."""

    def __init__(self, points: np.ndarray, cells: int) -> None:
        self.depth = max(0, cells - 1).bit_length()
        self.axis, self.at = np.zeros(1 << self.depth, np.int64), np.zeros(1 << self.depth)
        parts = {1: points}
        for node in range(1, 1 << self.depth):
            p = parts.pop(node)
            if len(p):
                axis = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
                self.axis[node], self.at[node] = axis, np.median(p[:, axis])
            over = p[:, self.axis[node]] > self.at[node]
            parts[2 * node], parts[2 * node + 1] = p[~over], p[over]

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.at[node])
        return node - (1 << self.depth)


def away(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of a projection from boxes."""
    gap = np.maximum(np.maximum(low - point, point - high), 0)
    return (gap * gap).sum(axis=1)


class Found:
    """The nearest of a query so far; ``kept`` rows are looked for."""

    def __init__(self, kept: int, bound: float = math.inf) -> None:
        self.kept, self.bound = kept, bound
        self.node, self.score, self.copies, self.first = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, node: np.ndarray, score: np.ndarray, copies: np.ndarray, first: np.ndarray) -> None:
        node, score, copies, first = (np.concatenate(x) for x in ((self.node, node), (self.score, score), (self.copies, copies), (self.first, first)))
        if len(score) > 4 * self.kept:  # a cheap cut before the sort; ties stay
            stay = score >= np.partition(score, -self.kept)[-self.kept]
            node, score, copies, first = node[stay], score[stay], copies[stay], first[stay]
        order = np.lexsort((first, -score))[: self.kept]
        self.node, self.score, self.copies, self.first = node[order], score[order], copies[order], first[order]
        enough = np.flatnonzero(np.cumsum(self.copies) >= self.kept)
        if len(enough):
            self.bound = min(self.bound, max(LEAST, 2 - 2 * float(self.score[enough[0]])))


class Tree:
    """The kd-tree of one unit."""

    def __init__(self, nodes: np.ndarray, vectors: np.ndarray, copies: np.ndarray, first: np.ndarray, axes: np.ndarray) -> None:
        lens = lengths(vectors)
        points, leaves, open_parts = (vectors / lens[:, None]) @ axes, [], [np.arange(len(nodes))]
        while open_parts:
            part = open_parts.pop()
            p = points[part]
            if len(part) <= LEAF:
                leaves.append(part)
                continue
            half = np.argpartition(p[:, int(np.argmax(p.max(axis=0) - p.min(axis=0)))], len(part) // 2)
            open_parts += [part[half[: len(part) // 2]], part[half[len(part) // 2 :]]]
        order = np.concatenate(leaves)
        self.nodes, self.vectors, self.lens, self.copies, self.first, self.points = nodes[order], vectors[order], lens[order], copies[order], first[order], points[order]
        self.starts = np.cumsum([0, *map(len, leaves)])
        self.low = np.array([points[x].min(axis=0) for x in leaves])
        self.high = np.array([points[x].max(axis=0) for x in leaves])

    def search(self, vector: np.ndarray, point: np.ndarray, found: Found, stop: float) -> None:
        """Verify candidates in the order of their projections, some leaves at a time and ever more, until the test holds."""
        far, length, at, step = away(point, self.low, self.high), lengths(vector[None])[0], 0, 1
        order = np.argsort(far, kind="stable")
        while at < len(order) and far[order[at]] <= stop * found.bound:
            rows = np.concatenate([np.arange(self.starts[k], self.starts[k + 1]) for k in order[at : at + step] if far[k] <= stop * found.bound])
            gap = self.points[rows] - point
            rows = rows[(gap * gap).sum(axis=1) <= stop * found.bound]
            score = (self.vectors[rows] * vector).sum(axis=1) / (self.lens[rows] * length)
            found.add(self.nodes[rows], score, self.copies[rows], self.first[rows])
            at, step = at + step, 2 * step


def matrix(batch: pa.RecordBatch, column: str = "vector") -> np.ndarray:
    """The vectors of a batch, scaled."""
    return scaled(batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)) if len(batch) else np.zeros((0, 1))


def nodes_of(embeddings: DataFrame, kept: int, every: int) -> DataFrame:
    """``(node, vector, ids, asked)``: each distinct vector, the ``kept`` smallest ids of its rows and how many of them are queries."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    size = rows.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    rows = rows.where(F.size("vector") == (size.n if size else 0))
    # a limit by rank is taken before the shuffle too, so equal vectors do not meet in one task
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("rank") <= kept)
    ids = ranked.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = rows.groupBy("vector").agg(F.count_if(F.col("vec_id") % every == 0).alias("asked"))
    return stage(ids.join(asked, "vector").withColumn("node", F.monotonically_increasing_id()), "nodes")


def celled(nodes: DataFrame, axes: np.ndarray, splits: Splits) -> DataFrame:
    """``nodes`` with their projection as ``point``, and their ``cell``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch)
            points = (v / lengths(v)[:, None]) @ axes if len(batch) else np.zeros((0, PROJECTIONS))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * PROJECTIONS, pa.int32()), pa.array(points.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed, pa.array(splits.cell_of(points), pa.int64())], [*batch.schema.names, "point", "cell"])

    return map_batches(nodes.select("node", "vector", "ids", "asked"), run, "node long, vector array<double>, ids array<long>, asked long, point array<double>, cell long")


def searched(candidates: DataFrame, queries: DataFrame, axes: np.ndarray, kept: int, stop: float) -> DataFrame:
    """``(query, node, score, ids)``: for each query the nearest of the units it comes to.

    ``candidates`` ``(unit, node, vector, ids)``, ``queries`` ``(unit, query,
    vector, bound)``. Units that many queries come to are dealt over tasks, each
    with the unit's candidates and a share of the queries.
    """
    loads = queries.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("shares"))
    loads = stage(loads, "loads")
    blank = F.lit(None)
    asked = queries.join(F.broadcast(loads), "unit").select("unit", F.pmod(F.xxhash64("query"), F.col("shares")).alias("share"), F.lit(1).alias("kind"), F.col("query").alias("node"), "vector", blank.cast("array<long>").alias("ids"), "bound")
    given = candidates.join(F.broadcast(loads), "unit").select("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"), "node", "vector", "ids", F.lit(0.0).alias("bound"))
    both = given.unionByName(asked)
    tasks = max(loads.agg(F.coalesce(F.sum("shares"), F.lit(0))).first()[0], 1)
    dealt = both.repartition(min(2 * tasks, 100_000), "unit", "share").sortWithinPartitions("unit", "share", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, parts, tree = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "share", "kind")], axis=1)
            cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                piece = batch.slice(a, z - a)
                if not len(piece):
                    continue
                if (name := tuple(keys[a, :2])) != unit:
                    unit, parts, tree = name, [], None
                if keys[a, 2] == 0:
                    ids = piece.column("ids").to_pylist()
                    parts.append((piece.column("node").to_numpy(), matrix(piece), ids))
                    continue
                if tree is None:
                    ids = [x for p in parts for x in p[2]]
                    nodes, vectors = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                    of_node, parts = dict(zip(nodes.tolist(), ids, strict=True)), []
                    tree = Tree(nodes, vectors, np.array([len(x) for x in ids]), np.array([x[0] for x in ids]), axes)
                out: list[list] = [[], [], [], []]
                vectors = matrix(piece)
                points = (vectors / lengths(vectors)[:, None]) @ axes
                for query, vector, point, bound in zip(piece.column("node").to_pylist(), vectors, points, piece.column("bound").to_pylist(), strict=True):
                    tree.search(vector, point, found := Found(kept, bound), stop)
                    for column, values in zip(out, ([query] * len(found.node), found.node.tolist(), found.score.tolist(), [of_node[n] for n in found.node.tolist()]), strict=True):
                        column.extend(values)
                kinds = pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["query", "node", "score", "ids"])

    return map_batches(dealt, run, "query long, node long, score double, ids array<long>")


def best_of(found: DataFrame, kept: int) -> DataFrame:
    """``(query, rows)``: the ``kept`` best rows of each query, nearest first, as ``(less, vec_id, node, score)``."""
    ranked = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.get("ids", F.lit(0))))
    nodes = found.withColumn("rank", ranked).where(F.col("rank") <= kept).groupBy("query").agg(F.collect_list(F.struct("node", "score", "ids")).alias("nodes"))
    rows = F.flatten(F.transform("nodes", lambda n: F.transform(n["ids"], lambda i: F.struct((-n["score"]).alias("less"), i.alias("vec_id"), n["node"].alias("node"), n["score"].alias("score")))))
    return nodes.select("query", F.slice(F.array_sort(rows), 1, kept).alias("rows"))


def elsewhere(queries: DataFrame, boxes: list[tuple[int, int, int]], low: np.ndarray, high: np.ndarray, stop: float) -> DataFrame:
    """``(unit, query, vector, bound)`` of the units beyond a query's own cell that the test leaves open. ``boxes`` has a cell's name, first unit and units."""
    names = np.array([b[0] for b in boxes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, rows = [], []
            cells, bounds = batch.column("cell").to_numpy(), batch.column("bound").to_numpy()
            points = batch.column("point").flatten().to_numpy().reshape(-1, PROJECTIONS)
            for k, (cell, point, bound) in enumerate(zip(cells, points, bounds, strict=True)):
                for c in np.flatnonzero((away(point, low, high) <= stop * bound) & (names != cell)):
                    units += range(boxes[c][1], boxes[c][1] + boxes[c][2])
                    rows += [k] * boxes[c][2]
            told = batch.select(["node", "vector", "bound"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), *told.columns], ["unit", "query", "vector", "bound"])

    return map_batches(queries, run, "unit long, query long, vector array<double>, bound double")


def nearest(embeddings: DataFrame, nearest: int = NEAREST, every: int = EVERY, confidence: float = CONFIDENCE, seed: int = SEED) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``nearest`` rows found of each row whose id ``every`` divides, but itself."""
    kept, stop = nearest + 1, stop_at(confidence, PROJECTIONS)  # a query's own row is among the rows kept
    nodes = nodes_of(embeddings, kept, every)
    count, size = nodes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    axes, cells = directions(size, seed), max(1, min(-(-count // UNIT), SAMPLE // PER_CELL))
    points = np.zeros((0, PROJECTIONS))
    if cells > 1:
        sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / count)))
        points = celled(sample, axes, Splits(points, 1)).select("point").toArrow().column("point").combine_chunks().flatten().to_numpy().reshape(-1, PROJECTIONS)
    index = stage(celled(nodes, axes, Splits(points, cells)), "index")

    ends = [f(F.get("point", F.lit(i))).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(PROJECTIONS)]
    found = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ends).orderBy("cell").collect()  # no more rows than cells
    low, high = (np.array([[b[f"{n}{i}"] for i in range(PROJECTIONS)] for b in found]).reshape(-1, PROJECTIONS) for n in ("low", "high"))
    boxes, start = [], 0
    for b in found:
        boxes.append((b.cell, start, -(-b.n // (2 * UNIT))))
        start += boxes[-1][2]
    units = nodes.sparkSession.createDataFrame(boxes, "cell long, start long, parts long")
    housed = index.join(F.broadcast(units), "cell")
    candidates = housed.select((F.col("start") + F.pmod(F.xxhash64("node"), F.col("parts"))).alias("unit"), "node", "vector", "ids")
    own_units = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("parts") - 1)).alias("unit")
    home = housed.where("asked > 0").select(own_units, F.col("node").alias("query"), "vector", F.lit(math.inf).alias("bound"))
    first = stage(searched(candidates, home, axes, kept, stop), "own-cell")

    last = F.get("rows", F.lit(kept - 1))["score"]
    bounds = best_of(first, kept).select(F.col("query").alias("node"), F.coalesce(F.greatest(F.lit(LEAST), 2 - 2 * last), F.lit(math.inf)).alias("bound"))
    bounded = index.where("asked > 0").select("node", "vector", "point", "cell").join(bounds, "node")
    rest = stage(searched(candidates, elsewhere(bounded, boxes, low, high, stop), axes, kept, stop), "other-cells")

    answers = nodes.where("asked > 0").select("node", "vector", "asked").join(best_of(first.unionByName(rest), kept).withColumnRenamed("query", "node"), "node")
    asking = embeddings.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector")).where((F.col("query_id") % every == 0) & usable(F.col("embedding")))
    met = split_join(asking, stage(answers, "answers"), ["vector"], "asked")
    # its own row is one with its id among those of its vector; if it is not there, smaller ids of equal vectors are
    own = F.array_position(F.transform("rows", lambda x: F.struct(x["node"], x["vec_id"])), F.struct("node", F.col("query_id").alias("vec_id")))
    others = F.filter("rows", lambda x, i: (i + 1) != F.col("own"))
    out = met.withColumn("own", own).select("query_id", F.posexplode(F.slice(others, 1, nearest)).alias("place", "x"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), "x.vec_id", "x.score")
