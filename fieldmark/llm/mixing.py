"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The tree is domain, language, source; its leaves hold the documents. A token
budget comes down from the root: at each node it is shared among the children
by weight, but no child gets more than its subtree can give, which is its
tokens times ``max_epochs``. What a short child leaves goes to its siblings by
weight (water-filling, exact in integers) and, as a node never gets more than
its whole subtree holds, to the node's own siblings only when all its children
are exhausted. Shares are rounded down.

A leaf's budget is a number of whole epochs over its documents and a prefix of
one more. The prefix is taken in that epoch's seeded order (md5 of seed, epoch
and doc_id), up to and with the document that reaches the budget. The order's
first three hex digits deal a leaf into 4096 buckets whose sums are added up
first, the next three deal the one where the prefix ends into as many again, and
only the one of those where it ends is ordered row by row: a leaf with a third
of all rows does not go to one task, nor does a 16-millionth of it matter. What comes out per leaf
is a cut-off key, and documents are compared with it without being moved.

Cases: tokens are words ``[^\\x20\\x09-\\x0D]+``; a null or empty text has none
and is taken only where its leaf repeats whole epochs or the prefix passes it;
null lang or source is the leaf ''; siblings that tie are taken in name order;
a weight of 0 leaves a node out; repeated rows are ordered next to each other,
and where the first of them is taken all are; further columns, whatever their names, are kept; an empty table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import row_key, stage

LEVELS = ["domain", "lang", "source"]
#: Leaf plans of at most so many rows are broadcast; a row is under 200 bytes.
BROADCAST_LEAVES = 50_000
#: Leading hex digits of the order key that a leaf is dealt by, level by level.
DIGITS = 3, 6
Weights = dict[str, dict[str, int]]


def domain_of(source: Column) -> Column:
    """The documents carry no domain: four domains by the number a source's name ends in."""
    return F.concat(F.lit("domain"), (F.coalesce(F.regexp_extract(source, r"(\d{1,9})$", 1).try_cast("long"), F.lit(0)) % 4).cast("string"))


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def with_leaf(docs: DataFrame) -> DataFrame:
    """``(rk_id, rk_text, row, text, leaf_domain, leaf_lang, leaf_source)``: the caller's columns nested, so that no name of theirs meets one of ours."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    return docs.select(*row_key(), F.struct("*").alias("row"), F.col("text").cast("string").alias("text"), domain_of(source).alias("leaf_domain"), lang.alias("leaf_lang"), source.alias("leaf_source"))


def weight_of(level: str, weights: Weights) -> Column:
    known = weights.get(level, {})
    return reduce(lambda c, kv: c.when(F.col(level) == kv[0], kv[1]), known.items(), F.when(F.lit(False), 1)).otherwise(known.get("*", 1)).cast("long")


def shared_out(children: DataFrame, parents: list[str], level: str) -> DataFrame:
    """Share each parent's ``budget`` among ``children`` by ``weight``, at most ``cap`` each; the result replaces ``budget``."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    ordered = family.orderBy(F.col("cap") / F.col("weight"), level)
    before = F.coalesce(F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    filled = children.withColumns({"before": before, "ahead": ahead})
    filled = filled.withColumn("full", (F.col("budget") - F.col("before")).cast("decimal(38,0)") * big("weight") >= big("cap") * big("ahead"))
    filled = filled.withColumns({"kept": F.sum(F.expr("if(full, cap, 0L)")).over(family), "open": F.sum(F.expr("if(full, 0L, weight)")).over(family)})
    share = F.expr("if(full, cap, (cast(budget - kept as decimal(38,0)) * weight) div open)")
    return filled.withColumn("budget", share.cast("long")).drop("before", "ahead", "full", "kept", "open")


def leaf_budgets(leaves: DataFrame, budget_share: float, max_epochs: int, weights: Weights) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with the ``budget`` of each, from ``budget_share`` of all tokens."""
    total = leaves.agg(F.coalesce(F.floor(F.sum("tokens") * F.lit(budget_share)).cast("long"), F.lit(0))).first()[0]
    weighted = leaves.withColumns({f"w_{x}": weight_of(x, weights) for x in LEVELS} | {"cap": F.col("tokens") * max_epochs})
    weighted = weighted.where(" and ".join(f"w_{x} > 0" for x in LEVELS))
    out = None
    for depth, level in enumerate(LEVELS):
        path = LEVELS[: depth + 1]
        nodes = weighted.groupBy(*path).agg(F.sum("cap").alias("cap"), F.first(f"w_{level}").alias("weight"))
        nodes = nodes.join(out, path[:-1]) if depth else nodes.withColumn("budget", F.lit(total).cast("long"))
        out = shared_out(nodes, path[:-1], level).select(*path, "budget")
    return out.join(leaves, LEVELS)


def order_key(seed: int, epoch: Column) -> Column:
    """A row's place in an epoch's order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col("rk_id").cast("string")))


def mix(docs: DataFrame, budget_share: float = 0.5, max_epochs: int = 4, weights: Weights | None = None, seed: int = 42) -> DataFrame:
    """The selected rows of ``docs`` with ``leaf_domain, leaf_lang, leaf_source`` and ``n_epochs``, how often each is taken.

    ``weights`` has integer weights by level and name, ``*`` for the others (1
    if not given). Every row of ``docs`` counts; its columns stay as they are,
    but those named like one of the four are replaced.
    """
    path = [F.col(f"leaf_{x}").alias(x) for x in LEVELS]
    keyed = with_leaf(docs)
    rows = stage(keyed.select("rk_id", "rk_text", *path, tokens_of(F.col("text")).alias("tokens")), "token-counts")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = leaf_budgets(leaves, budget_share, max_epochs, weights or {})
    whole = F.expr("if(tokens > 0, budget div tokens, 0L)")
    plan = stage(plan.select(*LEVELS, whole.alias("whole"), (F.col("budget") - whole * F.col("tokens")).alias("rest")), "leaf-plan")
    small = plan.count() <= BROADCAST_LEAVES

    def hint(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    key = order_key(seed, F.col("whole") + 1)
    last = rows.join(hint(plan.where("rest > 0")), LEVELS).withColumns({"key": key, "before": F.lit(0).cast("long")})
    for digits in DIGITS:
        last = last.withColumn("bucket", F.substring("key", 1, digits))
        sums = last.groupBy(*LEVELS, "bucket", "before", "rest").agg(F.sum("tokens").alias("tokens"))
        opens = F.col("before") + F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("bucket")) - F.col("tokens")
        ends = sums.withColumn("opens", opens).where("opens < rest and opens + tokens >= rest")
        ends = stage(ends.select(*LEVELS, "bucket", F.col("opens").alias("before")), "leaf-buckets")  # at most one row a leaf
        last = last.drop("before").join(hint(ends), [*LEVELS, "bucket"])
    order = Window.partitionBy(*LEVELS).orderBy("key", "rk_id", "rk_text").rowsBetween(Window.unboundedPreceding, -1)  # repeated rows stand one after another
    last = last.withColumn("so_far", F.col("before") + F.coalesce(F.sum("tokens").over(order), F.lit(0))).where("so_far < rest")
    cuts = last.groupBy(*LEVELS).agg(F.max(F.struct("key", "rk_id", "rk_text")).alias("cut"))
    cuts = stage(plan.join(cuts, LEVELS, "left").where("whole > 0 or cut is not null").drop("rest"), "leaf-cuts")
    for x in LEVELS:
        cuts = cuts.withColumnRenamed(x, f"leaf_{x}")
    taken = keyed.join(hint(cuts), [f"leaf_{x}" for x in LEVELS])
    more = F.struct(key.alias("key"), "rk_id", "rk_text") <= F.col("cut")
    taken = taken.withColumn("n_epochs", F.col("whole") + F.when(more, 1).otherwise(0)).where("n_epochs > 0")
    own = [*[f"leaf_{x}" for x in LEVELS], "n_epochs"]
    given = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in own]
    return taken.select(*given, *own)
