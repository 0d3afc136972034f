"""Exact medians by rank selection: no group's values meet in one buffer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One in so many of a group's ranks is how far the sketch may be off.
ACCURACY = 1000
#: Groups whose brackets, under 400 bytes each, may be broadcast.
BROADCAST_GROUPS = 200_000


def weighted_medians(counts: DataFrame, keys: list[str], value: str, weight: str, bucket: Column, below: Column | None = None, total: Column | None = None) -> DataFrame:
    """``(*keys, median)`` of ``counts``, which has each value of a group once and says in ``weight`` how often it stands.

    ``bucket`` must not fall as the value rises. The weights of buckets are added
    up first; only the buckets in which the middle ranks lie are then ordered
    value by value. ``below`` and ``total`` are the ranks before the first of
    ``counts`` and all ranks of the group, where ``counts`` is a part of it;
    both are columns of ``counts`` that are equal in a group.
    """
    group = Window.partitionBy(*keys)
    facts = [F.first(below if below is not None else F.lit(0)).alias("below"), F.first(total if total is not None else F.lit(None).cast("long")).alias("total")]
    sums = counts.groupBy(*keys, bucket.alias("bucket")).agg(F.sum(weight).alias("n"), *facts)
    opens = F.col("below") + F.sum("n").over(group.orderBy("bucket")) - F.col("n")
    sums = sums.withColumns({"opens": opens, "total": F.coalesce("total", F.sum("n").over(group))})
    sums = sums.withColumns({"low": F.expr("(total - 1) div 2"), "high": F.expr("total div 2")})
    chosen = sums.where((F.col("opens") <= F.col("high")) & (F.col("opens") + F.col("n") > F.col("low"))).select(*keys, "bucket", "opens", "low", "high")
    rows = counts.withColumn("bucket", bucket).join(chosen, [*keys, "bucket"])
    at = F.col("opens") + F.sum(weight).over(Window.partitionBy(*keys, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("until", at)

    def of_rank(rank: str) -> Column:
        return F.max(F.when((F.col("until") > F.col(rank)) & (F.col("until") - F.col(weight) <= F.col(rank)), F.col(value)))

    ends = rows.groupBy(*keys).agg(of_rank("low").alias("a"), of_rank("high").alias("z"))
    return ends.select(*keys, ((F.col("a") + F.col("z")) / 2).alias("median"))


def brackets(columns: dict[str, Column]) -> list[Column]:
    """Aggregates ``<name>:bracket``: two values that the median of each column lies between, from a sketch of bounded size."""
    near = 2 / ACCURACY
    return [F.percentile_approx(x, [0.5 - near, 0.5 + near], ACCURACY).alias(f"{c}:bracket") for c, x in columns.items()]


def medians(rows: DataFrame, keys: list[str], columns: dict[str, Column], bracketed: DataFrame) -> DataFrame:
    """``(*keys, column, median)`` of each of ``columns``.

    ``bracketed`` is a written table with ``brackets`` and ``<name>:count`` of every group. The rows
    are read once more for how many values lie below each bracket, and once for
    the values inside it, under one in a hundred, of which the middle ranks are
    taken. Where a sketch was off by more than it states, the whole group is its
    bracket. Brackets of up to ``BROADCAST_GROUPS`` groups are broadcast.
    """
    small, few = bracketed.select(*keys, *[f"`{c}:{x}`" for c in columns for x in ("bracket", "count")]), bracketed.count() <= BROADCAST_GROUPS
    small = F.broadcast(small) if few else small
    low = {c: F.get(F.col(f"`{c}:bracket`"), F.lit(0)) for c in columns}
    high = {c: F.get(F.col(f"`{c}:bracket`"), F.lit(1)) for c in columns}
    met = rows.select(*keys, *[x.alias(c) for c, x in columns.items()]).join(small, keys)
    ranks = met.groupBy(*keys).agg(*[f for c in columns for f in (F.count_if(F.col(f"`{c}`") < low[c]).alias(f"{c}:below"), F.count_if(F.col(f"`{c}`") <= high[c]).alias(f"{c}:until"))])
    ranks = ranks.join(small, keys)
    bounds = []
    for c in columns:
        n, below, until = (F.col(f"`{c}:{x}`") for x in ("count", "below", "until"))
        ok = (below <= F.expr(f"(`{c}:count` - 1) div 2")) & (until > F.expr(f"`{c}:count` div 2"))
        bounds.append(F.struct(F.lit(c).alias("column"), n.alias("total"), F.when(ok, below).otherwise(0).alias("below"), F.when(ok, low[c]).alias("low"), F.when(ok, high[c]).alias("high")))
    bounds = ranks.select(*keys, F.array(*bounds).alias("bounds"))
    met = rows.select(*keys, F.array(*[F.struct(F.lit(c).alias("column"), x.alias("value")) for c, x in columns.items()]).alias("cells"))
    met = met.join(F.broadcast(bounds) if few else bounds, keys)
    paired = F.zip_with("cells", "bounds", lambda x, b: F.struct(x["column"].alias("column"), x["value"].alias("value"), b["total"].alias("total"), b["below"].alias("below"), b["low"].alias("low"), b["high"].alias("high")))
    inside = F.filter(paired, lambda x: x["value"].isNotNull() & F.coalesce(x["value"] >= x["low"], F.lit(True)) & F.coalesce(x["value"] <= x["high"], F.lit(True)))
    cells = met.select(*keys, F.inline(inside)).groupBy(*keys, "column", "value", "total", "below").agg(F.count(F.lit(1)).alias("n"))
    # a value's place in steps of its bracket would serve as a bucket; a bracket is small, so it is one
    return weighted_medians(cells, [*keys, "column"], "value", "n", F.lit(0), F.col("below"), F.col("total"))
