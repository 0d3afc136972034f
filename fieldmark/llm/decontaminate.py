"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Every benchmark item is cut into windows of ``width`` words (an item of fewer
is one window). A window is the set of its word shingles. Shingles are ordered
by rarity, counted over all documents. A document holds a window only if it
holds all of its shingles, so by the prefix filter for containment 1 the
prefix is one shingle long: the rarest. Documents are joined on that shingle
alone. The shingle's place in the window fixes where the window would have to
start, which gives the positional bound (not before the first word) and the
length bound (not past the last); what is left is compared word for word.

The windows are broadcast while they measure at most ``broadcast_mb``; beyond
that the same join is shuffled, by document positions without their text.

Cases: a null or empty text has no words and no hits; a null item_id can hit
but is not listed; equal windows of several items count for each; repeated rows
each get their result; further columns, whatever their names, are ignored and by
``clean_documents`` kept; empty tables give an empty or an all-clean result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import ascii_lower, doc_id, keyed_rows, keyed_texts, stage

#: After lower-casing, words are runs of digits, a-z and whatever is not ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATORS), ""), F.array().cast("array<string>"))


def shingle_at(words: Column, at: Column, size: int) -> Column:
    """Hash of the ``size`` words from ``at``; a collision only adds a candidate that the comparison rejects."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(size)])


def benchmark_windows(benchmark: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``(win, size, seq)`` and the items of each ``(win, item)``."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text").cast("string")).alias("w")).where("size(w) > 0")
    size = F.least(F.lit(width), F.size("w"))
    starts = items.select("item", "w", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("at"))
    all_windows = starts.select("item", "size", F.slice("w", F.col("at") + 1, F.col("size")).alias("seq"))
    windows = stage(all_windows.select("size", "seq").distinct().withColumn("win", F.monotonically_increasing_id()), "windows")
    return windows, stage(all_windows.join(windows, ["size", "seq"]).select("win", "item").distinct(), "window-items")


def hits(docs: DataFrame, windows: DataFrame, shingle: int, broadcast_mb: int) -> DataFrame:
    """Rows ``(rk_id, rk_text, n_words, start, size, win)``: one with null start for each document, and one for each window found."""
    tokens = windows.select("win", "size", "seq", F.least(F.col("size"), F.lit(shingle)).alias("k"))
    lengths = sorted(r.k for r in tokens.select("k").distinct().collect())  # at most ``shingle`` numbers
    token = F.coalesce(*[F.when(F.col("k") == k, shingle_at(F.col("seq"), F.col("off"), k)) for k in lengths], F.lit(0).cast("long"))
    tokens = tokens.withColumn("off", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("k")))).withColumn("token", token)
    measured = windows.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("seq", " "))).alias("b")).first()
    small = (measured.b or 0) * 4 + measured.n * width_rows(windows) * 64 <= broadcast_mb << 20

    def hint(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    worded = docs.select("rk_id", "rk_text", words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    placed = worded.withColumn("at", F.explode(F.sequence(F.lit(-1), F.col("n_words") - 1)))
    at, words = F.col("at"), F.col("words")
    tokens_at = [F.when((at >= 0) & (at + k <= F.col("n_words")), shingle_at(words, at, k)) for k in lengths] or [F.lit(None).cast("long")]
    one = F.array(F.lit(None).cast("long"))
    placed = placed.withColumn("token", tokens_at[0] if len(tokens_at) == 1 else F.explode(F.when(at == -1, one).otherwise(F.array(*tokens_at))))

    counts = placed.join(hint(tokens.select("token").distinct()), "token").groupBy("token").count()
    rarest = F.min_by(F.struct("token", "off"), F.struct(F.coalesce("count", F.lit(0)), "off")).alias("r")
    index = tokens.join(counts, "token", "left").groupBy("win", "size", "seq").agg(rarest).select("win", "size", "seq", "r.token", "r.off")
    index = stage(index, "rarest-shingles")

    start = at - F.col("off")
    bounds = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    same = F.slice(words, F.greatest(start, F.lit(0)) + 1, F.col("size")) == F.col("seq")
    if small:
        i = F.broadcast(index.withColumnRenamed("token", "t"))
        rows = placed.join(i, (F.col("token") == F.col("t")) & bounds & same, "left")
        rows = rows.where((at == -1) | F.col("win").isNotNull())
        return rows.select("rk_id", "rk_text", "n_words", F.when(F.col("win").isNotNull(), start).alias("start"), "size", "win")
    places = placed.select("rk_id", "rk_text", "n_words", "at", "token").join(index.drop("seq"), "token").where(bounds)
    places = places.select("rk_id", "rk_text", start.alias("start"), "win").distinct()
    exact = worded.join(places, ["rk_id", "rk_text"]).join(windows, "win").where(F.slice(words, F.col("start") + 1, F.col("size")) == F.col("seq"))
    nothing = F.lit(None).cast("int")
    return worded.select("rk_id", "rk_text", "n_words", nothing.alias("start"), nothing.alias("size"), F.lit(None).cast("long").alias("win")).unionByName(
        exact.select("rk_id", "rk_text", "n_words", "start", "size", "win")
    )


def width_rows(windows: DataFrame) -> int:
    """Shingles of the longest window at most, for the size of the broadcast."""
    return windows.agg(F.coalesce(F.max("size"), F.lit(1)).alias("w")).first().w


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, shingle: int = 3, broadcast_mb: int = 64) -> DataFrame:
    """``(doc_id, rk_id, rk_text, n_words, n_hit, n_items, items, contaminated)`` for every row of ``docs``.

    ``n_hit`` counts the document's words inside any occurrence of a window;
    ``items`` lists the items with occurring windows, sorted as strings.
    """
    keyed = keyed_texts(docs)
    windows, items = benchmark_windows(benchmark, width)
    found = stage(hits(keyed, windows, shingle, broadcast_mb), "hits")
    span = F.when(F.col("win").isNotNull(), F.struct("start", (F.col("start") + F.col("size")).alias("stop")))
    rows = F.count_if(F.col("win").isNull())
    by_doc = found.groupBy("rk_id", "rk_text").agg(rows.alias("rows"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(span)).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], a["reach"]))).alias("n"), F.greatest(a["reach"], x["stop"]).alias("reach")
        ),
    )["n"]
    listed = found.where("win is not null").select("rk_id", "rk_text", "win").distinct().join(items, "win").where("item is not null")
    listed = listed.groupBy("rk_id", "rk_text").agg(F.array_sort(F.collect_set("item")).alias("items"))
    done = by_doc.join(listed, ["rk_id", "rk_text"], "left").withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    listing = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = covered.cast("long")
    return done.select(
        doc_id(), "rk_id", "rk_text", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.size(listing).cast("long").alias("n_items"), listing.alias("items"), (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no window of a benchmark item."""
    hit = contamination(docs, benchmark, width).where("contaminated").select("rk_id", "rk_text").distinct()
    return keyed_rows(docs).join(hit, ["rk_id", "rk_text"], "left_anti").select("row.*")
