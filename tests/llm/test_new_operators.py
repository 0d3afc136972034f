"""Nearest neighbours, fill-in-middle and the Merkle manifest against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.llm import fill_in_middle, merkle, neighbours, registry

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_text(rows):
    return sorted(map(tuple, rows), key=repr)


# --- nearest neighbours


def exact(rows, every=50, k=5):
    """Each query's ``k`` nearest rows, and the score of the last."""
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    a = np.array([v for _, v in ok], float)
    ids, n = np.array([i for i, _ in ok]), np.sqrt((a * a).sum(axis=1))
    out = []
    for q in np.flatnonzero(ids % every == 0):
        s = (a * a[q]).sum(axis=1) / (n * n[q])
        order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
        out.append((int(ids[q]), [(int(ids[j]), s[j]) for j in order]))
    return out


def found(spark, rows, parts=5, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string, score int").repartition(parts)
    out = {}
    for r in neighbours.nearest(df, **more).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def table(n, seed=3, dims=64):
    """Spread vectors, dense clusters, copies and near copies."""
    rng = np.random.default_rng(seed)
    spread, centres = rng.normal(size=(n // 2, dims)), rng.normal(size=(6, dims))
    dense = centres[rng.integers(0, 6, n // 4)] + rng.normal(size=(n // 4, dims)) * 0.1
    copies = np.repeat(spread[3:4], n // 4, axis=0)
    v = np.concatenate([spread, dense, copies]).astype(np.float32)
    return [(i, x.tolist(), "n", 1) for i, x in enumerate(v[rng.permutation(len(v))])]


@pytest.mark.parametrize("unit", [8192, 100])
def test_neighbours_recall_and_scores(spark, monkeypatch, unit):
    monkeypatch.setattr(neighbours, "UNIT", unit)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    rows = table(3000)
    got, want, hits, total = found(spark, rows), exact([r[:2] for r in rows]), 0, 0
    assert sorted(got) == [q for q, _ in want]
    for q, best in want:
        ids, scores = [i for i, _ in got[q]], [s for _, s in got[q]]
        assert len(set(ids)) == 5 and q not in ids and got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        v = {r[0]: np.array(r[1]) for r in rows if r[0] in {q, *ids}}
        for i, s in got[q]:
            assert s == pytest.approx(v[q] @ v[i] / np.sqrt((v[q] @ v[q]) * (v[i] @ v[i])), abs=1e-14)
        hits, total = hits + len(set(ids) & {i for i, _ in best}), total + 5
        if best[-1][1] > 0.999999:  # copies: all scores tie, so the smallest ids must come
            assert ids == [i for i, _ in best]
    assert hits / total >= 0.95, hits / total


def test_neighbours_query_recall(spark):
    for folder in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
        got = {}
        for r in registry.op11_nearest_neighbours(spark, folder).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        want = exact(rows)
        assert sum(len(got[q] & {i for i, _ in best}) for q, best in want) >= 0.95 * 5 * len(want)


def test_without_stopping_all_are_verified(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "UNIT", 60)
    rows = table(800)
    got = found(spark, rows, confidence=1 - 1e-12)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in exact([r[:2] for r in rows])}


def test_stopping_saves_work():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=(2000, 64)), rng.normal(size=(1, 64)) + rng.normal(size=(200, 64)) * 0.05])
    axes, seen = neighbours.directions(64, 7), []
    tree = neighbours.Tree(np.arange(2200), v, np.ones(2200, int), np.arange(2200), axes)
    hit = neighbours.Found(6)
    add = hit.add
    hit.add = lambda node, *x: (seen.append(len(node)), add(node, *x))
    tree.search(v[2100], v[2100] / neighbours.lengths(v[2100:2101]) @ axes, hit, neighbours.stop_at(0.95, 8))
    assert sum(seen) < 1000 and set(hit.node) <= set(range(2000, 2200))


def test_chi_square():
    draws = (np.random.default_rng(0).normal(size=(200_000, 8)) ** 2).sum(axis=1)
    assert np.mean(draws < neighbours.stop_at(0.95, 8)) == pytest.approx(0.95, abs=0.003)


def test_neighbours_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [3.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 0.0]), (7, [1.0]), (8, [None, 1.0]), (100, [0.0, 0.0]), (9, [2.0**-100, -(2.0**-100)])]
    got = neighbours.nearest(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")).collect()
    of = {}
    for r in got:
        of.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    r2 = round(2**-0.5, 9)
    assert by_text(of[0]) == by_text([(1, 0, 1.0), (2, 1, 1.0), (3, 2, r2), (4, 9, r2), (5, 50, 0.0)] * 2)
    assert of[50] == [(1, 2, r2), (2, 0, 0.0), (3, 0, 0.0), (4, 1, 0.0), (5, 9, -r2)]
    assert set(of) == {0, 50}
    huge = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e-200, 1e-200])], "vec_id long, embedding array<double>")
    assert neighbours.nearest(huge).first().score == pytest.approx(2**-0.5)
    assert neighbours.nearest(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0


# --- fill in the middle


def filled(d, text, markers=("<P>", "<S>", "<M>"), rate=100, spm=50, seed=7):
    t = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    x = hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()
    h = [int(x[k : k + 8], 16) for k in range(0, 32, 8)]
    a, z = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    prefix, middle, suffix = ("".join(lines[i:j]) for i, j in ((0, a), (a, z), (z, None)))
    if not t or any(m in t for m in markers) or h[2] % 100 >= rate:
        return d, len(lines), "plain", None, None, t
    p, s, m = markers
    if h[3] % 100 < spm:
        return d, len(lines), "spm", len(prefix), len(middle), f"{s}{suffix}{p}{prefix}{m}{middle}"
    return d, len(lines), "psm", len(prefix), len(middle), f"{p}{prefix}{s}{suffix}{m}{middle}"


ODD = ["", None, "\n", "\n\n\n", "a", "a\nb", "é\n✓ x\n𝄞𝄞\nend", "has <S> in it\nx", "<P", "P>\n<", "x" * 9000, "\n" * 5000, "é" * 4095 + "\n" + "𝄞\n" * 3000, "a\r\nb\x0bc d\n"]


@pytest.mark.parametrize("block", [1, 2, 7, 4096])
def test_cuts_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(fill_in_middle, "BLOCK", block)
    for i, t in enumerate(ODD):
        tree = fill_in_middle.Fenwick(np.frombuffer((t or "").encode(), np.uint8)) if t else None
        lines = re.findall(r"[^\n]*\n|[^\n]+", t or "")
        for k in range(1, min(len(lines), 40) + 1):
            assert tree.end_of(k) == (len("".join(lines[:k]).encode()), len("".join(lines[:k]))), (i, k)


@pytest.mark.parametrize(("rate", "spm", "markers"), [(100, 50, ("<P>", "<S>", "<M>")), (60, 0, ("<P>", "<S>", "<M>")), (100, 100, ("", "x", ""))])
def test_filled_equals_brute_force(spark, rate, spm, markers):
    rows = [(i, t) for i, t in enumerate(ODD * 4)] + [(3, ODD[6]), (3, ODD[6]), (None, ODD[6]), (-5, ODD[6])]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, output string").repartition(3)
    got = fill_in_middle.filled(df, rate=rate, spm=spm, markers=markers)
    assert by_text(got.collect()) == by_text(filled(d, t, markers, rate, spm) for d, t in rows)
    back = got.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form"), markers)).collect()
    assert by_text(back) == by_text((d, t or "") for d, t in rows)


def test_very_long_text_is_cut(spark):
    df = spark.range(3).select(F.col("id").alias("doc_id"), F.repeat(F.lit("zeile é\n"), 2_000_000).alias("text"))
    got = fill_in_middle.filled(df)
    same = fill_in_middle.restored(F.col("output"), F.col("form")) == F.repeat(F.lit("zeile é\n"), 2_000_000)
    assert [(r.n, r.ok) for r in got.select("n", same.alias("ok")).collect()] == [(2_000_000, True)] * 3
    assert {r.prefix_chars % 8 for r in got.collect()} == {0}


@pytest.mark.parametrize("markers", [("<P>", "<P>", "<M>"), ("<P<", "<S>", "<M>"), ("", "<S>", "<M>"), ("<", "<S>", "<M>")])
def test_markers_that_could_be_mistaken_are_refused(spark, markers):
    with pytest.raises(ValueError):
        fill_in_middle.filled(spark.createDataFrame([(1, "a")], "doc_id long, text string"), markers=markers)


# --- Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], text)))


def tree(digests):
    """The levels of a tree, bottom first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 8
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 8])))
        i //= 8
    return out


def manifest(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda r: (r[0] is None, r[0] or 0, leaf(r, r[4])))
        trees[lang] = own, tree([leaf(r, r[4]) for r in own])
    top, out = tree([trees[x][1][-1][0] for x in langs]), []
    for k, lang in enumerate(langs):
        own, levels = trees[lang]
        for i, r in enumerate(own):
            steps = path(levels, i) + path(top, k)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            fold = leaf(r, r[4].translate(LOWER) if tampered and r[4] is not None else r[4])
            for left, right in steps:
                fold = h(left, fold, right)
            out.append((r[0], levels[0][i], levels[-1][0], top[-1][0], h(*(a + b for a, b in steps)), fold, fold == top[-1][0]))
    return out


def manifested(spark, tmp_path, rows, parts=4):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, place string, `group` int")
    frame.repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op13_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return got.collect()


@pytest.mark.parametrize("broadcast", [True, False])
def test_manifest_equals_brute_force(spark, tmp_path, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(merkle, "NARROW_ROWS", 0)
        monkeypatch.setattr(merkle, "PATH_ROWS", 0)
    rows = [(i * 3, f"s{i % 4}", "de" if i < 70 else "en", i, f"Text {i} É") for i in range(83)]
    rows += [(7, None, None, None, None), (8, "s", None, 0, ""), (None, "s", "en", 1, "A"), (None, "s", "en", 1, "A"), (9, "s", "", 1, "Long " * 50_000), (10, "s", "ünï", 1, "b"), (5, "s", "en", 1, "a"), (5, "s", "en", 1, "b"), (5, "s", "en", 1, "b")]
    rows += [(1000 + i, "s", f"l{i}", 1, "X") for i in range(70)]
    got = manifested(spark, tmp_path, rows)
    assert by_text(got) == by_text(manifest(rows)) and 0 < sum(r.verified for r in got) < len(got)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_manifest_of_one_language(spark, tmp_path, n):
    rows = [(i, "s", "en", i, f"T{i}") for i in range(n)]
    assert by_text(manifested(spark, tmp_path, rows)) == by_text(manifest(rows))


def test_many_equal_rows_are_no_one_partition(spark, tmp_path):
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("A").alias("text"))
    leaves = rows.select(F.lit("=en").alias("group"), F.lit("x").alias("leaf"), F.monotonically_increasing_id().alias("row"))
    placed = merkle.placed(leaves, F.col("leaf"), F.col("row"))
    assert [r.place for r in placed.orderBy("place").collect()] == list(range(20_000))
    assert merkle.manifest(rows).select("root").distinct().count() == 1
