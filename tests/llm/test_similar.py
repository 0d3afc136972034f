"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

from __future__ import annotations

import random
import re

import pytest
from llm import brute

import corpus_pipeline
from fieldmark.llm import common, similar

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
STAGE = corpus_pipeline.STAGES[1][1]


def word_sets(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(brute.LOWER))
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    return sets


def similarity(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def kept(rows):
    """The (doc_id, text) that stay: the smallest of each component of five-word Jaccard >= 0.8."""
    sets, of = word_sets(rows), list(range(len(rows)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y) and x:
                of[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r), r, key=lambda r: brute.key(r[0]))
    return sorted(least.values(), key=repr)


def edited(words, n, rng):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize(("big", "leaders"), [(16, 3), (2, 1)])
def test_large_groups_equal_brute_force(spark, monkeypatch, big, leaders):
    """Groups of close copies, whose links no fingerprint misses."""
    monkeypatch.setattr(similar, "BIG", big)
    monkeypatch.setattr(similar, "LEADERS", leaders)
    rng = random.Random(7)
    texts = [None, "", " \t", "One two", "one  TWO", "one two three"]
    for g in range(30):  # pairs well on either side of 0.8
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(100, 300))]
        texts += [" ".join(words), edited(words, 1 if g % 2 else len(words) // 20, rng)]
    base = [f"b{i}" for i in range(200)]
    texts += [edited(base, rng.randrange(3), rng) for _ in range(60)]  # one large group
    line = " ".join(f"line{i}" for i in range(12))  # one line that many short texts hold
    texts += [f"{line} {' '.join(f't{rng.random()}' for _ in range(rng.randrange(6, 12)))}" for _ in range(60)]
    rows = list(enumerate(texts)) + [(None, "no id at all in this row"), (None, "")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS).repartition(5)
    got = STAGE(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == kept(rows)


def test_recall_and_precision_at_the_similarity(spark):
    rng = random.Random(1)
    rows = []
    for g in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, edited(words, rng.randrange(2, 7), rng))]  # Jaccard about 0.72 to 0.91
    sets = word_sets(rows)
    near = [similarity(*sets[i : i + 2]) for i in range(0, len(rows), 2)]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS)
    of = {r.rk_id: r["class"] for r in similar.classes(docs).collect()}
    linked = [of[2 * g] == of[2 * g + 1] for g in range(150)]
    assert not any(x for x, s in zip(linked, near, strict=True) if s < 0.8)
    true = [x for x, s in zip(linked, near, strict=True) if s >= 0.8]
    assert len(true) > 60 and sum(true) / len(true) >= 0.9
    assert len(set(of.values())) == len(rows) - sum(linked)


def test_empty_table(spark):
    assert STAGE(spark, spark.createDataFrame([], DOCS), "").collect() == []


def test_bound_by_own_shingles_loses_no_pair():
    """Random sets around one base: a pair of the similarity is never ruled out, and pairs of many own shingles are."""
    rng = random.Random(3)
    sets = []
    for g in range(60):
        base = set(range(100)) - set(rng.sample(range(100), rng.randrange(12)))
        sets.append(base | {1000 * (g + 1) + i for i in range(rng.randrange(25))})
    own = [len(s - set().union(*(x for x in sets if x is not s))) for s in sets]
    ruled_out = 0
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            common = min(len(x) - own[i], len(y) - own[j])
            if common < (len(x) + len(y) - common) * 0.8 - 1e-6:
                ruled_out += 1
                assert similarity(x, y) < 0.8
    assert ruled_out > 100


def test_coordinates_of_many_pivots_tell_parts_apart():
    """Equal bits have equal coordinates; 20 pivots leave fewer chance equals than 10."""
    import numpy as np

    from fieldmark.llm.simhash import part_coordinates, part_masks

    fps = np.random.default_rng(5).integers(0, 2**63, 60_000, np.uint64)
    masks = part_masks(similar.SPARED, similar.BLOCKS)[:2]
    few, many = (len(fps) - len(np.unique(part_coordinates(fps, masks, n)[:, 0])) for n in (10, similar.PIVOTS))
    real = len(fps) - len(np.unique(fps & masks[0]))
    assert real <= many <= real + 2 and many * 4 < few
    same = part_coordinates(np.array([fps[0], fps[0] ^ ~masks[0]]), masks, similar.PIVOTS)
    assert same[0, 0] == same[1, 0]


def test_a_text_without_a_count_bounds_nothing(spark):
    rows = [((100, None), (100, 90)), ((100, 90), (100, None)), ((100, 90), (100, 0)), ((100, 5), (100, 5))]
    df = spark.createDataFrame(rows, "a struct<n: long, own: long>, b struct<n: long, own: long>")
    assert [r[0] for r in df.select(similar.reachable("a", "b", 0.8)).collect()] == [True, True, False, True]


def test_a_group_below_the_similarity_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Classes of hashes rule out most pairs of a large group of near copies, and the links stay the same."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    texts = [edited(base, rng.randrange(2, 5), rng) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS).repartition(3)
    monkeypatch.setattr(similar, "BIG", 2)
    verified, found, compared = similar.verified, {}, {}
    for n in (1, similar.CLASSES):
        compared[n] = []
        monkeypatch.setattr(similar, "CLASSES", n)
        monkeypatch.setattr(similar, "verified", lambda pairs, *a, n=n: (compared[n].append(pairs.count()), verified(pairs, *a))[1])
        found[n] = {r.rk_id: r["class"] for r in similar.classes(docs).collect()}
    least = [{c: min(i for i in of if of[i] == c) for c in set(of.values())} for of in found.values()]
    assert [[x[of[i]] for i in range(120)] for x, of in zip(least, found.values(), strict=True)].count([least[0][found[1][i]] for i in range(120)]) == 2
    assert compared[1][0] == compared[64][0] and compared[64][1] * 5 < compared[1][1], compared


def test_bound_by_classes_loses_no_pair(spark):
    """Numbers by class of random sets around one base: no pair of the similarity is ruled out, most others are; a null rules out nothing."""
    rng = random.Random(4)
    sets = [set(range(100)) - set(rng.sample(range(100), rng.randrange(3, 30))) for _ in range(40)]
    held = [[len([x for x in s if x % 50 == c]) for c in range(50)] for s in sets]
    rows = [((len(x), held[i]), (len(sets[j]), held[j]), similarity(x, sets[j])) for i, x in enumerate(sets) for j in range(i)]
    df = spark.createDataFrame([*rows, ((9, None), (9, held[0]), 0.0)], "a struct<n: long, held: array<int>>, b struct<n: long, held: array<int>>, j double")
    got = df.select(similar.meeting("a", "b", 0.8).alias("ok"), "j").collect()
    assert got[-1].ok and all(r.ok for r in got if r.j >= 0.8)
    below = [r.ok for r in got[:-1] if r.j < 0.8]
    assert len(below) > 50 and sum(below) < 0.7 * len(below)


def test_rows_by_key_are_made_once_and_not_for_pairs(spark, monkeypatch):
    """What two texts share makes no rows by key, and a large group of one component makes them for the leaders' keys alone."""
    from fieldmark.llm import simhash

    made, join = [], similar.split_join

    def counting(rows, table, keys, *a, **k):
        found = join(rows, table, keys, *a, **k)
        if keys == ["key"]:
            made.append(found.count())
        return found

    monkeypatch.setattr(similar, "split_join", counting)
    monkeypatch.setattr(simhash, "split_join", counting)
    rng = random.Random(13)
    twos = [[f"w{rng.randrange(10**6)}" for _ in range(300)] for _ in range(40)]
    one = [f"b{i}" for i in range(400)]
    for texts, most, kinds in (
        ([t for w in twos for t in (" ".join(w), edited(w, 1, rng))], 0, 40),
        ([edited(one, 1, rng) for _ in range(80)], 80 * 160 // similar.LED * 2.5, 1),
    ):
        made.clear()
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS).repartition(3)
        assert len({r["class"] for r in similar.classes(docs).collect()}) == kinds
        assert sum(made) <= most, made


def test_any_component_of_a_key_may_stand_inside(spark, monkeypatch):
    """Two large groups and texts between them: links are the same whatever component a key's least node is in."""
    monkeypatch.setattr(similar, "BIG", 2)
    monkeypatch.setattr(similar, "TRIED", 1)
    rng = random.Random(17)
    base = [f"b{i}" for i in range(200)]
    other = edited(base, 5, rng).split()
    rows = list(enumerate([edited(x, n, rng) for x, n, k in ((base, 1, 30), (other, 1, 25), (base, 4, 40)) for _ in range(k)]))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS).repartition(4)
    assert sorted((r.doc_id, r.text) for r in STAGE(spark, docs, "").collect()) == kept(rows)


def plans_of(monkeypatch, *modules):
    """The plans of what ``modules`` write, as they are written."""
    plans = []
    for module in modules:
        monkeypatch.setattr(module, "stage", lambda df, name, f=module.stage: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or f(df, name))
    return plans


def test_small_rounds_of_components_broadcast_nothing(spark, monkeypatch):
    """A round in one task has neither a join nor a broadcast, which the driver would hold, and gives what a shuffled one gives."""
    rng = random.Random(19)
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(50)]
    given = spark.createDataFrame(edges, "a long, b long").repartition(3)
    plans = plans_of(monkeypatch, common)
    found = sorted(common.components(given).collect())
    assert len(plans) > 2 and not [name for name, plan in plans if "Join" in plan or "Broadcast" in plan]
    monkeypatch.setattr(common, "NARROW_ROWS", 0)
    assert found == sorted(common.components(given).collect())


def test_no_plan_of_the_stage_holds_all_pairs(spark, monkeypatch):
    """Each kind of pairs is planned by itself, and the roots of texts are broadcast once."""
    rng = random.Random(23)
    base = [f"b{i}" for i in range(200)]
    texts = [edited(base, n, rng) for n in (1, 4) for _ in range(25)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS).repartition(3)
    plans = plans_of(monkeypatch, common, similar)
    similar.classes(docs).count()
    most, broadcast = max(plan.count("Join") for _, plan in plans), sum(plan.count("BroadcastExchange") for _, plan in plans)
    assert most <= 6 and broadcast <= 50, (most, broadcast)
