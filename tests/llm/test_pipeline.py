"""The pipeline against its brute-force version, its stages on awkward tables, and the queries with SQL twins."""

from __future__ import annotations

import numpy as np
import pytest
from compare import connection, differences
from llm import brute
from llm.test_similar import kept as one_of_each

import corpus_pipeline
from fieldmark.llm import quality, registry

DATA = "/root/testdata/sf0.001"
#: Names that the operators use for columns of their own.
CLASHES = ["spans", "whole", "cut", "rk_id", "rk_text", "row", "score", "predicted", "open", "once", "z", "key", "class", "words", "bucket", "tokens", "times", "h", "win"]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    assert differences(registry.queries()[name](spark, DATA), registry.oracle_sql()[name], connection(DATA)) == ""


def test_pipeline_equals_brute_force(spark):
    got = {r.doc_id: (r.text, r.n_epochs) for r in corpus_pipeline.run(spark, DATA).collect()}
    docs = registry.table(spark, DATA, "documents")
    model = quality.fit(docs, registry.table(spark, DATA, "labels"))
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.orderBy("doc_id").collect()]
    scores = model.scores(np.array([quality.terms_of((r[1] or "").encode()) for r in rows]), quality.NEIGHBOURS)
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD]
    # candidates come from fingerprints, so a pair near 0.8 may be missed; nothing below 0.8 is ever linked
    exact = {d for d, _ in one_of_each([r[:2] for r in rows])}
    good = corpus_pipeline.quality_classifier(spark, docs, DATA)
    assert {r.doc_id for r in good.select("doc_id").collect()} == {r[0] for r in rows}
    stay = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, good, DATA).select("doc_id").collect()}
    assert exact <= stay and len(stay - exact) <= 0.02 * len(rows)
    rows = [r for r in rows if r[0] in stay]
    kept = {d: k.decode("utf-8", "ignore") for d, _, _, _, k in brute.repeats([r[:2] for r in rows])}
    rows = [(d, kept[d], lang, source) for d, _, lang, source in rows]
    bench = [(r.item_id, r.text) for r in registry.table(spark, DATA, "benchmark").collect()]
    hit = {d for d, _, n, _ in brute.contamination([r[:2] for r in rows], bench) if n}
    rows = [r for r in rows if r[0] not in hit]
    want = brute.mix(rows, registry.MIX_SHARE, registry.MIX_EPOCHS, registry.MIX_WEIGHTS, registry.MIX_SEED)
    assert got == {rows[k][0]: (rows[k][1], n) for k, n in want.items()}
    assert len(got) > 20


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_keep_columns_whatever_their_names(spark, name, stage):
    docs = registry.table(spark, DATA, "documents")
    extra = docs.selectExpr("*", *[f"concat('{c} ', doc_id) AS {c}" for c in CLASHES])
    plain = sorted((r.doc_id, r.text) for r in stage(spark, docs, DATA).collect())
    found = stage(spark, extra, DATA)
    assert found.columns[: len(extra.columns)] == extra.columns
    rows = found.collect()
    assert sorted((r.doc_id, r.text) for r in rows) == plain and len(plain) > 5
    assert all(r[c] == f"{c} {r.doc_id}" for r in rows for c in CLASHES)
    if stage is not corpus_pipeline.mix_sources:
        assert found.columns == extra.columns


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_empty_tables_nulls_and_repeated_rows(spark, name, stage):
    docs = registry.table(spark, DATA, "documents")
    assert stage(spark, docs.limit(0), DATA).count() == 0
    odd = [(1, None, None, None, None), (None, "a text without any id " * 30, "en", "src1", 9), (None, None, None, None, None), (3, "", "de", None, 0), *[(4, "a repeated row " * 40, None, "src2", 600)] * 2, (5, "x" * 300_000, "en", "src1", 300_000)]
    got = stage(spark, spark.createDataFrame(odd, docs.schema).repartition(3), DATA)
    assert got.columns[: len(docs.columns)] == docs.columns and got.count() <= len(odd)
    everything = stage(spark, docs.unionByName(docs), DATA)
    once = stage(spark, docs, DATA)
    if stage is corpus_pipeline.simhash_near_dedup:
        assert everything.count() == once.count()
    if stage in (corpus_pipeline.quality_classifier, corpus_pipeline.benchmark_decontamination):
        assert everything.count() == 2 * once.count()
    if stage is corpus_pipeline.suffix_array_dedup:  # every string of 200 bytes now stands twice
        assert everything.where("octet_length(text) >= 200").count() == 0


def test_last_stage_replaces_names_of_its_own(spark):
    docs = registry.table(spark, DATA, "documents").selectExpr("*", "'given' AS n_epochs", "'given' AS leaf_lang")
    got = corpus_pipeline.mix_sources(spark, docs, DATA)
    assert got.columns.count("n_epochs") == 1 and got.where("leaf_lang = 'given'").count() == 0 and got.count() > 0
