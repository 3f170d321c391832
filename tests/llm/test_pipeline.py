"""The stages, one by one, each on what its predecessor kept."""

import pytest

import corpus_pipeline
from postmill.llm import decontamination, quality, simhash


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), before.schema)
        assert docs.columns == columns
        kept[name] = (before, docs)
    before, after = kept["quality classifier"]
    model = quality.train(before, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in quality.score(before, model).filter("score >= 0.3").collect()}
    assert {r.doc_id for r in after.collect()} == good
    before, after = kept["simhash near-dedup"]
    groups = simhash.text_components(before.select("doc_id", "text")).collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in groups if r.stays)
    assert len(after.collect()) == len({r.root for r in groups})
    _, after = kept["benchmark decontamination"]
    found = decontamination.contamination(after, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert not found.filter("size(spans) > 0").count()
    before, after = kept["mixing to target weights"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    rows = corpus_pipeline.STAGES[-1][1](spark, after, sf).collect()
    assert len(rows) == after.count() and {r.shard for r in rows} == set(range(16))


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_shards_hold_the_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.STAGES[-1][1](spark, docs.unionAll(docs), sf)
    assert out.columns == [*docs.columns, "shard", "slot"]
    assert sorted(r.text for r in out.collect()) == sorted([r.text for r in docs.collect()] * 2)


@pytest.fixture(scope="module")
def messy(spark, sf):
    """Whole documents with nulls in every column, equal rows, ids that repeat, blank texts and columns of clashing names."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    own = [(None, None, None, None, None), (1, None, "en", "a", None), (1, "", "en", None, 0), (2, " ", None, "a", 1), (3, "only a few words", "en", None, 16), (3, "only a few words", "en", None, 16)]
    rows = docs.unionAll(spark.createDataFrame(own, docs.schema)).unionAll(docs.limit(20)).unionAll(docs.limit(3).selectExpr("cast(null as long)", "text", "lang", "source", "n_chars"))
    return rows.selectExpr("*", "'x' as __row", "1 as fp", "'y' as score", "'z' as root").repartition(3)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_messy_and_empty_tables(spark, sf, messy, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, messy, sf)
    more = ["shard", "slot"] if k == 4 else []
    assert out.columns == [*messy.columns, *more]
    rows = out.collect()
    assert all(r["__row"] == "x" and r.fp == 1 and r.score == "y" and r.root == "z" for r in rows)
    ids, n = {r.doc_id for r in messy.collect()}, messy.count()
    assert rows and {r.doc_id for r in rows} <= ids
    if k == 1:
        assert len(rows) < n and len({(r.doc_id, r.text) for r in rows}) == len(rows)
    if k == 4:
        assert len(rows) == n and sorted(r.slot for r in rows if r.shard == 0) == list(range(sum(r.shard == 0 for r in rows)))
    nothing = stage(spark, messy.limit(0), sf)
    assert nothing.columns == out.columns and nothing.count() == 0
