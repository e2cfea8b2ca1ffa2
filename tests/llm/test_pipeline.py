"""The pipeline's stages: columns, order and effect."""

import os

import corpus_pipeline
import pytest

from vicinity.llm import quality_classifier, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    columns, rows = docs.columns, docs.count()
    model = quality_classifier.score(docs, queries.quality_model(spark, SF))
    rejected = {r.doc_id for r in model.where("predicted = 0").collect()}
    seen = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == columns
        if k == 0:
            assert {r.doc_id for r in seen.collect()} - {r.doc_id for r in out.collect()} == rejected
        if k == 2:
            assert out.count() == seen.count()
        assert out.count() <= rows
        seen = out
    assert {"doc_id", "taken", "target"} <= set(seen.columns)
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, again.collect())) == sorted(map(str, seen.collect()))


def test_stages_take_odd_rows(spark):
    schema = queries.table(spark, SF, "documents").schema
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", None, 0), (2, "words " * 500, "en", "s", None), (2, "words " * 500, "en", "s", None), (2, "other", "en", "s", None)], schema)
    for rows in (odd, odd.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, SF).count() <= rows.count()


def test_rows_without_or_with_shared_ids_are_decided_one_by_one(spark):
    schema = queries.table(spark, SF, "documents").schema
    item = max((r.text for r in queries.table(spark, SF, "benchmark").collect()), key=len)
    clean = [" ".join(f"{w}{i * 37 % 101}" for i in range(80)) for w in ("alpha", "beta", "gamma")]
    row = lambda i, t: (i, t, "en", "s", len(t))
    leaky = spark.createDataFrame([row(None, item), row(None, clean[0]), row(7, item), row(7, clean[1])], schema)
    assert sorted(r.text for r in corpus_pipeline.decontaminate(spark, leaky, SF).collect()) == sorted(clean[:2])
    copies = spark.createDataFrame([row(None, clean[0]), row(None, clean[0]), row(None, clean[1]), row(5, clean[1]), row(7, clean[2]), row(6, clean[2]), row(6, item), row(9, item)], schema)
    got = corpus_pipeline.drop_near_duplicates(spark, copies, SF)
    assert got.columns == copies.columns
    assert sorted((r.doc_id or -1, r.text) for r in got.collect()) == sorted([(-1, clean[0]), (5, clean[1]), (6, clean[2]), (6, item)])
