"""The stages on the smallest table, each against what its operator promises."""

import os

import pytest

import corpus_pipeline
from tideglass.llm import packing, simhash

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_feed_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        if name == "packing":
            assert out.select("sequence_id", "offset").distinct().count() == out.count()
            assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
            break
        assert out.columns == columns
        if name != "mixing":
            assert out.count() <= docs.count()
        if name == "near_dedup":
            groups = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
            assert {r.doc_id for r in out.collect()} == {k for k, g in groups.items() if k == g}
        before, docs = docs, out
    assert before is not None
    assert packing.pack_documents(docs).count() == out.count()


ROWS = [(1, "The first one of them is here and it is good for all. " * 9, "en", "a", 1), (2, None, "en", None, 1), (3, "", None, "a", 1), (None, "null id text of some words that are read by the one who comes", "en", "b", 1), (4, "x " * 5000, "en", "a", 1)]


def test_stages_on_odd_rows_and_on_none(spark):
    """Null and empty texts, null ids and sources, a row that stands twice, a column of a helper's name, and no rows at all."""
    table = spark.createDataFrame(ROWS + ROWS[:1], "doc_id long, text string, lang string, source string, sift_at int")
    for docs in (table, table.limit(0)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
            if name == "packing":
                assert out.select("sequence_id", "offset").distinct().count() == out.count() and (out.count() > 0) == (docs.count() > 0)
                break
            assert out.columns == docs.columns
            if name == "near_dedup":
                assert out.groupBy("doc_id", "text").count().where("count > 1").isEmpty()
            docs = out
        assert n in (0, 6)


def test_stages_hand_texts_to_python_in_small_batches(spark):
    """A stage leaves batches of at most BATCH rows, and lower ones alone; the whole pipeline leaves the session as it was."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    docs = spark.createDataFrame([(k, "some words of a text " * 9, "en", "a", 1) for k in range(2500)], "doc_id long, text string, lang string, source string, n_chars int").coalesce(1)
    try:
        for stage in (corpus_pipeline.quality_stage, corpus_pipeline.near_stage, corpus_pipeline.pack_stage):
            spark.conf.set(setting, before)
            stage(spark, docs, SF)
            sizes = docs.mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), docs.schema).count()
            assert int(spark.conf.get(setting)) == corpus_pipeline.BATCH and sizes == 3
            spark.conf.set(setting, 7)
            stage(spark, docs.limit(3), SF)
            assert int(spark.conf.get(setting)) == 7
        if os.path.isdir(SF):
            spark.conf.set(setting, 5000)
            assert corpus_pipeline.run(spark, SF).count() and int(spark.conf.get(setting)) == 5000
    finally:
        spark.conf.set(setting, before)
