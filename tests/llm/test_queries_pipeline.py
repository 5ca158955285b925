"""The registered queries against SQL, and the pipeline stage by stage."""

import pytest
from oracle import connect, rows
from pyspark.sql import functions as F

import corpus_pipeline
from lodestream.llm import decontamination, ngram_join, registry

SF = "/root/testdata/sf0.001"
CLASHING = ("score", "lang_pred", "held_out", "n_lines", "n_dropped", "n_words", "hits", "items", "spans", "contaminated", "doc", "mark", "node", "_t")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    got = rows(registry.queries()[name](spark, SF).toArrow())
    assert got == rows(connect(SF).sql(registry.oracle_sql()[name]).to_arrow_table())


def test_pipeline_stages(spark):
    start = spark.read.parquet(f"{SF}/documents.parquet")
    docs = start
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == start.columns and 0 < out.count() <= docs.count(), name
        docs = out
    assert ngram_join.near_duplicates(docs).where("component_id <> doc_id").count() == 0
    found = decontamination.find_contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert decontamination.judged(found).where("contaminated").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_pipeline_at_the_edges(spark):
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (3, "12 34", "en", "s", 5), (None, "words and letters here", "en", "s", 22), (4, "the same words in two rows", "en", "s", 26), (4, "the same words in two rows", "en", "s", 26)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit("own"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.select(*CLASHING).distinct().count() <= 1
        assert all(r == ("own",) * len(CLASHING) for r in map(tuple, out.select(*CLASHING).collect()))
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.join_ngrams(spark, docs, SF).where("doc_id = 4").count() == 1
