"""The pipeline's stages, each on its own input, and the whole against its parts."""

from pyspark.sql import functions as F

import corpus_pipeline
from matchflow.llm import stages
from matchflow.llm.common import DOCUMENT_COLUMNS


def test_stages_take_odd_rows(spark, odd, empty, sf_dir):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == list(DOCUMENT_COLUMNS), name
        docs = stages.written(out)
        assert stage(spark, empty, sf_dir).count() == 0, name
    left = {r.doc_id: r.text for r in docs.collect()}
    assert docs.filter("doc_id = 5").count() == 0 and left[1].startswith("The quick")
    assert left[None] == "a row without an id [SECRET] in it"
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()}
    assert last[1].text == left[1] and last[1].n_tokens == len(last[1].ids)


def test_the_pipeline_drops_what_its_stages_find(spark, sf_dir):
    from matchflow.llm.queries import op2_decontamination, op4_toxicity, op9_simhash

    got = {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()}
    documents = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    toxic = {r.doc_id for r in op4_toxicity(spark, sf_dir).filter("predicted = 1").collect()}
    leaks = {r.doc_id for r in op2_decontamination(spark, sf_dir).select("doc_id").distinct().collect()}
    groups = op9_simhash(spark, sf_dir).filter(~F.col("doc_id").isin(*toxic) if toxic else F.lit(True)).groupBy("component_id").agg(F.min("doc_id").alias("least")).collect()
    assert got == {r.least for r in groups} - leaks
    assert got <= documents
