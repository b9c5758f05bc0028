import os

import pytest

import __spark_entry__
import corpus_pipeline
from terrane.llm import _store
from terrane.llm.toxicity import score_toxicity

from .helpers import clashing, empty, odd_docs

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    tmp = _store.Scratch(spark, "test")
    sizes, toxic = [docs.count()], {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = tmp.keep(stage(spark, docs, DATA), name)
        # Line dedup leaves no near copies in this small table, so near_dedup keeps all there; test_odd_tables has it drop some.
        assert out.columns == docs.columns and (out.count() < sizes[-1] or name == "near_dedup")
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "toxicity":
            scored = score_toxicity(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()
            assert ids == {r.doc_id for r in scored if not r.predicted} and len(ids & toxic) < 0.5 * len(toxic)
        sizes.append(out.count())
        docs = out
    packed = tmp.keep(corpus_pipeline.STAGES[-1][1](spark, docs, DATA), "packed")
    assert packed.select("doc_id").distinct().count() == sizes[-1]
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").isEmpty()


def test_odd_tables(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs(spark), clashing(odd_docs(spark)), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    near = corpus_pipeline.near_dedup(spark, odd_docs(spark), str(tmp_path))
    ids = [r.doc_id for r in near.collect()]
    assert 2 not in ids and ids.count(7) == 1 and None in ids and 5 not in ids


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]
