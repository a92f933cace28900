import os

import pytest

import corpus_pipeline
from quillgrid.llm import bpe
from quillgrid.llm import queries as q
from tests.llm import edges

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF) or not os.path.exists(bpe.file_of(q.TOKENIZER)), reason="no tables")


def test_stages_agree_with_the_operators(spark, tmp_path):
    """Each stage beside a plain reading of its operator's own results, on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        if name != "tokens":
            assert out.columns == docs.columns
        if name == "toxicity":
            model = q.toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(after) == {r.doc_id for r in q.toxicity.score(docs, model).collect() if not r.predicted}
        elif name == "near_duplicates":
            assert set(after) == {r.component_id for r in q.sh.near_duplicates(docs).collect()}
        elif name == "repeated_strings":
            kept = {r.doc_id: r.kept_text for r in q.suffix_dedup.remove_repeats(docs).collect()}
            assert {i: r.text for i, r in after.items()} == kept and all(r.n_chars == len(r.text) for r in after.values())
        elif name == "benchmark":
            found = q.dc.decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
            assert set(after) == {r.doc_id for r in found if not r.contaminated}
        else:
            assert set(after) == set(before)
        docs = out
    assert 0 < len(after) and corpus_pipeline.run(spark, SF).count() == len(after)


def test_stages_take_hard_rows(spark):
    docs = edges.table(spark)
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            assert stage(spark, table, SF).count() <= len(edges.ROWS), name
