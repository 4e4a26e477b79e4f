"""The pipeline stage by stage, the registered queries, and the oracles that SQL can state."""

import corpus_pipeline
import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from tickloom.llm import queries as Q
from tickloom.llm.common import stored

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, FOLDER), name)
        assert after.columns == docs.columns
        assert 0 < after.count() <= docs.count()
        assert after.select("doc_id").distinct().count() == after.count()
        if name == "personal_data":
            assert after.count() == docs.count() and after.join(docs, ["doc_id", "text"], "left_anti").count() > 0
        docs = after
    pieces = corpus_pipeline.run(spark, FOLDER)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_all_queries_are_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if k.startswith("op")} and "pipeline" in names
    assert set(Q.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracles(spark, name):
    assert compare(Q.QUERIES[name](spark, FOLDER).toPandas(), connect(FOLDER).execute(Q.ORACLES[name]).df()) == ""
