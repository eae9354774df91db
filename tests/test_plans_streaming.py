"""Plan shape checks and the streaming prompt counter."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from quill.operators import prepare as P
from quill.sources import io
from quill.streaming.prompt_counts import run_prompt_counts
from tests.conftest import SF_SMALL

HEAVY = {"model_report", "generate_greedy", "generate_greedy_ruled", "generate_warped", "generate_text",
         "generated_no_repeat", "synthetic_table", "generated_ppl", "csv_roundtrip", "run_metrics", "synthetic_rows"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


#: Queries of the user's own batched functions (X1, X2): the one place for Python.
PYTHON = {"map_batches", "map_batches_args"}
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas",
                "FlatMapGroupsInArrow", "FlatMapCoGroupsInPandas", "FlatMapCoGroupsInArrow")


@pytest.mark.parametrize("name", sorted(set(E._NAMES) - HEAVY))
def test_no_cartesian_or_python_udf(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    found = [node for node in PYTHON_NODES if node in plan]
    assert bool(found) == (name in PYTHON), found


def test_scan_pushes_filter_and_prunes(spark):
    plan = _plan(E.queries()["scan_corpus"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src3)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in plan


def test_streaming_prompt_counts_equal_batch(spark, tmp_path):
    src = str(tmp_path / "rows")
    docs = io.table(spark, SF_SMALL, "documents").select(F.col("lang").alias("label_lang"),
                                                           F.col("source").alias("label_source"))
    docs.repartition(3).write.parquet(src)
    run_prompt_counts(spark, src, docs.schema, ["label_lang", "label_source"], str(tmp_path / "out"),
                      str(tmp_path / "ckpt"))
    got = {r.prompt: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.prompt: r.n for r in P.prompt_counts(docs).collect()}
    assert got == want


def test_synthesis_chain_fills_quotas_exactly(spark):
    from quill.plans import catalog as C
    from quill.plans.synthesis import label_quotas

    out = C.synthetic_table(spark, SF_SMALL)
    code = F.concat_ws("\t", "lang", "source").alias("label")
    q = {r.label: r.quota for r in label_quotas(C.docs(spark, SF_SMALL).select(code), "label", 600).collect()}
    per = {r.label: r["count"] for r in out.groupBy(F.concat_ws("\t", "label_lang", "label_source").alias("label")).count().collect()}
    assert per == q
    assert out.where(F.length("text") == 0).count() == 0
    keys = sorted(r.shuffle_key for r in out.collect())
    assert keys == list(range(1, len(keys) + 1))
