"""Plan shapes, and every query beside its SQL on the smallest tables."""

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

ORACLE = oracle_sql()
PYTHON_STAGES = {"rewrite_with", "vector_dedup"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, small, con, name):
    df = queries()[name](spark, small)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON_STAGES:
        assert "EvalPython" not in plan and "InPandas" not in plan
    if name in ORACLE:
        assert differences(df, con, ORACLE[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_totals_shuffle_measures_not_texts(spark, small):
    """One scan of the needed columns; what is shuffled by key holds no text."""
    from textlots.operators import costs
    from textlots.packs import REVIEWS
    from textlots.plans import inputs, lots

    plan = plan_of(costs.lot_core(costs.lot_totals(lots.analyze(lots.ingest(inputs.feedback(spark, small)), REVIEWS))))
    assert plan.count("FileScan") == 1 and "n_chars" not in plan
    after_scan = plan.split("SortAggregate")[1]
    assert "text#" not in after_scan.split("min(struct(")[1].split(")")[0].replace("text_optimized", "")


def test_classification_does_not_shuffle(spark, small):
    from textlots.operators.classify import classify
    from textlots.packs import REVIEWS

    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = plan_of(classify(docs.select("doc_id", "text"), REVIEWS).select("doc_id", "classification"))
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_stage_counts_scan_once(spark, small):
    plan = plan_of(queries()["stage_counts"](spark, small))
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_a_large_file_is_dealt_to_more_tasks(spark, tmp_path, monkeypatch):
    from textlots.plans import inputs

    path = str(tmp_path / "one.parquet")
    spark.range(100_000).coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    assert inputs.spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(inputs, "TASK_BYTES", 10_000)
    assert inputs.spread(rows).rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    assert inputs.spread(rows).count() == 100_000
