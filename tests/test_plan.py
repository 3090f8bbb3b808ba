"""Plan-shape guards: the properties the large-scale design relies on."""

from conftest import SF_SMALL
from mailrisk.plans import catalog as CAT


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def static_plan(spark, fn):
    prev = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return physical(fn())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", prev)


def test_analysis_is_a_projection(spark):
    plan = static_plan(spark, lambda: CAT.analysis(spark, SF_SMALL))
    assert sum("FileScan" in l and "text" in l for l in plan.split("\n")) == 1   # the documents are scanned once
    for step in ("Exchange hashpartitioning", "Exchange rangepartitioning", "Aggregate", "Sort", "Generate", "Window"):
        assert not any(step in l.split("[")[0].split("(")[0] for l in plan.split("\n")), (step, plan)
    assert "from_json" not in plan                    # the weights are one folded literal


def test_join_form_has_one_exchange(spark):
    from mailrisk import fixtures as FX
    from mailrisk.operators import text_model as M
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    plan = static_plan(spark, lambda: M.score_by_join(docs, FX.model_terms(spark), 0.0))
    hash_ex = [l for l in plan.split("\n") if "Exchange hashpartitioning" in l and "_eid" in l]
    assert len(hash_ex) == 1, plan                    # about one row an email, after partial aggregation
    assert "BroadcastHashJoin [term" in plan          # model terms joined by broadcast
    assert "Window" not in plan


def test_corpus_positions_are_spread(spark):
    from mailrisk.operators import corpus as C
    prev = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table = C.corpus_table(CAT.canon(spark, SF_SMALL))
        sizes = [r["count"] for r in table.groupBy(CAT.F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", prev)
    assert len(sizes) >= 4 and max(sizes) <= 0.4 * sum(sizes)


def test_dedup_neither_sorts_nor_groups_bodies(spark):
    plan = static_plan(spark, lambda: CAT.q_dedup(spark, SF_SMALL))
    for line in plan.split("\n"):
        if "SortAggregate" in line or "HashAggregate" in line:
            assert "body" not in line.split("functions=")[0], line


def test_history_reports_prune_and_push_down(spark, tmp_path):
    import datetime as dt
    path = str(tmp_path / "hist")
    spark.createDataFrame([("i", "a@b.c", "SPAM", dt.datetime(2024, 1, 1), "long body")],
                          "id string, sender string, classification string, created_at timestamp, body string") \
        .write.parquet(path)
    h = spark.read.parquet(path)
    scan = [l for l in static_plan(spark, lambda: CAT.H.domain_breakdown(h)).split("\n") if "FileScan" in l][0]
    assert "body" not in scan and "ReadSchema" in scan
    scan = [l for l in static_plan(spark, lambda: CAT.H.history_by_class(h, "SPAM").select("id")).split("\n")
            if "FileScan" in l][0]
    assert "EqualTo(classification,SPAM)" in scan and "body" not in scan
