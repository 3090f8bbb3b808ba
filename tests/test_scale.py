"""Properties that keep the work of a query in proportion to its input."""

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from mailrisk.functions import regex as RX
from mailrisk.functions import signals as L
from mailrisk.functions import text as TX
from mailrisk.plans import catalog as CAT


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_signal_summary_writes_the_rules_out_once(spark):
    plan = optimized(CAT.q_signal_summary(spark, SF_SMALL))
    assert plan.count("https?://[") == 1, plan.count("https?://[")
    assert not any("Filter" in l and "size(" in l for l in plan.split("\n"))


def test_history_tests_the_error_on_the_finished_row(spark):
    plan = optimized(CAT.history(spark, SF_SMALL))
    below = plan[plan.index("Repartition"):]
    assert "https?://" not in below                   # nothing of the rules runs in the tasks of the scan
    assert plan.count("https?://[") == 1


def test_rules_are_tried_only_where_a_word_can_begin():
    assert RX.java_words(["urgent", "expires?"]).startswith("(?diu)(?=[eu])")
    for words in ([r"\d+ days"], ["a?bc"], ["x", "[yz]"]):
        assert "(?=" not in RX.java_words(words)


def test_fold_pattern_rules_ascii_out_first(spark):
    assert TX.NEEDS_PYTHON_FOLD.startswith(r"[[^\x{0}-\x{7f}]&&")
    texts = ["café  au\tlait ", " é", "é ", "a  b", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(TX.fold_case_accents("t")).collect()] == ["cafe  au\tlait ", " e", "e ", "a  b", "", None]


@pytest.mark.parametrize("text, wanted", [
    ("A" * 8 + "1" * 90 + "a" * 12, True),            # few letters at the beginning
    ("A" * 7 + "a" * 13, False), ("a" * 300 + "A" * 170, True), ("A" * 170 + "a" * 300, True), ("A" * 100 + "a" * 200, False), ("", False), (None, None)])
def test_capitals_with_few_letters_counted(spark, text, wanted):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(L.capitals("t")).first()[0] is wanted


def test_micro_batches_have_files_for_every_core(spark):
    from mailrisk.sources import paths
    from mailrisk.sources import table_log as LOG
    hist = CAT.stream_history(spark, SF_SMALL, n_files=2)
    segments = LOG.TableLog(spark, hist).snapshot().segments
    assert len(segments) == 2                         # still two micro-batches
    cores = spark.sparkContext.defaultParallelism
    for s in segments:
        files = [f for f in paths.files(spark, f"{hist}/data/{s}") if f.endswith(".parquet")]
        assert len(files) > min(1, cores - 1)


def test_dedup_input_runs_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    rows = [(0, i, "s", f"b{i % 7}", "x") for i in range(20)]
    df = spark.createDataFrame(rows, "src_ord int, row_idx long, subject string, body string, sender string")
    table = CAT.C.dense_index(CAT.C.dedup_keep_first(df.mapInArrow(look, df.schema)))
    assert sorted(r.row_idx for r in table.collect()) == list(range(7))
    assert calls.value == 20


def test_even_scans_are_not_moved(spark, tmp_path):
    from mailrisk import fixtures as FX
    for name in ("labels", "events"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs, cores = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 30)   # a task a file
    try:
        docs.repartition(2 * cores).write.parquet(f"{tmp_path}/documents.parquet")
        even = FX.emails(spark, str(tmp_path))
        assert "Repartition" not in optimized(even) and "Repartition" in optimized(FX.emails(spark, SF_SMALL))
        assert even.exceptAll(FX.emails(spark, SF_SMALL)).count() == 0 and even.count() == docs.count()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_indexed_history_is_laid_out_from_stored_rows(spark):
    from mailrisk.sources import table_log as LOG
    log = LOG.TableLog(spark, CAT.indexed_history(spark, SF_SMALL))
    assert [log.change(v).operation for v in range(1, log.latest() + 1)] == ["append", "compact"]
