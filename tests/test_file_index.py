"""Indexed lookups equal full scans and open fewer files."""

import datetime as dt

import pytest

from mailrisk import schema as SC
from mailrisk.operators import history as H
from mailrisk.sources import corpus_io as CIO
from mailrisk.sources import history_io as HIO
from mailrisk.sources import table_log as L


def records(spark, rows):
    """HISTORY rows from (id, minutes or None, body)."""
    day = dt.datetime(2024, 1, 1)
    at = {f.name: i for i, f in enumerate(SC.HISTORY)}
    out = []
    for key, minutes, body in rows:
        r = [None] * len(at)
        r[at["id"]], r[at["body"]], r[at["subject"]] = key, body, "s"
        r[at["created_at"]] = None if minutes is None else day + dt.timedelta(minutes=minutes)
        out.append(tuple(r))
    return spark.createDataFrame(out, SC.HISTORY)


@pytest.fixture
def table(spark, tmp_path):
    """Batches with overlapping times, ties and rows without a date."""
    path = str(tmp_path / "history")
    for b in range(3):
        rows = [(f"{b}-{i:02d}", (i // 2) * 3 + b if i % 11 else None, f"text {i} " + ("Ünïque Needle" if (b, i) == (1, 7) else "hay")) for i in range(40)]
        HIO.append_history(records(spark, rows), path, b)
    return path


def everything(spark, path):
    return [r["id"] for r in HIO.read_history(spark, path).orderBy(*H.newest_first()).collect()]


def pages(spark, path, spots):
    got = {}
    for offset, size in spots:
        rows = sorted(HIO.stored_page(spark, path, offset, size).collect(), key=lambda r: r["number"])
        assert [r["number"] for r in rows] == list(range(offset + 1, offset + 1 + len(rows)))
        got[offset, size] = [r["id"] for r in rows]
    return got


SPOTS = [(0, 5), (55, 9), (115, 50), (500, 5)]


def test_pages_equal_the_whole_order_with_and_without_index(spark, table):
    want = everything(spark, table)
    expected = {(o, n): want[o:o + n] for o, n in SPOTS}
    assert pages(spark, table, SPOTS) == expected            # no index yet
    HIO.index_history(spark, table)
    HIO.append_history(records(spark, [("new", 10_000, "hay")]), table, 3)  # newer than the index
    want = everything(spark, table)
    assert want[0] == "new" and pages(spark, table, SPOTS) == {(o, n): want[o:o + n] for o, n in SPOTS}


def test_a_page_opens_few_files_of_a_clustered_history(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "history")
    monkeypatch.setattr(HIO, "FILE_BYTES", 1)
    rows = records(spark, [(f"{i:03d}", i // 3, "x") for i in range(200)])
    HIO.append_history(HIO.newest_first_files(rows, 8), path)
    HIO.index_history(spark, path)
    log = L.TableLog(spark, path)
    assert len(log.read(SC.HISTORY, log.snapshot().segments).inputFiles()) == 8
    page = HIO.stored_page(spark, path, 90, 10)
    assert len(set(page.inputFiles())) <= 2
    assert [r["id"] for r in page.orderBy("number").collect()] == everything(spark, path)[90:100]
    monkeypatch.setattr(HIO, "FILE_BYTES", log.snapshot().segments.popitem()[1].bytes // 8)
    HIO.delete_history(spark, path, spark.createDataFrame([("005",)], "id string"))
    assert len(set(HIO.stored_page(spark, path, 90, 10).inputFiles())) <= 2  # rewritten files keep the order
    assert pages(spark, path, [(190, 20)])[190, 20] == everything(spark, path)[190:]


@pytest.mark.parametrize("query", ["needle", "ÜNÏQUE n", "hay", "no such text", "ne", "", "%"])
def test_search_equals_the_full_scan(spark, table, query):
    want = sorted(r["id"] for r in H.history_search(HIO.read_history(spark, table), query).collect())
    assert sorted(r["id"] for r in HIO.stored_search(spark, table, query).collect()) == want
    HIO.index_history(spark, table)
    found = HIO.stored_search(spark, table, query)
    assert sorted(r["id"] for r in found.collect()) == want
    if query == "needle":
        assert len(found.inputFiles()) == 1 and len(want) == 1
    if query == "no such text":
        assert found.inputFiles() == []


def test_indexes_are_built_once_and_follow_rewrites(spark, table):
    from mailrisk.sources import file_index as X
    HIO.index_history(spark, table)
    HIO.index_history(spark, table)
    log = L.TableLog(spark, table)
    assert X._newest(log, "order")[0] == 1
    HIO.compact_history(spark, table)
    HIO.index_history(spark, table)
    assert X._newest(log, "grams")[0] == 2
    want = everything(spark, table)
    assert pages(spark, table, SPOTS) == {(o, n): want[o:o + n] for o, n in SPOTS}
    assert [r["id"] for r in HIO.stored_search(spark, table, "needle").collect()] == ["1-07"]


def test_positions_open_only_their_files(spark, tmp_path):
    src, dest = tmp_path / "a.csv", str(tmp_path / "corpus")
    src.write_text("subject,body,label\n" + "".join(f"s{i},b{i},spam\n" for i in range(100)))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        CIO.replace_corpus(spark, str(src), dest)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    ask = lambda *p: CIO.stored_emails_at(spark, dest, spark.createDataFrame([(x,) for x in p], "pos long"))
    got = ask(3, 3, 97, -1, 100, None)
    assert sorted((r["row_idx"], r["subject"]) for r in got.collect()) == [(3, "s3"), (97, "s97")]
    assert len(set(got.inputFiles())) == 2
    assert ask().collect() == [] and ask(5_000).collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "RangePartitioning" not in plan and "rangepartitioning" not in plan
