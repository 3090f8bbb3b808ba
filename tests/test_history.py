import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_SMALL
from mailrisk.operators import history as H
from mailrisk.plans import catalog as CAT


def hist(spark, rows):
    return spark.createDataFrame(
        [(f"id{i}", s, c, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) for i, (s, c, m) in enumerate(rows)],
        "id string, sender string, classification string, created_at timestamp")


def test_breakdown_ties_by_latest_and_case(spark):
    h = hist(spark, [("a@x.com", "SPAM", 1), ("b@y.com", "HAM", 5), ("bob", "HAM", 2), ("Bob", "SPAM", 3),
                     ("", "HAM", 0), (None, "HAM", 0)])
    got = [(r.domain, r.spam, r.ham) for r in H.domain_breakdown(h).collect()]
    assert got[0] == ("Unknown sender", 0, 2)
    assert got[1:] == [("y.com", 0, 1), ("Bob", 1, 0), ("bob", 0, 1), ("x.com", 1, 0)]


def test_totals_equal_breakdown_sum(spark):
    h = CAT.history(spark, SF_SMALL)
    t = H.dashboard_totals(h).first()
    b = H.domain_breakdown(h).agg(F.sum("spam").alias("s"), F.sum("ham").alias("h")).first()
    assert (t.spam, t.not_spam, t.total) == (b.s, b.h, b.s + b.h)


def test_list_numbers_newest_first(spark):
    h = CAT.history(spark, SF_SMALL)
    rows = H.history_list(h.repartition(5)).orderBy("number").collect()
    assert [r.number for r in rows] == list(range(1, len(rows) + 1))
    ts = [r.created_at for r in rows]
    assert ts == sorted(ts, reverse=True)
    page = H.history_page(h, 10).orderBy("number").collect()
    assert [r.id for r in page] == [r.id for r in rows[:10]]


def test_percentages_zero_total(spark):
    df = spark.createDataFrame([("d", 0, 0), ("e", 1, 3)], "domain string, spam long, ham long")
    got = {r.domain: (r.spam_pct, r.ham_pct) for r in H.domain_percentages(df).collect()}
    assert got == {"d": (0.0, 0.0), "e": (25.0, 75.0)}


def test_delete_unknown_ids_noop(spark):
    h = hist(spark, [("a@x.com", "SPAM", 1), ("b@y.com", "HAM", 2)])
    ids = spark.createDataFrame([("id0",), ("nope",)], "id string")
    assert [r.id for r in H.history_delete(h, ids).collect()] == ["id1"]
