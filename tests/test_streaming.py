import datetime as dt
import time

from conftest import SF_SMALL
from mailrisk import schema as SC
from mailrisk.operators import history as H
from mailrisk.plans import catalog as CAT
from mailrisk.sources import history_io as HIO
from mailrisk.sources import table_log as L
from mailrisk.streaming import dashboard_stream as DS


def test_stream_equals_batch(spark):
    path = CAT.stream_history(spark, SF_SMALL, n_files=3)
    streamed = HIO.read_history(spark, path)
    batch = CAT.history(spark, SF_SMALL)
    cols = ["id", "classification", "spam_risk", "overall_risk"]
    assert sorted(streamed.select(*cols).collect()) == sorted(batch.select(*cols).collect())
    # replaying a batch id replaces its own segment: no duplicates
    log = L.TableLog(spark, path)
    part = log.read(SC.HISTORY, [k for k, x in log.snapshot().segments.items() if x.holds("stream", 0)])
    replay = spark.createDataFrame(part.collect(), part.schema)
    before = HIO.read_history(spark, path).count()
    HIO.append_history(replay, path, batch_id=0)
    assert HIO.read_history(spark, path).count() == before


def test_stream_dashboard_equals_batch(spark):
    got = sorted(CAT.q_stream_dashboard(spark, SF_SMALL).collect())
    want = sorted(H.domain_breakdown(CAT.history(spark, SF_SMALL)).collect())
    assert got == want


def test_dashboard_counts_replays_once_and_sees_deletions(spark, tmp_path):
    path, out, ckpt = str(tmp_path / "history"), str(tmp_path / "out"), str(tmp_path / "ckpt")

    def dashboard():
        DS.start_dashboard_stream(spark, path, out, ckpt).awaitTermination()
        return sorted(tuple(r) for r in DS.read_dashboard(spark, out).collect())

    HIO.append_history(rows(spark, ("1", "a@x.com", "SPAM"), ("2", "b@y.com", "HAM")), path, 0)
    HIO.append_history(rows(spark, ("3", "c@x.com", "HAM")), path)          # a job without a batch id
    assert HIO.read_history(spark, path).count() == 3                  # mixed appends are all read
    assert dashboard() == [("x.com", 1, 1), ("y.com", 0, 1)]
    HIO.append_history(rows(spark, ("1", "a@x.com", "SPAM"), ("2", "b@y.com", "HAM")), path, 0)   # replay
    assert dashboard() == [("x.com", 1, 1), ("y.com", 0, 1)]
    HIO.append_history(rows(spark, ("4", "d@z.com", "SPAM")), path, 1)
    assert dashboard() == [("x.com", 1, 1), ("y.com", 0, 1), ("z.com", 1, 0)]
    HIO.delete_history(spark, path, spark.createDataFrame([("3",), ("1",), ("unknown",)], "id string"))
    assert sorted(r.id for r in HIO.read_history(spark, path).collect()) == ["2", "4"]
    assert dashboard() == [("y.com", 0, 1), ("z.com", 1, 0)]
    assert DS.dashboard_totals(DS.read_dashboard(spark, out)).first() == (2, 1, 1)


def rows(spark, *items):
    """History rows (id, sender, classification[, minute])."""
    full = [{f: None for f in SC.HISTORY.fieldNames()} | {"id": i, "sender": s, "classification": c, "created_at": dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m[0] if m else 0)}
            for i, s, c, *m in items]
    return spark.createDataFrame(full, SC.HISTORY).coalesce(1)


def test_dashboard_keeps_h7_order(spark, tmp_path):
    """Ties go by the newest detection, also after the newest one is deleted; equal to H7 over the batch history."""
    path, out, ckpt = (str(tmp_path / x) for x in ("history", "out", "ckpt"))

    def same():
        DS.start_dashboard_stream(spark, path, out, ckpt).awaitTermination()
        got = [tuple(r) for r in DS.read_dashboard(spark, out).collect()]
        assert got == [tuple(r) for r in H.domain_breakdown(HIO.read_history(spark, path)).collect()]
        assert [(r.domain, r.place) for r in DS.read_ranked(spark, out).orderBy("place").collect()] == [(d, i + 1) for i, (d, _, _) in enumerate(got)]
        return [d for d, _, _ in got]

    HIO.append_history(rows(spark, ("1", "a@x.com", "SPAM", 5), ("2", "b@y.com", "HAM", 9), ("3", "c@z.com", "HAM", 1)), path, 0)
    HIO.append_history(rows(spark, ("4", "a@x.com", "SPAM", 1), ("5", "b@y.com", "HAM", 2)), path, 1)
    assert same() == ["y.com", "x.com", "z.com"]
    HIO.append_history(rows(spark, ("6", "q@z.com", "SPAM", 7)), path, 2)
    HIO.delete_history(spark, path, spark.createDataFrame([("2",)], "id string"))
    assert same() == ["z.com", "x.com", "y.com"]
    HIO.append_history(rows(spark, ("7", "b@y.com", None, 3)), path, 3)
    assert same() == ["z.com", "x.com", "y.com"]
    HIO.delete_history(spark, path, spark.createDataFrame([("6",), ("3",)], "id string"))
    HIO.compact_history(spark, path)
    HIO.append_history(rows(spark, ("8", "n@w.com", "HAM", 99)), path, 4)
    HIO.delete_history(spark, path, spark.createDataFrame([("4",), ("8",)], "id string"))
    assert same() == ["y.com", "x.com"]


def test_dashboard_work_does_not_grow_with_batches(spark, tmp_path, monkeypatch):
    """10,000 batches are in the history; a micro-batch reads its own commits and segments only."""
    path, out = str(tmp_path / "history"), str(tmp_path / "out")
    log = L.TableLog(spark, path)
    many = {f"s{i}": L.Segment(1, {"stream": [[i, i]]}) for i in range(10_000)}
    log.commit(lambda now: L.Change("append", many))
    HIO.append_history(rows(spark, ("1", "a@x.com", "SPAM")), path, "new")
    text = (tmp_path / "history" / "commits" / f"{2:020d}.json").read_text()
    read = []
    monkeypatch.setattr(L.TableLog, "snapshot", lambda *a: (_ for _ in ()).throw(AssertionError("the whole history was listed")))
    whole = L.TableLog.read
    monkeypatch.setattr(L.TableLog, "read", lambda self, schema, segments: read.append(len(list(segments))) or whole(self, schema, segments))
    DS.apply_commits(spark, path, out, [text], 0)
    assert read == [1] and [tuple(r) for r in DS.read_dashboard(spark, out).collect()] == [("x.com", 1, 0)]


def test_many_small_batches_are_compacted(spark, tmp_path):
    """After many micro-batches few files are left, newest first, and a replayed old batch counts once."""
    path, n = str(tmp_path / "history"), 45
    for i in range(n):
        HIO.append_history(rows(spark, (str(i), "a@x.com", "HAM", i * 7 % n)), path, i)
        HIO.compact_history(spark, path, at_least=10)
    log = L.TableLog(spark, path)
    segments = log.snapshot().segments
    assert len(segments) < 12 and sum(len(list((tmp_path / "history" / "data" / s).glob("part-*"))) for s in segments) < 20
    for replay in (0, 17, n - 1):
        HIO.append_history(rows(spark, (str(replay), "a@x.com", "HAM", 0)), path, replay)
    HIO.compact_history(spark, path)
    assert sorted(int(r.id) for r in HIO.read_history(spark, path).collect()) == list(range(n))
    assert [s.batches for s in log.snapshot().segments.values()] == [{"stream": [[0, n - 1]]}]
    minutes = [r.created_at for r in HIO.read_history(spark, path).collect()]
    assert minutes == sorted(minutes, reverse=True)
    before = HIO.read_history(spark, path, version=5)
    assert before.count() == 5  # an older version stays readable until it is vacuumed
    time.sleep(0.01)
    assert L.vacuum(log, dt.timedelta(0)) > n and HIO.read_history(spark, path).count() == n
