import datetime as dt

from pyspark.sql import functions as F

from tessella.session import scratch_path
from tessella.streaming import streams as S

SCHEMA = "ts timestamp, user string, v double"


def t(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def drop(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return S.file_stream(spark, path, schema, files_per_batch=1)


def test_late_rows_are_dropped_and_windows_closed_once(spark):
    path, work = scratch_path(spark, "in"), scratch_path(spark, "work")
    drop(spark, path, [(t(0.1), "a", 1.0), (t(0.5), "a", 3.0)])
    q = S.tumbling_mean(stream(spark, path), "ts", "v", ["user"], "1 hour", "1 hour")
    S.run_available(q, "w", "append", work)
    drop(spark, path, [(t(9), "a", 10.0)])
    S.run_available(q, "w", "append", work)
    drop(spark, path, [(t(0.2), "a", 99.0), (t(20), "a", 1.0)])
    table = S.run_available(q, "w", "append", work)
    rows = {r.window_start: (r.n, r.mean_value) for r in S.read_batches(spark, table, q.schema).collect()}
    assert rows[t(0)] == (2, 2.0) and rows[t(9)] == (1, 10.0) and len(rows) == 2


def test_sessions_close_after_silence(spark):
    path = scratch_path(spark, "in")
    drop(spark, path, [(t(0), "a", 1.0), (t(1), "a", 1.0), (t(8), "a", 1.0), (t(30), "b", 1.0)])
    out = S.appended(S.silence_gaps(stream(spark, path), "ts", "user", "4 hours", "1 hour"), "s")
    got = sorted((r.user, r.first_seen, r.last_seen, r.n) for r in out.collect())
    assert got == [("a", t(0), t(1), 2), ("a", t(8), t(8), 1)]


def test_duplicates_across_batches(spark):
    path = scratch_path(spark, "in")
    drop(spark, path, [(t(0), "a", 1.0)])
    drop(spark, path, [(t(0), "a", 1.0), (t(1), "b", 1.0)])
    out = S.appended(S.first_per_period(stream(spark, path), "ts", ["user"], "1 day"), "d")
    assert sorted(r.user for r in out.collect()) == ["a", "b"]


def test_ingest_is_exactly_once_over_restarts(spark):
    path, work = scratch_path(spark, "in"), scratch_path(spark, "work")
    s = stream(spark, path)
    drop(spark, path, [(t(0), "a", None)])
    S.ingest_snapshots(s, work)
    log = S.ingest_snapshots(s, work)
    assert S.read_batches(spark, log, s.schema).count() == 1
    drop(spark, path, [(t(0), "a", 5.0), (t(1), "b", 6.0)])
    log = S.ingest_snapshots(s, work)
    assert S.read_batches(spark, log, s.schema).count() == 3
    rows = S.current_rows(spark, log, s.schema, ["ts", "user"], ["v"])
    assert sorted((r.user, r.v) for r in rows.collect()) == [("a", 5.0), ("b", 6.0)]


def test_stream_static_join(spark):
    path = scratch_path(spark, "in")
    drop(spark, path, [(t(0), "a", 1.0), (t(0), "z", 2.0)])
    static = spark.createDataFrame([("a", 7)], "user string, k int")
    out = S.appended(S.enrich(stream(spark, path), static, ["user"]), "j")
    assert sorted((r.user, r.k) for r in out.select("user", F.col("k")).collect()) == [("a", 7), ("z", None)]


def test_compaction_survives_a_lost_run(spark, monkeypatch):
    path, work = scratch_path(spark, "in"), scratch_path(spark, "work")
    s, keys = stream(spark, path), ["ts", "user"]

    def deliver(rows):
        drop(spark, path, rows)
        return S.ingest_snapshots(s, work)

    def view(log):
        return sorted((r.user, r.v) for r in S.current_rows(spark, log, s.schema, keys, ["v"]).collect())

    deliver([(t(0), "a", None), (t(0), "b", 1.0)])
    log = deliver([(t(0), "a", 5.0)])
    assert S.manifest(spark, log) is None
    assert S.write_snapshot(spark, log, s.schema, keys, ["v"])  # the run is lost here: no manifest
    assert S.manifest(spark, log) is None and view(log) == [("a", 5.0), ("b", 1.0)]
    first = S.compact(spark, log, s.schema, keys, ["v"])
    assert (first.version, first.rows, first.through) == (0, 2, 1) and view(log) == [("a", 5.0), ("b", 1.0)]
    assert S.compact(spark, log, s.schema, keys, ["v"]) == first  # nothing new
    S.remove_folded(spark, log)
    assert view(log) == [("a", 5.0), ("b", 1.0)]
    log = deliver([(t(0), "b", 7.0), (t(0), "c", None)])
    assert view(log) == [("a", 5.0), ("b", 7.0), ("c", None)]

    class Lost(Exception):
        pass

    def lost(*_):
        raise Lost

    with monkeypatch.context() as m:
        m.setattr(S, "astuple", lost)
        try:
            S.compact(spark, log, s.schema, keys, ["v"])
        except Lost:
            pass
    assert S.manifest(spark, log) == first and view(log) == [("a", 5.0), ("b", 7.0), ("c", None)]
    second = S.compact(spark, log, s.schema, keys, ["v"])
    assert (second.version, second.through, second.rows) == (1, 2, 3) and view(log) == [("a", 5.0), ("b", 7.0), ("c", None)]
    # a manifest whose write was not committed does not count
    spark.createDataFrame([(9, "gone", 0, 0, 99)], S.MANIFEST).coalesce(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").json(
        f"{work}/manifests/{9:012d}"
    )
    assert S.manifest(spark, log) == second
