"""Streaming forms of the panel operators, run to the end of the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.plans.base import query, r, rounded, table
from tessella.session import materialize, scratch_path
from tessella.streaming import streams as ST


def event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return ST.event_time(ST.file_stream(spark, f"{d}/events.parquet", schema), "ts")


@query(
    "stream_daily_mean",
    "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2",
)
def stream_daily_mean(spark, d):
    """M2: tumbling window, equal to the batch aggregate."""
    s = ST.tumbling_mean(event_stream(spark, d), "ts", "value", ["event_type"], "1 day", "2 hours")
    out = ST.latest_updates(s, "tumbling", ["window_start", "event_type"])
    return rounded(out.select(F.col("window_start").cast("date").alias("day"), "event_type", "n", "mean_value"))


@query(
    "stream_sliding_stats",
    """WITH w AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, value FROM events
  UNION ALL SELECT CAST(date_trunc('day', ts) - INTERVAL 1 DAY AS DATE), event_type, value FROM events
  UNION ALL SELECT CAST(date_trunc('day', ts) - INTERVAL 2 DAY AS DATE), event_type, value FROM events)
SELECT day, event_type, count(*) AS n, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS std_value FROM w GROUP BY 1, 2""",
)
def stream_sliding_stats(spark, d):
    """M3: three-day windows sliding by a day."""
    s = ST.sliding_stats(event_stream(spark, d), "ts", "value", ["event_type"], "3 days", "1 day", "2 hours")
    out = ST.latest_updates(s, "sliding", ["window_start", "event_type"])
    return rounded(
        out.select(F.col("window_start").cast("date").alias("day"), "event_type", "n", "mean_value", "std_value")
    )


@query(
    "stream_silence",
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS brk FROM events),
g AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o),
z AS (SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, max(ts) + INTERVAL 12 HOUR AS silent_from, count(*) AS n FROM g GROUP BY user_id, s)
SELECT user_id, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us, n FROM z
WHERE silent_from <= (SELECT time_bucket(INTERVAL '1 millisecond', max(ts)) FROM events) - INTERVAL 2 HOUR""",
)
def stream_silence(spark, d):
    """M4: activity sessions closed by twelve hours of silence."""
    s = ST.silence_gaps(event_stream(spark, d), "ts", "user_id", "12 hours", "2 hours")
    out = ST.appended(s, "silence")
    return out.select(
        "user_id", F.unix_micros(F.col("first_seen")).alias("first_us"), F.unix_micros(F.col("last_seen")).alias("last_us"), "n"
    )


@query(
    "stream_duplicates_suppressed",
    "SELECT user_id, CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS n FROM events GROUP BY 1, 2",
)
def stream_duplicates_suppressed(spark, d):
    """M5: one row per user and day."""
    s = event_stream(spark, d).withColumn("day", F.col("ts").cast("date")).select("ts", "user_id", "day")
    out = ST.appended(ST.first_per_period(s, "ts", ["user_id", "day"], "1 day"), "dedupe")
    return out.groupBy("user_id", "day").agg(F.count("*").alias("n"))


@query(
    "stream_static_join",
    """WITH m AS (SELECT event_type, CAST(ts AS DATE) AS day, round(avg(value), 6) AS typical FROM events WHERE event_type <> 'error' GROUP BY 1, 2)
SELECT e.event_id, e.event_type, e.value, m.typical FROM events e LEFT JOIN m ON m.event_type = e.event_type AND m.day = CAST(e.ts AS DATE)""",
)
def stream_static_join(spark, d):
    """M6: stream left-joined with a static daily table."""
    day = F.col("ts").cast("date").alias("day")
    static = table(spark, d, "events").filter("event_type <> 'error'").groupBy("event_type", day).agg(r(F.avg("value")).alias("typical"))
    static = materialize(static, "typical")  # else every micro-batch aggregates anew
    s = event_stream(spark, d).withColumn("day", F.col("ts").cast("date"))
    out = ST.appended(ST.enrich(s, static, ["event_type", "day"]), "enrich")
    return out.select("event_id", "event_type", "value", "typical")


@query(
    "stream_snapshot_upsert",
    """SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, CASE WHEN user_id % 2 = 0 THEN round(sum(value), 2) END AS value FROM events GROUP BY 1, 2""",
)
def stream_snapshot_upsert(spark, d):
    """M1: two snapshot deliveries ingested by two runs of one query, then upserted."""
    ev = table(spark, d, "events")
    per = ev.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        F.count("*").alias("n"), r(F.sum("value"), 2).alias("value")
    )
    inbox, work = scratch_path(spark, "inbox"), scratch_path(spark, "ingest")
    per.withColumn("value", F.lit(None).cast("double")).write.mode("append").parquet(inbox)
    schema = per.schema
    ST.ingest_snapshots(ST.file_stream(spark, inbox, schema), work)
    per.filter("user_id % 2 = 0").write.mode("append").parquet(inbox)
    log = ST.ingest_snapshots(ST.file_stream(spark, inbox, schema), work)
    return ST.current_rows(spark, log, schema, ["user_id", "day"], ["n", "value"])


@query(
    "stream_compacted_upsert",
    """SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n,
  CASE WHEN user_id % 3 = 0 THEN -round(sum(value), 2) WHEN user_id % 2 = 0 THEN round(sum(value), 2) END AS value FROM events GROUP BY 1, 2""",
)
def stream_compacted_upsert(spark, d):
    """M1: three deliveries; the log is compacted after the second, the view reads
    the snapshot and what came later."""
    per = table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        F.count("*").alias("n"), r(F.sum("value"), 2).alias("value")
    )
    per = materialize(per, "deliveries")
    inbox, work = scratch_path(spark, "inbox"), scratch_path(spark, "ingest")
    keys, data, schema = ["user_id", "day"], ["n", "value"], per.schema
    deliveries = [
        per.withColumn("value", F.lit(None).cast("double")),
        per.filter("user_id % 2 = 0"),
        per.filter("user_id % 3 = 0").withColumn("value", -F.col("value")),
    ]
    for i, rows in enumerate(deliveries):
        rows.write.mode("append").parquet(inbox)
        log = ST.ingest_snapshots(ST.file_stream(spark, inbox, schema), work)
        if i == 1:
            ST.compact(spark, log, schema, keys, data)
            ST.remove_folded(spark, log)
    return ST.current_rows(spark, log, schema, keys, data)
