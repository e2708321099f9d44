"""Streams over many files: several batches, re-delivery, late rows, restarts."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.sources import messages
from riskloom.streaming import jobs

START = datetime(2024, 1, 1)
SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
KINDS = ["view", "click", "purchase", "signup", "error"]


@pytest.fixture()
def folder(spark, tmp_path):
    """Four files of events in time order, a third of them of one user."""
    rows = [
        (i, START + timedelta(minutes=11 * i), 1 if i % 3 == 0 else i % 7, KINDS[i * 7 % 5], float(i % 13), "{}")
        for i in range(400)
    ]
    for part in range(4):
        chunk = spark.createDataFrame(rows[part * 100:(part + 1) * 100], SCHEMA).coalesce(1)
        chunk.write.mode("append").parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def batch(spark, folder):
    return spark.read.schema(SCHEMA).parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def run(results, target, partition_by=()):
    jobs.append_to(results, f"{target}/rows", f"{target}/progress", partition_by).awaitTermination()
    return results.sparkSession.read.schema(results.schema).parquet(f"{target}/rows")


def test_tumbling_over_several_batches(spark, folder, tmp_path):
    stream = messages.events_stream(spark, folder, files_per_batch=1)
    found = run(jobs.windowed(stream, "1 hour", late="10 hours"), str(tmp_path / "out")).collect()
    last = START + timedelta(minutes=11 * 399) - timedelta(hours=10)
    expected = batch(spark, folder).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count()
    closed = {(r.w.start, r.event_type, r["count"]) for r in expected.collect() if r.w.end <= last}
    assert {(r.window_start, r.event_type, r.n) for r in found} == closed


def test_redelivered_messages_count_once(spark, folder, tmp_path):
    one, two = (messages.events_stream(spark, folder, files_per_batch=2) for _ in range(2))
    once = run(jobs.deduplicated(one.unionByName(two), late="10 days"), str(tmp_path / "out"))
    assert once.count() == 400 and once.select("event_id").distinct().count() == 400


def test_restart_does_not_repeat_results(spark, folder, tmp_path):
    def routed():
        return run(jobs.routed(messages.events_stream(spark, folder)), str(tmp_path / "out"), ("queue",))

    assert routed().count() == 400 and routed().count() == 400
    queues = {r.queue: r["count"] for r in routed().groupBy("queue").count().collect()}
    assert queues == {"analysis": 160, "webhooks": 160, "default": 80}


def test_stuck_scans_equal_the_batch_join(spark, folder, tmp_path):
    limit = 3 * 3600

    def side(kind):
        return messages.events_stream(spark, folder, files_per_batch=1).where(F.col("event_type") == kind)

    joined = jobs.unfinished(side("view"), side("purchase"), limit, late="10 hours")
    found = run(joined, str(tmp_path / "out")).collect()
    events = batch(spark, folder).collect()
    views = [e for e in events if e.event_type == "view"]
    purchases = [e for e in events if e.event_type == "purchase"]
    horizon = max(e.ts for e in purchases) - timedelta(hours=14)
    expected = set()
    for v in views:
        hits = [p.event_id for p in purchases if p.user_id == v.user_id and 0 <= (p.ts - v.ts).total_seconds() <= limit]
        expected |= {(v.event_id, h) for h in hits or [None] if v.ts <= horizon}
    assert {(r.started_id, r.completed_id) for r in found if r.started_at <= horizon} == expected
    assert len(found) == len({(r.started_id, r.completed_id) for r in found})


def test_sessions_equal_the_batch_form(spark, folder, tmp_path):
    stream = messages.events_stream(spark, folder, files_per_batch=2)
    found = run(jobs.sessions(stream, "30 minutes", "20 hours"), str(tmp_path / "out")).collect()
    expected = batch(spark, folder).groupBy(F.session_window("ts", "30 minutes").alias("s"), "user_id").count().collect()
    horizon = START + timedelta(minutes=11 * 399) - timedelta(hours=21)
    want = {(r.user_id, r.s.start, r.s.end, r["count"]) for r in expected if r.s.end <= horizon}
    assert {(r.user_id, r.session_start, r.session_end, r.n) for r in found if r.session_end <= horizon} == want


def test_running_counts_keep_the_newest_batch(spark, folder, tmp_path):
    target = str(tmp_path / "out")
    counts = jobs.unread_counts(messages.events_stream(spark, folder, files_per_batch=1))
    jobs.versions_to(counts, f"{target}/rows", f"{target}/progress").awaitTermination()
    schema = "user_id BIGINT, unread_count BIGINT, total_count BIGINT, newest_at TIMESTAMP"
    current = jobs.newest_versions(spark, f"{target}/rows", schema, ["user_id"])
    expected = jobs.unread_counts(batch(spark, folder))
    key = ["user_id", "unread_count", "total_count", "newest_at"]
    assert sorted(map(tuple, current.select(key).collect())) == sorted(map(tuple, expected.select(key).collect()))


def test_upsert_takes_the_last_push(spark, folder, tmp_path):
    target = str(tmp_path / "out")
    pushes = messages.events_stream(spark, folder, files_per_batch=1).select("user_id", "event_id", "value")
    reduce_batch = jobs.latest_in_batch("user_id", "event_id")
    jobs.versions_to(pushes, f"{target}/rows", f"{target}/progress", "append", reduce_batch).awaitTermination()
    current = jobs.newest_versions(spark, f"{target}/rows", "user_id BIGINT, event_id BIGINT, value DOUBLE", ["user_id"])
    expected = batch(spark, folder).groupBy("user_id").agg(F.max("event_id").alias("event_id")).collect()
    assert {(r.user_id, r.event_id) for r in current.collect()} == {(r.user_id, r.event_id) for r in expected}


def test_late_pushes_do_not_win(spark, tmp_path):
    target, schema = str(tmp_path / "v"), "k BIGINT, turn BIGINT, v STRING"
    for batch, rows in enumerate([[(1, 5, "five"), (2, 1, "one")], [(1, 2, "two"), (2, 3, "three")]]):
        spark.createDataFrame(rows, schema).write.parquet(f"{target}/batch_id={batch}")
    current = jobs.newest_versions(spark, target, schema, ["k"], ["turn"])
    assert {tuple(r) for r in current.collect()} == {(1, 5, "five"), (2, 3, "three")}
    jobs.compact(current, target, str(tmp_path / "w"))
    again = jobs.newest_versions(spark, str(tmp_path / "w"), schema, ["k"], ["turn"])
    assert {tuple(r) for r in again.collect()} == {(1, 5, "five"), (2, 3, "three")}


def test_review_counts_all_files_of_all_batches(spark, tmp_path):
    from riskloom.streaming.review import posted, review_job

    schema = "pr BIGINT, file_path STRING, risk_score DOUBLE, risk_tier STRING, findings_count BIGINT"
    batches = [
        [(1, "a", 0.1, "LOW", 1), (1, "b", 0.2, "LOW", 0), (2, "z", 0.9, "CRITICAL", 4)],
        [(1, "c", 0.1, "LOW", 2), (1, "a", 0.4, "MEDIUM", 3)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    baselines = spark.createDataFrame([(1, 0.1)], "pr BIGINT, risk_before DOUBLE")
    review_job(stream, baselines, "pr", str(tmp_path / "out")).awaitTermination()
    rows = posted(spark, str(tmp_path / "out"), "pr", "BIGINT").orderBy("pr", "ordinal").collect()
    first = [r for r in rows if r.pr == 1]
    assert [r.ordinal for r in first] == [1, 2, 3, 4, 5]
    assert (first[0].files, first[0].risk_trend) == (3, "DEGRADED") and abs(first[0].mean_risk - 0.7 / 3) < 1e-12
    assert [r.piece.split("`")[1] for r in first[1:4]] == ["a", "b", "c"] and "0.4000" in first[1].piece
    assert {r.risk_trend for r in rows if r.pr == 2} == {None}


def test_heartbeat_closes_every_session(spark, folder, tmp_path):
    stream = messages.with_heartbeat(messages.events_stream(spark, folder), str(tmp_path / "beat"), datetime(2024, 2, 1))
    found = run(jobs.sessions(stream), str(tmp_path / "out")).where("user_id is not null").collect()
    expected = batch(spark, folder).groupBy(F.session_window("ts", "30 minutes").alias("s"), "user_id").count().collect()
    assert {(r.user_id, r.session_start, r.n) for r in found} == {(r.user_id, r.s.start, r["count"]) for r in expected}


def test_message_bodies(spark):
    body = '{"event_id": 3, "ts": "2024-01-01T00:00:00Z", "user_id": 1, "event_type": "view", "value": 2.5}'
    rows = spark.createDataFrame([(body,), ("not json",)], "b STRING").select(messages.parsed(F.col("b")).alias("m"))
    good, bad = rows.select("m.*").collect()
    assert (good.event_id, good.event_type, good.value) == (3, "view", 2.5) and bad.event_id is None
