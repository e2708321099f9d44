"""Streaming queries, each run over all available messages and compared with its batch form.

Trends go on changing, so they are written as versions; sessions and joins only append, so a heartbeat after the last
message closes them all. Upserts run over several files in no order, one file a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.levels import risk_tier
from riskloom.plans import roles
from riskloom.plans.documents import SQL_COMMENT_PIECES
from riskloom.plans.projects import SPLIT
from riskloom.plans.registry import query
from riskloom.session import settle, shared_dir
from riskloom.sources.messages import HEARTBEAT, events_stream, table_stream, with_heartbeat
from riskloom.sources.tables import table
from riskloom.streaming import jobs
from riskloom.streaming.review import posted, review_job

# Views and purchases of one project are hours apart in the data; the limit is a parameter of the job.
LIMIT_SECONDS = 6 * 3_600


def _appended(spark: SparkSession, results: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    target = shared_dir(spark, name)
    jobs.append_to(results, f"{target}/rows", f"{target}/progress", partition_by).awaitTermination()
    return spark.read.schema(results.schema).parquet(f"{target}/rows")


def _versions(spark: SparkSession, results: DataFrame, name: str, keys: list[str]) -> DataFrame:
    target = shared_dir(spark, name)
    jobs.versions_to(results, f"{target}/rows", f"{target}/progress").awaitTermination()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in results.schema)
    return jobs.newest_versions(spark, f"{target}/rows", schema, keys)


def _closing(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Messages with a heartbeat two days after the last one."""
    last = table(spark, folder, "events").agg(F.max("ts").cast("timestamp") + F.expr("INTERVAL 2 DAYS")).first()[0]
    return with_heartbeat(events_stream(spark, folder), shared_dir(spark, name), last, user_id=-1)


def _in_pieces(spark: SparkSession, folder: str, name: str, parts: int = 4) -> DataFrame:
    """A table as a stream of several files that are in no order, one file a batch."""
    target = shared_dir(spark, f"pieces-{name}")
    rows = table(spark, folder, name)
    rows.repartition(parts, F.xxhash64(*rows.columns)).write.parquet(f"{target}/{name}.parquet")
    return table_stream(spark, target, name, files_per_batch=1)


def _text(column: str, pattern: str = "yyyy-MM-dd HH:mm:ss"):
    return F.date_format(column, pattern).alias(column)


_WINDOW_COLUMNS = """strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end, event_type, n, round(a, 6) AS avg_risk, m AS max_risk"""


def _windows(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return rows.select(
        _text("window_start"), _text("window_end"), "event_type", "n", F.round("avg_risk", 6).alias("avg_risk"), "max_risk"
    )


@query(
    "stream_tumbling",
    f"""WITH windows AS (SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
      event_type, count(*) AS n, avg(value) AS a, max(value) AS m FROM events GROUP BY ALL)
    SELECT {_WINDOW_COLUMNS} FROM windows""",
)
def stream_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    trend = jobs.windowed(events_stream(spark, folder), "1 day")
    return _windows(spark, _versions(spark, trend, "stream-tumbling", ["window_start", "window_end", "event_type"]))


@query(
    "stream_sliding",
    f"""WITH spread AS (SELECT date_trunc('day', ts) - to_days(k::INT) AS window_start, event_type, value
      FROM events, range(7) r(k)),
    windows AS (SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, event_type, count(*) AS n,
      avg(value) AS a, max(value) AS m FROM spread GROUP BY ALL)
    SELECT {_WINDOW_COLUMNS} FROM windows""",
)
def stream_sliding(spark: SparkSession, folder: str) -> DataFrame:
    trend = jobs.windowed(events_stream(spark, folder), "7 days", "1 day")
    return _windows(spark, _versions(spark, trend, "stream-sliding", ["window_start", "window_end", "event_type"]))


@query(
    "stream_session",
    """WITH steps AS (SELECT user_id, ts, value, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    numbered AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM steps),
    sessions AS (SELECT user_id, s, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n,
      sum(value) AS total FROM numbered GROUP BY ALL)
    SELECT user_id, strftime(session_start, '%Y-%m-%d %H:%M:%S') AS session_start,
      strftime(session_end, '%Y-%m-%d %H:%M:%S') AS session_end, n, round(total, 6) AS total
    FROM sessions""",
)
def stream_session(spark: SparkSession, folder: str) -> DataFrame:
    closed = _appended(spark, jobs.sessions(_closing(spark, folder, "session-beat")), "stream-session")
    return closed.where("user_id >= 0").select(
        "user_id", _text("session_start"), _text("session_end"), "n", F.round("total", 6).alias("total")
    )


@query(
    "stream_dedup",
    "SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1",
)
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    delivered = events_stream(spark, folder).select("event_id", "ts", "event_type")
    again = events_stream(spark, folder).select("event_id", "ts", "event_type")
    once = _appended(spark, jobs.deduplicated(delivered.unionByName(again)), "stream-dedup")
    return once.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


@query(
    "stream_route",
    """SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'analysis' WHEN event_type IN ('view', 'click')
      THEN 'webhooks' ELSE 'default' END AS queue, event_type, count(*) AS n, sum(event_id)::BIGINT AS id_sum
    FROM events GROUP BY ALL""",
)
def stream_route(spark: SparkSession, folder: str) -> DataFrame:
    messages = jobs.routed(events_stream(spark, folder).select("event_id", "event_type"))
    tables = _appended(spark, messages, "stream-route", ("queue",))
    return tables.groupBy("queue", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum")
    )


@query(
    "stream_stuck_scans",
    f"""WITH views AS (SELECT * FROM events WHERE event_type = 'view'),
    purchases AS (SELECT * FROM events WHERE event_type = 'purchase'),
    firsts AS (SELECT v.event_id, v.user_id, min(row(p.ts, p.event_id)) FILTER (p.event_id IS NOT NULL) AS first
      FROM views v LEFT JOIN purchases p ON p.user_id = v.user_id AND p.ts >= v.ts
        AND p.ts <= v.ts + to_seconds({LIMIT_SECONDS}) GROUP BY ALL)
    SELECT event_id AS started_id, user_id, first[2] AS completed_id, first IS NULL AS stuck FROM firsts""",
)
def stream_stuck_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Every started scan with its first completion within the limit; one without is stuck."""
    started = _closing(spark, folder, "start-beat").where(F.col("event_type").isin("view", HEARTBEAT))
    completed = _closing(spark, folder, "end-beat").where(F.col("event_type").isin("purchase", HEARTBEAT))
    joined = jobs.unfinished(started, completed, LIMIT_SECONDS)
    rows = jobs.first_completions(_appended(spark, joined, "stream-stuck"))
    return rows.select("started_id", "user_id", "completed_id", F.col("completed_id").isNull().alias("stuck"))


@query(
    "stream_upsert",
    """SELECT conv_id, max(turn) AS turn, max_by(md5(text), turn) AS text_md5, max_by(role, turn) AS role
    FROM conversations GROUP BY 1""",
)
def stream_upsert(spark: SparkSession, folder: str) -> DataFrame:
    pushes = _in_pieces(spark, folder, "conversations")
    target = shared_dir(spark, "stream-upsert")
    job = jobs.versions_to(
        pushes, f"{target}/rows", f"{target}/progress", "append", jobs.latest_in_batch("conv_id", "turn")
    )
    job.awaitTermination()
    schema = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
    # the last turn counts, whichever batch brought it
    current = jobs.newest_versions(spark, f"{target}/rows", schema, ["conv_id"], ["turn"])
    jobs.compact(current, f"{target}/rows", f"{target}/compacted")
    current = jobs.newest_versions(spark, f"{target}/compacted", schema, ["conv_id"], ["turn"])
    return current.select("conv_id", "turn", F.md5("text").alias("text_md5"), "role")


@query(
    "stream_unread",
    """SELECT user_id, count(*) FILTER (event_type NOT IN ('view', 'click')) AS unread_count, count(*) AS total_count,
      strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest_at FROM events GROUP BY 1""",
)
def stream_unread(spark: SparkSession, folder: str) -> DataFrame:
    counts = jobs.unread_counts(events_stream(spark, folder))
    target = shared_dir(spark, "stream-unread")
    jobs.versions_to(counts, f"{target}/rows", f"{target}/progress").awaitTermination()
    schema = "user_id BIGINT, unread_count BIGINT, total_count BIGINT, newest_at TIMESTAMP"
    current = jobs.newest_versions(spark, f"{target}/rows", schema, ["user_id"])
    return current.withColumn("newest_at", _text("newest_at"))


@query(
    "stream_pr_review",
    f"""WITH {roles.SQL_SCANS}, {roles.SQL_FINDINGS}, counts AS (SELECT scan_id, count(*) AS n FROM findings GROUP BY 1),
    pushed AS (SELECT * FROM scans LEFT JOIN counts USING (scan_id) WHERE created_at >= TIMESTAMP '{SPLIT}'),
    baselines AS (SELECT project_id, avg(risk_score) AS before FROM scans WHERE created_at < TIMESTAMP '{SPLIT}' GROUP BY 1),
    rated AS (SELECT project_id, count(*) AS files, sum(coalesce(n, 0))::BIGINT AS total_findings,
      avg(risk_score) AS mean_risk FROM pushed GROUP BY 1),
    drifted AS (SELECT r.*, abs(mean_risk - before) AS score, CASE WHEN before IS NULL THEN NULL
        WHEN abs(mean_risk - before) < 0.05 THEN 'STABLE' WHEN mean_risk < before THEN 'IMPROVED'
        WHEN abs(mean_risk - before) >= 0.5 THEN 'FRACTURED' ELSE 'DEGRADED' END AS trend
      FROM rated r LEFT JOIN baselines USING (project_id)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY scan_id) AS i FROM pushed),
    pieces AS (WITH {SQL_COMMENT_PIECES})
    SELECT project_id, ordinal, piece, files, total_findings, round(mean_risk, 12) AS mean_risk,
      {roles.SQL_TIER.format('mean_risk')} AS risk_tier, round(CASE WHEN trend IS NOT NULL THEN score END, 12) AS drift_score,
      trend AS risk_trend FROM pieces JOIN drifted USING (project_id)""",
)
def stream_pr_review(spark: SparkSession, folder: str) -> DataFrame:
    split = F.lit(SPLIT).cast("timestamp_ntz")
    baselines = roles.scans(spark, folder).where(F.col("created_at") < split).groupBy("project_id").agg(
        F.avg("risk_score").alias("risk_before")
    )
    counts = roles.findings(spark, folder).groupBy("scan_id").agg(F.count(F.lit(1)).alias("findings_count"))
    pushed = roles.scan_rows(_in_pieces(spark, folder, "orders")).where(F.col("created_at") >= split)
    files = pushed.join(settle(counts), "scan_id", "left").select(
        "project_id",
        "scan_id",
        F.concat(F.lit("scan/"), F.col("scan_id").cast("string")).alias("file_path"),
        "risk_score",
        risk_tier(F.col("risk_score")).alias("risk_tier"),
        F.coalesce("findings_count", F.lit(0)).alias("findings_count"),
    )
    target = shared_dir(spark, "stream-review")
    review_job(files, settle(baselines), "project_id", target, ["scan_id"]).awaitTermination()
    rounded = {"mean_risk": F.round("mean_risk", 12), "drift_score": F.round("drift_score", 12)}
    return posted(spark, target, "project_id", "BIGINT").withColumns(rounded)
