"""Queries on projects, scans, baselines, users and comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import levels, text
from riskloom.operators import keyed, rollups
from riskloom.operators.ordering import ordinals, rolling_mean, with_previous
from riskloom.plans import roles
from riskloom.plans.registry import query
from riskloom.sources.tables import table

SPLIT = "1998-06-01"


def _moment(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


@query(
    "project_rollup",
    f"""WITH {roles.SQL_SCANS}, {roles.SQL_FINDINGS}, {roles.SQL_PROJECTS},
    per_scan AS (SELECT scan_id, count(*) AS n FROM findings GROUP BY 1),
    ranked AS (SELECT s.*, coalesce(n, 0) AS n,
      row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, scan_id DESC) AS rn
      FROM scans s LEFT JOIN per_scan USING (scan_id))
    SELECT p.project_id, p.name, CAST(coalesce(sum(n), 0) AS BIGINT) AS findings_count,
      count(r.scan_id) AS scans_count, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_scan_at,
      max(status) FILTER (rn = 1) AS last_status
    FROM projects p LEFT JOIN ranked r USING (project_id) GROUP BY 1, 2""",
)
def project_rollup(spark: SparkSession, folder: str) -> DataFrame:
    rolled = rollups.project_rollup(
        roles.projects(spark, folder).select("project_id", "name"),
        roles.scans(spark, folder).select("scan_id", "project_id", "created_at", "status"),
        roles.findings(spark, folder).select("scan_id"),
    )
    return rolled.withColumn("last_scan_at", _moment("last_scan_at"))


_LEVELS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}_count" for s in levels.SEVERITIES)


@query(
    "dashboard_stats",
    f"""WITH {roles.SQL_SCANS}, {roles.SQL_FINDINGS}
    SELECT (SELECT count(*) FROM customer) AS total_projects, (SELECT count(*) FROM scans) AS total_scans,
      (SELECT round(avg(risk_score), 6) FROM scans) AS avg_risk_score, f.*
    FROM (SELECT count(*) AS total_findings, {_LEVELS} FROM findings) f""",
)
def dashboard_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = rollups.dashboard_stats(
        roles.projects(spark, folder).select("project_id"),
        roles.scans(spark, folder).select("risk_score"),
        roles.findings(spark, folder).select("severity"),
    )
    return stats.withColumn("avg_risk_score", F.round("avg_risk_score", 6))


@query(
    "risk_trend",
    f"""WITH {roles.SQL_SCANS}
    SELECT project_id, scan_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, risk_score,
      lag(scan_id) OVER w AS previous_scan_id, round(risk_score - lag(risk_score) OVER w, 8) AS change
    FROM scans WINDOW w AS (PARTITION BY project_id ORDER BY created_at, scan_id)""",
)
def risk_trend(spark: SparkSession, folder: str) -> DataFrame:
    scans = roles.scans(spark, folder).select("project_id", "scan_id", "created_at", "risk_score")
    order = [F.col("created_at"), F.col("scan_id")]
    trend = with_previous(
        scans, ["project_id"], order, {"previous_scan_id": "scan_id", "_previous": "risk_score"}
    )
    change = F.round(F.col("risk_score") - F.col("_previous"), 8).alias("change")
    return trend.select("project_id", "scan_id", _moment("created_at"), "risk_score", "previous_scan_id", change)


@query(
    "rolling_risk",
    f"""WITH {roles.SQL_SCANS}
    SELECT project_id, scan_id, round(avg(risk_score) OVER (PARTITION BY project_id ORDER BY created_at, scan_id
      ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 12) AS rolling_risk FROM scans""",
)
def rolling_risk(spark: SparkSession, folder: str) -> DataFrame:
    scans = roles.scans(spark, folder).select("project_id", "scan_id", "created_at", "risk_score")
    order = [F.col("created_at"), F.col("scan_id")]
    rolled = rolling_mean(scans, ["project_id"], order, "risk_score", 5, "rolling_risk")
    return rolled.select("project_id", "scan_id", F.round("rolling_risk", 12).alias("rolling_risk"))


@query(
    "latest_scan",
    f"""WITH {roles.SQL_SCANS}
    SELECT project_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, scan_id, status, risk_score
    FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, scan_id DESC) AS rn
          FROM scans) WHERE rn = 1""",
)
def latest_scan(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.latest_scan(roles.scans(spark, folder)).withColumn("created_at", _moment("created_at"))


@query(
    "search_projects",
    f"""WITH {roles.SQL_PROJECTS}
    SELECT project_id, name, description, contains(lower(name), '77') OR coalesce(contains(lower(description), '77'),
      false) AS by_number, true AS by_nothing FROM projects
    WHERE contains(lower(name), 'build') OR coalesce(contains(lower(description), 'build'), false)
       OR contains(lower(name), '77')""",
)
def search_projects(spark: SparkSession, folder: str) -> DataFrame:
    projects = roles.projects(spark, folder)
    name, description = F.col("name"), F.col("description")
    by_word = text.contains_text("Build", name, description)
    by_number = text.contains_text("77", name, description)
    by_nothing = text.contains_text("", name, description)
    return projects.where(by_word | by_number).select(
        "project_id", "name", "description", by_number.alias("by_number"), by_nothing.alias("by_nothing")
    )


@query(
    "pr_mean_risk",
    f"""WITH {roles.SQL_SCANS}, {roles.SQL_PROJECTS}, means AS (
      SELECT project_id, coalesce(avg(risk_score), 0) AS m FROM projects LEFT JOIN scans USING (project_id) GROUP BY 1)
    SELECT project_id, round(m, 12) AS mean_risk, {roles.SQL_TIER.format('m')} AS risk_tier FROM means""",
)
def pr_mean_risk(spark: SparkSession, folder: str) -> DataFrame:
    scans = roles.scans(spark, folder).select("project_id", "risk_score")
    means = rollups.mean_risk(scans, ["project_id"], "risk_score").drop("risk_tier")
    # the mean is taken before the join: one row per project meets one row per project
    every = roles.projects(spark, folder).select("project_id").join(means, "project_id", "left")
    mean = F.coalesce("mean_risk", F.lit(0.0))
    return every.select("project_id", F.round(mean, 12).alias("mean_risk"), levels.risk_tier(mean).alias("risk_tier"))


@query(
    "top_risky",
    f"""WITH {roles.SQL_SCANS}
    SELECT scan_id, project_id, risk_score FROM scans ORDER BY risk_score DESC, scan_id LIMIT 20""",
)
def top_risky(spark: SparkSession, folder: str) -> DataFrame:
    scans = roles.scans(spark, folder).select("scan_id", "project_id", "risk_score")
    return scans.orderBy(F.desc("risk_score"), "scan_id").limit(20)


_HALVES = f"""halves AS (
      SELECT project_id, severity || '@' || (epoch(created_at)::BIGINT // 86400 % 7) || ':' || status AS function_key,
             created_at >= TIMESTAMP '{SPLIT}' AS is_current, max(risk_score) AS risk
      FROM scans GROUP BY ALL)"""


def _halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(baseline, current) function scores of every project: scans before and after a date."""
    scans = roles.scans(spark, folder)
    day = F.floor(F.unix_timestamp(F.col("created_at").cast("timestamp")) / 86400) % 7
    key = F.concat("severity", F.lit("@"), day.cast("string"), F.lit(":"), "status").alias("function_key")
    keyed_scans = scans.select("project_id", key, "created_at", "risk_score")
    split = F.lit(SPLIT).cast("timestamp_ntz")

    def best(half: DataFrame) -> DataFrame:
        # grouped by exactly the keys the diff joins on, so the join needs no further shuffle
        return half.groupBy("project_id", "function_key").agg(F.max("risk_score").alias("risk"))

    return best(keyed_scans.where(F.col("created_at") < split)), best(keyed_scans.where(F.col("created_at") >= split))


@query(
    "snapshot_diff",
    f"""WITH {roles.SQL_SCANS}, {_HALVES}
    SELECT project_id, function_key, b.risk AS before, c.risk AS after,
      CASE WHEN b.project_id IS NULL THEN 'added' WHEN c.project_id IS NULL THEN 'removed'
           WHEN b.risk IS NOT DISTINCT FROM c.risk THEN 'unchanged' ELSE 'changed' END AS change
    FROM (SELECT * FROM halves WHERE NOT is_current) b
    FULL JOIN (SELECT * FROM halves WHERE is_current) c USING (project_id, function_key)""",
)
def snapshot_diff(spark: SparkSession, folder: str) -> DataFrame:
    baseline, current = _halves(spark, folder)
    return keyed.snapshot_diff(baseline, current, ["project_id", "function_key"], "risk")


@query(
    "snapshot_diff_by_name",
    f"""WITH {roles.SQL_SCANS}, {_HALVES}, named AS (
      SELECT project_id, split_part(function_key, '@', 1) AS function_key, is_current, max(risk) AS risk
      FROM halves GROUP BY ALL)
    SELECT project_id, function_key, b.risk AS before, c.risk AS after,
      CASE WHEN b.project_id IS NULL THEN 'added' WHEN c.project_id IS NULL THEN 'removed'
           WHEN b.risk IS NOT DISTINCT FROM c.risk THEN 'unchanged' ELSE 'changed' END AS change
    FROM (SELECT * FROM named WHERE NOT is_current) b
    FULL JOIN (SELECT * FROM named WHERE is_current) c USING (project_id, function_key)""",
)
def snapshot_diff_by_name(spark: SparkSession, folder: str) -> DataFrame:
    baseline, current = (
        keyed.by_name(half, ["project_id"], "function_key", "risk") for half in _halves(spark, folder)
    )
    return keyed.snapshot_diff(baseline, current, ["project_id", "function_key"], "risk")


@query(
    "missing_baselines",
    f"""WITH {roles.SQL_SCANS}, {roles.SQL_PROJECTS}, baselines AS (
      SELECT project_id, avg(risk_score) AS baseline_risk FROM scans WHERE created_at < TIMESTAMP '1996-03-01' GROUP BY 1)
    SELECT project_id, round(baseline_risk, 12) AS baseline_risk,
      CASE WHEN baseline_risk IS NULL THEN 'missing' ELSE 'present' END AS baseline
    FROM projects LEFT JOIN baselines USING (project_id)""",
)
def missing_baselines(spark: SparkSession, folder: str) -> DataFrame:
    early = roles.scans(spark, folder).where(F.col("created_at") < F.lit("1996-03-01").cast("timestamp_ntz"))
    baselines = early.groupBy("project_id").agg(F.avg("risk_score").alias("baseline_risk"))
    projects = roles.projects(spark, folder).select("project_id")
    present = keyed.having_baseline(projects, baselines, "project_id")
    found = keyed.with_baseline(present, baselines, "project_id").select(
        "project_id", F.round("baseline_risk", 12).alias("baseline_risk"), F.lit("present").alias("baseline")
    )
    absent = keyed.missing_baselines(projects, baselines, "project_id").select(
        "project_id", F.lit(None).cast("double").alias("baseline_risk"), F.lit("missing").alias("baseline")
    )
    return found.unionByName(absent)


@query(
    "project_id_collisions",
    """SELECT regexp_replace(url, '[^\\p{L}\\p{N}_-]', '_', 'g') AS safe_id, count(DISTINCT url) AS urls,
      count(DISTINCT lower(replace(url, '/', '-'))) AS repos, min(url) AS first_url, max(url) AS last_url
    FROM pages GROUP BY 1""",
)
def project_id_collisions(spark: SparkSession, folder: str) -> DataFrame:
    """Every safe id with the number of different urls (and repository ids) that fall on it; more than one collide."""
    url = F.col("url")
    ids = table(spark, folder, "pages").select("url", text.repo_id(url).alias("repo"), text.safe_id(url).alias("safe_id"))
    # distinct urls first, so that a hot id is combined before it is grouped
    pairs = ids.groupBy("safe_id", "repo", "url").agg(F.lit(1).alias("one"))
    repos = pairs.groupBy("safe_id", "repo").agg(
        F.count(F.lit(1)).alias("n"), F.min("url").alias("low"), F.max("url").alias("high")
    )
    return repos.groupBy("safe_id").agg(
        F.sum("n").alias("urls"), F.count(F.lit(1)).alias("repos"), F.min("low").alias("first_url"), F.max("high").alias("last_url")
    )


_STAMP = "2024-06-01 00:00:00"


@query(
    "upsert_dimension",
    f"""WITH target AS (
      SELECT c_custkey AS user_id, c_custkey * 2 AS github_id, lower(c_name) AS username, c_name AS name,
             lower(c_name) || '@old.example' AS email, 'avatar/' || c_custkey AS avatar_url,
             c_acctbal >= 0 AS is_active, '2020-01-01 00:00:00' AS created_at, '2020-01-01 00:00:00' AS updated_at
      FROM customer),
    incoming AS (
      SELECT s_suppkey * 3 AS github_id, lower(s_name) AS username,
             coalesce(nullif(CASE WHEN s_acctbal < 1000 THEN '' ELSE s_name END, ''), lower(s_name)) AS name,
             CASE WHEN s_acctbal >= 0 THEN lower(s_name) || '@new.example' END AS email, 'avatar/s' || s_suppkey AS avatar_url,
             true AS is_active
      FROM supplier WHERE s_suppkey * 3 <> 0 AND s_nationkey <> 5)
    SELECT coalesce(t.user_id, -i.github_id) AS user_id, coalesce(t.github_id, i.github_id) AS github_id,
      CASE WHEN i.github_id IS NOT NULL THEN i.username ELSE t.username END AS username,
      CASE WHEN i.github_id IS NOT NULL THEN i.name ELSE t.name END AS name,
      CASE WHEN i.github_id IS NOT NULL THEN i.email ELSE t.email END AS email,
      CASE WHEN i.github_id IS NOT NULL THEN i.avatar_url ELSE t.avatar_url END AS avatar_url,
      CASE WHEN i.github_id IS NOT NULL THEN i.is_active ELSE t.is_active END AS is_active,
      CASE WHEN t.github_id IS NULL THEN '{_STAMP}' ELSE t.created_at END AS created_at,
      CASE WHEN i.github_id IS NOT NULL THEN '{_STAMP}' ELSE t.updated_at END AS updated_at,
      CASE WHEN t.github_id IS NULL THEN 'insert' WHEN i.github_id IS NOT NULL THEN 'update' ELSE 'keep' END AS action
    FROM target t FULL JOIN incoming i ON t.github_id = i.github_id""",
)
def upsert_dimension(spark: SparkSession, folder: str) -> DataFrame:
    """Users after a log-in of others: six fields follow the record, new users get an id apart from the serial ones."""
    target = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"),
        (F.col("c_custkey") * 2).alias("github_id"),
        F.lower("c_name").alias("username"),
        F.col("c_name").alias("name"),
        F.concat(F.lower("c_name"), F.lit("@old.example")).alias("email"),
        F.concat(F.lit("avatar/"), F.col("c_custkey").cast("string")).alias("avatar_url"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
        F.lit("2020-01-01 00:00:00").alias("created_at"),
        F.lit("2020-01-01 00:00:00").alias("updated_at"),
    )
    login = F.when(F.col("s_nationkey") != 5, F.lower("s_name"))
    given = F.when(F.col("s_acctbal") < 1000, F.lit("")).otherwise(F.col("s_name"))
    records = table(spark, folder, "supplier").select(
        (F.col("s_suppkey") * 3).alias("github_id"),
        login.alias("username"),
        text.name_or_login(given, login).alias("name"),
        F.when(F.col("s_acctbal") >= 0, F.concat(login, F.lit("@new.example"))).alias("email"),
        F.concat(F.lit("avatar/s"), F.col("s_suppkey").cast("string")).alias("avatar_url"),
        F.lit(True).alias("is_active"),
    )
    accepted, _ = keyed.split_required(records, ["github_id", "username"])
    updated = ["username", "name", "email", "avatar_url", "is_active"]
    return keyed.upsert(target, accepted, "github_id", updated, F.lit(_STAMP), {"user_id": -F.col("github_id")})


@query(
    "comment_upsert",
    """WITH marked AS (SELECT conv_id, min(turn) AS turn FROM conversations WHERE contains(text, 'th') GROUP BY 1),
    posts AS (SELECT conv_id, 'report ' || conv_id AS new_body FROM (SELECT DISTINCT conv_id FROM conversations))
    SELECT c.conv_id, c.turn, md5(CASE WHEN m.conv_id IS NOT NULL THEN p.new_body ELSE c.text END) AS body_md5,
      CASE WHEN m.conv_id IS NOT NULL THEN 'edited' ELSE 'kept' END AS action
    FROM conversations c LEFT JOIN marked m ON c.conv_id = m.conv_id AND c.turn = m.turn JOIN posts p ON p.conv_id = c.conv_id
    UNION ALL
    SELECT p.conv_id, (SELECT max(turn) + 1 FROM conversations c WHERE c.conv_id = p.conv_id), md5(p.new_body), 'created'
    FROM posts p WHERE p.conv_id NOT IN (SELECT conv_id FROM marked)""",
)
def comment_upsert(spark: SparkSession, folder: str) -> DataFrame:
    comments = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    posts = comments.select("conv_id").distinct().withColumn(
        "new_body", F.concat(F.lit("report "), F.col("conv_id").cast("string"))
    )
    after = keyed.comment_upsert(comments, posts, "conv_id", "turn", "text", "th")
    return after.select("conv_id", "turn", F.md5("text").alias("body_md5"), "action")


@query(
    "notifications",
    """SELECT user_id, count(*) FILTER (event_type NOT IN ('view', 'click')) AS unread_count, count(*) AS total_count,
      strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest_at FROM events GROUP BY 1""",
)
def notifications(spark: SparkSession, folder: str) -> DataFrame:
    messages = table(spark, folder, "events").select(
        "user_id", F.col("event_type").isin("view", "click").alias("read"), F.col("ts").alias("created_at")
    )
    counted = rollups.unread(messages, ["user_id"]).withColumn("newest_at", _moment("newest_at"))
    return counted.orderBy(F.desc("newest_at"))


@query(
    "notification_list",
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS position FROM events""",
)
def notification_list(spark: SparkSession, folder: str) -> DataFrame:
    """Every message with its place in its user's list, newest first."""
    messages = table(spark, folder, "events").select("user_id", "event_id", "ts")
    placed = ordinals(messages, ["user_id"], [F.desc("ts"), F.desc("event_id")], "position")
    return placed.select("user_id", "event_id", "position")


@query(
    "json_props",
    """SELECT event_type, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) // 10 AS decile,
      coalesce(json_extract_string(props, '$.missing'), 'none') AS missing, count(*) AS n,
      sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0))::BIGINT AS total
    FROM events GROUP BY ALL""",
)
def json_props(spark: SparkSession, folder: str) -> DataFrame:
    parsed = F.from_json("props", "k BIGINT, missing STRING")
    rows = table(spark, folder, "events").select("event_type", parsed.alias("p"))
    fields = rows.select(
        "event_type",
        F.coalesce("p.k", F.lit(0)).alias("k"),
        F.coalesce("p.missing", F.lit("none")).alias("missing"),
    )
    decile = F.floor(F.col("k") / 10).alias("decile")
    return fields.groupBy("event_type", decile, "missing").agg(
        F.count(F.lit(1)).alias("n"), F.sum("k").alias("total")
    )
