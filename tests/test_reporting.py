"""Report documents, messages and editor rows."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from riskloom.functions import levels, text
from riskloom.operators import keyed, reporting

FINDING = "uri STRING, category STRING, severity STRING, node_path STRING, confidence_score DOUBLE, line_number INT"
REPORT = "uri STRING, function_key STRING, mahalanobis_distance DOUBLE, renyi_z_score DOUBLE"
ORDER = ["line", "message"]


def sarif(spark, threats=(), functions=(), module_z=0.0, uri="src/main.py"):
    artifacts = spark.createDataFrame([(uri,)], "uri STRING")
    results = (
        reporting.security_results(spark.createDataFrame([(uri, *t) for t in threats], FINDING), "uri")
        .unionByName(reporting.function_results(spark.createDataFrame([(uri, *f) for f in functions], REPORT), "uri"))
        .unionByName(
            reporting.module_results(
                spark.createDataFrame([(uri, module_z, 1.0)], "uri STRING, renyi_z_score DOUBLE, mahalanobis_distance DOUBLE"),
                "uri",
            )
        )
    )
    pieces = reporting.sarif_documents(artifacts, results, "uri", [F.col(c) for c in ORDER]).orderBy("ordinal").collect()
    assert [r.ordinal for r in pieces] == list(range(1, len(pieces) + 1))
    return json.loads("".join(r.piece for r in pieces))


def test_empty_report_keeps_its_skeleton(spark):
    document = sarif(spark)
    assert document["version"] == "2.1.0" and "$schema" in document and len(document["runs"]) == 1
    run = document["runs"][0]
    assert run["tool"]["driver"]["name"] == reporting.TOOL_NAME and run["results"] == []


def test_findings_become_results(spark):
    threats = [("weak-hash", "CRITICAL", "md5(salt)", 0.625, 31), ("dynamic-eval", "MEDIUM", 'eval("y")', 0.375, 0)]
    results = sarif(spark, threats)["runs"][0]["results"]
    assert [(r["ruleId"], r["level"]) for r in results] == [("dynamic-eval", "warning"), ("weak-hash", "error")]
    regions = [r["locations"][0]["physicalLocation"] for r in results]
    assert [r["region"]["startLine"] for r in regions] == [1, 31]
    assert regions[0]["artifactLocation"]["uri"] == "src/main.py"
    assert results[0]["message"]["text"] == 'dynamic-eval: eval("y") (confidence=0.38)'


def test_anomaly_gates(spark):
    functions = [("far@17:g", 7.5, 3.25), ("near@4:g", 0.75, 1.25), ("odd", 1.5, float("nan")), ("big@99999999999:g", 1.0, 2.0)]
    results = sarif(spark, functions=functions)["runs"][0]["results"]
    texts = {r["message"]["text"]: r for r in results}
    assert set(texts) == {
        "Structural anomaly in far@17:g (Anomaly Z=3.25, Mahalanobis=7.50)",
        "Structural anomaly in odd (Anomaly Z=NaN, Mahalanobis=1.50)",
        "Structural anomaly in big@99999999999:g (Anomaly Z=2.00, Mahalanobis=1.00)",
    }
    first = texts["Structural anomaly in far@17:g (Anomaly Z=3.25, Mahalanobis=7.50)"]
    assert first["ruleId"] == "structural-anomaly"
    assert first["locations"][0]["physicalLocation"]["region"]["startLine"] == 17
    big = texts["Structural anomaly in big@99999999999:g (Anomaly Z=2.00, Mahalanobis=1.00)"]
    assert big["locations"][0]["physicalLocation"]["region"]["startLine"] == 99999999999
    module = sarif(spark, module_z=2.25)["runs"][0]["results"]
    assert [r["message"]["text"][:12] for r in module] == ["Module-level"]
    assert sarif(spark, module_z=float("nan"))["runs"][0]["results"] == []


def test_an_artifact_has_one_document(spark):
    threats = [("eval", "LOW", f"n{i}", 0.5, i + 1) for i in range(250)]
    results = sarif(spark, threats)["runs"][0]["results"]
    assert [r["locations"][0]["physicalLocation"]["region"]["startLine"] for r in results] == list(range(1, 251))


def test_missing_uri_has_a_default(spark):
    assert sarif(spark, [("eval", "HIGH", "n", 0.5, 1)], uri="")["runs"][0]["results"][0]["locations"][0][
        "physicalLocation"]["artifactLocation"]["uri"] == "analyzed-file"


RESULT = "pr INT, file_path STRING, risk_score DOUBLE, risk_tier STRING, findings_count INT"


def comment(spark, rows, drift=()):
    results = spark.createDataFrame(rows, RESULT)
    drifts = spark.createDataFrame(list(drift), "pr INT, trend STRING, score DOUBLE")
    pieces = reporting.markdown_comments(results, drifts, "pr", [F.col("file_path")]).orderBy("pr", "ordinal").collect()
    return {pr: "".join(r.piece for r in pieces if r.pr == pr) for pr in {r.pr for r in pieces}}


def test_comment_table(spark):
    bodies = comment(spark, [(1, "a/run.py", 0.6875, "HIGH", 12), (1, "b.py", 0.125, None, 0)])
    lines = bodies[1].split("\n")
    assert lines[0].startswith("## ") and lines[1] == "" and lines[2].startswith("| File |")
    assert lines[4] == "| `a/run.py` | 0.6875 | 🟠 HIGH | 12 |"
    assert lines[5] == "| `b.py` | 0.1250 | ⚪ UNKNOWN | 0 |"
    assert lines[6:] == ["", reporting.COMMENT_MARKER]


def test_comment_drift_line(spark):
    bodies = comment(spark, [(1, "a/run.py", 0.6875, "HIGH", 12), (2, "b.py", 0.1, "LOW", 0)], [(1, "DEGRADED", 0.3125)])
    assert bodies[1].split("\n")[-4:] == ["", "**Drift:** DEGRADED ↑ 0.3125 from baseline", "", reporting.COMMENT_MARKER]
    assert "Drift" not in bodies[2]


def test_comment_is_created_or_edited_once(spark):
    marker = reporting.COMMENT_MARKER
    comments = spark.createDataFrame(
        [(1, 0, "hi"), (1, 1, f"{marker} old"), (1, 2, f"{marker} older copy"), (2, 0, "hello")], "pr INT, turn INT, body STRING"
    )
    posts = spark.createDataFrame([(1, "new 1"), (2, "new 2"), (3, "new 3")], "pr INT, new_body STRING")
    after = keyed.comment_upsert(comments, posts, "pr", "turn", "body", marker).collect()
    assert sorted((r.pr, r.turn, r.body, r.action) for r in after) == [
        (1, 0, "hi", "kept"), (1, 1, "new 1", "edited"), (1, 2, f"{marker} older copy", "kept"),
        (2, 0, "hello", "kept"), (2, 1, "new 2", "created"), (3, 0, "new 3", "created"),
    ]


@pytest.mark.parametrize("places", [0, 2, 4])
def test_number_formats_round_like_their_sources(spark, places):
    values = [0.125, 2.5, 0.03125, 0.22585, 1234567.891, -0.001, 0.5, 1.5, 0.045, 1e-7, 99.995]
    rows = spark.createDataFrame([(v,) for v in values], "x DOUBLE").select(
        "x", text.fixed(F.col("x"), places).alias("even"), text.fixed_half_up(F.col("x"), places).alias("up"),
        text.round_half_even(F.col("x"), places).alias("r"),
    ).collect()
    for row in rows:
        assert row.even == f"{row.x:.{places}f}"
        assert row.r == round(row.x, places)
        tie = (row.x * 2 ** (places + 1)) % 2 == 1
        expected = math.floor(row.x * 10**places + 0.5) / 10**places if tie else row.x
        assert row.up == f"{expected:.{places}f}"


def test_function_key_lines(spark):
    keys = {"a@12:f": 12, "a": 1, "a@": 1, "a@x": 1, "a@ 7 :f": 7, "a@+3": 3, "a@1_0:b@9": 10, "a@-4": -4, "a@1__0": 1,
            "a@5@6": 5, "": 1, "a@\t8\n:x": 8}
    rows = spark.createDataFrame([(k, v) for k, v in keys.items()], "k STRING, line INT").select(
        "k", "line", text.key_line(F.col("k")).alias("found")
    ).collect()
    assert {r.k: r.found for r in rows} == keys


def test_levels_stay_apart(spark):
    rows = spark.createDataFrame([("CRITICAL",), ("HIGH",), ("high",), (None,), ("ODD",)], "s STRING").select(
        levels.report_level(F.col("s")).alias("report"), levels.editor_level(F.col("s")).alias("editor"),
        levels.tier_symbol(F.col("s")).alias("symbol"),
    ).collect()
    assert [r.report for r in rows] == ["error", "error", "warning", "warning", "warning"]
    assert [r.editor for r in rows] == ["Error", "Warning", "Information", "Information", "Information"]
    assert [r.symbol for r in rows] == ["🔴", "🟠", "🟠", "⚪", "⚪"]


def test_tiers_and_bands(spark):
    tiers = [0.0, 0.2999, 0.3, 0.5, 0.6999, 0.7, 1.0]
    rows = spark.createDataFrame([(t,) for t in tiers], "x DOUBLE")
    assert [r.t for r in rows.select(levels.risk_tier(F.col("x")).alias("t")).collect()] == [
        "LOW", "LOW", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL"]
    bands = spark.createDataFrame([(b,) for b in [3.9, 3.95, 6.9, 8.9, 9.0]], "x DOUBLE")
    assert [r.t for r in bands.select(levels.risk_band(F.col("x")).alias("t")).collect()] == [
        "Low", "Medium", "Medium", "High", "Critical"]


def test_ids(spark):
    row = spark.createDataFrame([("proj/one:two", "Owner/Repo"), ], "a STRING, b STRING").select(
        text.safe_id(F.col("a")).alias("a"), text.repo_id(F.col("b")).alias("b"),
        text.safe_id(F.lit("é-9_Ж²")).alias("u"),
    ).first()
    assert (row.a, row.b, row.u) == ("proj_one_two", "owner-repo", "é-9_Ж²")


def test_small_strings(spark):
    row = spark.range(1).select(
        text.plural(F.lit(1), "project").alias("one"), text.plural(F.lit(0), "project").alias("none"),
        text.capitalised(F.lit("running")).alias("cap"), text.capitalised(F.lit("")).alias("empty"),
        text.name_or_login(F.lit(""), F.lit("me")).alias("login"),
        text.stripped(F.lit("\t\n key \u00a0\r\n")).alias("secret"),
        text.utc_iso(F.timestamp_seconds(F.lit(0))).alias("iso"),
        text.editor_message(F.lit("HIGH"), F.lit("c"), F.lit("n"), F.lit(0.125)).alias("editor"),
        text.hover_text(F.lit("HIGH"), F.lit("c"), F.lit("n")).alias("hover"),
        text.status_line(F.lit(0.125), F.lit("LOW")).alias("status"),
    ).first()
    assert (row.one, row.none, row.cap, row.empty, row.login) == ("1 project", "0 projects", "Running", "", "me")
    assert row.secret == "key"
    assert row.iso.startswith("1970-01-01T00:00:00.000000")
    assert row.editor == "[HIGH] c | n | confidence 13%" and row.hover == "[HIGH] c: n" and row.status == "0.13 [LOW]"


def test_pretty_and_compact_reports(spark):
    reports = spark.createDataFrame([("a.py", 0.5, ["x"], None)], "path STRING, score DOUBLE, tags ARRAY<STRING>, n INT")
    row = reports.select(reporting.report_json(reports).alias("c"), reporting.report_json(reports, True).alias("p")).first()
    assert row.c == '{"path":"a.py","score":0.5,"tags":["x"],"n":null}'
    assert "\n" in row.p and json.loads(row.p) == json.loads(row.c)


def test_table_order(spark):
    rows = spark.createDataFrame([(1, "b"), (2, None), (3, "A"), (None, "c")], "n INT, s STRING")
    more = spark.createDataFrame([("zeta", "9.50"), ("école", "100.00"), ("Eclair", "10.50"), ("eclair", None)], "s STRING, d STRING")
    more = more.select("s", F.col("d").cast("decimal(8,2)").alias("d"))
    listed_more = lambda c: [r[c] for r in more.orderBy(*reporting.table_order(more, [(c, "asc")])).collect()]
    assert listed_more("s") == ["eclair", "Eclair", "école", "zeta"]
    assert [float(x) if x else None for x in listed_more("d")] == [9.5, 10.5, 100.0, None]

    def listed(column, direction):
        return [r[column] for r in rows.orderBy(*reporting.table_order(rows, [(column, direction)])).collect()]

    assert listed("n", "asc") == [1, 2, 3, None] and listed("n", "desc") == [3, 2, 1, None]
    assert listed("s", "asc") == ["A", "b", "c", None] and listed("s", "desc") == ["c", "b", "A", None]
