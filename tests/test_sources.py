"""Corpus folders, CSV, snapshots, relational options, plug-in scanners, keyed operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskloom.functions import scanner
from riskloom.operators import keyed
from riskloom.operators.findings import scan
from riskloom.session import checkpoint_root, shared_dir
from riskloom.sources import files, models, relational, results, snapshots, store


def test_corpus_scan(spark, tmp_path):
    (tmp_path / "a" / "Command Injection").mkdir(parents=True)
    (tmp_path / "a-b").mkdir()
    (tmp_path / "a" / "Command Injection" / "x.py").write_bytes(b"one\r\ntwo\rthree\n")
    (tmp_path / "a-b" / "y.py").write_bytes(b"\xff\xfe bad")
    (tmp_path / "a" / "z.py").write_text("é\n", encoding="utf-8")
    (tmp_path / "a" / "skip.txt").write_text("no")
    rows = files.read_corpus(spark, str(tmp_path)).orderBy(files.path_order(F.col("path"))).collect()
    assert [r.path for r in rows] == ["a/Command Injection/x.py", "a/z.py", "a-b/y.py"]
    assert [r.valid for r in rows] == [True, True, False]
    assert [r.text for r in rows] == ["one\ntwo\nthree\n", "é\n", None]
    labels = files.read_corpus(spark, str(tmp_path), "*").select(
        "path", files.category_of(F.col("path")).alias("c"), files.language_of(F.col("path")).alias("l")
    ).collect()
    assert {r.path: (r.c, r.l) for r in labels}["a/Command Injection/x.py"] == ("Command Injection", "python")
    assert {r.path: r.l for r in labels}["a/skip.txt"] == "other"


def test_unreadable_files_become_error_rows_and_are_left_out_on_read(spark, tmp_path):
    good = spark.createDataFrame([("b/x.py", 0.123456, 2, 1, "LOW"), ('a "q",\n.py', 0.5, 0, 0, None)], results.CSV_SCHEMA)
    failed = spark.createDataFrame([("c.py",)], "file_path STRING")
    target = str(tmp_path / "out")
    results.write_csv(results.with_errors(good, failed).coalesce(1).where("file_path <> 'x'"), target)
    raw = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert raw.startswith(",".join(results.CSV_COLUMNS)) and "c.py,0.0,0,0,ERROR" in raw and "b/x.py,0.1235,2,1,LOW" in raw
    rows = {r.file_path: r for r in results.read_csv(spark, target).collect() if r.file_path == "b/x.py"}
    assert rows["b/x.py"].risk_score == 0.1235 and rows["b/x.py"].security_findings_count == 2
    assert results.read_csv(spark, target).where("risk_tier = 'ERROR'").count() == 0


def snapshot(spark, rows):
    return spark.createDataFrame(rows, "project_id STRING, score DOUBLE")


def test_snapshot_save_load(spark, tmp_path):
    target, schema = str(tmp_path / "s"), "project_id STRING, score DOUBLE"
    snapshots.save(snapshot(spark, [("proj/one:two", 0.1), ("b", 0.2)]), target, 1)
    snapshots.save(snapshot(spark, [("b", 0.7)]), target, 2)
    assert snapshots.load(spark, target, schema, "proj/one:two").first().score == 0.1
    assert snapshots.load(spark, target, schema, "b").first().score == 0.7
    snapshots.save(snapshot(spark, [("b", 0.9)]), target, 2)
    assert {r.safe_id: r.score for r in snapshots.load_all(spark, target, schema).collect()} == {
        "proj_one_two": 0.1, "b": 0.9}
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, target, schema, "does-not-exist")


def test_dropped_functions_stay_dropped(spark, tmp_path):
    target, projects = str(tmp_path / "f"), str(tmp_path / "p")
    schema = "project_id STRING, function_key STRING, n INT"
    first = spark.createDataFrame([("p", "a@1", 1), ("p", "b@2", 2), ("q", "c@3", 3), ("r", "d@4", 4)], schema)
    snapshots.save(first, target, 1)
    snapshots.save(snapshot(spark, [("p", 0.1), ("q", 0.2), ("r", 0.3)]), projects, 1)
    snapshots.save(spark.createDataFrame([("p", "a@1", 5)], schema), target, 2)
    snapshots.save(snapshot(spark, [("p", 0.1), ("r", 0.3)]), projects, 2)  # r has no functions any more
    rows = snapshots.load_functions(spark, target, schema, projects).collect()
    assert {(r.safe_id, r.function_key, r.n) for r in rows} == {("p", "a@1", 5), ("q", "c@3", 3)}


def test_compaction_keeps_the_current_state(spark, tmp_path):
    source, target, schema = str(tmp_path / "s"), str(tmp_path / "t"), "project_id STRING, score DOUBLE"
    for version in (1, 2, 3):
        snapshots.save(snapshot(spark, [("a", 0.1 * version), (f"b{version}", 0.5)]), source, version)
    snapshots.compact(spark, source, schema, target)
    expected = sorted(map(tuple, snapshots.load_all(spark, source, schema).collect()))
    assert sorted(map(tuple, snapshots.load_all(spark, target, schema).collect())) == expected
    assert [p.name for p in (tmp_path / "t").glob("version=*")] == ["version=3"]


def test_snapshot_defaults(spark):
    ids = spark.createDataFrame([(1,)], "project_id BIGINT")
    security = spark.createDataFrame([], "project_id BIGINT, severity_counts MAP<STRING, BIGINT>, total_threats BIGINT")
    vectors = spark.createDataFrame(
        [], "project_id BIGINT, aggregate_56d ARRAY<DOUBLE>, anomaly_16d ARRAY<DOUBLE>, threat_18d ARRAY<DOUBLE>")
    risk = spark.createDataFrame([], "project_id BIGINT, unified_risk_score DOUBLE, risk_tier STRING")
    row = snapshots.build(ids, security, vectors, risk).first()
    assert row.security.severity_counts == {} and row.security.total_threats == 0
    assert (len(row.vectors.aggregate_56d), len(row.vectors.anomaly_16d), len(row.vectors.threat_18d)) == (56, 16, 18)
    assert (row.risk.unified_risk_score, row.risk.risk_tier) == (0.0, "LOW")


def test_stored_results_are_reused_by_content(spark):
    sources = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id INT, text STRING")
    known = sources.where("id = 1").select(keyed.content_key(F.col("text")).alias("content_key"))
    assert [r.id for r in keyed.unanalysed(sources, known, "text").collect()] == [2]
    other_rules = sources.select(keyed.content_key(F.col("text"), "2").alias("content_key"))
    assert keyed.unanalysed(sources, other_rules, "text").count() == 3


def test_upsert_and_required_fields(spark):
    schema = "user_id INT, github_id INT, username STRING, name STRING, created_at STRING, updated_at STRING"
    target = spark.createDataFrame([(1, 10, "a", "A", "t0", "t0"), (2, 20, "b", "B", "t0", "t0")], schema)
    incoming = spark.createDataFrame(
        [(10, "a2", "New"), (30, "c", "C"), (0, "z", "Z"), (None, "y", "Y"), (40, None, "X"), (50, "", "W")],
        "github_id INT, username STRING, name STRING")
    accepted, rejected = keyed.split_required(incoming, ["github_id", "username"])
    assert (accepted.count(), rejected.count()) == (2, 4)
    rows = {r.github_id: r for r in keyed.upsert(target, accepted, "github_id", ["username", "name"], F.lit("t1")).collect()}
    assert (rows[10].user_id, rows[10].username, rows[10].created_at, rows[10].updated_at) == (1, "a2", "t0", "t1")
    assert (rows[20].username, rows[20].updated_at, rows[20].action) == ("b", "t0", "keep")
    assert (rows[30].user_id, rows[30].created_at, rows[30].action) == (None, "t1", "insert")
    twice = spark.createDataFrame([(30, "c", "C"), (30, "c", "D")], "github_id INT, username STRING, name STRING")
    new = keyed.upsert(target, twice, "github_id", ["username", "name"], F.lit("t1"), {"user_id": -F.col("github_id")})
    assert [(r.user_id, r.name) for r in new.where("github_id = 30").collect()] == [(-30, "D")]


def test_latest_per_key(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "z")], "k INT, t INT, v STRING")
    assert {(r.k, r.t, r.v) for r in keyed.latest_per_key(rows, "k", ["t"]).collect()} == {(1, 3, "c"), (2, 1, "z")}


def test_diff_treats_nulls_as_equal(spark):
    before = spark.createDataFrame([("p", "a", 1.0), ("p", "b", None), ("p", "c", 2.0)], "p STRING, k STRING, v DOUBLE")
    after = spark.createDataFrame([("p", "a", 1.5), ("p", "b", None), ("p", "d", 2.0)], "p STRING, k STRING, v DOUBLE")
    rows = {r.k: r.change for r in keyed.snapshot_diff(before, after, ["p", "k"], "v").collect()}
    assert rows == {"a": "changed", "b": "unchanged", "c": "removed", "d": "added"}


def test_moved_function_keeps_its_name_key(spark):
    before = spark.createDataFrame([("p", "f@1:x", 1.0)], "p STRING, k STRING, v DOUBLE")
    after = spark.createDataFrame([("p", "f@9:x", 1.0)], "p STRING, k STRING, v DOUBLE")
    assert keyed.snapshot_diff(before, after, ["p", "k"], "v").count() == 2
    named = [keyed.by_name(side, ["p"], "k", "v") for side in (before, after)]
    assert [r.change for r in keyed.snapshot_diff(*named, ["p", "k"], "v").collect()] == ["unchanged"]


def test_plug_in_scanner(spark):
    sources = spark.createDataFrame([(1, "x = 1\nTODO later\n"), (2, None)], "id INT, text STRING")

    def todo(text):
        for number, line in enumerate(text.split("\n"), 1):
            if "TODO" in line:
                yield number, "todo", "LOW", 1.0, line

    scanner.register(spark, "todo_scanner", todo)
    rows = scanner.scan_with(sources, "todo_scanner", "id", "text").collect()
    assert [(r.id, r.line_number, r.category) for r in rows] == [(1, 2, "todo")]


def test_rule_scan_edge_cases(spark):
    sources = spark.createDataFrame(
        [(1, ""), (2, None), (3, "eval(x); eval(y)\n\neval(z)"), (4, "EVAL(x)")], "id INT, text STRING")
    rows = scan(sources, "id", "text").collect()
    assert sorted((r.id, r.line_number, r.node_path) for r in rows) == [(3, 1, "eval("), (3, 3, "eval(")]


def test_rules_and_plug_in_agree_on_odd_lines(spark):
    gap = " x" * 200
    texts = [
        f'select a{gap} from t{gap} where x = "" + y', 'select a from t where x = \r "" + y\r\n', "\u2028eval(x)\u0085 eval(y)",
        "\u00ebeval(x)", "shell\x0b=\x0bTrue", "shell\u00a0=\u00a0True", 'select a\u2028from t where x = "" % y', "_eval(x) 1.2.3.4\u0663",
    ]
    sources = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    scanner.register(spark, "odd_scanner", scanner.rule_scanner())
    columns = ["id", "line_number", "category", "severity", "confidence_score", "node_path"]
    by_rules = sorted(map(tuple, scan(sources, "id", "text").select(columns).collect()))
    by_plug_in = sorted(map(tuple, scanner.scan_with(sources, "odd_scanner", "id", "text").select(columns).collect()))
    assert by_rules == by_plug_in
    assert {r[0] for r in by_rules if r[2] == "sql-injection"} == {0, 1, 6}
    assert {r[0] for r in by_rules if r[2] == "dynamic-eval"} == {2, 3} and {r[0] for r in by_rules if r[3] == "HIGH"} == {4}
    assert not [v.name for v in spark.catalog.listTables() if v.name.startswith("odd_scanner")]


def test_rules_from_a_table(spark):
    from riskloom.operators.findings import RULE_TABLE

    rules = spark.createDataFrame([("todo", "LOW", 1.0, "TODO.*", None)], RULE_TABLE)
    rows = scan(spark.createDataFrame([(1, "a\nTODO b")], "id INT, text STRING"), "id", "text", rules).collect()
    assert [(r.line_number, r.category, r.node_path) for r in rows] == [(2, "todo", "TODO b")]


def test_relational_reader_is_partitioned(spark):
    assert relational.RANGE_COLUMNS["scans"] == "scan_id"
    with pytest.raises(Exception, match="(?i)driver|class"):
        relational.read_table(spark, "jdbc:none://nowhere", "scans", (0, 10), 4)


def test_shared_folder_follows_the_session(spark):
    assert shared_dir(spark, "x").startswith(checkpoint_root(spark))
    assert shared_dir(spark, "x") != shared_dir(spark, "x")


def test_analysis_is_reused_between_runs(spark, tmp_path):
    target, schema, seen = str(tmp_path / "store"), "content_key STRING, size INT", []

    def analyse(contents):
        seen.append(sorted(r.text for r in contents.collect()))
        return contents.select("content_key", F.length("text").alias("size"))

    def run(rows, rule_set="1"):
        sources = spark.createDataFrame(rows, "id INT, text STRING")
        found = store.analysed(sources, "id", "text", target, schema, analyse, rule_set)
        return {(r.id, r.size) for r in found.collect()}

    first = run([(1, "a"), (2, "bb"), (3, "a")])
    assert first == {(1, 1), (2, 2), (3, 1)} and run([(1, "a"), (2, "bb"), (3, "a")]) == first
    assert run([(1, "a"), (4, "ccc")]) == {(1, 1), (4, 3)}
    run([(1, "a")], rule_set="2")
    assert seen == [["a", "bb"], [], ["ccc"], ["a"]]


def test_table_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert store.built_once(spark, str(tmp_path / "t"), "id BIGINT", build).count() == 3
    assert calls == [1]


def test_report_records(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        '{"file_path": "a.py", "unified_risk_score": 0.5,\n "fusion_weights": [0.2, 0.3, 0.5],'
        ' "security_findings": [{"severity": "HIGH", "line_number": 3}, {"severity": "LOW"}]}'
    )
    reports = models.read_records(spark, str(tmp_path / "r.json"), "reports", multiline=True)
    assert [(r.file_path, r.severity, r.line_number) for r in models.report_findings(reports).collect()] == [
        ("a.py", "HIGH", 3), ("a.py", "LOW", None)]
    assert models.report_functions(reports).count() == 0
