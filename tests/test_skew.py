"""Queries on tables where one key holds a third of all rows."""

from __future__ import annotations

import duckdb
import pytest

from riskloom.plans import ORACLES, QUERIES
from tests.compare import connect, difference

SOURCE = "/root/testdata/sf0.001"
HOT = {
    "lineitem": "* REPLACE (CASE WHEN file_row_number % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey)",
    "orders": "* REPLACE (CASE WHEN file_row_number % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey)",
    "events": "* REPLACE (CASE WHEN file_row_number % 3 = 0 THEN 3 ELSE user_id END AS user_id)",
    "documents": "* REPLACE (CASE WHEN file_row_number % 3 = 0 THEN 'token = \"0123456789\"' ELSE text END AS text)",
}
PLAIN = ["customer", "conversations", "embeddings", "labels"]
NAMES = [
    "risk_trend", "rolling_risk", "sorted_findings_nulls_last", "union_results", "editor_rows", "sarif_documents",
    "pr_markdown", "corpus_ordinals", "first_files", "project_rollup", "latest_scan", "scan_severity_pivot",
    "findings_by_severity_rollup", "snapshot_diff", "drift_trend", "graph_descriptors", "modularity", "fused_risk",
    "notifications", "renyi_discrete", "exact_dedup", "unanalysed_files", "eval_metrics", "stratified_folds",
    "stream_stuck_scans", "stream_session", "stream_unread", "stream_pr_review", "threat_vector",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    target = tmp_path_factory.mktemp("skewed")
    connection = duckdb.connect()
    for name in [*HOT, *PLAIN]:
        chosen = HOT.get(name, "*").replace("* REPLACE", "* EXCLUDE (file_row_number) REPLACE")
        source = f"read_parquet('{SOURCE}/{name}.parquet', file_row_number = true)"
        chosen = chosen if name in HOT else "* EXCLUDE (file_row_number)"
        connection.execute(f"COPY (SELECT {chosen} FROM {source}) TO '{target}/{name}.parquet' (FORMAT parquet)")
    return str(target)


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys_change_no_result(spark, folder, name):
    assert difference(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) is None
