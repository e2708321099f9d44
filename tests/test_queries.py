"""Every registered query against its SQL check on the small tables."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest

import __spark_entry__ as entry_points
from tests.compare import connect, difference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    return connect(FOLDER)


def test_every_check_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, tables, name):
    assert difference(QUERIES[name](spark, FOLDER), tables, ORACLES[name]) is None


def test_entry_has_rows(spark):
    rows = entry_points.entry(spark).collect()
    assert len(rows) == 1 and rows[0].total_files > 0


def test_full_mahalanobis_mean_is_exact(spark):
    distances = np.array([r.distance for r in QUERIES["mahalanobis_full"](spark, FOLDER).collect()])
    n = len(distances)
    assert math.isclose((distances**2).mean(), 64 * (n - 1) / n, rel_tol=1e-4)


def test_spectral_estimates_match_numpy(spark):
    from riskloom.plans.scoring import settled_graphs

    edges, nodes = settled_graphs(spark, FOLDER)
    members, pairs = {}, {}
    for r in nodes.collect():
        members.setdefault(r.graph_id, []).append(r.node)
    for r in edges.collect():
        pairs.setdefault(r.graph_id, []).append((r.src, r.dst))
    rows = {r.graph_id: r for r in QUERIES["spectral_estimates"](spark, FOLDER).collect()}
    assert set(rows) == set(members)
    for g, names in members.items():
        at, lap = {n: i for i, n in enumerate(names)}, np.zeros((len(names), len(names)))
        for a, b in pairs.get(g, []):
            lap[at[a], at[b]] = lap[at[b], at[a]] = -1.0
        lap -= np.diag(lap.sum(axis=1))
        values = np.linalg.eigvalsh(lap)
        assert abs(rows[g].lambda_max - values[-1]) < 2e-5
        assert abs(rows[g].lambda_2 - (values[1] if len(names) > 1 else 0.0)) < 2e-5


def test_feature_vectors_have_fourteen_entries(spark):
    rows = QUERIES["graph_spectral_vectors"](spark, FOLDER).groupBy("graph_id").count().collect()
    assert rows and {r["count"] for r in rows} == {14}
