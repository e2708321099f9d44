"""Closed forms, contracts and metamorphic checks of statistics, graphs, fusion and drift."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import levels
from riskloom.operators import drift, evaluation, fusion, graphs, keyed, rollups, spectral
from riskloom.operators import statistics as stats
from riskloom.operators.findings import scan, security_summary


def path(n):
    return [(i, i + 1) for i in range(n - 1)]


def cycle(n):
    return [*path(n), (n - 1, 0)]


def complete(n):
    return [(i, j) for i in range(n) for j in range(i)]


GRAPHS = {1: (path(6), 6), 2: (cycle(6), 6), 3: (complete(5), 5), 4: (path(40), 40), 5: ([(0, 1), (2, 3)], 5), 6: ([], 1)}


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(g, a, b) for g, (pairs, _) in GRAPHS.items() for a, b in pairs]
    # noise a simple graph must lose: both directions, a loop, a repeated edge
    rows += [(1, 1, 0), (1, 2, 2), (2, 0, 1)]
    return graphs.simple_edges(spark.createDataFrame(rows, "graph_id BIGINT, src BIGINT, dst BIGINT"))


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(g, i) for g, (_, n) in GRAPHS.items() for i in range(n)]
    return spark.createDataFrame(rows, "graph_id BIGINT, node BIGINT")


def laplacian(pairs, n):
    a = np.zeros((n, n))
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    return np.diag(a.sum(1)) - a, a


def test_descriptors(edges, nodes):
    found = {r.graph_id: r for r in graphs.descriptors(edges, nodes).collect()}
    for g, (pairs, n) in GRAPHS.items():
        lap, _ = laplacian(pairs, n)
        row = found[g]
        assert (row.order, row.size) == (n, len(pairs))
        assert row.trace_l == np.trace(lap) and row.trace_l2 == np.trace(lap @ lap)
        assert math.isclose(row.degree_variance, np.diag(lap).var(), abs_tol=1e-12)
        assert math.isclose(row.energy_bound, math.sqrt(2 * len(pairs) * n))
    assert found[3].density == 1.0 and found[6].density == 0.0 and found[1].leaves == 2


def test_components(edges, nodes):
    counts = {r.graph_id: r.components for r in graphs.component_counts(graphs.components(edges, nodes)).collect()}
    assert counts == {1: 1, 2: 1, 3: 1, 4: 1, 5: 3, 6: 1}


def test_components_of_a_shuffled_path_need_few_rounds(spark):
    names = np.random.default_rng(1).permutation(600).tolist()
    pairs = [(1, a, b) for a, b in zip(names[:399], names[1:400], strict=True)] + [(1, a, b) for a, b in zip(names[400:-1], names[401:], strict=True)]
    simple = graphs.simple_edges(spark.createDataFrame(pairs, "graph_id BIGINT, src BIGINT, dst BIGINT"))
    members = spark.createDataFrame([(1, n) for n in names], "graph_id BIGINT, node BIGINT")
    found = graphs.components(simple, members).groupBy("label").count().collect()
    assert {(r.label, r["count"]) for r in found} == {(min(names[:400]), 400), (min(names[400:]), 200)}


def test_modularity_of_two_cliques(spark):
    pairs = [(1, a, b) for a, b in complete(4)] + [(1, a + 4, b + 4) for a, b in complete(4)] + [(1, 0, 4)]
    simple = graphs.simple_edges(spark.createDataFrame(pairs, "graph_id BIGINT, src BIGINT, dst BIGINT"))
    sides = spark.createDataFrame([(1, i, i // 4) for i in range(8)], "graph_id BIGINT, node BIGINT, community BIGINT")
    q = graphs.modularity(simple, sides).first().modularity
    assert math.isclose(q, 12 / 13 - 2 * (13 / 26) ** 2)


@pytest.fixture(scope="module")
def spectra(spark, edges, nodes):
    """Extremes of the small graphs, a longer path and a wheel, all in one run."""
    more = [(20, i, i + 1) for i in range(23)]
    more += [(21, i, (i + 1) % 30) for i in range(30)] + [(21, 30, i) for i in range(30)]
    longer = graphs.simple_edges(spark.createDataFrame(more, "graph_id BIGINT, src BIGINT, dst BIGINT"))
    all_edges = edges.unionByName(longer.select([F.col(c).cast(t) for c, t in edges.dtypes]))
    ends = longer.select("graph_id", "src").union(longer.select("graph_id", "dst")).distinct().toDF("graph_id", "node")
    all_nodes = nodes.unionByName(ends.select([F.col(c).cast(t) for c, t in nodes.dtypes]))
    counts = graphs.component_counts(graphs.components(all_edges, all_nodes))
    return {r.graph_id: r for r in spectral.extremes(all_edges, all_nodes, counts).collect()}


def test_extremes_match_numpy(spectra):
    for g, (pairs, n) in GRAPHS.items():
        values = np.linalg.eigvalsh(laplacian(pairs, n)[0])
        assert abs(spectra[g].lambda_max - values[-1]) < 1e-6
        second = values[1] if n > 1 else 0.0
        assert abs(spectra[g].lambda_2 - second) < 1e-6, g


def test_extremes_of_large_graphs_converge(spectra):
    assert abs(spectra[20].lambda_2 - (2 - 2 * math.cos(math.pi / 24))) < 1e-6
    assert abs(spectra[20].lambda_max - (2 + 2 * math.cos(math.pi / 24))) < 1e-6
    assert abs(spectra[21].lambda_2 - (3 - 2 * math.cos(2 * math.pi / 30))) < 1e-6
    assert abs(spectra[21].lambda_max - 31) < 1e-6


def frames(spark, found):
    rows = [(g, min(a, b), max(a, b)) for g, (pairs, _) in found.items() for a, b in pairs]
    simple = spark.createDataFrame(rows, "graph_id BIGINT, src BIGINT, dst BIGINT").distinct()
    members = spark.createDataFrame([(g, i) for g, (_, n) in found.items() for i in range(n)], "graph_id BIGINT, node BIGINT")
    return simple, members


def test_low_spectrum_fiedler_and_energy_of_small_graphs(spark, edges, nodes):
    found = {}
    for r in spectral.low_spectrum(edges, nodes).orderBy("rank").collect():
        found.setdefault(r.graph_id, []).append(r.value)
    entries = {}
    for r in spectral.fiedler_vectors(edges, nodes).collect():
        entries.setdefault(r.graph_id, {})[r.node] = r.value
    energy = {r.graph_id: r for r in spectral.energies(edges, nodes).collect()}
    for g, (pairs, n) in GRAPHS.items():
        lap, adjacency = laplacian(pairs, n)
        values = np.linalg.eigvalsh(lap)
        assert np.allclose(found[g], values[:20], atol=1e-9)
        assert math.isclose(energy[g].energy, np.abs(np.linalg.eigvalsh(adjacency)).sum(), abs_tol=1e-9)
        if n > 1:
            vector = np.array([entries[g][i] for i in range(n)])
            assert np.allclose(lap @ vector, values[1] * vector, atol=1e-9) and math.isclose(vector @ vector, 1.0)
        else:
            assert g not in entries
    assert math.isclose(energy[3].energy, 8.0)  # 2 (n - 1) on a complete graph


def test_ends_of_large_graphs_against_closed_forms(spark):
    n = 700
    shuffled = np.random.default_rng(3).permutation(n).tolist()
    long_path = [(shuffled[a], shuffled[b]) for a, b in path(n)]
    found = {1: (long_path, n), 2: (cycle(400), 400), 3: ([(0, i) for i in range(1, 400)], 400)}
    simple, members = frames(spark, found)
    values, errors = {}, {}
    for r in spectral.low_spectrum(simple, members, wanted=4, dense=300).orderBy("rank").collect():
        values.setdefault(r.graph_id, []).append(r.value)
        errors.setdefault(r.graph_id, []).append(r.error)
    closed = {
        1: [2 - 2 * math.cos(math.pi * k / n) for k in range(4)],
        2: [2 - 2 * math.cos(2 * math.pi * ((k + 1) // 2) / 400) for k in range(4)],
        3: [0.0] + [1.0] * 3,
    }
    for g, expected in closed.items():
        assert np.allclose(values[g], expected, atol=2e-5), (g, values[g], expected)
        assert max(errors[g]) < 1e-2


def test_a_large_graph_of_many_components(spark):
    simple, members = frames(spark, {1: ([(0, 1), (2, 3)], 90)})
    found = spectral.low_spectrum(simple, members, wanted=3, dense=30).collect()
    assert len(found) == 3 and all(abs(r.value) < 1e-9 for r in found)


def test_fiedler_and_energy_of_large_graphs(spark):
    rng = np.random.default_rng(5)
    sides = [(a, b) for s in (0, 80) for a in range(s, s + 80) for b in range(s, a) if rng.random() < 0.2]
    pairs = [*sides, (3, 90), (7, 130)]
    simple, members = frames(spark, {1: (pairs, 160)})
    lap, adjacency = laplacian(pairs, 160)
    entries = {r.node: r.value for r in spectral.fiedler_vectors(simple, members, dense=40).collect()}
    vector = np.array([entries[i] for i in range(160)])
    exact = np.linalg.eigh(lap)[1][:, 1]
    assert math.isclose(abs(vector @ exact), 1.0, abs_tol=1e-6)
    energy = spectral.energies(simple, members, dense=40, moments=6).first()
    assert abs(energy.energy - np.abs(np.linalg.eigvalsh(adjacency)).sum()) <= energy.error < 0.5 * energy.energy
    ends = spectral.extremes(simple, members, dense=40).first()
    exact_values = np.linalg.eigvalsh(lap)
    assert abs(ends.lambda_2 - exact_values[1]) < 1e-5 and abs(ends.lambda_max - exact_values[-1]) < 1e-4


def test_triangles_match_a_plain_count(spark, edges, nodes):
    found = {r.graph_id: r.triangles for r in graphs.triangle_counts(edges, nodes).collect()}
    for g, (pairs, n) in GRAPHS.items():
        adjacency = laplacian(pairs, n)[1]
        assert found[g] == round(np.trace(adjacency @ adjacency @ adjacency) / 6)


def test_mahalanobis_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id INT, v ARRAY<DOUBLE>")
    population = stats.fit_full(df, "v")
    centred = x - x.mean(0)
    full = np.sqrt(np.einsum("ij,jk,ik->i", centred, np.linalg.inv(np.cov(x.T)), centred))
    diagonal = np.sqrt((centred**2 / x.var(0, ddof=1)).sum(1))
    rows = df.select(
        "id",
        stats.mahalanobis_full(F.col("v"), population).alias("full"),
        stats.mahalanobis_diagonal(F.col("v"), population).alias("diagonal"),
    ).orderBy("id").collect()
    assert np.allclose([r.full for r in rows], full) and np.allclose([r.diagonal for r in rows], diagonal)


def test_constant_dimension_contributes_nothing(spark):
    df = spark.createDataFrame([(float(i), [float(i), 7.0]) for i in range(5)], "id DOUBLE, v ARRAY<DOUBLE>")
    population = stats.fit_full(df, "v")
    rows = df.select(stats.mahalanobis_diagonal(F.col("v"), population).alias("d"),
                     stats.mahalanobis_full(F.col("v"), population).alias("f")).collect()
    assert all(math.isclose(r.d, r.f, abs_tol=1e-9) for r in rows)


def test_entropies(spark):
    df = spark.createDataFrame([([1.0, -1.0, 1.0, 1.0],), ([0.0, 0.0, 0.0, 0.0],), ([3.0, 0.0, 0.0, 0.0],)],
                               "v ARRAY<DOUBLE>")
    second = [r.h for r in df.select(stats.renyi_of_vector(F.col("v")).alias("h")).collect()]
    first = [r.h for r in df.select(stats.renyi_of_vector(F.col("v"), 1).alias("h")).collect()]
    assert np.allclose(second, [math.log(4), 0, 0]) and np.allclose(first, [math.log(4), 0, 0])


def test_score_is_half_exactly_at_the_gate(spark):
    rows = spark.createDataFrame([(0.5,), (1.5,), (2.0,), (2.5,), (float("nan"),)], "z DOUBLE").select(
        (stats.anomaly_score(F.col("z")) >= 0.5).alias("raw"),
        levels.scored_anomaly(stats.anomaly_score(F.col("z"))).alias("scored"),
        levels.function_anomaly(F.col("z")).alias("function"),
        levels.module_anomaly(F.col("z")).alias("module"),
    ).collect()
    assert [r.scored for r in rows] == [False, True, True, True, False]
    assert [r.function for r in rows] == [False, True, True, True, True]
    assert [r.module for r in rows] == [False, True, True, True, False]


VULNERABLE = 'import os\n\ndef connect():\n    password = "SuperSecret123!"\n    return password\n'
CLEAN = "def add(a, b):\n    return a + b\n\ndef subtract(a, b):\n    return a - b\n"
RISKY = "def bar(user_input):\n    eval(user_input)\n    os.system(user_input)\n    return user_input\n"


def scored(spark, sources):
    files = spark.createDataFrame(list(sources.items()), "path STRING, text STRING")
    found = security_summary(scan(files, "path", "text"), ["path"])
    none = F.lit(None).cast("double")
    signals = files.select("path").join(found, "path", "left").na.fill(0, ["findings"]).na.fill(0.0, ["security_score"])
    return fusion.fuse(signals.select("*", none.alias("analyzer_score"), none.alias("validator_score")))


def test_vulnerable_and_clean_files(spark):
    rows = {r.path: r for r in scored(spark, {"v": VULNERABLE, "c": CLEAN, "e": ""}).collect()}
    assert rows["v"].findings >= 1 and 0 <= rows["v"].unified_risk_score <= 1
    assert rows["c"].findings == 0 and rows["c"].risk_tier in {"LOW", "MEDIUM"}
    assert rows["e"].findings == 0 and rows["e"].risk_tier == "LOW"
    assert math.isclose(rows["v"].weight_security, 1.0)


def test_clean_file_cannot_pass_medium_whatever_its_structure(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 0.0)], "analyzer_score DOUBLE, validator_score DOUBLE, security_score DOUBLE")
    assert fusion.fuse(rows).first().risk_tier == "MEDIUM"


def test_fusion_weights_renormalise(spark):
    rows = spark.createDataFrame([(None, 0.4, 0.9), (None, None, None)],
                                 "analyzer_score DOUBLE, validator_score DOUBLE, security_score DOUBLE")
    first, nothing = fusion.fuse(rows).collect()
    assert math.isclose(first.weight_validator + first.weight_security, 1) and first.weight_analyzer == 0
    assert math.isclose(first.unified_risk_score, (0.25 * 0.4 + 0.55 * 0.9) / 0.8)
    assert nothing.unified_risk_score == 0 and nothing.risk_tier == "LOW"


def test_threat_and_pooled_widths(spark):
    files = spark.createDataFrame([("r", RISKY), ("v", VULNERABLE)], "path STRING, text STRING")
    vectors = fusion.threat_vectors(scan(files, "path", "text"), "path").collect()
    assert {len(r.threat_18d) for r in vectors} == {18}
    functions = spark.createDataFrame([("a", [float(i) for i in range(14)]), ("a", [2.0] * 14)], "f STRING, v ARRAY<DOUBLE>")
    pooled = fusion.pooled_vectors(functions, "f", "v").first().aggregate_56d
    assert len(pooled) == 56 and pooled[0] == 1.0 and pooled[28] == 0.0 and pooled[42 + 13] == 13.0
    module = spark.createDataFrame([([1.0] * 14, None)], "m ARRAY<DOUBLE>, p ARRAY<DOUBLE>")
    padded = module.select(fusion.padded_vector(F.col("p"), F.col("m")).alias("v")).first().v
    assert len(padded) == 56 and sum(x == 0 for x in padded) < 42


def drift_of(spark, before, after):
    def side(source, name):
        files = spark.createDataFrame([(name, source)], "path STRING, text STRING")
        names = spark.createDataFrame([("p", k) for k in source.split() if "(" in k], "project STRING, function_key STRING")
        risk = scored(spark, {name: source}).first().unified_risk_score
        found = fusion.threat_vectors(scan(files, "path", "text"), "path").first()
        return names.distinct().withColumn("value", F.lit(1)), risk, found.threat_18d if found else [0.0] * 18

    (keys_a, risk_a, vector_a), (keys_b, risk_b, vector_b) = side(before, "a"), side(after, "b")
    diff = keyed.snapshot_diff(keys_a, keys_b, ["project", "function_key"], "value")
    distance = drift.jaccard_distance(diff, ["project"]).first().key_distance
    vectors = spark.createDataFrame([(risk_a, risk_b, float(distance), vector_a, vector_b)],
                                    "risk_before DOUBLE, risk_after DOUBLE, key_distance DOUBLE, a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    paired = vectors.withColumn("vector_change", drift.relative_change(F.col("a"), F.col("b")))
    return drift.drift(paired).first(), diff.where("change <> 'unchanged'").count()


def test_identical_snapshots_do_not_drift(spark):
    row, changes = drift_of(spark, RISKY, RISKY)
    assert row.drift_score < 0.05 and row.risk_trend == "STABLE" and changes == 0


def test_risky_edit_drifts(spark):
    row, changes = drift_of(spark, "def foo():\n    return 1\n", "def foo():\n    return 1\n" + RISKY)
    assert row.drift_score > 0.2 and row.risk_trend in {"DEGRADED", "FRACTURED"} and changes > 0
    back, _ = drift_of(spark, "def foo():\n    return 1\n" + RISKY, "def foo():\n    return 1\n")
    assert back.risk_trend == "IMPROVED"


def test_duplicated_findings_double_counts_only(spark):
    files = spark.createDataFrame([(1, RISKY), (2, VULNERABLE)], "path INT, text STRING")
    found = scan(files, "path", "text")
    single = {r.severity: r.findings for r in rollups.severity_histogram(found).collect()}
    double = {r.severity: r.findings for r in rollups.severity_histogram(found.unionByName(found)).collect()}
    assert double == {k: 2 * v for k, v in single.items()}


def test_missing_severity_counts_as_low(spark):
    rows = spark.createDataFrame([("HIGH",), (None,), ("LOW",), ("odd",)], "severity STRING")
    found = {r.severity: (r.findings, r.total_findings) for r in rollups.severity_histogram(rows).collect()}
    assert found == {"HIGH": (1, 4), "LOW": (2, 4), "odd": (1, 4)}


def test_summary_of_nothing_has_no_row(spark):
    schema = "risk_score DOUBLE, security_findings_count BIGINT, structural_anomalies_count BIGINT, risk_tier STRING"
    assert rollups.corpus_summary(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(0.8, 1, 0, "CRITICAL"), (0.2, 0, 2, None), (0.0, 0, 0, "ERROR")], schema)
    row = rollups.corpus_summary(rows).first()
    assert (row.total_files, row.critical_pct, row.anomalies_pct) == (2, 50.0, 50.0)


def test_metrics_of_undefined_ratios(spark):
    rows = spark.createDataFrame([(False, None), (False, False)], "truth BOOLEAN, p BOOLEAN")
    row = evaluation.metrics(rows, [], "truth", "p").first()
    assert (row.tp, row.fp, row.fn, row.tn) == (0, 0, 0, 2)
    assert row.precision is None and row.recall is None and row.f1 is None and row.accuracy == 1.0


def test_bootstrap_interval_agrees_with_row_bootstrap(spark):
    rng = np.random.default_rng(5)
    truth = rng.random(3000) < 0.3
    guess = np.where(rng.random(3000) < 0.8, truth, ~truth)
    rows = spark.createDataFrame(
        [(i, bool(t), bool(g)) for i, (t, g) in enumerate(zip(truth, guess, strict=True))], "id INT, t BOOLEAN, p BOOLEAN"
    )
    found = {r.metric: r for r in evaluation.bootstrap(rows, "id", "t", "p").collect()}
    draws = [(truth[i] == guess[i]).mean() for i in rng.integers(0, 3000, size=(1000, 3000))]
    low, high = np.percentile(draws, [2.5, 97.5])
    assert abs(found["accuracy"].low - low) < 0.006 and abs(found["accuracy"].high - high) < 0.006
    assert found["accuracy"].iterations == 1000
