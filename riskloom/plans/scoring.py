"""Queries on vectors, graphs, fusion and drift."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import levels, text
from riskloom.operators import drift as drifts
from riskloom.operators import communities as found_communities
from riskloom.operators import fusion, graphs, keyed, rollups, spectral
from riskloom.operators import statistics as stats
from riskloom.operators.findings import CATEGORIES, scan, security_summary
from riskloom.plans import roles
from riskloom.plans.projects import SPLIT, _HALVES, _halves
from riskloom.plans.registry import query
from riskloom.session import settle, spread
from riskloom.sources.tables import table

_GAUSS = 0.5 * (math.log(2 * math.pi) + math.log(2.0))


def functions(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    return spread(vectors, "vec_id")


def reports(spark: SparkSession, folder: str) -> DataFrame:
    return stats.function_reports(functions(spark, folder), "vec_id", "embedding")


SQL_REPORTS = f"""cells AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
population AS (SELECT dim, avg(x) AS mean, var_samp(x) AS variance FROM cells GROUP BY dim),
measured AS (
  SELECT vec_id, label, sqrt(sum(CASE WHEN variance > 0 THEN (x - mean) ** 2 / variance ELSE 0 END)) AS distance,
    -ln(sum(x * x) / sum(abs(x)) ** 2) AS entropy, 0.5 * ln(var_samp(x)) + {_GAUSS} AS differential
  FROM cells JOIN population USING (dim) GROUP BY vec_id, label),
scored AS (
  SELECT *, (entropy - avg(entropy) OVER ()) / stddev_samp(entropy) OVER () AS z FROM measured),
reports AS (SELECT *, 1 / (1 + exp(1.5 - z)) AS score FROM scored)"""


@query(
    "function_reports",
    f"""WITH {SQL_REPORTS}
    SELECT vec_id, label, round(distance, 6) AS mahalanobis_distance, round(entropy, 6) AS renyi_entropy_discrete,
      round(differential, 6) AS renyi_entropy_differential, round(z, 6) AS renyi_z_score,
      round(score, 6) AS anomaly_score, z >= 1.5 AS anomalous FROM reports""",
)
def function_reports(spark: SparkSession, folder: str) -> DataFrame:
    measures = [
        "mahalanobis_distance", "renyi_entropy_discrete", "renyi_entropy_differential", "renyi_z_score", "anomaly_score",
    ]
    scored = reports(spark, folder)
    anomalous = levels.scored_anomaly(F.col("anomaly_score")).alias("anomalous")
    return scored.select("vec_id", "label", *[F.round(m, 6).alias(m) for m in measures], anomalous)


@query(
    "mahalanobis_diag",
    f"""WITH {SQL_REPORTS} SELECT vec_id, round(distance, 6) AS distance FROM measured""",
)
def mahalanobis_diag(spark: SparkSession, folder: str) -> DataFrame:
    vectors = functions(spark, folder)
    population = stats.fit(vectors, "embedding")
    distance = stats.mahalanobis_diagonal(F.col("embedding"), population)
    return vectors.select("vec_id", F.round(distance, 6).alias("distance"))


@query("mahalanobis_full")
def mahalanobis_full(spark: SparkSession, folder: str) -> DataFrame:
    vectors = functions(spark, folder)
    population = stats.fit_full(vectors, "embedding")
    distance = stats.mahalanobis_full(F.col("embedding"), population)
    return vectors.select("vec_id", F.round(distance, 6).alias("distance"))


@query(
    "renyi_discrete",
    """WITH counts AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
    entropies AS (SELECT user_id, sum(n)::BIGINT AS total, -ln(sum((n * 1.0) ** 2) / sum(n) ** 2) AS h2,
      ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h1 FROM counts GROUP BY 1)
    SELECT user_id, total, round(h2, 6) AS renyi_2, round(h1, 6) AS shannon,
      round(coalesce((h2 - avg(h2) OVER ()) / nullif(stddev_samp(h2) OVER (), 0), 0), 6) AS z FROM entropies""",
)
def renyi_discrete(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", "event_type")
    entropies = settle(stats.renyi_discrete(events, ["user_id"], "event_type", 2.0, shannon="shannon"))
    spread_of = entropies.agg(F.avg("renyi_entropy").alias("m"), F.stddev_samp("renyi_entropy").alias("s")).first()
    z = stats.z_score(F.col("renyi_entropy"), spread_of.m, spread_of.s)
    return entropies.select(
        "user_id",
        "total",
        F.round("renyi_entropy", 6).alias("renyi_2"),
        F.round("shannon", 6).alias("shannon"),
        F.round(z, 6).alias("z"),
    )


@query(
    "renyi_gaussian_diag",
    f"""WITH {SQL_REPORTS}, spreads AS (SELECT label, dim, var_samp(x) AS v FROM cells GROUP BY ALL)
    SELECT label, count(*) AS dimensions, round(sum(0.5 * ln(v) + {_GAUSS}), 6) AS renyi_entropy
    FROM spreads WHERE v > 0 GROUP BY 1""",
)
def renyi_gaussian_diag(spark: SparkSession, folder: str) -> DataFrame:
    entropy = stats.renyi_gaussian(functions(spark, folder), ["label"], "embedding")
    return entropy.withColumn("renyi_entropy", F.round("renyi_entropy", 6))


@query(
    "covariance_matrix",
    """WITH cells AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
    SELECT a.dim::INT AS i, b.dim::INT AS j, round(covar_samp(a.x, b.x), 6) AS covariance
    FROM cells a JOIN cells b USING (vec_id) GROUP BY ALL""",
)
def covariance_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Sample covariance of every pair of dimensions, summed as one matrix per task."""
    cells = stats.covariance_cells(functions(spark, folder), "embedding")
    # a covariance below the rounding may have either sign
    return cells.select("i", "j", (F.round("covariance", 6) + F.lit(0.0)).alias("covariance"))


@query(
    "anomaly_gates_nan",
    """WITH z AS (SELECT vec_id, CASE WHEN embedding[2] < -0.1 THEN 'nan'::DOUBLE ELSE embedding[1]::DOUBLE * 15 END AS z
      FROM embeddings)
    SELECT vec_id, isnan(z) OR z >= 1.5 AS function_gate, NOT isnan(z) AND z >= 1.5 AS module_gate,
      NOT isnan(z) AND z >= 1.5 AS scored_gate FROM z""",
)
def anomaly_gates_nan(spark: SparkSession, folder: str) -> DataFrame:
    first, second = F.get("embedding", F.lit(0)), F.get("embedding", F.lit(1))
    z = F.when(second < F.lit(-0.1), F.lit(float("nan"))).otherwise(first.cast("double") * 15)
    rows = table(spark, folder, "embeddings").select("vec_id", z.alias("z"))
    return rows.select(
        "vec_id",
        levels.function_anomaly(F.col("z")).alias("function_gate"),
        levels.module_anomaly(F.col("z")).alias("module_gate"),
        levels.scored_anomaly(stats.anomaly_score(F.col("z"))).alias("scored_gate"),
    )


@query(
    "key_line_parse",
    """SELECT vec_id, CASE label % 6 WHEN 0 THEN 'fn@' || vec_id || ':3' WHEN 1 THEN 'fn' WHEN 2 THEN 'fn@x:1'
        WHEN 3 THEN 'fn@ 7 :2' WHEN 4 THEN 'a@1_0:b@2' ELSE 'fn@-4' END AS function_key,
      CASE label % 6 WHEN 0 THEN vec_id WHEN 3 THEN 7 WHEN 4 THEN 10 WHEN 5 THEN -4 ELSE 1 END AS line,
      CASE label % 6 WHEN 4 THEN 'a' ELSE 'fn' END AS name FROM embeddings""",
)
def key_line_parse(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("label") % 6
    key = (
        F.when(kind == 0, F.concat(F.lit("fn@"), F.col("vec_id").cast("string"), F.lit(":3")))
        .when(kind == 1, F.lit("fn"))
        .when(kind == 2, F.lit("fn@x:1"))
        .when(kind == 3, F.lit("fn@ 7 :2"))
        .when(kind == 4, F.lit("a@1_0:b@2"))
        .otherwise(F.lit("fn@-4"))
    )
    keyed_rows = table(spark, folder, "embeddings").select("vec_id", key.alias("function_key"))
    return keyed_rows.select(
        "vec_id", "function_key",
        text.key_line(F.col("function_key")).alias("line"), text.key_name(F.col("function_key")).alias("name"),
    )


@query(
    "profile_projection",
    """SELECT vec_id, len(embedding)::INT AS block_count,
      round(list_sum(list_transform(list_sort(embedding)[1:20], lambda x: x::DOUBLE)), 6) AS smallest_sum,
      len(embedding[1:20])::INT AS kept, list_min(embedding) >= -1e-12 AS non_negative,
      CASE WHEN label = 0 THEN 0 ELSE len(embedding) END::INT AS fiedler_size,
      CASE WHEN label <> 0 THEN round(embedding[len(embedding)]::DOUBLE, 6) END AS fiedler_first FROM embeddings""",
)
def profile_projection(spark: SparkSession, folder: str) -> DataFrame:
    values = F.transform("embedding", lambda x: x.cast("double"))
    columns = F.when(F.col("label") == 0, F.array(values)).otherwise(F.array(values, F.reverse(values)))
    profiles = table(spark, folder, "embeddings").select("vec_id", values.alias("values"), columns.alias("vectors"))
    smallest = F.slice(F.array_sort("values"), 1, spectral.KEPT_EIGENVALUES)
    second = F.when(F.size("vectors") > 1, F.get("vectors", F.lit(1))).otherwise(F.array().cast("array<double>"))
    shown = profiles.select("vec_id", "values", smallest.alias("top"), second.alias("fiedler"))
    total = F.aggregate("top", F.lit(0.0), lambda s, x: s + x)
    return shown.select(
        "vec_id",
        F.size("values").alias("block_count"),
        F.round(total, 6).alias("smallest_sum"),
        F.size("top").alias("kept"),
        (F.array_min("values") >= -1e-12).alias("non_negative"),
        F.size("fiedler").alias("fiedler_size"),
        F.round(F.get("fiedler", F.lit(0)), 6).alias("fiedler_first"),
    )


@query(
    "vector_pool_pad",
    """WITH cells AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1) % 14 AS pos
      FROM embeddings),
    folded AS (SELECT vec_id, label, pos, sum(x) AS x FROM cells GROUP BY ALL),
    pools AS (SELECT label, pos, avg(x) AS a, stddev_pop(x) AS s, min(x) AS lo, max(x) AS hi FROM folded GROUP BY ALL),
    wanted AS (SELECT l.label, m.x AS module FROM (SELECT DISTINCT label FROM embeddings) l, (SELECT 1) m(x)
      UNION ALL SELECT -1 - quality, 1 FROM (SELECT DISTINCT quality FROM labels))
    SELECT label, pos::INT AS pos, round(a, 6) AS value FROM pools
    UNION ALL SELECT label, (pos + 14)::INT, round(s, 6) FROM pools
    UNION ALL SELECT label, (pos + 28)::INT, round(lo, 6) FROM pools
    UNION ALL SELECT label, (pos + 42)::INT, round(hi, 6) FROM pools
    UNION ALL SELECT label, i::INT, CASE label WHEN -1 THEN 0 ELSE (i % 3 + 1)::DOUBLE END
      FROM wanted, range(56) r(i) WHERE label < 0""",
)
def vector_pool_pad(spark: SparkSession, folder: str) -> DataFrame:
    """Pooled vectors of every file with functions; files without any take their module vector or zeros."""
    vectors = functions(spark, folder)
    narrow = vectors.select("label", fusion.folded(F.col("embedding"), fusion.FUNCTION_WIDTH).alias("v"))
    pooled = fusion.pooled_vectors(narrow, "label", "v")
    no_module = F.array().cast("array<double>")
    bare = table(spark, folder, "labels").select((-1 - F.col("quality")).alias("label")).distinct()
    module = F.when(F.col("label") < -1, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).otherwise(no_module)
    files = vectors.select("label").distinct().unionByName(bare).withColumn("module", module)
    padded = files.join(pooled, "label", "left").select(
        "label", fusion.padded_vector(F.col("aggregate_56d"), F.col("module")).alias("v")
    )
    return padded.select("label", F.posexplode("v").alias("pos", "value")).withColumn("value", F.round("value", 6))


def message_graphs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of one graph per user: transitions between consecutive message states."""
    band = F.when(F.col("value") < 10, F.lit("a")).when(F.col("value") < 40, F.lit("b")).otherwise(F.lit("c"))
    states = table(spark, folder, "events").select(
        "user_id", "ts", "event_id", F.concat_ws(":", "event_type", band).alias("state")
    )
    edges = graphs.transition_edges(states, "user_id", [F.col("ts"), F.col("event_id")], "state")
    nodes = states.select(F.col("user_id").alias("graph_id"), F.col("state").alias("node")).distinct()
    return graphs.simple_edges(edges), nodes


def settled_graphs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The same graphs, built once for queries that read them several times."""
    edges, nodes = message_graphs(spark, folder)
    return settle(edges), settle(nodes)


SQL_GRAPHS = """states AS (
  SELECT user_id AS graph_id, ts, event_id, event_type || ':' || CASE WHEN value < 10 THEN 'a' WHEN value < 40 THEN 'b'
    ELSE 'c' END AS state FROM events),
steps AS (SELECT graph_id, state, lag(state) OVER (PARTITION BY graph_id ORDER BY ts, event_id) AS prev FROM states),
edges AS (SELECT DISTINCT graph_id, least(prev, state) AS src, greatest(prev, state) AS dst FROM steps
  WHERE prev <> state),
nodes AS (SELECT DISTINCT graph_id, state AS node FROM states),
ends AS (SELECT graph_id, src AS node, dst AS other FROM edges UNION ALL SELECT graph_id, dst, src FROM edges),
degrees AS (SELECT n.graph_id, n.node, count(e.other) AS d FROM nodes n LEFT JOIN ends e USING (graph_id, node)
  GROUP BY ALL),
described AS (
  SELECT graph_id, count(*) AS "order", (sum(d) / 2)::BIGINT AS size, sum(d) / (count(*) * (count(*) - 1)) AS density,
    avg(d) AS mean_degree, max(d) AS max_degree, var_pop(d) AS degree_variance, count(*) FILTER (d = 1) AS leaves,
    sum(d)::BIGINT AS trace_l, (sum(d * d) + sum(d))::BIGINT AS trace_l2,
    (sum(d) / 2 - count(*) + 2)::BIGINT AS cyclomatic, sqrt(sum(d) * count(*)) AS energy_bound
  FROM degrees GROUP BY 1)"""


@query(
    "graph_descriptors",
    f"""WITH RECURSIVE {SQL_GRAPHS},
    reach AS (SELECT graph_id, node, node AS other FROM nodes
      UNION SELECT r.graph_id, r.node, e.other FROM reach r JOIN ends e ON e.graph_id = r.graph_id AND e.node = r.other),
    roots AS (SELECT graph_id, node, min(other) AS root FROM reach GROUP BY ALL)
    SELECT graph_id, "order", size, round(density, 6) AS density, round(mean_degree, 6) AS mean_degree, max_degree,
      round(degree_variance, 6) AS degree_variance, leaves, trace_l, trace_l2, cyclomatic,
      round(energy_bound, 6) AS energy_bound, components, coalesce(triangles, 0) AS triangles
    FROM described JOIN (SELECT graph_id, count(DISTINCT root) AS components FROM roots GROUP BY 1) USING (graph_id)
    LEFT JOIN (SELECT a.graph_id, count(*) AS triangles FROM edges a JOIN edges b ON b.graph_id = a.graph_id AND b.src = a.dst
      JOIN edges c ON c.graph_id = a.graph_id AND c.src = a.src AND c.dst = b.dst GROUP BY 1) USING (graph_id)""",
)
def graph_descriptors(spark: SparkSession, folder: str) -> DataFrame:
    edges, nodes = settled_graphs(spark, folder)
    described = graphs.descriptors(edges, nodes)
    counts = graphs.component_counts(graphs.components(edges, nodes))
    rounded = ["density", "mean_degree", "degree_variance", "energy_bound"]
    joined = described.join(counts, "graph_id").join(graphs.triangle_counts(edges, nodes), "graph_id")
    return joined.withColumns({c: F.round(c, 6) for c in rounded})


@query(
    "modularity",
    f"""WITH {SQL_GRAPHS}, labelled AS (
      SELECT graph_id, split_part(node, ':', 1) AS community, split_part(other, ':', 1) AS far FROM ends),
    sums AS (SELECT graph_id, community, count(*) AS degree, count(*) FILTER (community = far) AS inner_ends
      FROM labelled GROUP BY ALL)
    SELECT graph_id, round(sum(inner_ends) / sum(degree) - sum(degree * degree) / (sum(degree) * sum(degree)), 12)
      AS modularity FROM sums GROUP BY 1""",
)
def modularity(spark: SparkSession, folder: str) -> DataFrame:
    edges, nodes = message_graphs(spark, folder)
    community = nodes.withColumn("community", F.substring_index("node", ":", 1))
    scored = graphs.modularity(edges, community)
    return scored.select("graph_id", F.round("modularity", 12).alias("modularity"))


@query("communities")
def communities(spark: SparkSession, folder: str) -> DataFrame:
    """The community of every node of every graph."""
    edges, nodes = settled_graphs(spark, folder)
    return found_communities.communities(edges, nodes, found_communities.WHOLE_NODES)


@query(
    "community_quality",
    f"""WITH {SQL_GRAPHS}
    SELECT graph_id, round(-sum(d * d)::DOUBLE / (sum(d) * sum(d)), 12) AS alone, true AS gained, true AS connected_only
    FROM degrees GROUP BY 1 HAVING sum(d) > 0""",
)
def community_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Modularity of every node alone; whether the found communities gain on it, and none spans two components."""
    edges, nodes = settled_graphs(spark, folder)
    found = settle(found_communities.communities(edges, nodes, found_communities.WHOLE_NODES))
    reached = graphs.modularity(edges, found).withColumnRenamed("modularity", "reached")
    alone = graphs.modularity(edges, nodes.withColumn("community", F.col("node"))).withColumnRenamed("modularity", "alone")
    labels = graphs.components(edges, nodes)
    spans = found.join(labels, ["graph_id", "node"]).groupBy("graph_id", "community").agg(F.min("label").alias("a"), F.max("label").alias("b"))
    whole = spans.groupBy("graph_id").agg(F.every(F.col("a") == F.col("b")).alias("connected_only"))
    rated = alone.join(reached, "graph_id").join(whole, "graph_id")
    return rated.select("graph_id", F.round("alone", 12).alias("alone"), (F.col("reached") > F.col("alone")).alias("gained"), "connected_only")


@query("spectral_estimates")
def spectral_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """Second-smallest and largest Laplacian eigenvalue of every graph."""
    edges, nodes = settled_graphs(spark, folder)
    found = spectral.extremes(edges, nodes)
    return found.select("graph_id", "order", F.round("lambda_max", 5).alias("lambda_max"), F.round("lambda_2", 5).alias("lambda_2"))


@query(
    "low_spectrum",
    f"""WITH {SQL_GRAPHS}
    SELECT graph_id, least(count(*), 20)::BIGINT AS kept, round(sum(d)::DOUBLE, 4) AS value_sum,
      round(sum(d * d + d)::DOUBLE, 3) AS square_sum FROM degrees GROUP BY 1 HAVING count(*) <= 20""",
)
def low_spectrum(spark: SparkSession, folder: str) -> DataFrame:
    """The smallest eigenvalues of every graph, held against its traces where they are all there are."""
    edges, nodes = settled_graphs(spark, folder)
    low = spectral.low_spectrum(edges, nodes)
    orders = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("order"))
    sums = low.groupBy("graph_id").agg(
        F.max("rank").cast("bigint").alias("kept"),
        F.round(F.sum("value"), 4).alias("value_sum"),
        F.round(F.sum(F.col("value") * F.col("value")), 3).alias("square_sum"),
    )
    return sums.join(orders.where(F.col("order") <= spectral.KEPT_EIGENVALUES).select("graph_id"), "graph_id")


@query("low_eigenvalues")
def low_eigenvalues(spark: SparkSession, folder: str) -> DataFrame:
    """(graph_id, rank, value) of the 20 smallest eigenvalues of every graph."""
    edges, nodes = settled_graphs(spark, folder)
    return spectral.low_spectrum(edges, nodes).select("graph_id", "rank", F.round("value", 5).alias("value"))


@query("fiedler_vectors")
def fiedler_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(graph_id, node, value): the second eigenvector of every graph."""
    edges, nodes = settled_graphs(spark, folder)
    return spectral.fiedler_vectors(edges, nodes).withColumn("value", F.round("value", 6))


@query("graph_energy")
def graph_energy(spark: SparkSession, folder: str) -> DataFrame:
    """(graph_id, order, energy, error) of every graph."""
    edges, nodes = settled_graphs(spark, folder)
    return spectral.energies(edges, nodes).withColumns({c: F.round(c, 5) for c in ("energy", "error")})


_PLAIN_FEATURES = [f for f in spectral.FEATURES if not f.startswith("lambda")]


@query(
    "graph_feature_vectors",
    f"""WITH RECURSIVE {SQL_GRAPHS},
    reach AS (SELECT graph_id, node, node AS other FROM nodes
      UNION SELECT r.graph_id, r.node, e.other FROM reach r JOIN ends e ON e.graph_id = r.graph_id AND e.node = r.other),
    roots AS (SELECT graph_id, node, min(other) AS root FROM reach GROUP BY ALL),
    full_rows AS (SELECT described.*, components FROM described
      JOIN (SELECT graph_id, count(DISTINCT root) AS components FROM roots GROUP BY 1) USING (graph_id))
    """
    + " UNION ALL ".join(
        f"SELECT graph_id, {spectral.FEATURES.index(f)} AS position, '{f}' AS feature, round(\"{f}\"::DOUBLE, 6) AS value FROM full_rows"
        for f in _PLAIN_FEATURES
    ),
)
def graph_feature_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve features of every graph that need no spectrum, by their place in the vector of fourteen."""
    edges, nodes = settled_graphs(spark, folder)
    counts = graphs.component_counts(graphs.components(edges, nodes))
    joined = graphs.descriptors(edges, nodes).join(counts, "graph_id")
    places = F.array(
        *[
            F.struct(
                F.lit(spectral.FEATURES.index(f)).alias("position"), F.lit(f).alias("feature"),
                F.round(F.col(f).cast("double"), 6).alias("value"),
            )
            for f in _PLAIN_FEATURES
        ]
    )
    return joined.select("graph_id", F.explode(places).alias("p")).select("graph_id", "p.*")


@query("graph_spectral_vectors")
def graph_spectral_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The whole vector of fourteen features of every graph."""
    edges, nodes = settled_graphs(spark, folder)
    counts = settle(graphs.component_counts(graphs.components(edges, nodes)))
    vectors = spectral.feature_vectors(
        graphs.descriptors(edges, nodes), spectral.extremes(edges, nodes, counts), counts
    )
    exploded = vectors.select("graph_id", F.posexplode("raw_feature_vector").alias("position", "value"))
    return exploded.withColumn("value", F.round("value", 5))


_CATEGORY_LIST = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"
_THREAT_SQL = ", ".join(
    [f"count(*) FILTER (severity = '{s}')::DOUBLE AS severity_{s.lower()}" for s in fusion.THREAT_SEVERITIES]
    + [f"count(*) FILTER (category = '{c}')::DOUBLE AS category_{c.replace('-', '_')}" for c in CATEGORIES]
)


@query(
    "threat_vector",
    f"""WITH {roles.SQL_FINDINGS}, named AS (
      SELECT scan_id, upper(severity) AS severity, {_CATEGORY_LIST}[(rule_id % {len(CATEGORIES)} + 1)::INT] AS category,
             confidence_score FROM findings)
    SELECT o_orderkey AS scan_id, {_THREAT_SQL}, count(category)::DOUBLE AS total,
      count(DISTINCT category)::DOUBLE AS distinct_categories, round(coalesce(avg(confidence_score), 0), 6) AS mean_confidence,
      coalesce(max(confidence_score), 0) AS max_confidence
    FROM orders LEFT JOIN named ON scan_id = o_orderkey GROUP BY 1""",
)
def threat_vector(spark: SparkSession, folder: str) -> DataFrame:
    category = F.get(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("rule_id") % len(CATEGORIES)).cast("int"))
    found = roles.findings(spark, folder).select(
        "scan_id", F.upper("severity").alias("severity"), category.alias("category"), "confidence_score"
    )
    # counted first: one row per scan meets one row per scan
    threats = roles.scans(spark, folder).select("scan_id").join(fusion.threat_columns(found, ["scan_id"]), "scan_id", "left")
    threats = threats.na.fill(0.0)
    return threats.withColumn("mean_confidence", F.round("mean_confidence", 6))


_ANOMALY_SQL = ", ".join(
    f"round(avg({m}), 6) AS {n}_mean, round(stddev_pop({m}), 6) AS {n}_std, round(min({m}), 6) AS {n}_min, "
    f"round(max({m}), 6) AS {n}_max"
    for m, n in zip(("distance", "entropy", "differential", "score"), fusion.ANOMALY_MEASURES, strict=True)
)


@query("anomaly_vector", f"WITH {SQL_REPORTS} SELECT label, {_ANOMALY_SQL} FROM reports GROUP BY label")
def anomaly_vector(spark: SparkSession, folder: str) -> DataFrame:
    features = fusion.anomaly_columns(reports(spark, folder), ["label"])
    return features.select("label", *[F.round(c, 6).alias(c) for c in features.columns if c != "label"])


def corpus_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Signals of every file: graph, function vector and findings with its id; all three sides are per-file rows."""
    files = roles.files(spark, folder)
    found = security_summary(scan(files, "doc_id", "text"), ["doc_id"])
    edges, nodes = message_graphs(spark, folder)
    structure = graphs.descriptors(edges, nodes).select(
        F.col("graph_id").alias("doc_id"), graphs.structure_score(F.col("cyclomatic")).alias("analyzer_score")
    )
    validated = fusion.anomaly_counts(reports(spark, folder), "vec_id").withColumnRenamed("vec_id", "doc_id")
    ids = table(spark, folder, "documents").select("doc_id", "source")
    joined = ids.join(found, "doc_id", "left").join(structure, "doc_id", "left").join(validated, "doc_id", "left")
    return joined.na.fill(0, ["findings", "structural_anomalies_count"]).na.fill(0.0, ["security_score"])


def corpus_results(spark: SparkSession, folder: str) -> DataFrame:
    """Per-file benchmark rows of the corpus."""
    fused = fusion.fuse(corpus_signals(spark, folder))
    return fused.select(
        "doc_id",
        "source",
        F.col("unified_risk_score").alias("risk_score"),
        F.col("findings").alias("security_findings_count"),
        "structural_anomalies_count",
        "risk_tier",
        "weight_analyzer",
        "weight_validator",
        "weight_security",
    )


SQL_RESULTS = f"""{roles.sql_rule_findings('documents', 'doc_id', 'text')},
security AS (SELECT doc_id, count(*) AS findings, 1 - exp(-sum({roles.SQL_SEVERITY_WEIGHT} * confidence_score)) AS s
  FROM rule_hits GROUP BY 1),
{SQL_GRAPHS},
{SQL_REPORTS},
signals AS (
  SELECT d.doc_id, d.source, coalesce(findings, 0) AS findings, coalesce(s, 0) AS s,
    1 - exp(-greatest(cyclomatic - 1, 0) / 10) AS a, r.score AS v, CASE WHEN r.z >= 1.5 THEN 1 ELSE 0 END AS anomalies,
    CASE WHEN g.graph_id IS NULL THEN 0 ELSE 0.20 END::DOUBLE AS wa, CASE WHEN r.vec_id IS NULL THEN 0 ELSE 0.25 END::DOUBLE AS wv
  FROM documents d LEFT JOIN security USING (doc_id) LEFT JOIN described g ON g.graph_id = d.doc_id
  LEFT JOIN reports r ON r.vec_id = d.doc_id),
weighed AS (SELECT *, wa / (wa + wv + 0.55) AS weight_analyzer, wv / (wa + wv + 0.55) AS weight_validator,
  0.55 / (wa + wv + 0.55) AS weight_security FROM signals),
fused AS (SELECT *, least(1, greatest(0, weight_analyzer * coalesce(a, 0) + weight_validator * coalesce(v, 0)
  + weight_security * s)) AS risk_score FROM weighed),
results AS (SELECT doc_id, source, risk_score, findings AS security_findings_count,
  anomalies::BIGINT AS structural_anomalies_count, {roles.SQL_TIER.format('risk_score')} AS risk_tier,
  weight_analyzer, weight_validator, weight_security FROM fused)"""


@query(
    "fused_risk",
    f"""WITH {SQL_RESULTS}
    SELECT doc_id, round(risk_score, 6) AS risk_score, security_findings_count, structural_anomalies_count, risk_tier,
      round(weight_analyzer, 6) AS weight_analyzer, round(weight_validator, 6) AS weight_validator,
      round(weight_security, 6) AS weight_security FROM results""",
)
def fused_risk(spark: SparkSession, folder: str) -> DataFrame:
    rounded = ["risk_score", "weight_analyzer", "weight_validator", "weight_security"]
    return corpus_results(spark, folder).drop("source").withColumns({c: F.round(c, 6) for c in rounded})


SUMMARY_SQL = """SELECT count(*) AS total_files, round(avg(risk_score), 6) AS mean_risk_score,
  round(avg(security_findings_count), 6) AS mean_security_findings,
  round(avg(structural_anomalies_count), 6) AS mean_structural_anomalies,
  round(count(*) FILTER (risk_tier = 'CRITICAL') * 100 / count(*), 6) AS critical_pct,
  round(count(*) FILTER (structural_anomalies_count > 0) * 100 / count(*), 6) AS anomalies_pct FROM results
  WHERE risk_tier IS NULL OR risk_tier <> 'ERROR'"""


def rounded_summary(summary: DataFrame) -> DataFrame:
    return summary.select("total_files", *[F.round(c, 6).alias(c) for c in summary.columns if c != "total_files"])


@query("corpus_summary", f"WITH {SQL_RESULTS} {SUMMARY_SQL}")
def corpus_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_summary(rollups.corpus_summary(corpus_results(spark, folder)))


_VECTOR = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in levels.SEVERITIES)
_MOVED = " + ".join(f"(b.{s} - c.{s}) ** 2" for s in levels.SEVERITIES)
_LENGTH = " + ".join(f"b.{s} ** 2" for s in levels.SEVERITIES)


@query(
    "drift_trend",
    f"""WITH {roles.SQL_SCANS}, {_HALVES},
    diffs AS (SELECT project_id, count(*) FILTER (b.project_id IS NULL OR c.project_id IS NULL) / count(*) AS key_distance
      FROM (SELECT * FROM halves WHERE NOT is_current) b FULL JOIN (SELECT * FROM halves WHERE is_current) c
      USING (project_id, function_key) GROUP BY 1),
    sides AS (SELECT project_id, created_at >= TIMESTAMP '{SPLIT}' AS is_current, avg(risk_score) AS risk, {_VECTOR}
      FROM scans GROUP BY ALL),
    paired AS (SELECT project_id, c.risk - b.risk AS change, key_distance,
        CASE WHEN {_MOVED} = 0 THEN 0 WHEN {_LENGTH} = 0 THEN 1
             ELSE tanh(sqrt({_MOVED}) / sqrt({_LENGTH})) END AS vector_change
      FROM (SELECT * FROM sides WHERE NOT is_current) b JOIN (SELECT * FROM sides WHERE is_current) c
      USING (project_id) JOIN diffs USING (project_id)),
    scored AS (SELECT *, 0.4 * abs(change) + 0.3 * key_distance + 0.3 * vector_change AS score FROM paired)
    SELECT project_id, round(score, 6) AS drift_score,
      CASE WHEN score < 0.05 THEN 'STABLE' WHEN change < 0 THEN 'IMPROVED' WHEN score >= 0.5 THEN 'FRACTURED'
           ELSE 'DEGRADED' END AS risk_trend FROM scored""",
)
def drift_trend(spark: SparkSession, folder: str) -> DataFrame:
    """Drift of projects that have a baseline and a current half; nothing can drift without both."""
    baseline, current = _halves(spark, folder)
    distance = drifts.jaccard_distance(
        keyed.snapshot_diff(baseline, current, ["project_id", "function_key"], "risk"), ["project_id"]
    )
    scans = roles.scans(spark, folder).withColumn(
        "is_current", F.col("created_at") >= F.lit(SPLIT).cast("timestamp_ntz")
    )
    counts = F.array(*[F.count_if(F.col("severity") == s).cast("double") for s in levels.SEVERITIES])
    sides = scans.groupBy("project_id", "is_current").agg(F.avg("risk_score").alias("risk"), counts.alias("vector"))
    # both sides of a project meet by one more grouping, not by a self join
    half = {name: F.col("is_current") == flag for name, flag in (("before", False), ("after", True))}
    paired = sides.groupBy("project_id").agg(
        *[F.max(F.when(cond, F.col("risk"))).alias(f"risk_{name}") for name, cond in half.items()],
        *[F.max(F.when(cond, F.col("vector"))).alias(f"vector_{name}") for name, cond in half.items()],
    )
    change = drifts.relative_change(F.col("vector_before"), F.col("vector_after")).alias("vector_change")
    both = paired.where("risk_before is not null and risk_after is not null")
    parts = both.join(distance, "project_id").select(
        "project_id", "risk_before", "risk_after", "key_distance", change
    )
    scored = drifts.drift(parts)
    return scored.select("project_id", F.round("drift_score", 6).alias("drift_score"), "risk_trend")
