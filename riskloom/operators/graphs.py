"""Graph descriptors from edge tables ``(graph_id, src, dst)``; all graphs at once, joins and grouping only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ordering import with_previous
from riskloom.session import settle


def transition_edges(rows: DataFrame, graph: str, order: Sequence[Column], state: str) -> DataFrame:
    """Edges between consecutive different states of each graph's ordered rows."""
    steps = with_previous(rows, [graph], order, {"_previous": state})
    moved = steps.where(F.col("_previous").isNotNull() & (F.col("_previous") != F.col(state)))
    return moved.select(F.col(graph).alias("graph_id"), F.col("_previous").alias("src"), F.col(state).alias("dst"))


def simple_edges(edges: DataFrame) -> DataFrame:
    """Undirected simple graph: no loops, one row ``src < dst`` per pair."""
    proper = edges.where(F.col("src") != F.col("dst"))
    return proper.select(
        "graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    ).distinct()


def both_ways(simple: DataFrame) -> DataFrame:
    """Each undirected edge seen from either end: ``(graph_id, node, other)``."""
    ends = F.explode(
        F.array(
            F.struct(F.col("src").alias("node"), F.col("dst").alias("other")),
            F.struct(F.col("dst").alias("node"), F.col("src").alias("other")),
        )
    )
    return simple.select("graph_id", ends.alias("e")).select("graph_id", "e.node", "e.other")


def degrees(simple: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Degree per node; listed nodes without edges get 0."""
    counted = both_ways(simple).groupBy("graph_id", "node").agg(F.count(F.lit(1)).alias("degree"))
    if nodes is None:
        return counted
    listed = nodes.select("graph_id", "node").distinct()
    return listed.join(counted, ["graph_id", "node"], "left").na.fill(0, ["degree"])


def components(simple: DataFrame, nodes: DataFrame) -> DataFrame:
    """Component label (smallest node) per node, in a logarithmic number of rounds.

    A round has three steps: every node hears the smallest label around it; it passes what it heard on
    to the node its label names, so whole labelled groups merge at once; and it follows its new label's
    own label. Without the second step a long path with shuffled names takes a round per few nodes.
    Each round is settled, and the last one finds nothing to change.
    """
    links = settle(both_ways(simple))
    state = settle(nodes.select("graph_id", "node").distinct().withColumn("label", F.col("node")))
    while True:
        around = links.join(state.withColumnRenamed("node", "other"), ["graph_id", "other"]).select(
            "graph_id", "node", "label"
        )
        own = state.withColumn("old", F.col("label"))
        heard = settle(
            own.unionByName(around, allowMissingColumns=True)
            .groupBy("graph_id", "node")
            .agg(F.max("old").alias("old"), F.min("label").alias("label"))
        )
        passed = heard.groupBy("graph_id", F.col("old").alias("node")).agg(F.min("label").alias("passed"))
        merged = heard.join(passed, ["graph_id", "node"], "left").select(
            "graph_id", "node", "old", F.least("label", "passed").alias("label")
        )
        owners = merged.select("graph_id", F.col("node").alias("label"), F.col("label").alias("root"))
        after = settle(
            merged.join(owners, ["graph_id", "label"], "left").select(
                "graph_id", "node", "old", F.least("label", "root").alias("label")
            )
        )
        state = after.drop("old")
        if after.where("old <> label").isEmpty():
            return state


def descriptors(simple: DataFrame, nodes: DataFrame) -> DataFrame:
    """Order, size, degree statistics, Laplacian traces and the energy bound of every graph."""
    degree = degrees(simple, nodes)
    d = F.col("degree")
    per_graph = degree.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("order"),
        F.sum(d).alias("trace_l"),
        (F.sum(d * d) + F.sum(d)).alias("trace_l2"),
        F.avg(d).alias("mean_degree"),
        F.max(d).alias("max_degree"),
        F.var_pop(d).alias("degree_variance"),
        F.count_if(d == 1).alias("leaves"),
    )
    n, m = F.col("order"), (F.col("trace_l") / 2)
    return per_graph.select(
        "graph_id",
        "order",
        m.cast("bigint").alias("size"),
        F.coalesce(F.try_divide(2 * m, n * (n - 1)), F.lit(0.0)).alias("density"),
        "mean_degree",
        "max_degree",
        "degree_variance",
        "leaves",
        "trace_l",
        "trace_l2",
        (m - n + 2).cast("bigint").alias("cyclomatic"),
        F.sqrt(2 * m * n).alias("energy_bound"),
    )


def triangle_counts(simple: DataFrame, nodes: DataFrame) -> DataFrame:
    """Triangles per graph (0 where there is none): every edge points to its end of higher degree, so no node has many to pair."""
    degree = degrees(simple)
    low = degree.select("graph_id", F.col("node").alias("src"), F.col("degree").alias("ds"))
    high = degree.select("graph_id", F.col("node").alias("dst"), F.col("degree").alias("dd"))
    ranked = simple.join(low, ["graph_id", "src"]).join(high, ["graph_id", "dst"])
    upward = F.struct("ds", "src") < F.struct("dd", "dst")
    ends = ranked.select(
        "graph_id",
        F.when(upward, F.col("src")).otherwise(F.col("dst")).alias("a"),
        F.when(upward, F.col("dst")).otherwise(F.col("src")).alias("b"),
    )
    two = ends.join(ends.withColumnRenamed("b", "c"), ["graph_id", "a"]).where("b < c")
    closed = two.select("graph_id", F.col("b").alias("src"), F.col("c").alias("dst")).join(simple, ["graph_id", "src", "dst"])
    counted = closed.groupBy("graph_id").agg(F.count(F.lit(1)).alias("triangles"))
    every = nodes.select("graph_id").distinct()
    return every.join(counted, "graph_id", "left").na.fill(0, ["triangles"])


def component_counts(labels: DataFrame) -> DataFrame:
    """Number of components per graph."""
    roots = labels.groupBy("graph_id", "label").agg(F.lit(1).alias("one"))
    return roots.groupBy("graph_id").agg(F.count(F.lit(1)).alias("components"))


def modularity(simple: DataFrame, community: DataFrame) -> DataFrame:
    """Modularity of a given community column ``(graph_id, node, community)``."""
    ends = both_ways(simple).join(community, ["graph_id", "node"])
    far = community.select("graph_id", F.col("node").alias("other"), F.col("community").alias("far"))
    labelled = ends.join(far, ["graph_id", "other"])
    # every edge is seen from both ends, so degree sums and inner edges come from one grouping
    per_community = labelled.groupBy("graph_id", "community").agg(
        F.count(F.lit(1)).alias("degree"), F.count_if(F.col("community") == F.col("far")).alias("inner")
    )
    two_m = F.sum("degree")
    return per_community.groupBy("graph_id").agg(
        (F.sum("inner") / two_m - F.sum(F.col("degree") * F.col("degree")) / (two_m * two_m)).alias("modularity")
    )


def structure_score(cyclomatic: Column) -> Column:
    """Structural risk in [0, 1): grows with the number of independent paths beyond the first."""
    return 1 - F.exp(-F.greatest(cyclomatic - 1, F.lit(0)) / 10.0)
