"""Centralities and feature tables of weighted graphs, all graphs of a table at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormgrid.operators import networks as N
from stormgrid.operators.joins import symmetrize
from stormgrid.operators.losses import gini
from stormgrid.operators.spectrum import algebraic_connectivity
from stormgrid.sources.shared import dropped, written

#: Two path lengths within this share of each other are the same length.
SAME = 1e-9


def shortest_path_edges(both: DataFrame, distances: DataFrame) -> DataFrame:
    """(graph_id, s, v, w): the edges v to w that lie on a shortest path from s; n x m rows at most."""
    own = both.select("graph_id", "src").distinct().select("graph_id", "src", F.col("src").alias("dst"), F.lit(0.0).alias("d"))
    every = distances.select("graph_id", "src", "dst", "d").unionByName(own)
    tail = every.select("graph_id", F.col("src").alias("s"), F.col("dst").alias("v"), F.col("d").alias("d_v"))
    head = every.select("graph_id", F.col("src").alias("s"), F.col("dst").alias("w"), F.col("d").alias("d_w"))
    step = both.select("graph_id", F.col("src").alias("v"), F.col("dst").alias("w"), "weight")
    on_path = F.abs(F.col("d_v") + F.col("weight") - F.col("d_w")) <= SAME * F.greatest(F.lit(1.0), F.col("d_w"))
    return tail.join(step, ["graph_id", "v"]).join(head, ["graph_id", "s", "w"]).where(on_path).select("graph_id", "s", "v", "w")


def dependencies(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(graph_id, node_id, raw): for each node the shortest paths of other pairs through it, as shares, over ordered pairs.

    Brandes' accumulation. Forward: the numbers of shortest paths from every source grow along the
    edges that lie on one, a round for each number of edges. A node's level is the most edges that a
    shortest path to it has, so all its successors have higher levels. Backward: from the highest
    level down, a node's dependency is final when its level's turn comes, and each edge passes it on
    once. Rows are sources times edges, never triples of nodes.
    """
    if weight is not None and edges.where(~(F.col(weight) > 0)).limit(1).count():
        raise ValueError("path counts need positive weights")
    both = N.settled(symmetrize(edges.withColumn("weight", F.lit(1.0) if weight is None else F.col(weight).cast("double"))))
    dag = written(shortest_path_edges(both, N.shortest_paths(edges, weight)), "paths")
    key = ["graph_id", "s"]
    layer = N.settled(both.select("graph_id", F.col("src").alias("s"), F.col("src").alias("v"), F.lit(1.0).alias("paths"), F.lit(0).alias("hop")).distinct())
    layers, hop = [layer], 0
    while True:
        hop += 1
        grown = layer.drop("hop").join(dag, [*key, "v"]).groupBy(*key, F.col("w").alias("v")).agg(F.sum("paths").alias("paths"))
        layer = N.settled(grown.withColumn("hop", F.lit(hop)))
        if not layer.limit(1).count():
            break
        layers.append(layer)
    counted = layers[0]
    for more in layers[1:]:
        counted = counted.unionByName(more)
    sigma = N.settled(counted.groupBy(*key, "v").agg(F.sum("paths").alias("paths"), F.max("hop").alias("level")))
    of_v = sigma.select(*key, "v", F.col("paths").alias("paths_v"), F.col("level").alias("level_v"))
    of_w = sigma.select(*key, F.col("v").alias("w"), F.col("paths").alias("paths_w"), F.col("level").alias("level_w"))
    rated = dag.join(of_v, [*key, "v"]).join(of_w, [*key, "w"])
    rated = rated.select(*key, "v", "w", (F.col("paths_v") / F.col("paths_w")).alias("share"), "level_v", "level_w")
    rated = written(rated, "paths", by="level_w")
    passed = None
    for level in range(hop - 1, 0, -1):
        now = rated.where(F.col("level_w") == level)
        if passed is None:
            whole = now.withColumn("delta", F.lit(0.0))
        else:
            ready = passed.where(F.col("level_v") == level).groupBy(*key, F.col("v").alias("w")).agg(F.sum("part").alias("delta"))
            whole = now.join(ready, [*key, "w"], "left")
        part = F.sum(F.col("share") * (1.0 + F.coalesce("delta", F.lit(0.0)))).alias("part")
        step = N.settled(whole.groupBy(*key, "v", "level_v").agg(part))
        passed = step if passed is None else passed.unionByName(step)
    if passed is None:
        return both.select("graph_id", F.col("src").alias("node_id"), F.lit(0.0).alias("raw")).where("false")
    out = N.settled(passed.where("s <> v").groupBy("graph_id", F.col("v").alias("node_id")).agg(F.sum("part").alias("raw")))
    dropped(dag, rated, sigma, *layers)
    return out


def betweenness(nodes: DataFrame, edges: DataFrame, weight: str | None = None) -> DataFrame:
    """Share of shortest paths through each node, normalised over the ordered pairs of other nodes.

    By hops, or by ``weight``, which must be positive; of repeated edges the least weight counts.
    Paths whose lengths agree to a billionth tie. Nodes without edges, and all of graphs of fewer
    than three nodes, have 0.
    """
    size = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    sums = dependencies(edges, weight)
    out = nodes.select("graph_id", "node_id").join(size, "graph_id").join(sums, ["graph_id", "node_id"], "left")
    pairs = (F.col("n") - 1) * (F.col("n") - 2)
    return out.select("graph_id", "node_id", F.when(pairs > 0, F.coalesce("raw", F.lit(0.0)) / pairs).otherwise(0.0).alias("betweenness"))


def weighted_clustering(nodes: DataFrame, edges: DataFrame, weight: str = "weight") -> DataFrame:
    """For each node the geometric mean weights of its triangles, over the graph's largest weight, summed over pairs of neighbours."""
    both = symmetrize(edges.withColumn("weight", F.col(weight).cast("double")))
    most = both.groupBy("graph_id").agg(F.max("weight").alias("most"))
    both = N.settled(both.join(most, "graph_id").select("graph_id", "src", "dst", F.try_divide("weight", "most").alias("x")))
    a = both.select("graph_id", F.col("src").alias("node_id"), F.col("dst").alias("u"), F.col("x").alias("x1"))
    b = both.select("graph_id", F.col("src").alias("node_id"), F.col("dst").alias("w"), F.col("x").alias("x2"))
    c = both.select("graph_id", F.col("src").alias("u"), F.col("dst").alias("w"), F.col("x").alias("x3"))
    closed = a.join(b, ["graph_id", "node_id"]).where("u < w").join(c, ["graph_id", "u", "w"])
    sums = closed.groupBy("graph_id", "node_id").agg(F.sum(F.cbrt(F.col("x1") * F.col("x2") * F.col("x3"))).alias("t"))
    out = N.degree(nodes, edges).join(sums, ["graph_id", "node_id"], "left")
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return out.select("graph_id", "node_id", F.when(pairs > 0, F.coalesce("t", F.lit(0.0)) / pairs).otherwise(0.0).alias("clustering"))


def network_characteristics(nodes: DataFrame, edges: DataFrame, weight: str = "weight") -> DataFrame:
    """One row for each graph: size, degrees, components, weighted clustering and efficiency, density."""
    degrees = N.degree(nodes, edges).groupBy("graph_id").agg(
        F.count("*").alias("num_nodes"), F.floor(F.sum("degree") / 2).cast("long").alias("num_edges"), F.avg("degree").alias("avg_degree"),
        F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"),
    )
    parts = N.largest_share(nodes, edges).select("graph_id", (F.col("n_components") == 1).alias("is_connected"), F.col("n_components").alias("num_components"))
    triangles = weighted_clustering(nodes, edges, weight).groupBy("graph_id").agg(F.avg("clustering").alias("avg_clustering"))
    reach = N.global_efficiency(nodes, edges, weight).select("graph_id", F.col("efficiency").alias("global_efficiency"))
    n = F.col("num_nodes")
    density = F.when(n > 1, 2.0 * F.col("num_edges") / (n * (n - 1))).otherwise(0.0)
    return degrees.join(parts, "graph_id").join(triangles, "graph_id").join(reach, "graph_id").withColumn("density", density)


BASE_FEATURES = """n_nodes n_edges density total_capacity mean_capacity std_capacity max_capacity avg_degree max_degree avg_clustering
max_betweenness mean_betweenness global_efficiency diameter n_components""".split()
MORE_FEATURES = "algebraic_connectivity avg_shortest_path degree_heterogeneity".split()


def global_features(nodes: DataFrame, edges: DataFrame, weight: str = "weight", extended: bool = False, fast: bool = False) -> DataFrame:
    """The 15 features of each graph, or 18 if ``extended``; nodes has capacity.

    Clustering, betweenness and mean path (of the largest component, the one with the smallest node
    of equal ones) use weights; efficiency and diameter (the largest of all components) use hops.
    ``fast`` leaves what needs paths or triangles at 0, and counts one component. Graphs without
    edges have 0 from avg_degree on.
    """
    capacity = F.coalesce("capacity", F.lit(0.0))
    sums = nodes.withColumn("capacity", capacity).groupBy("graph_id").agg(
        F.count("*").cast("double").alias("n_nodes"), F.sum("capacity").alias("total_capacity"), F.avg("capacity").alias("mean_capacity"),
        F.stddev_pop("capacity").alias("std_capacity"), F.max("capacity").alias("max_capacity"),
    )
    degrees = N.degree(nodes, edges).groupBy("graph_id").agg(
        (F.sum("degree") / 2).alias("n_edges"), F.avg("degree").alias("avg_degree"), F.max("degree").cast("double").alias("max_degree"),
        F.try_divide(F.stddev_pop("degree"), F.avg("degree")).alias("degree_heterogeneity"),
    )
    n = F.col("n_nodes")
    out = sums.join(degrees, "graph_id").withColumn("density", F.when(n > 1, 2.0 * F.col("n_edges") / (n * (n - 1))).otherwise(0.0))
    slow = ["avg_clustering", "max_betweenness", "mean_betweenness", "global_efficiency", "diameter"]
    if fast:
        out = out.withColumns({c: F.lit(0.0) for c in [*slow, *MORE_FEATURES[:2]]}).withColumn("n_components", F.lit(1.0))
        return out.select("graph_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in BASE_FEATURES + (MORE_FEATURES if extended else [])))
    hops = N.settled(N.shortest_paths(edges))
    reach = hops.groupBy("graph_id").agg(F.sum(1.0 / F.col("d")).alias("reach"), F.max("d").alias("diameter"))
    between = betweenness(nodes, edges, weight).groupBy("graph_id").agg(F.max("betweenness").alias("max_betweenness"), F.avg("betweenness").alias("mean_betweenness"))
    triangles = weighted_clustering(nodes, edges, weight).groupBy("graph_id").agg(F.avg("clustering").alias("avg_clustering"))
    roots = N.settled(N.components(nodes, edges))
    parts = roots.groupBy("graph_id").agg(F.count_distinct("root").cast("double").alias("n_components"))
    for table in (reach, between, triangles, parts):
        out = out.join(table, "graph_id", "left")
    out = out.withColumn("global_efficiency", F.when(n > 1, F.coalesce("reach", F.lit(0.0)) / (n * (n - 1))).otherwise(0.0))
    if extended:
        by_size = roots.groupBy("graph_id", "root").agg(F.count("*").alias("size"))
        largest = by_size.groupBy("graph_id").agg(F.max(F.struct("size", (-F.col("root")).alias("least")))["least"].alias("least"))
        inside = roots.join(largest, "graph_id").where(F.col("root") == -F.col("least")).select("graph_id", F.col("node_id").alias("src"))
        paths = N.shortest_paths(edges, weight).join(inside, ["graph_id", "src"], "left_semi").groupBy("graph_id").agg(F.avg("d").alias("avg_shortest_path"))
        second = algebraic_connectivity(nodes, edges, weight).withColumnRenamed("lambda2", "algebraic_connectivity")
        out = out.join(paths, "graph_id", "left").join(second, "graph_id", "left")
    has_edges = F.col("n_edges") > 0
    late = BASE_FEATURES[7:] + (MORE_FEATURES if extended else [])
    return out.select("graph_id", *BASE_FEATURES[:7], *(F.when(has_edges, F.coalesce(c, F.lit(0.0))).otherwise(0.0).alias(c) for c in late))


def hypernode_features(nodes: DataFrame, edges: DataFrame, weight: str = "weight") -> DataFrame:
    """The ten features of each node (lat, lon, capacity): centralities, nearest other node of its graph, its neighbours and its graph."""
    from stormgrid.operators.spatial import nearest_other

    key = ["graph_id", "node_id"]
    degrees = N.settled(N.degree(nodes, edges))
    both = symmetrize(edges.withColumn("weight", F.col(weight)))
    beside = both.select("graph_id", F.col("src").alias("node_id"), F.col("dst").alias("other"))
    facts = nodes.select("graph_id", F.col("node_id").alias("other"), "capacity").join(degrees.withColumnsRenamed({"node_id": "other", "degree": "other_degree"}), ["graph_id", "other"])
    around = N.settled(beside.join(facts, ["graph_id", "other"]))
    means = around.groupBy(*key).agg(F.avg("capacity").alias("neighbor_mean_capacity"), F.avg("other_degree").alias("neighbor_mean_degree"))
    near_gini = gini(around.where("capacity is not null"), key, "capacity").withColumnRenamed("gini", "neighbor_capacity_gini")
    whole = nodes.groupBy("graph_id").agg(F.count("*").alias("graph_n_nodes"), F.avg("capacity").alias("graph_mean_capacity"))
    whole_gini = gini(nodes.where("capacity is not null"), ["graph_id"], "capacity").withColumnRenamed("gini", "graph_capacity_gini")
    lone = nearest_other(nodes, "node_id", "graph_id").select(*key, F.col("nearest_km").alias("nearest_neighbor_km"))
    out = nodes.select(*key, "capacity").join(degrees, key).join(betweenness(nodes, edges, weight), key).join(N.clustering(nodes, edges), key)
    out = out.join(lone, key, "left").join(means, key, "left").join(near_gini, key, "left").join(whole, "graph_id").join(whole_gini, "graph_id", "left")
    return out.withColumn("neighbor_capacity_gini", F.coalesce("neighbor_capacity_gini", F.lit(0.0)))


def attack_scores(nodes: DataFrame, edges: DataFrame, strategy: str, weight: str = "weight") -> DataFrame:
    """(graph_id, node_id, score) by which a targeted attack takes nodes, highest first."""
    if strategy == "capacity":
        return nodes.select("graph_id", "node_id", F.coalesce("capacity", F.lit(0.0)).alias("score"))
    made = {
        "degree": lambda: N.degree(nodes, edges).withColumnRenamed("degree", "score"),
        "betweenness": lambda: betweenness(nodes, edges, weight).withColumnRenamed("betweenness", "score"),
        "closeness": lambda: N.closeness(nodes, edges, weight).withColumnRenamed("closeness", "score"),
    }
    if strategy not in made:
        raise ValueError(f"no strategy {strategy}")
    return made[strategy]()


def random_orders(nodes: DataFrame, replicates: int, seed: str) -> DataFrame:
    """(graph_id, node_id, replicate, place): ``replicates`` orders of each graph's nodes by hash numbers."""
    from stormgrid.functions.columns import hash_u

    dealt = nodes.select("graph_id", "node_id", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    u = hash_u(F.lit(seed), F.col("graph_id"), F.col("replicate"), F.col("node_id"))
    order = Window.partitionBy("graph_id", "replicate").orderBy(u, "node_id")
    return dealt.withColumn("place", F.row_number().over(order))
