"""Eigenvalues of graph Laplacians by joins and sums over node and edge tables, all graphs at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from stormgrid.operators.joins import symmetrize
from stormgrid.operators.networks import settled
from stormgrid.sources.shared import dropped

#: Vectors that a node keeps before the search starts again from its best estimate.
BASIS = 200


_RITZ = StructType().add("theta", DoubleType()).add("top", DoubleType()).add("rest", DoubleType()).add("vector", ArrayType(DoubleType()))


@F.pandas_udf(_RITZ)
def _least_ritz(steps: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Smallest and largest eigenvalue of the small tridiagonal matrices, with the smallest's vector and its residual."""
    for alphas, betas in steps:
        rows = []
        for a, b in zip(alphas, betas, strict=True):
            if a is None or len(a) == 0:
                rows.append((0.0, 0.0, 0.0, []))
                continue
            values, vectors = np.linalg.eigh(np.diag(a) + np.diag(b[:-1], 1) + np.diag(b[:-1], -1))
            rows.append((values[0], abs(values).max(), abs(b[-1] * vectors[-1, 0]), vectors[:, 0].tolist()))
        yield pd.DataFrame(rows, columns=["theta", "top", "rest", "vector"])


def _mixed(weights: str) -> Column:
    """Sum of a node's basis entries, each times the graph's weight for it."""
    return F.aggregate(F.zip_with("basis", weights, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)


def algebraic_connectivity(nodes: DataFrame, edges: DataFrame, weight: str | None = None, tol: float = 1e-8, kept: int = BASIS) -> DataFrame:
    """Second smallest Laplacian eigenvalue (graph_id, lambda2) of each graph, of weighted edges if ``weight``.

    Lanczos steps on all graphs at once, on vectors that sum to 0: an edge join and a sum by node for the
    product, sums by graph for the coefficients, twice against all earlier vectors. A graph ends when its
    vectors span the whole space, after n - 1 steps, or when the residual of the estimate is at most
    ``tol`` times the largest eigenvalue found, which bounds its distance from an eigenvalue. After
    ``kept`` steps the search starts again from the estimate, so a node holds at most that many numbers.
    The start is a hash of the node: that it has no part in the wanted direction is possible but for
    rounding unlikely. Graphs of one node and those of several components give 0. Loops and edges whose
    ends are not both nodes count nothing, repeated edges once.
    """
    names = nodes.select("graph_id", "node_id").distinct()
    both = symmetrize(edges.withColumn("weight", F.lit(1.0) if weight is None else F.col(weight).cast("double"))).where("src <> dst")
    for end in ("src", "dst"):
        both = both.join(names.withColumnRenamed("node_id", end), ["graph_id", end], "left_semi")
    links = settled(both.select("graph_id", "src", "dst", "weight"))

    def applied(state: DataFrame) -> DataFrame:
        """state (graph_id, node_id, basis) with y, the Laplacian times the last basis vector."""
        last = F.element_at("basis", -1)
        out = state.select("graph_id", F.col("node_id").alias("dst"), last.alias("q"))
        pulled = links.join(out, ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("node_id"))
        pulled = pulled.agg(F.sum(F.col("weight") * F.col("q")).alias("pull"), F.sum("weight").alias("degree"))
        y = F.coalesce(F.col("degree") * last - F.col("pull"), F.lit(0.0))
        return state.join(pulled, ["graph_id", "node_id"], "left").select("graph_id", "node_id", "basis", y.alias("y"))

    hashed = names.withColumn("q", F.xxhash64("node_id") / F.lit(2.0**63))
    sums = hashed.groupBy("graph_id").agg(F.count("*").alias("n"), F.avg("q").alias("mean"), F.var_pop("q").alias("var"))
    sums = settled(sums)
    none = F.array().cast("array<double>")
    graphs = settled(sums.select("graph_id", "n", none.alias("alphas"), none.alias("betas"), F.lit(0.0).alias("theta"), (F.col("n") < 2).alias("done")))
    unit = (F.col("q") - F.col("mean")) / F.sqrt(F.col("var") * F.col("n"))
    table = settled(applied(hashed.join(sums.where("n > 1"), "graph_id").select("graph_id", "node_id", F.array(unit).alias("basis"))))
    size = 1
    while graphs.where("not done").limit(1).count():
        # The same plan in every round, so that its compiled code is used again.
        parts = vector_to_array(Summarizer.sum(array_to_vector(F.transform("basis", lambda x: x * F.col("y")))))
        first = table.groupBy("graph_id").agg(parts.alias("c"), F.avg("y").alias("m"))
        once = table.join(first, "graph_id").withColumn("y", F.col("y") - F.col("m") - _mixed("c"))
        second = once.groupBy("graph_id").agg(parts.alias("c2"), F.avg("y").alias("m2"), F.sum(F.col("y") * F.col("y")).alias("ss"))
        found = first.join(second, "graph_id")
        spare = F.aggregate("c2", F.lit(0.0), lambda s, x: s + x * x) + F.col("n") * F.col("m2") * F.col("m2")
        beta = F.sqrt(F.greatest(F.col("ss") - spare, F.lit(0.0)))
        step = graphs.join(found, "graph_id", "left").withColumn("fresh", F.col("c").isNotNull())
        step = step.withColumn("alphas", F.when(F.col("fresh"), F.array_append("alphas", F.element_at("c", -1) + F.element_at("c2", -1))).otherwise(F.col("alphas")))
        step = step.withColumn("beta", beta).withColumn("betas", F.when(F.col("fresh"), F.array_append("betas", F.col("beta"))).otherwise(F.col("betas")))
        step = step.withColumn("ritz", _least_ritz("alphas", "betas"))
        ends = (F.size("c") >= F.col("n") - 1) | (F.col("beta") <= 1e-12 * F.col("ritz.top")) | (F.col("ritz.rest") <= tol * F.col("ritz.top"))
        step = step.withColumns({"theta": F.when(F.col("fresh"), F.col("ritz.theta")).otherwise(F.col("theta")), "done": ~F.col("fresh") | ends})
        step, last = settled(step.withColumn("vector", F.col("ritz.vector")).drop("ritz", "fresh")), graphs
        dropped(last)
        going = step.where("not done").select("graph_id", "c", "m", "c2", "m2", "beta", "vector")
        again = size == kept
        graphs = step.select("graph_id", "n", *((none if again else F.col(c)).alias(c) for c in ("alphas", "betas")), "theta", "done")
        graphs.written_at = step.written_at
        y = (F.col("y") - F.col("m") - _mixed("c")) - F.col("m2") - _mixed("c2")
        basis = F.array(_mixed("vector")) if again else F.array_append("basis", y / F.col("beta"))
        state = table.join(going, "graph_id").select("graph_id", "node_id", basis.alias("basis"))
        table, last = settled(applied(state)), table
        dropped(last)
        size = 1 if again else size + 1
    dropped(table, links, sums)
    return graphs.select("graph_id", F.greatest("theta", F.lit(0.0)).alias("lambda2"))
