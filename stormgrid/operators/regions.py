"""Regions on the map: circles, polygons and the cells of a grid, with the features of the networks inside."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormgrid.functions import columns as C
from stormgrid.operators.centrality import global_features
from stormgrid.operators.joins import induced_edges
from stormgrid.operators.networks import settled
from stormgrid.operators.spatial import within_radius

LEAST_NODES = 2


def region_features(members: DataFrame, nodes: DataFrame, edges: DataFrame, extended: bool = False, fast: bool = True) -> DataFrame:
    """Features of the network that each region's members (window_id, node_id) and the edges between them make; window_id, then the features."""
    inside = settled(members.select("window_id", "node_id").join(nodes.select("node_id", "capacity"), "node_id").withColumnRenamed("window_id", "graph_id"))
    links = settled(induced_edges(edges.select("src", "dst", "weight"), members).select(F.col("window_id").alias("graph_id"), "src", "dst", "weight"))
    return global_features(inside, links, extended=extended, fast=fast).withColumnRenamed("graph_id", "window_id")


def grid_cells(df: DataFrame, box: tuple[float, float, float, float], step: float, most: int | None = None) -> DataFrame:
    """(window_id, clat, clon): a grid from south and west up to north and east; of more than ``most`` cells evenly spaced ones.

    ``df`` only lends its session. The grid is made on the executors.
    """
    south, west, north, east = box
    rows, columns = (math.floor((hi - lo + 1e-9) / step) + 1 for lo, hi in ((south, north), (west, east)))
    n = rows * columns
    count = n if most is None else min(n, most)
    place = F.col("id") if count == n else F.floor(F.col("id") * F.lit((n - 1) / max(count - 1, 1))).cast("bigint")
    cells = df.sparkSession.range(count).select(place.alias("window_id"))
    i, j = F.floor(F.col("window_id") / columns), F.col("window_id") % columns
    return cells.select("window_id", (F.lit(south) + i * step).alias("clat"), (F.lit(west) + j * step).alias("clon"))


def grid_heatmap(
    nodes: DataFrame, edges: DataFrame, box: tuple[float, float, float, float], step: float, radius_km: float, score: Column,
    least: int = LEAST_NODES, most: int | None = None, extended: bool = False, fast: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """The cells whose disk holds ``least`` nodes, with n, features and score; and one row of n_cells, skipped, lowest and highest score.

    ``score`` is a column of the features, such as a fitted model's.
    """
    cells = settled(grid_cells(nodes, box, step, most))
    near = within_radius(nodes.select("node_id", "lat", "lon"), cells, F.lit(radius_km)).select("window_id", "node_id")
    sizes = settled(near.groupBy("window_id").agg(F.count("*").alias("n")).where(F.col("n") >= least))
    members = near.join(sizes.select("window_id"), "window_id")
    features = region_features(members, nodes, edges, extended, fast)
    scored = settled(cells.join(sizes, "window_id").join(features, "window_id").withColumn("score", score))
    summary = scored.agg(F.count("*").alias("n_cells"), F.min("score").alias("lowest"), F.max("score").alias("highest"))
    whole = cells.agg(F.count("*").alias("all_cells"))
    summary = summary.crossJoin(whole).select("n_cells", (F.col("all_cells") - F.col("n_cells")).alias("skipped"), "lowest", "highest")  # one row each
    return scored, summary


def region_summary(
    nodes: DataFrame, edges: DataFrame, circle: tuple[float, float, float] | None = None, ring: list[tuple[float, float]] | None = None,
    extended: bool = False, fast: bool = True,
) -> DataFrame:
    """One row for a circle (lat, lon, km) or a polygon (lon, lat corners): n_stations, states, centre, radius and features.

    A polygon's centre is the mean place of its nodes, and it has no radius. No node, no row.
    """
    if (circle is None) == (ring is None):
        raise ValueError("a region is a circle or a ring")
    if circle is not None:
        inside = nodes.where(C.haversine_km(F.lit(circle[0]), F.lit(circle[1]), F.col("lat"), F.col("lon")) <= circle[2])
        centre, radius = (F.lit(float(circle[0])), F.lit(float(circle[1]))), F.lit(float(circle[2]))
    else:
        corners = ", ".join(f"named_struct('lon', {float(x)}D, 'lat', {float(y)}D)" for x, y in ring)
        inside = nodes.where(C.in_ring("lat", "lon", f"array({corners})"))
        centre, radius = (F.avg("lat"), F.avg("lon")), F.lit(None).cast("double")
    inside = settled(inside.withColumn("window_id", F.lit("region")))
    about = inside.groupBy("window_id").agg(
        F.count("*").alias("n_stations"), F.array_sort(F.collect_set("state")).alias("states"), centre[0].alias("center_lat"), centre[1].alias("center_lon")
    )
    return about.withColumn("radius_km", radius).join(region_features(inside, nodes, edges, extended, fast), "window_id").drop("window_id")
