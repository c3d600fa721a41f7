"""Surrogates from pyspark.ml on the window tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormgrid.operators import losses as L
from stormgrid.operators import models as M
from stormgrid.operators.joins import curve_to_columns
from stormgrid.operators.networks import settled
from stormgrid.plans.registry import Tables, query

FEATURES = ["radius_km", "center_lat", "center_lon"]


def windows(t: Tables):
    wide = curve_to_columns(t.fx_curves, ["betweenness", "random"], [10, 50])
    return t.fx_windows.join(wide, "window_id")


@query("m01_curve_surrogate")
def m01(t: Tables):
    df = windows(t)
    models = M.fit_curve_surrogate(df.where("center_lon > -100"), FEATURES, ["y_betweenness_10", "y_random_50"], 5, 3)
    return M.score(df, models).select("window_id", *(F.round(c, 4).alias(c) for c in ("pred_y_betweenness_10", "pred_y_random_50")))


@query("m03_score")
def m03(t: Tables):
    """Scores of three kinds of areas: circles, polygons by their box and area, and cells of a grid."""
    df = windows(t)
    models = M.fit_curve_surrogate(df.where("center_lon > -100"), FEATURES, ["y_random_50"], 5, 3)
    circles = t.fx_windows.select(F.lit("circle").alias("kind"), F.col("window_id").alias("area_id"), *FEATURES)
    side = (F.col("c_custkey") % 9 + 1) / 4.0
    polygons = t.customer.select(
        F.lit("polygon").alias("kind"), F.col("c_custkey").cast("string").alias("area_id"), (side * 111.0 / 3.141592653589793**0.5).alias("radius_km"),
        (F.col("c_nationkey") % 10 * 1.5 + 30.7).alias("center_lat"), (F.col("c_nationkey") % 10 * 4.0 - 118.2).alias("center_lon"),
    )
    grid = t.fx_windows.select(F.floor("center_lat").alias("y"), F.floor("center_lon").alias("x")).distinct().select(
        F.lit("grid").alias("kind"), F.concat_ws("_", "y", "x").alias("area_id"), F.lit(55.5).alias("radius_km"), (F.col("y") + 0.5).alias("center_lat"), (F.col("x") + 0.5).alias("center_lon")
    )
    scored = M.score(circles.unionByName(polygons).unionByName(grid), models)
    return scored.select("kind", "area_id", F.round("pred_y_random_50", 4).alias("pred_y_random_50"))


@query("m02_node_surrogate")
def m02(t: Tables):
    df = t.fx_nodes.withColumn("loss", F.col("capacity") / 1000.0)
    model = M.fit_node_surrogate(df, ["lat", "lon", "capacity"], "loss", 10)
    return model.transform(df).select("node_id", F.round("pred_loss", 4).alias("pred_loss"))


@query("m05_importance")
def m05(t: Tables):
    models = M.fit_curve_surrogate(windows(t), FEATURES, ["y_random_50"], 5, 3)
    return M.importance(models, FEATURES, t.spark).withColumn("importance", F.round("importance", 4))


@query("m06_compare_splits")
def m06(t: Tables):
    df = windows(t)
    splits = {"east_west": F.col("center_lon") > -100, "low_north": F.col("center_lat") < 37}
    out = None
    for name, train in splits.items():
        models = M.fit_curve_surrogate(df.where(train), FEATURES, ["y_random_50"], 5, 3)
        scored = M.score(df.where(~train), models).select(F.lit(name).alias("split"), F.col("y_random_50").alias("y_true"), F.col("pred_y_random_50").alias("y_pred"))
        out = scored if out is None else out.unionAll(scored)
    return L.curve_metrics(out, ["split"]).select("split", F.round("r2", 4).alias("r2"), F.round("mae", 4).alias("mae"), "n")


def _rounded(found):
    return found.withColumns({c: F.round(c, 4) for c in ("r2", "mae", "overall_r2", "overall_mae")})


def coded(t: Tables):
    """Windows with their targets and the codes of states that stand for the letters of the fixture's."""
    code = F.split_part(F.lit("CA TX NY MD DE IA OH ME FL ZZ"), F.lit(" "), F.expr("1 + cast(substring(state, 2) as int)"))
    return settled(windows(t).withColumn("code", code))


@query("m06_protocols")
def m06_protocols(t: Tables):
    """Three protocols and a region, two targets each."""
    splits = M.protocols(coded(t), "ord", "protocols", regions=["northeast"], states=[])
    return _rounded(M.compare_splits(splits, FEATURES, ["y_betweenness_10", "y_random_50"], 5, 3))


@query("m06_state_folds")
def m06_folds(t: Tables):
    """A fold for each state of 20 windows."""
    splits = {k: v for k, v in M.protocols(coded(t), "ord", "protocols").items() if k.startswith("state_")}
    return _rounded(M.compare_splits(splits, FEATURES, ["y_random_50"], 5, 3))


@query("m04_tune")
def m04(t: Tables):
    _, errors = M.tune(windows(t), FEATURES, "y_random_50", [2, 3], [2, 4])
    return errors.withColumn("rmse", F.round("rmse", 4))
