"""Model tables: closed-form shrinkage, and surrogates from pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormgrid.operators.losses import curve_metrics
from stormgrid.operators.networks import settled
from stormgrid.operators.ranking import region_holdout, state_holdout, stratified_split


def shrink_rates(counts: DataFrame, by: str) -> DataFrame:
    """Empirical Bayes for Poisson rates: Gamma prior by moments of each group; counts has n and t."""
    rate = F.col("n") / F.col("t")
    prior = counts.groupBy(by).agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), F.avg("t").alias("mean_t"))
    prior = prior.withColumn("v", F.greatest(F.col("v") - F.col("m") / F.col("mean_t"), F.lit(1e-9)))
    out = counts.join(prior, by).withColumn("raw", rate)
    a, b = F.col("m") * F.col("m") / F.col("v"), F.col("m") / F.col("v")
    return out.withColumn("shrunk", (a + F.col("n")) / (b + F.col("t")))


def shrink_rates_nested(counts: DataFrame, by: str, z: float = 1.959964) -> DataFrame:
    """Poisson rates in three levels: states towards the nation, their counties towards the state, with an interval.

    counts has ``by``, n and t (exposure). A state's rate is its posterior mean under a Gamma prior by
    the moments of all states' rates; a county's prior has that mean and the state's own variance
    beyond Poisson's (the mean of all states' where a state has one county). Adds raw, group_rate,
    national_rate, shrunk, and low and high at ``z`` deviations by Wilson and Hilferty's cube root.
    """
    rate = F.col("n") / F.col("t")
    groups = counts.groupBy(by).agg(F.sum("n").alias("gn"), F.sum("t").alias("gt"), F.var_samp(rate).alias("gv"), F.avg("t").alias("mean_t"))
    groups = groups.withColumn("gr", F.col("gn") / F.col("gt"))
    own = F.greatest(F.col("gv") - F.col("gr") / F.col("mean_t"), F.lit(1e-9))
    groups = groups.withColumn("gv", F.when(F.col("gv").isNotNull(), own))
    nation = groups.agg(
        F.avg("gr").alias("national_rate"), F.greatest(F.var_samp("gr") - F.avg(F.col("gr") / F.col("gt")), F.lit(1e-9)).alias("nv"),
        F.coalesce(F.avg("gv"), F.lit(1e-9)).alias("usual"),
    )
    groups = groups.crossJoin(F.broadcast(nation))  # one row
    a0, b0 = F.pow("national_rate", 2) / F.coalesce("nv", F.lit(1e-9)), F.col("national_rate") / F.coalesce("nv", F.lit(1e-9))
    groups = groups.select(by, "national_rate", ((a0 + F.col("gn")) / (b0 + F.col("gt"))).alias("group_rate"), F.coalesce("gv", "usual").alias("v"))
    out = counts.join(groups, by).withColumn("raw", rate)
    shape = F.pow("group_rate", 2) / F.col("v") + F.col("n")
    per = F.col("group_rate") / F.col("v") + F.col("t")
    root = lambda side: F.pow(F.greatest(F.lit(0.0), 1 - 1 / (9 * shape) + side * z / (3 * F.sqrt(shape))), 3)
    return out.withColumns({"shrunk": shape / per, "low": shape / per * root(-1), "high": shape / per * root(1)}).drop("v")


def severity_glm(counts: DataFrame, covariates: Sequence[str], ridge: float = 0.0) -> tuple[DataFrame, dict[str, float]]:
    """Share k / n of severe events by a binomial model of the covariates (logit link), weighted by n.

    Covariates are standardised over the rows with events; nulls count as their mean. Returns the
    rows with ``predicted`` (also for rows without events) and the coefficients, ``intercept`` among them.
    """
    from pyspark.ml.regression import GeneralizedLinearRegression

    made = [f"_{c}" for c in covariates]
    stages = [Imputer(inputCols=list(covariates), outputCols=made), VectorAssembler(inputCols=made, outputCol="_raw"), StandardScaler(withMean=True, inputCol="_raw", outputCol="_x")]
    typed = counts.withColumns({c: F.col(c).cast("double") for c in covariates})
    fitted = typed.where("n > 0").withColumns({"_y": F.col("k") / F.col("n"), "_n": F.col("n").cast("double")})
    glm = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_x", labelCol="_y", weightCol="_n", predictionCol="predicted", maxIter=50, tol=1e-10, regParam=ridge)
    model = Pipeline(stages=[*stages, glm]).fit(fitted)
    solved = model.stages[-1]
    coefficients = {"intercept": float(solved.intercept), **dict(zip(covariates, map(float, solved.coefficients), strict=True))}
    return model.transform(typed).drop(*made, "_raw", "_x"), coefficients


def shrink_severity(counts: DataFrame, by: str) -> DataFrame:
    """Empirical Bayes for proportions: Beta prior by moments of each group; counts has k and n."""
    rate = F.col("k") / F.col("n")
    prior = counts.groupBy(by).agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"))
    m, v = F.col("m"), F.greatest(F.col("v"), F.lit(1e-9))
    prior = prior.withColumn("w", F.greatest(m * (1 - m) / v - 1, F.lit(1e-6)))
    out = counts.join(prior, by).withColumn("raw", rate)
    return out.withColumn("shrunk", (F.col("m") * F.col("w") + F.col("k")) / (F.col("w") + F.col("n")))


def fit_curve_surrogate(df: DataFrame, features: Sequence[str], targets: Sequence[str], trees: int = 20, depth: int = 4) -> dict[str, PipelineModel]:
    """Gradient-boosted trees for each target, on features scaled by the training rows."""
    out = {}
    for target in targets:
        stages = [
            VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="keep"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True),
            GBTRegressor(labelCol=target, maxIter=trees, maxDepth=depth, stepSize=0.08, subsamplingRate=0.8, seed=42, predictionCol=f"pred_{target}"),
        ]
        out[target] = Pipeline(stages=stages).fit(df)
    return out


def fit_node_surrogate(df: DataFrame, features: Sequence[str], target: str, trees: int = 50) -> PipelineModel:
    filled = [f"{c}_filled" for c in features]
    stages = [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="features"),
        RandomForestRegressor(labelCol=target, numTrees=trees, minInstancesPerNode=2, seed=42, predictionCol=f"pred_{target}"),
    ]
    return Pipeline(stages=stages).fit(df)


def score(df: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    for model in models.values():
        df = model.transform(df).drop("raw_features", "features")
    return df


def protocols(df: DataFrame, row_id: str, seed: str, east_of: float = -100.0, share: float = 0.3, regions: Sequence[str] = (), least: int = 20, states: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The rows of df with a column split (train or test) under each protocol, by its name.

    east_west trains east of a meridian; stratified_stratum tests a share of each window_stratum;
    stratified_state tests whole states of about that share. region_<name> tests one region's states
    (column code), and state_<name> one state: all with ``least`` rows, or those in ``states``. Rows
    without a longitude take no part in east_west, those without a state none in folds and stratified_state.
    """
    side = F.when(F.col("center_lon") > east_of, "train").otherwise("test")
    known = df.where("state is not null")
    held = state_holdout(known, "window_stratum", share)
    out = {
        "east_west": df.where("center_lon is not null").withColumn("split", side),
        "stratified_stratum": stratified_split(df, "window_stratum", share, seed, row_id),
        "stratified_state": known.withColumn("split", F.when(F.col("state").isin(held), "test").otherwise("train")),
    }
    for region in regions:
        out[f"region_{region}"] = region_holdout(df, "code", region)
    large = known.groupBy("state").count().where(F.col("count") >= least)
    for state in sorted(r["state"] for r in large.toLocalIterator()):  # one row a state
        if states is None or state in states:
            out[f"state_{state}"] = known.withColumn("split", F.when(F.col("state") == state, "test").otherwise("train"))
    return out


def compare_splits(splits: dict[str, DataFrame], features: Sequence[str], targets: Sequence[str], trees: int = 20, depth: int = 4) -> DataFrame:
    """One model for each target, fitted and scored under each split: (split, target, n_train, n_test, r2, mae, overall_r2, overall_mae).

    Each split's rows have a column split; a model sees only its train rows, its scale included.
    Targets that are null count in neither part. A split whose train or test part is empty for a
    target has a row with its counts and nulls. Overall figures take all targets' test rows together.
    """
    scores, sizes = [], []
    for name, rows in splits.items():
        for target in targets:
            whole = rows.where(F.col(target).isNotNull()).select("split", *features, target)
            train, test = whole.where("split = 'train'"), whole.where("split = 'test'")
            n_train, n_test = train.count(), test.count()
            sizes.append((name, target, n_train, n_test))
            if n_train and n_test:
                scored = score(test, fit_curve_surrogate(train, features, [target], trees, depth))
                scores.append(scored.select(F.lit(name).alias("split"), F.lit(target).alias("target"), F.col(target).cast("double").alias("y_true"), F.col(f"pred_{target}").alias("y_pred")))
    spark = next(iter(splits.values())).sparkSession
    out = spark.createDataFrame(sizes, "split string, target string, n_train long, n_test long")
    every = reduce(DataFrame.unionAll, scores) if scores else spark.createDataFrame([], "split string, target string, y_true double, y_pred double")
    every = settled(every)
    each = curve_metrics(every, ["split", "target"], 1).drop("n")
    overall = curve_metrics(every, ["split"], 1).select("split", F.col("r2").alias("overall_r2"), F.col("mae").alias("overall_mae"))
    return out.join(each, ["split", "target"], "left").join(overall, "split", "left")


def importance(models: dict[str, PipelineModel], features: Sequence[str], spark) -> DataFrame:
    rows = [(t, f, float(v)) for t, m in models.items() for f, v in zip(features, m.stages[-1].featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "target string, feature string, importance double")


def tune(df: DataFrame, features: Sequence[str], target: str, depths: Sequence[int], trees: Sequence[int]):
    """The best of a grid on an inner validation split: the model and the error of each setting."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit

    model = GBTRegressor(featuresCol="features", labelCol=target, stepSize=0.08, subsamplingRate=0.8, seed=42)
    grid = ParamGridBuilder().addGrid(model.maxDepth, list(depths)).addGrid(model.maxIter, list(trees)).build()
    stages = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), model])
    search = TrainValidationSplit(estimator=stages, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=target), trainRatio=0.8, seed=42)
    fitted = search.fit(df)
    rows = [(int(p[model.maxDepth]), int(p[model.maxIter]), float(e)) for p, e in zip(grid, fitted.validationMetrics, strict=True)]
    return fitted.bestModel, df.sparkSession.createDataFrame(rows, "depth int, trees int, rmse double")
