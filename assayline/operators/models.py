"""Classifiers of Spark ML behind one call, search over their parameters, and what they find important."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.functions.columns import draw

#: Boosted trees stand for both boosting libraries that the models of this kind usually come from.
MODELS = ("gbt", "rf", "svm", "logistic", "ann")
GRIDS = {"gbt": {"maxDepth": [2, 3, 5], "maxIter": [10, 20]}, "rf": {"maxDepth": [4, 6, 8], "numTrees": [20, 50]}, "logistic": {"regParam": [0.001, 0.01, 0.1]}, "svm": {"regParam": [0.001, 0.01, 0.1]}}


def estimator(model: str, seed: int = 42, weight: str | None = None, n_features: int = 0, **params):
    common = {"featuresCol": "features", "labelCol": "label"}
    if weight and model != "ann":
        common["weightCol"] = weight
    if model == "gbt":
        return GBTClassifier(**{"maxIter": 10, "maxDepth": 3, "seed": seed} | common | params)
    if model == "rf":
        return RandomForestClassifier(**{"numTrees": 20, "maxDepth": 6, "seed": seed} | common | params)
    if model == "svm":
        return LinearSVC(**{"maxIter": 20, "regParam": 0.01} | common | params)
    if model == "logistic":
        return LogisticRegression(**{"maxIter": 30, "regParam": 0.01} | common | params)
    if model == "ann":
        return MultilayerPerceptronClassifier(**{"layers": [n_features, 128, 64, 2], "maxIter": 60, "seed": seed} | common | params)
    raise ValueError(f"unknown model {model!r}")


class Scorer:
    """A fitted model that adds proba; a margin without probabilities goes through a logistic fit on the training rows."""

    def __init__(self, model: Model, link: Model | None = None) -> None:
        self.model, self.link = model, link

    def __call__(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        if self.link is not None:
            out = self.link.transform(_margin(out).drop("prediction", "rawPrediction"))
        return out.withColumn("proba", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", "_margin")


def _margin(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=["_m"], outputCol="_margin").transform(df.withColumn("_m", vector_to_array("rawPrediction")[1])).drop("_m")


def balanced(df: DataFrame) -> DataFrame:
    """df with weight, which gives both classes equal weight. Their two counts are read first, so that no job of a fit counts anew or waits for a broadcast of them."""
    c = df.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")).first()
    share = lambda k: F.lit(c["n"] / (2 * k) if k else None).cast("double")
    return df.withColumn("weight", F.when(F.col("label") == 1, share(c["p"])).otherwise(share(c["n"] - c["p"])))


def copied(df: DataFrame, weight: str, seed: int = 42) -> DataFrame:
    """df with rows as often as their weight, scaled so that the smallest is 1, says: for learners that know no weights. What is left of a whole number is drawn by a hash of the row's features."""
    least = df.agg(F.min(weight).alias("_least"))
    u = draw(seed, F.xxhash64("features").cast("string")) / F.lit(4294967296.0)
    times = F.floor(F.col(weight) / F.col("_least") + u).cast("int")
    return df.crossJoin(F.broadcast(least)).withColumn("_times", times).withColumn("_times", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times", "_least")  # one row


def fit(train: DataFrame, model: str, seed: int = 42, **params) -> Scorer:
    """train: features (vector), label. Classes are weighted to equal weight; for ann, which takes no weights, rows of the smaller class are repeated."""
    n = len(train.first()["features"]) if model == "ann" else 0
    t = balanced(train)
    fitted = estimator(model, seed, "weight", n, **params).fit(copied(t, "weight", seed) if model == "ann" else t)
    if model != "svm":
        return Scorer(fitted)
    return Scorer(fitted, LogisticRegression(featuresCol="_margin", labelCol="label").fit(_margin(fitted.transform(t)).select("_margin", "label")))


def fit_score(train: DataFrame, test: DataFrame, model: str, **params) -> DataFrame:
    return fit(train, model, **params)(test)


def oof_predictions(df: DataFrame, model: str, fold: str = "fold", k: int = 5, fit_fn: Callable[[DataFrame], Callable] | None = None) -> DataFrame:
    """Each row scored by the model of the folds that it isn't in; k fits, one table."""
    out = None
    for i in range(k):
        train, test = df.filter(F.col(fold) != i), df.filter(F.col(fold) == i)
        scored = (fit_fn or (lambda t: fit(t, model)))(train)(test)
        out = scored if out is None else out.unionByName(scored)
    return out


def cv_mcc(df: DataFrame, model: str, fold: str = "fold", k: int = 5, **params) -> DataFrame:
    """(fold, mcc, ...) at threshold 0.5 of out-of-fold scores."""
    from assayline.operators.metrics import classification_metrics

    scored = oof_predictions(df, model, fold, k, lambda t: fit(t, model, **params))
    return classification_metrics(scored.withColumn("pred", (F.col("proba") >= 0.5).cast("int")), [fold])


def random_search(df: DataFrame, model: str, n_iter: int = 10, k: int = 3, fold: str = "fold", seed: int = 42, folder: str | None = None) -> tuple[DataFrame, dict]:
    """Mean MCC over the folds of some of the grid's settings, drawn by hash, and the best of them, the earlier of equals. df has its folds (group folds keep groups whole); fits run side by side, and with a folder an interrupted search goes on."""
    from assayline.plans.grid import run_cells

    spark = df.sparkSession
    grid = [{}]
    for name, values in GRIDS.get(model, {}).items():
        grid = [g | {name: v} for g in grid for v in values]
    order = spark.createDataFrame([(i,) for i in range(len(grid))], "i int").orderBy(draw(seed, "i"), "i").limit(n_iter).collect()

    def cell(i: int):
        return lambda: cv_mcc(df, model, fold, k, **grid[i]).agg(F.avg("mcc").alias("mcc")).select(F.lit(model).alias("model"), F.lit(i).alias("i"), F.lit(str(grid[i])).alias("params"), "mcc")

    table = run_cells(spark, {f"setting-{r['i']}": cell(r["i"]) for r in order}, folder).drop("cell")
    best = max(table.collect(), key=lambda r: (r["mcc"], -r["i"]))
    return table, grid[best["i"]]


def final_refit(train: DataFrame, model: str, params: dict, resample: Callable[[DataFrame], DataFrame] | None = None) -> Scorer:
    return fit(resample(train) if resample else train, model, **params)


def feature_importance(scorer: Scorer, names: list[str], spark) -> DataFrame:
    """(feature, importance), largest first: tree importances, or absolute coefficients."""
    m = scorer.model
    values = m.featureImportances.toArray() if hasattr(m, "featureImportances") else abs(m.coefficients.toArray())
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values, strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def linear_contribution(df: DataFrame, cols: list[str], coefficients: dict[str, float]) -> DataFrame:
    """(feature, contribution): mean of |coefficient * (x - mean)|, the exact attribution of a linear model."""
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(F.lit(coefficients[c]) * (F.col(c) - F.col(f"_m_{c}"))).alias("v")) for c in cols])
    return df.crossJoin(F.broadcast(means)).select(F.explode(parts).alias("x")).groupBy("x.feature").agg(F.round(F.avg("x.v"), 4).alias("contribution"))
