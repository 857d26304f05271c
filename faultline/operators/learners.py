"""Named learners with one way to fit and score: those of pyspark.ml, and a few of our own over its parts."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.ml import classification as C
from pyspark.ml import regression as G
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators import relevancy as V
from faultline.operators.ordered import row_numbers
from faultline.session import cut

_RF = {"numTrees": 10, "seed": 1}
#: Random cosine features that stand for a radial kernel.
WAVES = 100
NEIGHBOURS, RADIUS, STUMPS = 5, 1.0, 50  # fixed values: defaults of the neighbour and boosting learners


def _assembled(train: DataFrame, test: DataFrame, features: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    asm = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip")
    return asm.transform(train).withColumn("__y", F.col(label).cast("int").cast("double")), asm.transform(test)


def _ml(make: Callable, count: bool = False) -> Callable:
    """A learner of pyspark.ml: probability of class 1 (raw margin where it has none), or the predicted count."""

    def run(train: DataFrame, test: DataFrame, features: list[str], label: str) -> DataFrame:
        a, b = _assembled(train, test, features, label)
        out = make().setFeaturesCol("__x").setLabelCol("__y").fit(a).transform(b)
        if count:
            return out.withColumn("score", F.col("prediction")).select(*test.columns, "score")
        raw = "probability" if "probability" in out.columns else "rawPrediction"
        return out.withColumn("score", vector_to_array(raw)[1]).select(*test.columns, "score")

    return run


def _kernel(make: Callable, count: bool = False, seed: int = 1) -> Callable:
    """A linear learner over random cosine features of the standardised columns, which stand for a radial kernel of width 1 / (number of features)."""

    def run(train: DataFrame, test: DataFrame, features: list[str], label: str) -> DataFrame:
        rng = np.random.default_rng(seed)
        w, b = rng.normal(0, math.sqrt(2 / len(features)), (WAVES, len(features))), rng.uniform(0, 2 * math.pi, WAVES)
        stats = train.agg(*[x for k, f in enumerate(features) for x in (F.avg(f).alias(f"m{k}"), F.stddev_pop(f).alias(f"s{k}"))]).first()
        scaled = [(F.col(f) - float(stats[f"m{k}"] or 0.0)) / float(stats[f"s{k}"] or 1.0) for k, f in enumerate(features)]
        x = F.array(*scaled)
        wave = lambda row: F.cos(F.aggregate(F.zip_with(x, row["w"], lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v) + row["b"])
        table = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in w[k]]).alias("w"), F.lit(float(b[k])).alias("b")) for k in range(WAVES)])
        names = [f"__k{k}" for k in range(WAVES)]
        wide = lambda df: cut(df.withColumn("__w", F.transform(table, wave))).select("*", *[F.col("__w")[k].alias(n) for k, n in enumerate(names)])
        return _ml(make, count)(wide(train), wide(test), names, label).select(*test.columns, "score")

    return run


def _keyed(df: DataFrame, features: list[str]) -> DataFrame:
    rows = cut(df.withColumn("__i", F.monotonically_increasing_id()))
    return row_numbers(rows, ["__i"], "vec_id__").withColumn("v", F.array(*[F.col(f).cast("double") for f in features]))


def _near(count: bool, radius: float | None) -> Callable:
    """The mean label of the nearest NEIGHBOURS rows, or of all within ``radius``; the training mean where there is none."""

    def run(train: DataFrame, test: DataFrame, features: list[str], label: str) -> DataFrame:
        a = _keyed(train.select(*features, (F.col(label).cast("int") if count else (F.col(label) > 0).cast("int")).alias("__y")), features)
        b = cut(_keyed(test, features))
        vote = V.knn_vote(a, b, NEIGHBOURS, "__y", "vec_id__") if radius is None else V.radius_vote(a, b, radius, "__y", "vec_id__").drop("n")
        mean = train.agg(F.avg((F.col(label).cast("int") if count else (F.col(label) > 0).cast("int")))).first()[0]
        return b.join(vote, "vec_id__", "left").select(*test.columns, F.coalesce("score", F.lit(float(mean or 0.0))).alias("score"))

    return run


def _boosted(train: DataFrame, test: DataFrame, features: list[str], label: str) -> DataFrame:
    """Discrete boosting of stumps for two classes (SAMME): a stump's say is the log odds of its weighted error; score is the share of the say that votes for 1."""
    a, b = _assembled(train, test, features, label)
    a = cut(a.select("__x", F.when(F.col("__y") > 0, 1.0).otherwise(0.0).alias("__y"), F.lit(1.0).alias("__w")))
    votes: list[tuple[float, object]] = []
    for _ in range(STUMPS):
        stump = C.DecisionTreeClassifier(maxDepth=1, featuresCol="__x", labelCol="__y", weightCol="__w", seed=1).fit(a)
        seen = stump.transform(a).withColumn("__miss", F.col("prediction") != F.col("__y"))
        sums = seen.agg(F.sum("__w").alias("w"), F.sum(F.when(F.col("__miss"), F.col("__w")).otherwise(0.0)).alias("e"), F.count(F.lit(1)).alias("n")).first()
        error = (sums["e"] or 0.0) / (sums["w"] or 1.0)
        if error >= 0.5:
            votes = votes or [(1.0, stump)]
            break
        say = math.log((1 - error) / max(error, 1e-10))
        votes.append((say, stump))
        if error <= 0:
            break
        a = cut(seen.select("__x", "__y", (F.when(F.col("__miss"), F.col("__w") * math.exp(say)).otherwise(F.col("__w")) * (sums["n"] / (sums["w"] - sums["e"] + sums["e"] * math.exp(say)))).alias("__w")))
    total: Column | None = None
    for k, (say, stump) in enumerate(votes):
        b = stump.transform(b).withColumn(f"__v{k}", F.col("prediction") * say).drop("prediction", "rawPrediction", "probability")
        total = F.col(f"__v{k}") if total is None else total + F.col(f"__v{k}")
    return b.withColumn("score", total / sum(s for s, _ in votes)).select(*test.columns, "score")


# The names under which learners are asked for.
BINARY: dict[str, Callable] = {
    "Naive Bayes": _ml(lambda: C.NaiveBayes(modelType="gaussian")),
    "Multinomial Naive Bayes": _ml(lambda: C.NaiveBayes(modelType="multinomial")),
    "Bernoulli Naive Bayes": _ml(lambda: C.NaiveBayes(modelType="bernoulli")),
    "Logistic Regression": _ml(lambda: C.LogisticRegression(regParam=1e-3)),
    "Decision Tree": _ml(lambda: C.DecisionTreeClassifier(maxDepth=10, seed=1)),
    "Extra Tree Classifier": _ml(lambda: C.RandomForestClassifier(numTrees=1, subsamplingRate=1.0, seed=1)),
    "AdaBoost Classifier": _boosted,
    "Bagging Classifier": _ml(lambda: C.RandomForestClassifier(featureSubsetStrategy="all", **_RF)),
    "Gradient Boosting Classifier": _ml(lambda: C.GBTClassifier(maxIter=20, seed=1)),
    "Random Forest Classifier": _ml(lambda: C.RandomForestClassifier(**_RF)),
    "Gaussian Process Classifier": _kernel(lambda: C.LogisticRegression(regParam=1e-3)),
    "K Neighbors Classifier": _near(False, None),
    "Radius Neighbors Classifier": _near(False, RADIUS),
    "Support Vector Classfifier": _kernel(lambda: C.LinearSVC(regParam=1e-2)),
    "Linear Support Vector Classfifier": _ml(lambda: C.LinearSVC()),
}
COUNT: dict[str, Callable] = {
    "Linear Regression": _ml(lambda: G.LinearRegression(solver="normal"), True),
    "Decision Tree Regressor": _ml(lambda: G.DecisionTreeRegressor(maxDepth=10, seed=1), True),
    "Extra Tree Regressor": _ml(lambda: G.RandomForestRegressor(numTrees=1, seed=1), True),
    "AdaBoost Regressor": _ml(lambda: G.GBTRegressor(maxIter=20, maxDepth=1, seed=1), True),
    "Bagging Regressor": _ml(lambda: G.RandomForestRegressor(featureSubsetStrategy="all", **_RF), True),
    "Gradient Boosting Regressor": _ml(lambda: G.GBTRegressor(maxIter=20, seed=1), True),
    "Random Forest Regressor": _ml(lambda: G.RandomForestRegressor(**_RF), True),
    "Gaussian Process Regressor": _kernel(lambda: G.LinearRegression(regParam=1e-3), True),
    "K Neighbors Regressor": _near(True, None),
    "Radius Neighbors Regressor": _near(True, RADIUS),
    "Support Vector Regressor": _kernel(lambda: G.LinearRegression(loss="huber"), True),
    "Linear Support Vector Regressor": _ml(lambda: G.LinearRegression(loss="huber"), True),
}
# Other names under which the forms offer learners.
ALIASES = {"Logistic Regresson": "Logistic Regression", "Bayesian Network": "Naive Bayes", "Support Vector Machine": "Linear Support Vector Classfifier", "Random Forest": "Random Forest Classifier"}


def get(name: str, count: bool | None = None) -> Callable:
    """The learner of that name: fit on a training set and score a test set. ``count`` None: whichever kind has the name."""
    name = ALIASES.get(name, name)
    for wanted, table in ((False, BINARY), (True, COUNT)):
        if count in (None, wanted) and name in table:
            return table[name]
    raise KeyError(name)


def fit_score(name: str, train: DataFrame, test: DataFrame, features: list[str], label: str = "label", count: bool | None = None) -> DataFrame:
    """``test`` plus ``score``: probability of class 1 (raw margin where a learner has none), or the predicted count. Counts are fitted as integers."""
    return get(name, count)(train, test, features, label)
