"""Grouped Gaussian naive Bayes: any number of models fitted in one aggregation and applied in one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMOOTHING = 1e-9  # fixed value: share of the largest variance added to every variance


def fit(train: DataFrame, features: list[str], label: str = "label", by: list[str] | None = None) -> DataFrame:
    """One row a model (``by``): arrays of means and variances and the prior of each class, null where a class is missing."""
    by = by or []
    y = F.col(label) > 0
    stats = []
    for c, cond in (("0", ~y), ("1", y)):
        stats.append(F.sum(F.when(cond, 1).otherwise(0)).cast("double").alias(f"n{c}"))
        stats.append(F.array(*[F.avg(F.when(cond, F.col(f))) for f in features]).alias(f"m{c}"))
        stats.append(F.array(*[F.var_pop(F.when(cond, F.col(f))) for f in features]).alias(f"v{c}"))
    stats.append(F.greatest(*[F.var_pop(F.col(f)) for f in features]).alias("vmax") if len(features) > 1 else F.var_pop(F.col(features[0])).alias("vmax"))
    return train.groupBy(*by).agg(*stats)


def _log_density(x: Column, c: str) -> Column:
    """Over arrays, so that the generated code doesn't grow with the features."""
    v = F.transform(f"v{c}", lambda v: F.greatest(v + SMOOTHING * F.col("vmax"), F.lit(1e-12)))
    terms = F.zip_with(F.zip_with(x, f"m{c}", lambda x, m: (x - m) * (x - m)), v, lambda d, v: -0.5 * F.log(2 * 3.141592653589793 * v) - d / (2 * v))
    return F.log(F.col(f"n{c}") / (F.col("n0") + F.col("n1"))) + F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def score(rows: DataFrame, models: DataFrame, features: list[str], by: list[str] | None = None, out: str = "score") -> DataFrame:
    """Rows joined with the models (on ``by``, else every row with every model) plus the posterior of class 1.

    A model with one class gives that class with certainty. ``models`` is small: a row a model.
    """
    by = by or []
    j = rows.join(F.broadcast(models), by) if by else rows.crossJoin(F.broadcast(models))
    x = F.array(*[F.col(f).cast("double") for f in features])
    d = _log_density(x, "0") - _log_density(x, "1")
    p = F.when(F.col("n1") == 0, 0.0).when(F.col("n0") == 0, 1.0).otherwise(1 / (1 + F.exp(F.least(d, F.lit(700.0)))))
    return j.withColumn(out, p).drop("n0", "n1", "m0", "m1", "v0", "v1", "vmax")


def fit_leave_one_out(train: DataFrame, features: list[str], by: str, label: str = "label") -> DataFrame:
    """Models of all rows outside each value of ``by``, from one aggregation: the totals less the value's own sums.

    Variances come from centred sums, so large offsets do no harm. One row a value of ``by``.
    """
    from pyspark.sql import Window

    centre = train.agg(*[F.avg(f).alias(f"c_{f}") for f in features])
    rows = train.crossJoin(F.broadcast(centre)).select(by, (F.col(label) > 0).cast("int").alias("y"), *[(F.col(f) - F.col(f"c_{f}")).alias(f) for f in features], *[f"c_{f}" for f in features])
    aggs = []
    for c in (0, 1):
        cond = F.col("y") == c
        aggs.append(F.count_if(cond).cast("double").alias(f"n{c}"))
        for f in features:
            aggs += [F.sum(F.when(cond, F.col(f)).otherwise(0.0)).alias(f"s{c}_{f}"), F.sum(F.when(cond, F.col(f) * F.col(f)).otherwise(0.0)).alias(f"q{c}_{f}")]
    own = rows.groupBy(by).agg(*aggs, *[F.max(f"c_{f}").alias(f"c_{f}") for f in features])
    every = Window.partitionBy(F.lit(0))  # a row a value of by
    rest = own.select(by, *[f"c_{f}" for f in features], *[(F.sum(x).over(every) - F.col(x)).alias(x) for x in own.columns if x[0] in "nsq"])
    n = lambda c: F.col(f"n{c}")
    mean = lambda c, f: F.try_divide(F.col(f"s{c}_{f}"), n(c))
    var = lambda c, f: F.greatest(F.lit(0.0), F.try_divide(F.col(f"q{c}_{f}"), n(c)) - mean(c, f) * mean(c, f))
    whole = [F.greatest(F.lit(0.0), (F.col(f"q0_{f}") + F.col(f"q1_{f}")) / (n(0) + n(1)) - F.pow((F.col(f"s0_{f}") + F.col(f"s1_{f}")) / (n(0) + n(1)), 2)) for f in features]
    cols = [F.col("n0"), F.col("n1")]
    for c in (0, 1):
        cols += [F.array(*[mean(c, f) + F.col(f"c_{f}") for f in features]).alias(f"m{c}"), F.array(*[var(c, f) for f in features]).alias(f"v{c}")]
    return rest.select(by, *cols, (F.greatest(*whole) if len(whole) > 1 else whole[0]).alias("vmax"))
