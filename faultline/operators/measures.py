"""Evaluation measures: confusion matrices, binary and count measures, ranks and AUC, spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import cut

from faultline.operators.ordered import prefix_sums

#: The sweep's cut-offs: steps of 0.1 added up in doubles.
CUTS = [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6, 0.7, 0.7999999999999999, 0.8999999999999999, 0.9999999999999999]


def _counts(actual: Column, score: Column, cf: float | Column) -> dict[str, Column]:
    a, p = actual >= cf, score >= cf
    one = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    return {"tp": one(a & p), "tn": one(~a & ~p), "fp": one(~a & p), "fn": one(a & ~p)}


def confusion(df: DataFrame, actual: str = "actual", score: str = "score", cf: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """tp, tn, fp, fn per group; both sides are positive from ``cf`` on. Rows with a null side are in none; an empty ungrouped input gives nulls."""
    counts = _counts(F.col(actual).cast("double"), F.col(score).cast("double"), cf)
    return df.groupBy(*(by or [])).agg(*[v.alias(k) for k, v in counts.items()])


def mean_predictions(df: DataFrame, key: str, actual: str = "actual", score: str = "score") -> DataFrame:
    """Ensembles: one row a key with the mean score of its prediction rows."""
    return df.groupBy(key).agg(F.max(actual).alias(actual), F.avg(score).alias(score))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def _f(beta2: float, r: Column, p: Column) -> Column:
    return _ratio((1 + beta2) * r * p, r + beta2 * p)


#: Measures by name, as builders over tp, tn, fp, fn; more can be registered.
MEASURES = {
    "rec": lambda c: _ratio(c["tp"], c["tp"] + c["fn"]),
    "prec": lambda c: _ratio(c["tp"], c["tp"] + c["fp"]),
    "accu": lambda c: _ratio(c["tp"] + c["tn"], c["tp"] + c["fp"] + c["tn"] + c["fn"]),
    "pf": lambda c: _ratio(c["fp"], c["fp"] + c["tn"]),
    "tnr": lambda c: _ratio(c["tn"], c["tn"] + c["fp"]),
    "fnr": lambda c: _ratio(c["fn"], c["fn"] + c["tp"]),
    "mcc": lambda c: _ratio(c["tp"] * c["tn"] - c["fp"] * c["fn"], F.sqrt(c["tp"] + c["fp"]) * F.sqrt(c["tp"] + c["fn"]) * F.sqrt(c["tn"] + c["fp"]) * F.sqrt(c["tn"] + c["fn"])),
    "f": lambda c: _f(1.0, c["rec"], c["prec"]),
    "f2": lambda c: _f(4.0, c["rec"], c["prec"]),
    "f05": lambda c: _f(0.25, c["rec"], c["prec"]),
    "bal": lambda c: 1 - F.sqrt(c["pf"] * c["pf"] + (1 - c["rec"]) * (1 - c["rec"])) / F.sqrt(F.lit(2.0)),
    "gmean1": lambda c: F.sqrt(c["rec"] * c["prec"]),
    "gmean2": lambda c: F.sqrt(c["rec"] * (1 - c["pf"])),
}


def with_measures(conf: DataFrame, digits: int | None = 9) -> DataFrame:
    """A confusion frame plus all MEASURES; 0 where a denominator is 0."""
    c: dict[str, Column] = {k: F.col(k) for k in ("tp", "tn", "fp", "fn")}
    for name, build in MEASURES.items():
        c[name] = build(c)
    return conf.select("*", *[(F.round(c[n], digits) if digits is not None else c[n]).alias(n) for n in MEASURES])


def unpivot_measures(measured: DataFrame, ids: list[str]) -> DataFrame:
    """Long form: ids, measure, value."""
    return measured.unpivot(ids, list(MEASURES), "measure", "value")


def count_measures(df: DataFrame, actual: str = "actual", score: str = "score", by: list[str] | None = None, digits: int = 9) -> DataFrame:
    """Measures of predicted counts: prec, prec0, prec1, precp, aae, are, rmse; null where a class is missing.

    Counts are truncated to integers, predictions after adding a half; aae and are use the raw values.
    """
    a, s = F.col(actual).cast("bigint"), F.col(score).cast("double")
    p = (s + 0.5).cast("bigint")
    n = lambda c: F.count_if(c).cast("double")
    div = lambda x, y: F.round(F.try_divide(x, y), digits)
    err = F.abs(s - F.col(actual))
    return df.groupBy(*(by or [])).agg(
        F.round(F.avg((a == p).cast("double")), digits).alias("prec"), div(n((a == 0) & (p == a)), n(a == 0)).alias("prec0"), div(n((a != 0) & (p == a)), n(a != 0)).alias("prec1"),
        div(n((a > 0) & (p > 0)), n(a != 0)).alias("precp"), F.round(F.avg(err), digits).alias("aae"), F.round(F.avg(err / (F.col(actual) + 1)), digits).alias("are"),
        F.round(F.sqrt(F.avg(((p - a) * (p - a)).cast("double"))), digits).alias("rmse"),
    )


def tied_rank(df: DataFrame, value: str, by: list[str] | None = None, out: str = "rank") -> DataFrame:
    """Add the 1-based average rank of ``value`` (within ``by``); ties share their mean. Rows with a null value are left out."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    ranks = prefix_sums(counts, [value], {"__before": "__n"}, by).select(*by, value, (F.col("__before") + (F.col("__n") + 1) / 2.0).alias(out))
    return df.join(ranks, [*by, value])


def auc(df: DataFrame, actual: str = "actual", score: str = "score", by: list[str] | None = None, digits: int = 9) -> DataFrame:
    """Area under the ROC curve by the Mann-Whitney statistic; 0 if a class is missing.

    Rows are counted per distinct score first, so no row-level sort takes place.
    """
    by = by or []
    pos = F.when(F.col(actual).cast("int") == 1, 1).otherwise(0).cast("bigint")
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("__s")).agg(F.sum(pos).alias("__pos"), F.sum(1 - pos).alias("__neg"))
    cum = prefix_sums(counts, ["__s"], {"__before": "__neg"}, by)
    wins = F.sum(F.col("__pos").cast("double") * (F.col("__before") + F.col("__neg") / 2.0))
    p, n = F.sum("__pos").cast("double"), F.sum("__neg").cast("double")
    return cum.groupBy(*by).agg(F.round(F.when((p == 0) | (n == 0), 0.0).otherwise(wins / (p * n)), digits).alias("auc"), F.sum("__pos").alias("n_pos"), F.sum("__neg").alias("n_neg"))


def threshold_sweep(df: DataFrame, actual: str = "actual", score: str = "score", digits: int = 9) -> DataFrame:
    """(cf, fit): F * GMean1 at each of CUTS, all in one aggregation; ``actual`` is 0 or 1."""
    a, s = F.col(actual).cast("double") >= 0.5, F.col(score).cast("double")
    one = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    cells = [F.struct(F.lit(cf).alias("cf"), one(a & (s >= cf)).alias("tp"), one(~a & (s < cf)).alias("tn"), one(~a & (s >= cf)).alias("fp"), one(a & (s < cf)).alias("fn")) for cf in CUTS]
    swept = df.agg(F.array(*cells).alias("c")).select(F.inline("c"))
    return with_measures(swept, None).select("cf", F.round(F.col("f") * F.col("gmean1"), digits).alias("fit"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of the highest fit; the smallest cut-off among equals."""
    return sweep.orderBy(F.desc("fit"), "cf").limit(1)


def whole_median(df: DataFrame, value: str, out: str = "median") -> DataFrame:
    """One row: the exact median of all non-null values, null if there are none.

    Values are counted first and the counts summed over ranges, so no task holds all distinct values, as the built-in would.
    """
    from faultline.operators.ordered import prefix_sums

    counts = cut(df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    lo, hi = (total - 1) // 2, total // 2
    ranked = prefix_sums(counts, ["v"], {"before": "n"})
    holds = lambda k: F.max(F.when((F.col("before") <= k) & (F.col("before") + F.col("n") > k), F.col("v")))
    return ranked.agg(((holds(lo) + holds(hi)) / 2).alias(out))


def mad(df: DataFrame, value: str, by: list[str] | None = None, out: str = "mad") -> DataFrame:
    """Median absolute deviation from the median, per group."""
    by = by or []
    if not by:
        off = df.crossJoin(F.broadcast(whole_median(df, value, "__med"))).select(F.abs(F.col(value) - F.col("__med")).alias("__off"))
        return whole_median(off, "__off", out)
    med = df.groupBy(*by).agg(F.median(value).alias("__med"))
    joined = df.join(med, by)
    return joined.groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("__med"))).alias(out))


def both_classes(df: DataFrame, actual: str = "actual", score: str = "score", digits: int = 9) -> DataFrame:
    """(class, counts, measures, auc): the measures with either class as the positive one, and the AUC, which is the same for both."""
    other = df.select((1 - F.col(actual)).alias("actual"), F.when(F.col(score) >= 0.5, 0.0).otherwise(1.0).alias("score"))
    sides = [confusion(df, actual, score).withColumn("class", F.lit(1)), confusion(other).withColumn("class", F.lit(0))]
    return with_measures(sides[0].unionByName(sides[1]), digits).crossJoin(auc(df, actual, score, digits=digits).select("auc"))


def descriptive(df: DataFrame, value: str, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """count, min, mean, median, max and population standard deviation of the non-null values."""
    v = F.col(value)
    return df.groupBy(*(by or [])).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.round(F.avg(v), digits).alias("mean"), F.median(v).alias("median"), F.max(v).alias("max"), F.round(F.stddev_pop(v), digits).alias("sd"))
