"""Defect-data stand-ins built from the driver's tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import table

FEATURES = ["f_lines", "f_qty", "f_price", "f_disc", "f_size"]


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions: errors among events, scored by their value."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.col("event_type") == "error").cast("double").alias("actual"), (F.col("value") / 500.0).alias("score"))


SCORES = "scores AS (SELECT event_id, user_id, event_type, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END::DOUBLE AS actual, value / 500.0 AS score FROM events)"


def inst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances: parts with features of their line items; bugs = returned lines, label = more than a third returned."""
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint")).cast("double")
    r = F.count_if(F.col("l_returnflag") == "R")
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    agg = items.groupBy("l_partkey").agg(
        F.count(F.lit(1)).cast("double").alias("f_lines"), F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("f_qty"), cents("l_extendedprice").alias("f_price"), cents("l_discount").alias("f_disc"),
        r.alias("bugs"), F.when(3 * r > F.count(F.lit(1)), 1.0).otherwise(0.0).alias("label"),
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("project"), F.col("p_type").alias("kind"), F.col("p_size").cast("double").alias("f_size"))
    return agg.join(part, agg["l_partkey"] == part["id"]).select("id", "project", "kind", *FEATURES, "bugs", "label")


INST = """inst AS (SELECT p.p_partkey AS id, p.p_brand AS project, p.p_type AS kind, l.f_lines, l.f_qty, l.f_price, l.f_disc, p.p_size::DOUBLE AS f_size, l.bugs, CASE WHEN 3 * l.bugs > l.f_lines THEN 1.0 ELSE 0.0 END::DOUBLE AS label
 FROM part p JOIN (SELECT l_partkey, count(*)::DOUBLE AS f_lines, sum(l_quantity::BIGINT)::DOUBLE AS f_qty, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE AS f_price, sum(round(l_discount * 100)::BIGINT)::DOUBLE AS f_disc,
  count(*) FILTER (l_returnflag = 'R') AS bugs FROM lineitem GROUP BY 1) l ON l.l_partkey = p.p_partkey)"""


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as doubles; the label of the second half of the classes is 1."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("label") >= 5).cast("int").alias("label"), F.col("label").alias("cls"))


VEC = "vec AS (SELECT vec_id, embedding::DOUBLE[] AS v, (label >= 5)::INT AS label, label AS cls FROM embeddings)"


def measures_sql(source: str, cols: str = "") -> str:
    """SELECT of all binary measures over a relation with tp, tn, fp, fn."""
    r = lambda a, b: f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END)"
    rec, prec, pf = r("tp", "tp + fn"), r("tp", "tp + fp"), r("fp", "fp + tn")
    f = lambda b: r(f"(1 + {b}) * {rec} * {prec}", f"{rec} + {b} * {prec}")
    m = {
        "rec": rec, "prec": prec, "accu": r("tp + tn", "tp + fp + tn + fn"), "pf": pf, "tnr": r("tn", "tn + fp"), "fnr": r("fn", "fn + tp"),
        "mcc": r("tp * tn - fp * fn", "sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)"), "f": f("1.0"), "f2": f("4.0"), "f05": f("0.25"),
        "bal": f"1 - sqrt({pf} * {pf} + (1 - {rec}) * (1 - {rec})) / sqrt(2.0)", "gmean1": f"sqrt({rec} * {prec})", "gmean2": f"sqrt({rec} * (1 - {pf}))",
    }
    return f"SELECT {cols}tp, tn, fp, fn, " + ", ".join(f"round(({e})::DOUBLE, 9) AS {k}" for k, e in m.items()) + f" FROM {source}"


def confusion_sql(source: str, actual: str = "actual", score: str = "score", cf: str = "0.5", by: str = "") -> str:
    c = lambda x: f"sum(CASE WHEN {x} THEN 1.0 ELSE 0.0 END)::DOUBLE"
    a, p = f"{actual} >= {cf}", f"{score} >= {cf}"
    return f"SELECT {by + ', ' if by else ''}{c(f'{a} AND {p}')} AS tp, {c(f'NOT {a} AND NOT {p}')} AS tn, {c(f'NOT {a} AND {p}')} AS fp, {c(f'{a} AND NOT {p}')} AS fn FROM {source}" + (f" GROUP BY {by}" if by else "")
