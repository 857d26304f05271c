"""Queries over evaluation measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import measures as M
from faultline.plans.standins import INST, SCORES, confusion_sql, inst, measures_sql, scores
from faultline.session import table


def loc50_baseline(spark, sf_dir):
    """Learner-free baseline: an instance is predicted defective if its size is at least the median."""
    d = inst(spark, sf_dir)
    med = M.whole_median(d, "f_qty", "med")
    pred = d.crossJoin(F.broadcast(med)).select(F.col("label").alias("actual"), (F.col("f_qty") >= F.col("med")).cast("double").alias("score"))
    return M.with_measures(M.confusion(pred)).crossJoin(M.auc(pred).select("auc"))


def count_predictions(spark, sf_dir):
    """A count prediction for the stand-in: a fixed rate of the lines."""
    return inst(spark, sf_dir).select("project", "id", F.col("bugs").cast("double").alias("actual"), (F.col("f_lines") * 0.31).alias("score"))


def _ensemble(spark, sf_dir):
    s = scores(spark, sf_dir)
    three = s.select("event_id", "actual", F.explode(F.array(F.col("score"), 1 - F.col("score"), F.lit(0.6))).alias("score"))
    return M.confusion(M.mean_predictions(three, "event_id"))


def _class_counts(spark, sf_dir):
    return inst(spark, sf_dir).groupBy("project").agg(F.count_if(F.col("label") > 0).alias("class1"), F.count_if(F.col("label") <= 0).alias("class0"), F.round(F.avg("f_qty"), 6).alias("mean_qty"))


def _rollup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.posexplode(F.array(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"))).alias("metric", "value"))
    d = M.descriptive(li, "value", ["l_suppkey", "metric"]).drop("sd", "n")
    return d.join(M.mad(li, "value", ["l_suppkey", "metric"]), ["l_suppkey", "metric"]).withColumns({"median": F.round("median", 6), "mad": F.round("mad", 6)})


_COUNTS = f"WITH {INST}, pr AS (SELECT project, id, bugs::DOUBLE AS actual, f_lines * 0.31 AS score FROM inst)"
_CM = (
    "round(avg((a = p)::INT), 9) AS prec, round(count(*) FILTER (a = 0 AND p = a)::DOUBLE / nullif(count(*) FILTER (a = 0), 0), 9) AS prec0, round(count(*) FILTER (a <> 0 AND p = a)::DOUBLE / nullif(count(*) FILTER (a <> 0), 0), 9) AS prec1, "
    "round(count(*) FILTER (a > 0 AND p > 0)::DOUBLE / nullif(count(*) FILTER (a <> 0), 0), 9) AS precp, round(avg(abs(score - actual)), 9) AS aae, round(avg(abs(score - actual) / (actual + 1)), 9) AS are, round(sqrt(avg(((p - a) * (p - a))::DOUBLE)), 9) AS rmse "
    "FROM (SELECT *, trunc(actual)::BIGINT AS a, trunc(score + 0.5)::BIGINT AS p FROM pr)"
)
_AUC = "round(CASE WHEN sum(a) = 0 OR sum(1 - a) = 0 THEN 0.0 ELSE (sum(CASE WHEN a = 1 THEN rk ELSE 0 END) - sum(a) * (sum(a) + 1) / 2.0) / (sum(a)::DOUBLE * sum(1 - a)) END, 9) AS auc, sum(a)::BIGINT AS n_pos, sum(1 - a)::BIGINT AS n_neg"

QUERIES = {
    "loc50_baseline": loc50_baseline,
    "confusion_matrix": lambda s, d: M.confusion(scores(s, d)),
    "confusion_by_group": lambda s, d: M.confusion(scores(s, d), cf=0.4, by=["user_id"]),
    "confusion_ensemble": _ensemble,
    "binary_measures": lambda s, d: M.with_measures(M.confusion(scores(s, d), by=["user_id"])),
    "measures_long": lambda s, d: M.unpivot_measures(M.with_measures(M.confusion(scores(s, d), by=["event_type"])), ["event_type"]),
    "count_measures": lambda s, d: M.count_measures(count_predictions(s, d), by=["project"]),
    "count_measures_pooled": lambda s, d: M.count_measures(count_predictions(s, d)),
    "tied_rank": lambda s, d: M.tied_rank(scores(s, d), "score").select("event_id", F.col("rank").alias("tied_rank")),
    "both_classes": lambda s, d: M.both_classes(scores(s, d)),
    "whole_median": lambda s, d: M.whole_median(table(s, d, "events"), "value").withColumn("median", F.round("median", 6)),
    "whole_mad": lambda s, d: M.mad(table(s, d, "events"), "value").withColumn("mad", F.round("mad", 6)),
    "auc": lambda s, d: M.auc(scores(s, d)),
    "auc_by_group": lambda s, d: M.auc(scores(s, d), by=["user_id"]),
    "threshold_sweep": lambda s, d: M.threshold_sweep(scores(s, d)),
    "best_threshold": lambda s, d: M.best_threshold(M.threshold_sweep(scores(s, d))),
    "mad": lambda s, d: M.mad(table(s, d, "events"), "value", ["event_type"]).withColumn("mad", F.round("mad", 6)),
    "descriptive": lambda s, d: M.descriptive(table(s, d, "events"), "value", ["event_type"]).withColumn("median", F.round("median", 6)),
    "metric_rollup": _rollup,
    "class_counts": _class_counts,
}
_SWEEP = f"WITH {SCORES}, c AS (SELECT unnest({M.CUTS})::DOUBLE AS cf), k AS (SELECT cf, " + ", ".join(
    f"sum(CASE WHEN {x} THEN 1.0 ELSE 0.0 END)::DOUBLE AS {n}" for n, x in {"tp": "actual = 1 AND score >= cf", "tn": "actual = 0 AND score < cf", "fp": "actual = 0 AND score >= cf", "fn": "actual = 1 AND score < cf"}.items()
) + " FROM scores, c GROUP BY cf), r AS (SELECT cf, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS rec, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS prec FROM k), w AS (SELECT cf, round((CASE WHEN rec + prec = 0 THEN 0 ELSE 2 * rec * prec / (rec + prec) END) * sqrt(rec * prec), 9) AS fit FROM r)"
_RANKED = "SELECT *, (actual = 1)::INT AS a, rank() OVER ({0}ORDER BY score) + (count(*) OVER (PARTITION BY {1}score) - 1) / 2.0 AS rk FROM scores"
ORACLES = {
    "loc50_baseline": f"WITH {INST}, m AS (SELECT median(f_qty) AS med FROM inst), scores AS (SELECT label AS actual, (f_qty >= med)::INT::DOUBLE AS score FROM inst, m), k AS ({confusion_sql('scores')}), b AS ({measures_sql('k')}), r AS ({_RANKED.format('', '')}), u AS (SELECT {_AUC} FROM r) SELECT b.*, u.auc FROM b, u",
    "confusion_matrix": f"WITH {SCORES} {confusion_sql('scores')}",
    "confusion_by_group": f"WITH {SCORES} {confusion_sql('scores', cf='0.4', by='user_id')}",
    "confusion_ensemble": f"WITH {SCORES}, e AS (SELECT actual, (score + (1 - score) + 0.6) / 3 AS score FROM scores) {confusion_sql('e')}",
    "binary_measures": f"WITH {SCORES}, k AS ({confusion_sql('scores', by='user_id')}) {measures_sql('k', 'user_id, ')}",
    "measures_long": f"WITH {SCORES}, k AS ({confusion_sql('scores', by='event_type')}), b AS ({measures_sql('k', 'event_type, ')}) UNPIVOT (SELECT event_type, " + ", ".join(M.MEASURES) + " FROM b) ON " + ", ".join(M.MEASURES) + " INTO NAME measure VALUE value",
    "count_measures": f"{_COUNTS} SELECT project, {_CM} GROUP BY project",
    "count_measures_pooled": f"{_COUNTS} SELECT {_CM}",
    "tied_rank": f"WITH {SCORES} SELECT event_id, rk AS tied_rank FROM ({_RANKED.format('', '')})",
    "both_classes": f"WITH {SCORES}, o AS (SELECT 1 - actual AS actual, CASE WHEN score >= 0.5 THEN 0.0 ELSE 1.0 END AS score FROM scores), k AS ({confusion_sql('scores')}), k0 AS ({confusion_sql('o')}), u AS (SELECT {_AUC} FROM ({_RANKED.format('', '')})), m AS ({measures_sql('k', '1 AS class, ')} UNION ALL {measures_sql('k0', '0 AS class, ')}) SELECT m.*, u.auc FROM m, u",
    "whole_median": "SELECT round(median(value), 6) AS median FROM events",
    "whole_mad": "SELECT round(mad(value), 6) AS mad FROM events",
    "auc": f"WITH {SCORES} SELECT {_AUC} FROM ({_RANKED.format('', '')})",
    "auc_by_group": f"WITH {SCORES} SELECT user_id, {_AUC} FROM ({_RANKED.format('PARTITION BY user_id ', 'user_id, ')}) GROUP BY user_id",
    "threshold_sweep": f"{_SWEEP} SELECT * FROM w",
    "best_threshold": f"{_SWEEP} SELECT * FROM w ORDER BY fit DESC, cf LIMIT 1",
    "mad": "SELECT event_type, round(mad(value), 6) AS mad FROM events GROUP BY 1",
    "descriptive": "SELECT event_type, count(value) AS n, min(value) AS min, round(avg(value), 6) AS mean, round(median(value), 6) AS median, max(value) AS max, round(stddev_pop(value), 6) AS sd FROM events GROUP BY 1",
    "metric_rollup": "SELECT l_suppkey, metric, min(value) AS min, round(avg(value), 6) AS mean, round(median(value), 6) AS median, max(value) AS max, round(mad(value), 6) AS mad FROM (SELECT l_suppkey, 0 AS metric, l_quantity AS value FROM lineitem UNION ALL SELECT l_suppkey, 1, l_discount FROM lineitem UNION ALL SELECT l_suppkey, 2, l_tax FROM lineitem) GROUP BY 1, 2",
    "class_counts": f"WITH {INST} SELECT project, count(*) FILTER (label > 0) AS class1, count(*) FILTER (label <= 0) AS class0, round(avg(f_qty), 6) AS mean_qty FROM inst GROUP BY 1",
}
