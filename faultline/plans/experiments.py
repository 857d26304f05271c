"""Queries over samplers, learners and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import bayes, experiments as E, genetic as G, learners, measures as M, ordered, relational as R, relevancy as V, sampling as S
from faultline.plans.standins import FEATURES, INST, SCORES, confusion_sql, inst, measures_sql, scores, vec
from faultline.session import table

NX = 64  # all entries of an embedding


def _vec_split(s, d):
    v, names = E.with_features(vec(s, d), "v", NX)
    return v.where("vec_id % 5 <> 0"), v.where("vec_id % 5 = 0"), names


def _lsh(s, d):
    tr, te, names = _vec_split(s, d)
    return E.lsh_selection(tr, te, names, "v", "label")


def _ga(by_distribution):
    def run(s, d):
        i = inst(s, d)
        return E.genetic_selection(i.where("id % 5 <> 0"), i.where("id % 5 = 0"), FEATURES, by_distribution=by_distribution)

    return run


def _nnb(s, d):
    v, names = E.with_features(vec(s, d), "v", NX)
    return E.nn_filter_benchmark(v.where("vec_id % 20 <> 0"), v.where("vec_id % 20 = 0"), names, "v", "label", [1, 5])


def _pca(s, d):
    v, names = E.with_features(vec(s, d), "v", NX)
    share = E.pca(v, names)[2]
    return s.createDataFrame([(k, round(float(x), 6)) for k, x in enumerate(share)], "component int, share double")


def _learner(name):
    def run(s, d):
        i = inst(s, d)
        out = learners.fit_score(name, i.where("id % 5 <> 0"), i.where("id % 5 = 0"), FEATURES)
        return M.with_measures(M.confusion(out.withColumn("actual", F.col("label")).select("actual", "score")))

    return run


def _counts(s, d):
    i = inst(s, d).withColumn("actual", F.col("bugs").cast("double"))
    out = learners.fit_score("Linear Regression", i.where("id % 5 <> 0"), i.where("id % 5 = 0"), FEATURES, "actual")
    return M.count_measures(out)


def _nb(s, d):
    i = inst(s, d)
    m = bayes.fit(i.where("id % 5 <> 0"), FEATURES)
    return bayes.score(i.where("id % 5 = 0"), m, FEATURES).select("id", F.round("score", 6).alias("score"))


def _near(name):
    def run(s, d):
        v, names = E.with_features(vec(s, d), "v", NX)
        out = learners.fit_score(name, v.where("vec_id % 5 <> 0"), v.where("vec_id % 5 = 0"), names)
        return out.select("vec_id", F.round("score", 6).alias("score"))

    return run


def _fold_scores(s, d):
    """Predictions of four validation sets for two chromosomes: parity of the user and day."""
    return scores(s, d).select(F.pmod("user_id", F.lit(2)).cast("int").alias("chrm"), F.pmod(F.floor(F.col("user_id") / 2), F.lit(4)).cast("int").alias("vset"), "actual", "score")


def _log(s, d):
    m = M.confusion(scores(s, d).withColumn("day", F.pmod("user_id", F.lit(10))), by=["event_type", "day"])
    line = F.concat(F.lit("GIS-"), "event_type", F.lit(":d"), "day", F.lit(": {'tp': "), "tp", F.lit(", 'fp': "), "fp", F.lit("}"))
    return E.parse_log(m.select(line.alias("line")))


def _loo(s, d):
    """Leave one project out: measures of naive Bayes on each project, trained on all others."""
    i = inst(s, d)
    m = bayes.fit_leave_one_out(i, FEATURES, "project")
    scored = bayes.score(i, m, FEATURES, ["project"]).withColumn("actual", F.col("label"))
    return M.confusion(scored, by=["project"])


def _earlier(s, d):
    return E.earlier_versions(inst(s, d), "project", FEATURES, "label", 6)


def _validation(s, d):
    """Rows of each kind of validation set: the training set, its nearest-neighbour filter, a random set of the test's size."""
    v = vec(s, d)
    tr, te = v.where("vec_id % 20 <> 0"), v.where("vec_id % 20 = 0")
    sets = {"train": tr.select("vec_id"), "nn_filter": V.nn_filter(tr, te, 1), "random": S.least_hash(tr.select("vec_id"), te.count(), 3, "vec_id")}
    return R.union_all([x.withColumn("kind", F.lit(k)) for k, x in sets.items()])


def _growth(s, d):
    i = inst(s, d)
    ranked = [r["feature"] for r in V.mutual_information(i, FEATURES, "label").orderBy(F.desc("mi"), F.desc("feature")).collect()]
    return s.createDataFrame([(k, f) for k, f in enumerate(E.grow_features(i, ranked, "label", "id"))], "place int, feature string")


def _draws(s, d):
    """Two hundred draws from all users, numbered without gaps."""
    users = ordered.row_numbers(table(s, d, "users").groupBy("id").agg(F.min("username").alias("username")), ["id"], "pos")
    return S.with_replacement(users.select("pos", "username"), 200, 4, "pos", users.count())


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _count_sets(s, d):
    return inst(s, d).select(F.pmod("id", F.lit(3)).cast("int").alias("chrm"), F.when(F.col("f_size") > 25, 1).otherwise(0).alias("vset"), F.col("bugs").cast("double").alias("actual"), (F.col("f_lines") * 0.31).alias("score"))


def _population(s, d, parity):
    """Customers as chromosomes: the thousandths of their balance are the fitness."""
    c = table(s, d, "customer").where(F.pmod("c_custkey", F.lit(2)) == parity)
    return c.select(F.col("c_custkey").alias("chrm"), (F.floor(F.pmod(F.col("c_acctbal"), F.lit(100.0))) / 1000).alias("fitness"))


def _tuned(s, d):
    tr, te, names = _vec_split(s, d)
    return E.lsh_tuned(tr, te, names, "v", "label")


_TREE = """tree AS (SELECT id, method, dataset, measure, unnest(range(len(vals)))::INT AS run, unnest(vals) AS value FROM (SELECT id, method, dataset, m.key AS measure, m.value AS vals FROM (SELECT id, method, ds.key AS dataset, unnest(map_entries(ds.value.measures)) AS m
 FROM (SELECT id, me.key AS method, unnest(map_entries(me.value)) AS ds FROM (SELECT id, unnest(map_entries(nullif(results, '')::JSON::MAP(VARCHAR, MAP(VARCHAR, STRUCT(measures MAP(VARCHAR, DOUBLE[]), confs VARCHAR[]))))) AS me FROM experiment)))))"""
_DRAW = lambda seed, key: f"('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"

QUERIES = {
    "experiment_results_tree": lambda s, d: E.result_tree(table(s, d, "experiment")),
    "violin_stats": lambda s, d: E.violin(E.result_tree(table(s, d, "experiment"))),
    "experiment_log": _log,
    "stratified_folds": lambda s, d: S.stratified_folds(inst(s, d).select("id", "label"), "label", 10, 5, "id"),
    "class_limited_sample": lambda s, d: S.class_limited(inst(s, d).select("id", "label"), "label", {0.0: 30, 1.0: 20}, 5, "id"),
    "unique_sample": lambda s, d: S.least_hash(inst(s, d).select("id", "label"), 100, 9, "id"),
    "replacement_sample": _draws,
    "chromosome_fitness": lambda s, d: G.binary_fitness(_fold_scores(s, d), ["chrm"]),
    "chromosome_spread": lambda s, d: _rounded(G.spread(_fold_scores(s, d), ["chrm"])),
    "count_fitness": lambda s, d: _rounded(G.count_fitness(_count_sets(s, d), ["chrm"])),
    "population_order": lambda s, d: G.ranked(_population(s, d, 0)),
    "population_merge": lambda s, d: G.combine(_population(s, d, 0), _population(s, d, 1)),
    "knn_classifier": _near("K Neighbors Classifier"), "radius_classifier": _near("Radius Neighbors Classifier"),
    "roulette_pick": lambda s, d: S.roulette(inst(s, d).select("id", F.col("f_qty").cast("bigint").alias("w")), "w", "id", 0.37),
    "naive_bayes_scores": _nb,
    "within_project_cv": lambda s, d: E.cross_validation(inst(s, d), FEATURES, "label", "id", 5, ["kind"]),
    "lsh_instance_selection": _lsh,
    "ga_instance_selection": _ga(False), "ks_instance_selection": _ga(True),
    "nnfilter_benchmark": _nnb,
    "pca_variance": _pca,
    "learner_logistic": _learner("Logistic Regression"), "learner_forest": _learner("Random Forest Classifier"),
    "learner_counts": _counts,
    "leave_one_out": _loo, "earlier_version_benchmark": _earlier, "validation_sets": _validation, "feature_growth": _growth, "lsh_tuned": _tuned,
    "mutation_size": lambda s, d: inst(s, d).groupBy("kind").agg(F.floor(F.stddev_pop("bugs") + 1).cast("bigint").alias("step")),
}
_DEN = lambda c: "ln(n%s / (n0 + n1)) + " % c + " + ".join(f"(-0.5 * ln(2 * 3.141592653589793 * greatest(v{c}_{f} + 1e-9 * vmax, 1e-12)) - power(i.{f} - m{c}_{f}, 2) / (2 * greatest(v{c}_{f} + 1e-9 * vmax, 1e-12)))" for f in FEATURES)
_NBF = FEATURES
_MODEL = "count(*) FILTER (label = 0)::DOUBLE AS n0, count(*) FILTER (label = 1)::DOUBLE AS n1, greatest(" + ", ".join(f"var_pop({f})" for f in FEATURES) + ") AS vmax, " + ", ".join(f"avg({f}) FILTER (label = {c}) AS m{c}_{f}, var_pop({f}) FILTER (label = {c}) AS v{c}_{f}" for c in "01" for f in FEATURES)
_POSTERIOR = f"CASE WHEN n1 = 0 THEN 0.0 WHEN n0 = 0 THEN 1.0 ELSE 1 / (1 + exp(least(({_DEN('0')}) - ({_DEN('1')}), 700.0))) END"
_LOO = f"WITH {INST}, p AS (SELECT DISTINCT project FROM inst), m AS (SELECT p.project AS held, count(*) FILTER (label = 0)::DOUBLE AS n0, count(*) FILTER (label = 1)::DOUBLE AS n1, " + _MODEL[_MODEL.index("greatest"):] + f" FROM inst i JOIN p ON i.project <> p.project GROUP BY 1), s AS (SELECT project, label AS actual, {_POSTERIOR} AS score FROM inst i JOIN m ON held = project) {confusion_sql('s', by='project')}"
_FOLDS = f"f AS (SELECT (user_id % 2)::INT AS chrm, (user_id // 2 % 4)::INT AS vset, actual, score FROM scores), k AS ({confusion_sql('f', by='chrm, vset')})"
_POP = "WITH p AS (SELECT c_custkey AS chrm, floor(((c_acctbal % 100) + 100) % 100) / 1000 AS fitness, (c_custkey % 2)::INT AS is_new FROM customer)"
ORACLES = {
    "leave_one_out": _LOO,
    "mutation_size": f"WITH {INST} SELECT kind, floor(stddev_pop(bugs) + 1)::BIGINT AS step FROM inst GROUP BY 1",
    "validation_sets": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), t AS (SELECT * FROM v WHERE vec_id % 20 <> 0), q AS (SELECT * FROM v WHERE vec_id % 20 = 0) SELECT vec_id, 'train' AS kind FROM t UNION ALL SELECT DISTINCT nb, 'nn_filter' FROM (SELECT t.vec_id AS nb, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, t.v), t.vec_id) AS k FROM q, t) WHERE k = 1 UNION ALL SELECT vec_id, 'random' FROM (SELECT vec_id, row_number() OVER (ORDER BY " + _DRAW(3, "vec_id") + ", vec_id) AS k FROM t) WHERE k <= (SELECT count(*) FROM q)",
    "experiment_results_tree": f"WITH {_TREE} SELECT * FROM tree",
    "violin_stats": f"WITH {_TREE}, s AS (SELECT method, measure, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS lo, max(value) AS hi FROM tree GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY measure ORDER BY median, method)::INT AS place FROM s",
    "experiment_log": f"WITH {SCORES}, s2 AS (SELECT *, user_id % 10 AS day FROM scores), k AS ({confusion_sql('s2', by='event_type, day')}) SELECT 'GIS-' || event_type AS method, 'd' || day AS dataset, 'measure' AS kind, 'tp' AS measure, tp AS value FROM k UNION ALL SELECT 'GIS-' || event_type, 'd' || day, 'measure', 'fp', fp FROM k",
    "stratified_folds": f"WITH {INST}, b AS (SELECT id, label, {_DRAW(5, 'id')} AS d, {_DRAW(6, 'id')} % 64 AS b FROM inst) SELECT id, label, ((row_number() OVER (PARTITION BY label, b ORDER BY d, id) - 1 + b) % 10)::INT AS fold FROM b",
    "class_limited_sample": f"WITH {INST}, b AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_DRAW(5, 'id')}, id) AS k FROM inst) SELECT id, label FROM b WHERE k <= CASE WHEN label = 0 THEN 30 ELSE 20 END",
    "unique_sample": f"WITH {INST} SELECT id, label FROM inst ORDER BY {_DRAW(9, 'id')}, id LIMIT 100",
    "replacement_sample": f"WITH u AS (SELECT id, min(username) AS username, row_number() OVER (ORDER BY id) - 1 AS pos FROM users GROUP BY id), p AS (SELECT id AS draw_no, {_DRAW(4, 'id')} % (SELECT count(*) FROM u) AS pos FROM range(200) t(id)) SELECT pos, draw_no, username FROM p JOIN u USING (pos)",
    "chromosome_fitness": f"WITH {SCORES}, {_FOLDS}, m AS ({measures_sql('k', 'chrm, vset, ')}) SELECT chrm, floor(avg(f) * 1000) / 1000 AS fitness FROM m GROUP BY 1",
    "chromosome_spread": f"WITH {SCORES}, {_FOLDS}, m AS ({measures_sql('k', 'chrm, vset, ')}) SELECT chrm, " + ", ".join(f"round({g}({n}), 6) AS {n}_{k}" for n in G.MEASURES for k, g in (("min", "min"), ("mean", "avg"), ("sd", "stddev_pop"))) + " FROM m GROUP BY 1",
    "count_fitness": f"WITH {INST}, m AS (SELECT (id % 3)::INT AS chrm, CASE WHEN f_size > 25 THEN 1 ELSE 0 END AS vset, avg(abs(bugs - f_lines * 0.31) / (bugs + 1)) AS are FROM inst GROUP BY 1, 2) SELECT chrm, round(1 / (1 + avg(are)), 6) AS fitness FROM m GROUP BY 1",
    "population_order": f"{_POP} SELECT chrm, fitness, row_number() OVER (ORDER BY fitness DESC, chrm) - 1 AS place FROM p WHERE is_new = 0",
    "population_merge": f"{_POP} SELECT chrm, fitness, is_new FROM p ORDER BY fitness DESC, is_new, chrm LIMIT (SELECT count(*) FROM p WHERE is_new = 0)",
    "knn_classifier": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v, (label >= 5)::INT AS y FROM embeddings), n AS (SELECT q.vec_id, t.y, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, t.v), t.vec_id) AS k FROM v q, v t WHERE q.vec_id % 5 = 0 AND t.vec_id % 5 <> 0) SELECT vec_id, round(avg(y), 6) AS score FROM n WHERE k <= 5 GROUP BY 1",
    "radius_classifier": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v, (label >= 5)::INT AS y FROM embeddings), n AS (SELECT q.vec_id, avg(t.y) AS score FROM v q, v t WHERE q.vec_id % 5 = 0 AND t.vec_id % 5 <> 0 AND list_distance(q.v, t.v) <= 1.0 GROUP BY 1) SELECT vec_id, round(coalesce(score, (SELECT avg(y) FROM v WHERE vec_id % 5 <> 0)), 6) AS score FROM v LEFT JOIN n USING (vec_id) WHERE vec_id % 5 = 0",
    "within_project_cv": f"WITH {INST}, b AS (SELECT *, ((row_number() OVER (PARTITION BY label, {_DRAW(12, 'id')} % 64 ORDER BY {_DRAW(11, 'id')}, id) - 1 + {_DRAW(12, 'id')} % 64) % 5)::INT AS fold FROM inst), m AS (SELECT b.kind AS k, h.held, {_MODEL} FROM b, range(5) h(held) WHERE fold <> held GROUP BY 1, 2), s AS (SELECT kind, label AS actual, {_POSTERIOR} AS score FROM b i JOIN m ON k = kind AND held = fold), c AS ({confusion_sql('s', by='kind')}) {measures_sql('c', 'kind, ')}",
    "earlier_version_benchmark": f"WITH {INST}, p AS (SELECT DISTINCT project FROM inst), m AS (SELECT a.project AS test, {_MODEL} FROM p a JOIN inst i ON substr(a.project, 1, 6) = substr(i.project, 1, 6) AND i.project < a.project GROUP BY 1), s AS (SELECT test, label AS actual, {_POSTERIOR} AS score FROM inst i JOIN m ON test = project), c AS ({confusion_sql('s', by='test')}) {measures_sql('c', 'test, ')}",
    "roulette_pick": f"WITH {INST}, c AS (SELECT id, f_qty::BIGINT AS w, sum(f_qty::BIGINT) OVER (ORDER BY id) - f_qty::BIGINT AS before, sum(f_qty::BIGINT) OVER () AS t FROM inst) SELECT id, w FROM c WHERE before <= 0.37 * t AND 0.37 * t < before + w",
    "naive_bayes_scores": f"WITH {INST}, m AS (SELECT {_MODEL} FROM inst WHERE id % 5 <> 0) SELECT id, round({_POSTERIOR}, 6) AS score FROM inst i, m WHERE id % 5 = 0",
}
