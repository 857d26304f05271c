"""Queries over the relational core: projections, look-ups, pairings, neighbours and relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import ordered, relational as R, relevancy as V
from faultline.plans.standins import FEATURES, INST, VEC, inst, vec
from faultline.session import table

ROUNDED = ["r_qty", "r_size", "r_lines"]


def _rounded(s, d):
    return inst(s, d).select("id", "project", (F.col("f_qty") / 100).cast("bigint").alias("r_qty"), (F.col("f_size") / 10).cast("bigint").alias("r_size"), (F.col("f_lines") / 8).cast("bigint").alias("r_lines"), "label")


_ROUNDED = f"WITH {INST}, r AS (SELECT id, project, trunc(f_qty / 100)::BIGINT AS r_qty, trunc(f_size / 10)::BIGINT AS r_size, trunc(f_lines / 8)::BIGINT AS r_lines, label FROM inst)"


def _split(s, d):
    v = vec(s, d)
    return v.where("vec_id % 20 <> 0"), v.where("vec_id % 20 = 0")


def _parts(s, d):
    n = ordered.row_numbers(inst(s, d).select("id"), ["id"])
    total = n.agg(F.count(F.lit(1)).alias("total"))
    return n.crossJoin(F.broadcast(total)).select("id", "pos", F.least(F.floor(F.col("pos") / F.floor(F.col("total") / 7)), F.lit(6)).cast("bigint").alias("part"))


def _tokens(s, d):
    t = table(s, d, "part").select("p_partkey", F.concat_ws(";", F.when(F.col("p_size") > 25, F.concat(F.lit("!"), "p_brand")).otherwise(F.col("p_brand")), "p_type").alias("t"))
    return t.where(F.col("t").startswith("!")).select("p_partkey", F.split_part(F.col("t"), F.lit(";"), F.lit(1)).alias("folder"), F.split_part(F.col("t"), F.lit(";"), F.lit(2)).alias("file"))


def _methods(s, d):
    ty = F.get_json_object("pars", "$.type")
    return table(s, d, "experiment").select("id", F.concat(ty, F.lit("-nb-GEN-LOC-50.arff")).alias("raw")).where("raw IS NOT NULL").distinct().select("id", R.replace_all(F.col("raw")).alias("short"))


def _pipe_replace(x: str) -> str:
    for a, b in R.REPLACEMENTS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


_KNN = f"""WITH {VEC}, q AS (SELECT * FROM vec WHERE vec_id % 20 = 0), t AS (SELECT * FROM vec WHERE vec_id % 20 <> 0),
 n AS (SELECT q.vec_id AS query, t.vec_id AS neighbour, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, t.v), t.vec_id) AS rk, list_distance(q.v, t.v) AS dist,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_max(list_transform(range(1, 65), lambda i: abs(q.v[i] - t.v[i]))), t.vec_id) AS rc FROM q, t)"""
_KS = f"""WITH {INST}, l AS (SELECT feature, x, na, nb FROM (SELECT unnest(['f_qty','f_price','f_size']) AS feature, unnest([f_qty, f_price, f_size]) AS x, (label = 0)::INT AS na, (label = 1)::INT AS nb FROM inst)),
 c AS (SELECT feature, x, sum(na) AS na, sum(nb) AS nb FROM l GROUP BY 1, 2), w AS (SELECT feature, sum(na) OVER (PARTITION BY feature ORDER BY x) AS ca, sum(nb) OVER (PARTITION BY feature ORDER BY x) AS cb, sum(na) OVER (PARTITION BY feature) AS ta, sum(nb) OVER (PARTITION BY feature) AS tb FROM c),
 d AS (SELECT feature, max(ta)::DOUBLE AS ta, max(tb)::DOUBLE AS tb, max(abs(ca::DOUBLE / ta - cb::DOUBLE / tb)) AS d FROM w GROUP BY 1), e AS (SELECT *, (sqrt(ta * tb / (ta + tb)) + 0.12 + 0.11 / sqrt(ta * tb / (ta + tb))) * d AS x FROM d)
 SELECT feature, round(d, 9) AS d, round(greatest(0, least(1, CASE WHEN x < 0.2 THEN 1 ELSE (SELECT sum((CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * x * x)) FROM range(1, 101) t(k)) END))::DOUBLE, 9) AS p FROM e"""

QUERIES = {
    "arff_like_format": lambda s, d: inst(s, d).select("id", R.csv_row(FEATURES).alias("line")),
    "minmax_normalize": lambda s, d: R.minmax(inst(s, d).select("id", *FEATURES), FEATURES).select("id", *[F.round(c, 9).alias(c) for c in FEATURES]),
    "binarize_label": lambda s, d: inst(s, d).select("id", R.binarize(F.col("bugs")).alias("label")),
    "select_features": lambda s, d: inst(s, d).select("id", "f_qty", "f_size", "label"),
    "union_datasets": lambda s, d: R.union_all([inst(s, d).where(F.col("kind") == k).select("id", "f_qty") for k in ("ECONOMY", "STANDARD", "PROMO")]),
    "find_instance": lambda s, d: R.find_instances(_rounded(s, d), _rounded(s, d), [*ROUNDED, "label"]),
    "find_instance_no_label": lambda s, d: R.find_instances(_rounded(s, d), _rounded(s, d), ROUNDED),
    "similar_instances": lambda s, d: R.similar_classes(_rounded(s, d), ROUNDED),
    "majority_relabel": lambda s, d: R.majority_relabel(_rounded(s, d), ROUNDED).select("id", "label"),
    "loo_pairs": lambda s, d: R.project_pairs(inst(s, d), "project"),
    "earlier_version_pairs": lambda s, d: R.earlier_versions(inst(s, d), "project", 6),
    "partition_ranges": lambda s, d: ordered.row_numbers(inst(s, d).select("id"), ["id"]).where("pos BETWEEN 40 AND 79").select("id", "pos"),
    "test_parts": _parts,
    "dataset_tokens": _tokens,
    "parameter_clamps": lambda s, d: table(s, d, "experiment").select("id", R.clamp(F.get_json_object("pars", "$.popSize").cast("int"), 15, 40).cast("bigint").alias("pop"), R.clamp(F.get_json_object("pars", "$.numGens").cast("int"), 1, 10).cast("bigint").alias("gens")).distinct(),
    "method_names": _methods,
    "finished_experiments": lambda s, d: table(s, d, "experiment").where(F.col("endDateTime") != "--RUNNING--").select("id", "type").distinct(),
    "fixed_core_bugs": lambda s, d: table(s, d, "validbugs").where(F.lower("status").like("%fixed%") & (F.lower("product") == "core") & F.lower("component").like("gra%")).select("bug", "component").distinct(),
    "name_digest": lambda s, d: table(s, d, "users").select("id", F.md5("username").alias("digest")),
    "nn_filter": lambda s, d: V.nn_filter(*_split(s, d), 3),
    "nn_filter_multi": lambda s, d: V.nn_filter(*_split(s, d), 3, V.METRICS),
    "nearest": lambda s, d: V.neighbours(*_split(s, d), 5).select("query", "rank", "neighbour", F.round("dist", 6).alias("dist")),
    "knn_classify": lambda s, d: V.knn_vote(*_split(s, d), 5, "label"),
    "radius_classify": lambda s, d: V.radius_vote(*_split(s, d), 1.25, "label"),
    "mutual_information": lambda s, d: V.mutual_information(_rounded(s, d), ROUNDED, "label"),
    "feature_ranking": lambda s, d: V.mutual_information(_rounded(s, d), ROUNDED, "label").orderBy(F.desc("mi"), F.desc("feature")).limit(2),
    "ks_similarity": lambda s, d: V.ks_similarity(inst(s, d).where("label = 0"), inst(s, d).where("label = 1"), ["f_qty", "f_price", "f_size"]),
}
_MI = _ROUNDED + """, l AS (SELECT unnest(['r_qty','r_size','r_lines']) AS feature, unnest([r_qty, r_size, r_lines]) AS x, label::INT AS y FROM r), j AS (SELECT feature, x, y, count(*) AS n FROM l GROUP BY 1, 2, 3),
 m AS (SELECT feature, round(sum(n::DOUBLE / nt * ln(n::DOUBLE * nt / (nx::DOUBLE * ny))), 9) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS nt FROM j) GROUP BY 1)"""
_SAME = "a.r_qty = b.r_qty AND a.r_size = b.r_size AND a.r_lines = b.r_lines"
ORACLES = {
    "arff_like_format": f"WITH {INST} SELECT id, printf('%.4f,%.4f,%.4f,%.4f,%.4f', f_lines, f_qty, f_price, f_disc, f_size) AS line FROM inst",
    "minmax_normalize": f"WITH {INST}, m AS (SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in FEATURES) + " FROM inst) SELECT id, " + ", ".join(f"round(CASE WHEN hi_{c} = lo_{c} THEN {c} ELSE ({c} - lo_{c}) / (hi_{c} - lo_{c}) END, 9) AS {c}" for c in FEATURES) + " FROM inst, m",
    "binarize_label": f"WITH {INST} SELECT id, CASE WHEN bugs > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM inst",
    "select_features": f"WITH {INST} SELECT id, f_qty, f_size, label FROM inst",
    "union_datasets": f"WITH {INST} SELECT id, f_qty FROM inst WHERE kind IN ('ECONOMY', 'STANDARD', 'PROMO')",
    "find_instance": f"{_ROUNDED} SELECT a.id, coalesce((SELECT min(b.id) FROM r b WHERE {_SAME} AND a.label = b.label), -1) AS found FROM r a",
    "find_instance_no_label": f"{_ROUNDED} SELECT a.id, coalesce((SELECT min(b.id) FROM r b WHERE {_SAME}), -1) AS found FROM r a",
    "similar_instances": f"{_ROUNDED} SELECT id, min(id) OVER w AS class_id, count(*) OVER w AS n_similar FROM r WINDOW w AS (PARTITION BY r_qty, r_size, r_lines)",
    "majority_relabel": f"{_ROUNDED} SELECT id, CASE WHEN avg(label) OVER (PARTITION BY r_qty, r_size, r_lines) >= 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM r",
    "loo_pairs": f"WITH {INST}, p AS (SELECT DISTINCT project FROM inst) SELECT a.project AS test, b.project AS train FROM p a, p b WHERE a.project <> b.project",
    "earlier_version_pairs": f"WITH {INST}, p AS (SELECT DISTINCT project FROM inst) SELECT a.project AS test, b.project AS train FROM p a, p b WHERE substr(a.project, 1, 6) = substr(b.project, 1, 6) AND b.project < a.project",
    "partition_ranges": f"WITH {INST} SELECT * FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM inst) WHERE pos BETWEEN 40 AND 79",
    "test_parts": f"WITH {INST} SELECT id, pos, least(pos // (n // 7), 6)::BIGINT AS part FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM inst)",
    "dataset_tokens": "SELECT p_partkey, '!' || p_brand AS folder, p_type AS file FROM part WHERE p_size > 25",
    "parameter_clamps": "SELECT DISTINCT id, greatest(15, least((pars::JSON->>'popSize')::INT, 40))::BIGINT AS pop, greatest(1, least((pars::JSON->>'numGens')::INT, 10))::BIGINT AS gens FROM experiment",
    "method_names": "SELECT id, " + _pipe_replace("raw") + " AS short FROM (SELECT DISTINCT id, (pars::JSON->>'type') || '-nb-GEN-LOC-50.arff' AS raw FROM experiment) WHERE raw IS NOT NULL",
    "finished_experiments": "SELECT DISTINCT id, type FROM experiment WHERE endDateTime <> '--RUNNING--'",
    "fixed_core_bugs": "SELECT DISTINCT bug, component FROM validbugs WHERE lower(status) LIKE '%fixed%' AND lower(product) = 'core' AND lower(component) LIKE 'gra%'",
    "name_digest": "SELECT id, md5(username) AS digest FROM users",
    "nn_filter": f"{_KNN} SELECT DISTINCT neighbour AS vec_id FROM n WHERE rk <= 3",
    "nn_filter_multi": f"{_KNN} SELECT DISTINCT neighbour AS vec_id FROM n WHERE rk <= 3 OR rc <= 3",
    "nearest": f"{_KNN} SELECT query, rk::INT AS rank, neighbour, round(dist, 6) AS dist FROM n WHERE rk <= 5",
    "knn_classify": f"{_KNN} SELECT query AS vec_id, round(avg(label), 9) AS score FROM n WHERE rk <= 5 GROUP BY 1",
    "radius_classify": f"{_KNN} SELECT query AS vec_id, count(*) AS n, round(avg(label), 9) AS score FROM n WHERE dist <= 1.25 GROUP BY 1",
    "mutual_information": _MI + " SELECT * FROM m",
    "feature_ranking": _MI + " SELECT * FROM m ORDER BY mi DESC, feature DESC LIMIT 2",
    "ks_similarity": _KS,
}
