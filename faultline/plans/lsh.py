"""Queries over MinHash, Super-Bit and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import lsh as L
from faultline.plans.standins import VEC, vec
from faultline.session import cut, spread, table

DICT, STAGES, BUCKETS, SIZE = 20_011, 5, 100_003, 20
COEFS = L.minhash_coefficients(SIZE, DICT, 123456)
SB_STAGES, SB_BUCKETS, DIM = 2, 16, 64
SB_N, SB_BLOCKS = L.superbit_shape(SB_STAGES, SB_BUCKETS, DIM)
PLANES = L.superbit_planes(DIM, SB_N, SB_BLOCKS, 7)
K = SB_N * SB_BLOCKS


def _sets(s, d):
    """Distinct words of each text, numbered by a digest."""
    w = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != ""))
    return spread(table(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text")).select("doc_id", F.array_sort(F.array_distinct(F.transform(w, lambda x: F.conv(F.substring(F.md5(x), 1, 6), 16, 10).cast("bigint") % DICT))).alias("xs"))


_SETS = f"sets AS (SELECT doc_id, list_sort(list_distinct(list_transform(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '')), lambda w: ('0x' || substr(md5(w), 1, 6))::BIGINT % {DICT}))) AS xs FROM documents WHERE text IS NOT NULL)"
_SIG = f"{_SETS}, sig AS (SELECT doc_id, xs, CASE WHEN len(xs) > 0 THEN [" + ", ".join(f"list_min(list_transform(xs, lambda x: ({a} * x + {b}) % {DICT}))" for a, b in COEFS) + "] END AS sig FROM sets)"
_ROWS = SIZE // STAGES


def _stage_sql(s: int) -> str:
    e = "0"
    for i in range(s * _ROWS + 1, (s + 1) * _ROWS + 1):
        e = f"(({e} + sig[{i}] * {L.LARGE_PRIME}) % {BUCKETS})"
    return e


_BANDS = f"{_SIG}, bands AS (SELECT doc_id, xs, [{', '.join(_stage_sql(s) for s in range(STAGES))}] AS bands FROM sig WHERE sig IS NOT NULL)"
_PAIRS = f"{_BANDS}, b AS (SELECT doc_id, xs, unnest(bands) AS h, unnest(range({STAGES})) AS st FROM bands), pairs AS (SELECT DISTINCT q.doc_id AS query, r.doc_id AS other FROM b q JOIN b r ON q.h = r.h AND q.st = r.st AND q.doc_id <> r.doc_id WHERE q.doc_id % 20 = 0)"


def _signed(s, d):
    return _sets(s, d).withColumn("sig", L.minhash_signature(F.col("xs"), COEFS, DICT))


def _banded(s, d):
    return cut(_signed(s, d).where("sig IS NOT NULL").select("doc_id", "xs", L.stage_hashes(F.col("sig"), SIZE, STAGES, BUCKETS).alias("bands")))


def _pairs(s, d):
    b = _banded(s, d)
    return L.candidates(b, b.where("doc_id % 20 = 0"), "doc_id", "bands")


def _similar(s, d):
    b = _banded(s, d)
    p = L.candidates(b, b.where("doc_id % 20 = 0"), "doc_id", "bands")
    x = p.join(b.select(F.col("doc_id").alias("query"), F.col("xs").alias("qx")), "query").join(b.select(F.col("doc_id").alias("other"), F.col("xs").alias("ox")), "other")
    return x.select("query", "other", F.round(L.jaccard(F.col("qx"), F.col("ox")), 9).alias("jaccard")).where("jaccard >= 0.8")


_PL = "[" + ", ".join("[" + ", ".join(repr(float(x)) for x in p) + "]::DOUBLE[]" for p in PLANES) + "]"
_SB = f"WITH {VEC}, sb AS (SELECT vec_id, label, cls, v, list_transform({_PL}, lambda p: list_dot_product(v, p) >= 0) AS sig FROM vec)"


def _sb_stage(s: int) -> str:
    e, rows = "0::BIGINT", K // SB_STAGES
    for i in range(s * rows + 1, (s + 1) * rows + 1):
        e = f"(({e} + CASE WHEN sig[{i}] THEN {i * L.LARGE_PRIME}::BIGINT ELSE 0::BIGINT END) % {L.WRAP})"
    return f"({e} % {SB_BUCKETS})::BIGINT"


_SBH = f"{_SB}, h AS (SELECT vec_id, cls, v, [{', '.join(_sb_stage(s) for s in range(SB_STAGES))}] AS hashes FROM sb)"


def _bits(s, d):
    return vec(s, d).withColumn("sig", L.superbit_signature(F.col("v"), PLANES))


def _hashed(s, d):
    return _bits(s, d).select("vec_id", "cls", "v", L.stage_hashes_bool(F.col("sig"), K, SB_STAGES, SB_BUCKETS).alias("hashes"))


def _neighbour_pairs(df):
    """Each vector with the next one by number."""
    a = df.select("vec_id", "v", "sig")
    b = df.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"), F.col("sig").alias("sig2"))
    return a.join(b, "vec_id")


def _curve(s, d):
    """Share of pairs in a common bucket by tenth of cosine, queries divisible by 20 against all."""
    h = cut(_hashed(s, d))
    return L.collision_curve(h, h.where("vec_id % 20 = 0"))


def _baskets(s, d):
    li = table(s, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    m = li.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_partkey", F.col("q").cast("double")))).alias("m"))
    a = m.where("l_orderkey % 2 = 0").select((F.col("l_orderkey") / 2).cast("bigint").alias("k"), F.col("m").alias("a"))
    b = m.where("l_orderkey % 2 = 1").select(((F.col("l_orderkey") - 1) / 2).cast("bigint").alias("k"), F.col("m").alias("b"))
    return a.join(b, "k")


_BASK = """WITH li AS (SELECT l_orderkey o, l_partkey p, sum(l_quantity::BIGINT)::DOUBLE q FROM lineitem GROUP BY 1, 2), a AS (SELECT o // 2 AS k, p, q FROM li WHERE o % 2 = 0), b AS (SELECT (o - 1) // 2 AS k, p, q FROM li WHERE o % 2 = 1),
 ks AS (SELECT DISTINCT a.k FROM a JOIN b USING (k)), j AS (SELECT coalesce(a.k, b.k) AS k, a.q AS x, b.q AS y FROM a FULL JOIN b ON a.k = b.k AND a.p = b.p), t AS (SELECT * FROM j SEMI JOIN ks USING (k))"""

QUERIES = {
    "minhash_signature": lambda s, d: _signed(s, d).select("doc_id", F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig")),
    "minhash_bands": lambda s, d: _banded(s, d).select("doc_id", F.array_join(F.col("bands").cast("array<string>"), ",").alias("bands")),
    "minhash_pairs": _pairs,
    "jaccard_pairs": _similar,
    "superbit_signature": lambda s, d: _bits(s, d).select("vec_id", F.array_join(F.transform("sig", lambda x: x.cast("int").cast("string")), "").alias("bits")),
    "superbit_buckets": lambda s, d: _hashed(s, d).select("vec_id", F.col("hashes")[0].alias("b0"), F.col("hashes")[1].alias("b1")),
    "superbit_similarity": lambda s, d: _neighbour_pairs(_bits(s, d)).select("vec_id", F.round(L.superbit_similarity(F.col("sig"), F.col("sig2")), 9).alias("estimate"), F.round(L.cosine(F.col("v"), F.col("w")), 6).alias("cosine")),
    "bucket_occupancy": lambda s, d: L.occupancy(_hashed(s, d), "hashes"),
    "lsh_collision_curve": _curve,
    "dense_vectors": lambda s, d: vec(s, d).select("vec_id", F.round(L.norm(F.col("v")), 6).alias("norm"), F.round(L.norm(L.minus(F.col("v"), L.scale(F.col("v"), F.lit(0.5)))), 6).alias("half")),
    "sparse_dot": lambda s, d: _baskets(s, d).select("k", F.round(L.sparse_dot(F.col("a"), F.col("b")), 6).alias("dot")),
    "sparse_cosine": lambda s, d: _baskets(s, d).select("k", F.round(L.sparse_cosine(F.col("a"), F.col("b")), 9).alias("cosine"), F.round(L.sparse_cosine(F.col("a"), F.col("b"), 900.0), 9).alias("damped")),
    "sparse_qgram": lambda s, d: _baskets(s, d).select("k", L.sparse_qgram(F.col("a"), F.col("b")).alias("qgram")),
    "sparse_jaccard": lambda s, d: _baskets(s, d).select("k", F.round(L.sparse_jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"), F.size("a").cast("bigint").alias("size_a")),
}
ORACLES = {
    "minhash_signature": f"WITH {_SIG} SELECT doc_id, array_to_string(sig, ',') AS sig FROM sig",
    "minhash_bands": f"WITH {_BANDS} SELECT doc_id, array_to_string(bands, ',') AS bands FROM bands",
    "minhash_pairs": f"WITH {_PAIRS} SELECT * FROM pairs",
    "jaccard_pairs": f"WITH {_PAIRS} SELECT * FROM (SELECT query, other, round(len(list_intersect(q.xs, o.xs))::DOUBLE / len(list_distinct(list_concat(q.xs, o.xs))), 9) AS jaccard FROM pairs JOIN sets q ON q.doc_id = query JOIN sets o ON o.doc_id = other) WHERE jaccard >= 0.8",
    "superbit_signature": f"{_SB} SELECT vec_id, array_to_string(list_transform(sig, lambda x: x::INT), '') AS bits FROM sb",
    "superbit_buckets": f"{_SBH} SELECT vec_id, hashes[1] AS b0, hashes[2] AS b1 FROM h",
    "superbit_similarity": f"{_SB} SELECT a.vec_id, round(cos((1 - list_sum(list_transform(range(1, {K + 1}), lambda i: (a.sig[i] = b.sig[i])::INT)) / {K}.0) * pi()), 9) AS estimate, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM sb a JOIN sb b ON b.vec_id = a.vec_id + 1",
    "bucket_occupancy": f"{_SBH} SELECT stage::INT AS stage, bucket, count(*) AS n FROM (SELECT unnest(range({SB_STAGES})) AS stage, unnest(hashes) AS bucket FROM h) GROUP BY 1, 2",
    "lsh_collision_curve": f"{_SBH} SELECT floor(list_cosine_similarity(a.v, q.v) * 10)::BIGINT AS bin, count(*) AS n, sum((a.hashes[1] = q.hashes[1] OR a.hashes[2] = q.hashes[2])::INT)::BIGINT AS hits FROM h a JOIN h q ON q.vec_id % 20 = 0 AND a.vec_id <> q.vec_id GROUP BY 1",
    "dense_vectors": f"WITH {VEC} SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(sqrt(list_dot_product(v, v)) / 2, 6) AS half FROM vec",
    "sparse_dot": f"{_BASK} SELECT k, round(sum(coalesce(x * y, 0)), 6) AS dot FROM t GROUP BY 1",
    "sparse_cosine": f"{_BASK} SELECT k, round(sum(coalesce(x * y, 0)) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 9) AS cosine, round(sum(coalesce(x * y, 0)) / (least(30.0, sqrt(sum(x * x))) * least(30.0, sqrt(sum(y * y)))), 9) AS damped FROM t GROUP BY 1",
    "sparse_qgram": f"{_BASK} SELECT k, sum(abs(coalesce(x, 0) - coalesce(y, 0)))::DOUBLE AS qgram FROM t GROUP BY 1",
    "sparse_jaccard": f"{_BASK} SELECT k, round(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL)::DOUBLE / count(*), 9) AS jaccard, count(x) AS size_a FROM t GROUP BY 1",
}
