"""Locality-sensitive hashing (MinHash, Super-Bit) and vector functions, as column expressions."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGE_PRIME = 433494437  # fixed value: multiplier of the stage hashes
WRAP = 2147483647  # fixed value: modulus of the Boolean stage accumulator


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def signature_size(stages: int) -> int:
    """Signature length for bands that are hit at a similarity of about a half."""
    return stages * (math.ceil(math.log(1.0 / stages) / math.log(0.5)) + 1)


def size_for_error(error: float) -> int:
    return int(round(1 / (error * error), 9))


def error_for_size(size: int) -> float:
    return 1 / math.sqrt(size)


def minhash_coefficients(size: int, dictionary: int, seed: int) -> list[tuple[int, int]]:
    r = random.Random(seed)
    return [(r.randint(0, dictionary - 1), r.randint(0, dictionary - 1)) for _ in range(size)]


def minhash_signature(items: Column, coefficients: list[tuple[int, int]], dictionary: int) -> Column:
    """Minimum of (a x + b) mod dictionary over the set, per coefficient pair; null for an empty or null set. Worked out for a whole batch at once."""

    def sign(sets: pd.Series) -> pd.Series:
        full = [k for k, x in enumerate(sets) if x is not None and len(x)]
        out = pd.Series([None] * len(sets), dtype=object)
        if not full:
            return out
        held = [np.asarray(sets.iloc[k], np.int64) for k in full]
        flat, starts = np.concatenate(held), np.cumsum([0] + [len(x) for x in held[:-1]])
        least = np.stack([np.minimum.reduceat((a * flat + b) % dictionary, starts) for a, b in coefficients], axis=1)
        for k, row in zip(full, least):
            out.iat[k] = row
        return out

    return F.pandas_udf(sign, "array<bigint>")(items)


def stage_hashes(signature: Column, length: int, stages: int, buckets: int) -> Column:
    """One bucket per stage of an integer signature of known length; the last stage takes the remainder."""
    rows = length // stages
    one = lambda s: F.aggregate(F.slice(signature, s * rows + 1, rows if s < stages - 1 else length - rows * (stages - 1)), F.lit(0).cast("bigint"), lambda h, v: (h + v * LARGE_PRIME) % buckets)
    return F.array(*[one(s) for s in range(stages)])


def stage_hashes_bool(signature: Column, length: int, stages: int, buckets: int) -> Column:
    """One bucket per stage of a Boolean signature."""
    rows = length // stages
    indexed = F.transform(signature, lambda v, i: F.when(v, (i + 1).cast("bigint") * LARGE_PRIME).otherwise(F.lit(0).cast("bigint")))
    one = lambda s: F.aggregate(F.slice(indexed, s * rows + 1, rows if s < stages - 1 else length - rows * (stages - 1)), F.lit(0).cast("bigint"), lambda h, v: (h + v) % WRAP) % buckets
    return F.array(*[one(s) for s in range(stages)])


def minhash_similarity(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, v: s + v) / F.size(a)


def superbit_planes(dimension: int, n: int, blocks: int, seed: int) -> np.ndarray:
    """blocks * n Gaussian directions, made orthogonal within each block of n; rows have length 1."""
    if not (dimension > 0 and 1 <= n <= dimension and blocks >= 1):
        raise ValueError("needs dimension > 0, 1 <= n <= dimension, blocks >= 1")
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(blocks):
        q, r = np.linalg.qr(rng.standard_normal((dimension, n)))
        out.append((q * np.sign(np.diag(r))).T)
    return np.vstack(out)


def superbit_shape(stages: int, buckets: int, dimension: int) -> tuple[int, int]:
    """(n, blocks): code length stages * buckets / 2 cut into the largest blocks that divide it and fit the dimension."""
    k = stages * buckets // 2
    n = next(i for i in range(min(dimension, k), 0, -1) if k % i == 0)
    return n, k // n


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def scale(a: Column, f: Column) -> Column:
    return F.transform(a, lambda x: x * f)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def superbit_signature(v: Column, planes: np.ndarray) -> Column:
    """On which side of each plane the vector lies."""
    return F.transform(F.array(*[_array([float(x) for x in p]) for p in planes]), lambda p: dot(v, p) >= 0)


def superbit_similarity(a: Column, b: Column) -> Column:
    """Estimated cosine from two signatures."""
    agree = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, v: s + v) / F.size(a)
    return F.cos((1 - agree) * math.pi)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index; 0 if both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / u)


# sparse vectors are maps index -> value


def sparse(dense: Column) -> Column:
    """A sparse vector of the non-zero entries of a dense one."""
    pairs = F.filter(F.transform(dense, lambda v, i: F.struct(i.alias("key"), v.alias("value"))), lambda p: p.value != 0)
    return F.map_from_entries(pairs)


def sparse_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x * y, F.lit(0)))), F.lit(0.0), lambda s, v: s + v)


def sparse_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.map_values(a), F.lit(0.0), lambda s, v: s + v * v))


def sparse_cosine(a: Column, b: Column, gamma: float | None = None) -> Column:
    """Cosine; with ``gamma`` norms count sqrt(gamma) at most."""
    cut = (lambda n: F.least(F.lit(math.sqrt(gamma)), n)) if gamma is not None else (lambda n: n)
    return sparse_dot(a, b) / (cut(sparse_norm(a)) * cut(sparse_norm(b)))


def sparse_qgram(a: Column, b: Column) -> Column:
    """L1 distance."""
    z = F.map_zip_with(a, b, lambda k, x, y: F.abs(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    return F.aggregate(F.map_values(z), F.lit(0.0), lambda s, v: s + v)


def sparse_jaccard(a: Column, b: Column) -> Column:
    return jaccard(F.map_keys(a), F.map_keys(b))


def dimsum_gamma(threshold: float, count: int) -> float:
    return 10 * math.log(count) / threshold


def dimsum_sample(v: Column, gamma: float, key: Column, seed: int) -> Column:
    """Entries of a sparse vector kept with probability sqrt(gamma) / norm where that is below 1; draws follow (seed, key, index)."""
    p = math.sqrt(gamma) / sparse_norm(v)
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), key, k), F.lit(1 << 30)) / float(1 << 30)
    return F.map_filter(v, lambda k, x: (p >= 1) | (u(k) < p))


def occupancy(hashed: DataFrame, hashes: str) -> DataFrame:
    """(stage, bucket, n): rows per bucket of each stage."""
    return hashed.select(F.posexplode(hashes).alias("stage", "bucket")).groupBy("stage", "bucket").agg(F.count(F.lit(1)).alias("n"))


def bucket_classes(hashed: DataFrame, key: str, hashes: str) -> DataFrame:
    """(key, rep): rows with the same bucket in every stage form a class, named by its least key. Null hashes are left out."""
    rows = hashed.where(F.col(hashes).isNotNull()).select(key, F.col(hashes).alias("__h"))
    reps = rows.groupBy("__h").agg(F.min(key).alias("rep"))
    return rows.join(reps, "__h").select(key, "rep")


def class_pairs(hashed: DataFrame, queries: DataFrame, key: str, hashes: str) -> DataFrame:
    """(a, b): distinct pairs of a class of ``queries`` and a class of ``hashed`` that share a bucket in some stage, by their least keys there; a class is with itself.

    However many copies a text has, its class enters a bucket once.
    """
    side = lambda df, n: df.where(F.col(hashes).isNotNull()).groupBy(F.col(hashes).alias("h")).agg(F.min(key).alias(n)).select(n, F.posexplode("h").alias("stage", "bucket"))
    return side(queries, "a").join(side(hashed, "b"), ["stage", "bucket"]).select("a", "b").distinct()


def candidates(hashed: DataFrame, queries: DataFrame, key: str, hashes: str) -> DataFrame:
    """(query, other): distinct pairs of a query and another row that share a bucket in some stage; pairs of classes, then their members."""
    pairs = class_pairs(hashed, queries, key, hashes)
    q = bucket_classes(queries, key, hashes).select(F.col(key).alias("query"), F.col("rep").alias("a"))
    r = bucket_classes(hashed, key, hashes).select(F.col(key).alias("other"), F.col("rep").alias("b"))
    return pairs.join(q, "a").join(r, "b").where("query <> other").select("query", "other")


CURVE_BLOCK = 20_000  # queries held against a batch of rows at once


def collision_curve(hashed: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "v", hashes: str = "hashes") -> DataFrame:
    """(bin, n, hits): pairs of a query and another row by tenth of their cosine, and how many of them share a bucket in some stage.

    The stated query set goes over all rows in blocks, which stay in arrays; only one row a batch and bin leaves a task. Null vectors
    are left out, a zero vector is at cosine 0.
    """
    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"), F.col(hashes).alias("h"))
    rows = hashed.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"), F.col(hashes).alias("h"))
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    blocks, out = max(1, -(-q.count() // CURVE_BLOCK)), None
    for b in range(blocks):
        part = q.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).toPandas()
        wide = lambda c, t, part=part: np.array(part[c].tolist(), t) if len(part) else np.zeros((0, 1), t)
        held = q.sparkSession.sparkContext.broadcast((part["k"].to_numpy(), unit(wide("v", float)), wide("h", np.int64)))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, qv, qh = held.value
            for p in batches:
                if not len(p) or not len(ids):
                    continue
                x, h, keys = unit(np.array(p["v"].tolist(), float)), np.array(p["h"].tolist(), np.int64), p["k"].to_numpy()
                n: dict[int, list[int]] = {}
                for s in range(0, len(ids), 512):
                    bins = np.floor(np.round(x @ qv[s : s + 512].T, 12) * 10).astype(int)
                    hit = np.zeros(bins.shape, bool)
                    for j in range(h.shape[1]):
                        hit |= h[:, j, None] == qh[s : s + 512, j]
                    other = keys[:, None] != ids[s : s + 512]
                    for c in np.unique(bins):
                        at = (bins == c) & other
                        t = n.setdefault(int(c), [0, 0])
                        t[0] += int(at.sum())
                        t[1] += int((hit & at).sum())
                yield pd.DataFrame([(c, *t) for c, t in n.items()], columns=["bin", "n", "hits"])

        found = rows.mapInPandas(run, "bin long, n long, hits long")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).where("n > 0")
