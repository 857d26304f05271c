"""Nearest-neighbour relevancy filters, distribution similarity and feature relevance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Query vectors that are held against a block of rows at once.
QUERY_BLOCK = 20_000
METRICS = ["euclidean", "chebyshev", "minkowski"]


def _distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "chebyshev":
        return np.stack([np.abs(x - r).max(1) for r in q])
    return np.stack([np.sqrt(((x - r) ** 2).sum(1)) for r in q])  # minkowski of order 2 is the same


def _query_blocks(queries: DataFrame, key: str, vector: str) -> Iterator:
    """Broadcast (keys, vectors) of about QUERY_BLOCK queries each, cut by hash; at least one, perhaps empty."""
    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("q"), F.col(vector).alias("v"))
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    for b in range(blocks):
        part = q.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toPandas()
        yield queries.sparkSession.sparkContext.broadcast((part["q"].to_numpy(), np.array(part["v"].tolist(), float) if len(part) else np.zeros((0, 1))))


def neighbours(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "v", metric: str = "euclidean") -> DataFrame:
    """(query, rank, neighbour, dist): the exact k nearest ``rows`` of each query, ties by key.

    The stated query set goes over all rows in blocks: each task keeps its k best per query, and only
    those are shuffled. Null vectors are left out. Queries are held by the driver block by block.
    """
    out = None
    for held in _query_blocks(queries, key, vector):

        def best(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, qs = held.value
            for p in batches:
                if not len(p) or not len(ids):
                    continue
                x, keys = np.array(p["v"].tolist(), float), p["key"].to_numpy()
                for s in range(0, len(ids), 256):
                    d = _distances(qs[s : s + 256], x, metric)
                    order = np.lexsort((np.broadcast_to(keys, d.shape), d), axis=1)[:, :k]
                    n = order.shape[1]
                    yield pd.DataFrame({"query": np.repeat(ids[s : s + 256], n), "neighbour": keys[order].ravel(), "dist": np.take_along_axis(d, order, 1).ravel()})

        local = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v")).mapInPandas(best, "query long, neighbour long, dist double")
        top = local.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "neighbour"))), 1, k).alias("n"))  # k rows a task
        found = top.select("query", F.posexplode("n").alias("pos", "n")).select("query", (F.col("pos") + 1).alias("rank"), "n.neighbour", "n.dist")
        out = found if out is None else out.unionByName(found)
    return out


def nn_filter(train: DataFrame, test: DataFrame, k: int, metrics: list[str] = ["euclidean"], key: str = "vec_id") -> DataFrame:
    """Keys of the training rows that are among the k nearest of any test row under any of ``metrics``."""
    hits = [neighbours(train, test, k, key, metric=m).select(F.col("neighbour").alias(key)) for m in metrics]
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out.distinct()


def knn_vote(train: DataFrame, test: DataFrame, k: int, label: str, key: str = "vec_id") -> DataFrame:
    """(key, score): share of positive labels among the k nearest."""
    n = neighbours(train, test, k, key)
    lab = train.select(F.col(key).alias("neighbour"), F.col(label).alias("__y"))
    return n.join(lab, "neighbour").groupBy(F.col("query").alias(key)).agg(F.round(F.avg("__y"), 9).alias("score"))


def radius_vote(train: DataFrame, test: DataFrame, radius: float, label: str, key: str = "vec_id", vector: str = "v") -> DataFrame:
    """(key, n, score): neighbours within ``radius`` and their share of positive labels; queries without any give no row. Null vectors are left out."""
    out = None
    rows = train.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v"), F.col(label).cast("double").alias("y"))
    for held in _query_blocks(test, key, vector):

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, qs = held.value
            for p in batches:
                if not len(p) or not len(ids):
                    continue
                x, y = np.array(p["v"].tolist(), float), p["y"].to_numpy(float)
                for s in range(0, len(ids), 256):
                    near = _distances(qs[s : s + 256], x, "euclidean") <= radius
                    yield pd.DataFrame({"q": ids[s : s + 256], "n": near.sum(1), "pos": (near * y).sum(1)})

        local = rows.mapInPandas(run, "q long, n long, pos double")
        found = local.groupBy(F.col("q").alias(key)).agg(F.sum("n").alias("n"), F.sum("pos").alias("p")).where("n > 0").select(key, "n", F.round(F.col("p") / F.col("n"), 9).alias("score"))
        out = found if out is None else out.unionByName(found)
    return out


def mutual_information(df: DataFrame, features: list[str], label: str, digits: int = 9) -> DataFrame:
    """(feature, mi): discrete mutual information in nats of each feature with the integer label."""
    long = df.select(F.col(label).cast("int").alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("s")).select("y", "s.feature", "s.x")
    joint = long.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    fx = joint.groupBy("feature", "x").agg(F.sum("n").alias("nx"))
    fy = joint.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    ft = joint.groupBy("feature").agg(F.sum("n").alias("nt"))
    j = joint.join(fx, ["feature", "x"]).join(F.broadcast(fy), ["feature", "y"]).join(F.broadcast(ft), "feature")  # a row a feature and label
    term = F.col("n") / F.col("nt") * F.log(F.col("n") * F.col("nt") / (F.col("nx") * F.col("ny")))
    return j.groupBy("feature").agg(F.round(F.sum(term), digits).alias("mi"))


def ks_similarity(a: DataFrame, b: DataFrame, features: list[str], digits: int = 9, by: str | None = None) -> DataFrame:
    """(feature, d, p): two-sample Kolmogorov-Smirnov distance and its asymptotic p-value per feature; of each group ``by`` of ``a`` against ``b``.

    Values are counted per feature first; the running counts go over ranges, not over one sorted column.
    """
    from faultline.operators.ordered import prefix_sums

    keys = [by, "feature"] if by else ["feature"]
    side = lambda df, w, own: df.select(*own, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("s"), F.lit(1 - w).alias("na"), F.lit(w).alias("nb")).select(*own, "s.*", "na", "nb").where("x IS NOT NULL")
    other = side(b, 1, []).groupBy("feature", "x").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    if by:  # a row a group
        other = other.join(F.broadcast(a.select(by).distinct()))
    counts = side(a, 0, [by] if by else []).groupBy(*keys, "x").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")).unionByName(other).groupBy(*keys, "x").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    cum = prefix_sums(counts, ["x"], {"ba": "na", "bb": "nb"}, keys)
    tot = counts.groupBy(*keys).agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    j = cum.join(F.broadcast(tot), keys)  # a row a feature and group
    d = j.groupBy(*keys, "ta", "tb").agg(F.max(F.abs((F.col("ba") + F.col("na")) / F.col("ta") - (F.col("bb") + F.col("nb")) / F.col("tb"))).alias("d"))
    en = F.sqrt(F.col("ta") * F.col("tb") / (F.col("ta") + F.col("tb")))
    x = (en + 0.12 + F.lit(0.11) / en) * F.col("d")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    return d.select(*keys, F.round("d", digits).alias("d"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(x < 0.2, 1.0).otherwise(series))), digits).alias("p"))


def ks_score(ks: DataFrame, by: str | None = None) -> DataFrame:
    """(score): sum of p-values over the number of features with p <= 0.05, or just the sum if there is none; per ``by``."""
    low = F.count_if(F.col("p") <= 0.05)
    return ks.groupBy(*([by] if by else [])).agg((F.sum("p") / F.when(low == 0, 1).otherwise(low)).alias("score"))
