"""Seedable samplers: every draw follows the digest of (seed, keys), so any engine can repeat it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *keys: str) -> Column:
    """A whole number below 2**32 from the digest of the seed and the keys."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *keys)), 1, 8), 16, 10).cast("bigint")


def least_hash(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` distinct rows: those with the least draws (a bounded top-n, no full sort)."""
    return df.withColumn("__d", draw(seed, key)).orderBy("__d", key).limit(n).drop("__d")


def with_replacement(df: DataFrame, n: int, seed: int, pos: str, total: int) -> DataFrame:
    """``n`` draws of rows numbered 0..total-1 in ``pos``; repeats possible."""
    spark = df.sparkSession
    picks = spark.range(n).select(F.col("id").alias("draw_no"), (draw(seed, "id") % total).alias(pos))
    return picks.join(df, pos)


def stratified_folds(df: DataFrame, label: str, k: int, seed: int, key: str) -> DataFrame:
    """Add ``fold``: rows of each label dealt to k folds in draw order.

    Ranks are taken per (label, hash bucket), so a frequent label is spread over tasks; fold sizes
    differ by at most one per bucket and label.
    """
    b = F.pmod(draw(seed + 1, key), F.lit(64))
    w = Window.partitionBy(label, "__b").orderBy("__d", key)
    return df.withColumn("__d", draw(seed, key)).withColumn("__b", b).withColumn("fold", ((F.row_number().over(w) - 1 + F.col("__b")) % k).cast("int")).drop("__d", "__b")


def class_limited(df: DataFrame, label: str, quotas: dict[float, int], seed: int, key: str) -> DataFrame:
    """The first ``quotas[label]`` rows of each label in draw order, stopping at the quotas."""
    parts = [least_hash(df.where(F.col(label) == v), n, seed, key) for v, n in sorted(quotas.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def roulette(df: DataFrame, weight: str, key: str, u: float) -> DataFrame:
    """The row on which a wheel of the positive weights stops at ``u`` in [0, 1)."""
    from faultline.operators.ordered import prefix_sums

    cum = prefix_sums(df.where(F.col(weight) > 0), [key], {"__before": weight})
    total = cum.agg(F.sum(weight).alias("__t"))
    return cum.crossJoin(F.broadcast(total)).where((F.col("__before") <= u * F.col("__t")) & (F.lit(u) * F.col("__t") < F.col("__before") + F.col(weight))).select(*df.columns)
