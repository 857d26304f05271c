"""Items that appear together, and how much more often than chance.

Exact counts of item pairs over baskets, held against a fitted bipartite configuration model that
honours how frequent each item and how large each basket is: item i is in basket c with probability
x_i * y_c / (1 + x_i * y_c), the multipliers fitted until both margins hold. The tail of the pair count under it is that of a Poisson binomial (saddlepoint
approximation over the classes of basket size); Benjamini-Hochberg controls the false discoveries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import cut

ROW_ITEMS = 2_000  # larger baskets are paired block by block over several tasks
BROADCAST_ITEMS = 200_000  # a larger item dictionary is joined by shuffle
PACKED_ITEMS = 1 << 31  # the numbers of two of fewer items fit one long
BROADCAST_KINDS = 1_000_000  # the same for the scored combinations of counts


def dense_ids(df: DataFrame, out: str) -> DataFrame:
    """``df`` plus consecutive numbers from 0 in the order of its partitions; only one row a partition is summed up and joined."""
    df = cut(df.withColumn("__m", F.monotonically_increasing_id()))
    part, row = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = df.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    start = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    # as many rows as partitions, at most some hundred thousand of 16 bytes
    return df.withColumn("__p", part).join(F.broadcast(start), "__p").withColumn(out, (row + F.col("__s")).cast("bigint")).drop("__m", "__p", "__s")


def fit_null(n: np.ndarray, k: np.ndarray, s: np.ndarray, m: np.ndarray, tol: float = 1e-9, sweeps: int = 5_000) -> np.ndarray:
    """Probability that an item of frequency n[i] (k[i] such items) is in a basket of size s[j] (m[j] such baskets).

    Items in all baskets, baskets with all items and what they leave empty are certain (1 or 0); the rest is
    x[i] * y[j] / (1 + x[i] * y[j]), one side fitted after the other until no margin is off by more than ``tol`` of it.
    """
    p = np.zeros((len(n), len(s)))
    rows, cols = np.ones(len(n), bool), np.ones(len(s), bool)
    left, room = n.astype(float), s.astype(float)  # what is still to be placed per item and per basket
    while rows.any() and cols.any():
        full, none = rows & (left >= m[cols].sum()), rows & (left <= 0)
        if (full | none).any():
            p[np.ix_(full, cols)] = 1.0
            room[cols] -= k[full].sum()
            rows &= ~(full | none)
            continue
        full, none = cols & (room >= k[rows].sum()), cols & (room <= 0)
        if not (full | none).any():
            break
        p[np.ix_(rows, full)] = 1.0
        left[rows] -= m[full].sum()
        cols &= ~(full | none)
    if not (rows.any() and cols.any()):
        return p
    n, k, s, m = left[rows], k[rows].astype(float), room[cols], m[cols].astype(float)
    u, v = np.log(n / np.sqrt((n * k).sum())), np.log(s / np.sqrt((n * k).sum()))  # logarithms of x and y
    for _ in range(sweeps):
        for _ in range(3):
            q = 1 / (1 + np.exp(-(u[:, None] + v)))
            u = u + np.clip((n - q @ m) / np.maximum((q * (1 - q)) @ m, 1e-300), -2.0, 2.0)
        for _ in range(3):
            q = 1 / (1 + np.exp(-(u[:, None] + v)))
            v = v + np.clip((s - k @ q) / np.maximum(k @ (q * (1 - q)), 1e-300), -2.0, 2.0)
        q = 1 / (1 + np.exp(-(u[:, None] + v)))
        if max(np.abs(q @ m / n - 1).max(), np.abs(k @ q / s - 1).max()) <= tol:
            break
    p[np.ix_(rows, cols)] = q
    return p


def _upper_tail_log10(n: np.ndarray, scale: np.ndarray, sq: np.ndarray, m: np.ndarray) -> np.ndarray:
    """log10 P(X >= n), X a sum over size classes of Binomial(m, q), q = min(1, scale * sq); exact for n = 1, else Lugannani-Rice.

    ``sq`` is one row for all sums or one row per sum.
    """
    q = np.minimum(scale[:, None] * np.atleast_2d(sq), 0.999999)
    out = np.zeros(len(n))
    one = n <= 1
    out[one] = np.log10(np.maximum(-np.expm1((m * np.log1p(-q[one])).sum(1)), 1e-300))
    if one.all():
        return out
    out[~one] = _saddlepoint(n[~one], q[~one], m)
    return out


def _tilt(at: np.ndarray, q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tilt under which the mean is ``at``, the logarithm of the generating function there and the variance."""
    t = np.log(np.maximum(at, 1e-9) / np.maximum(q @ m, 1e-300))
    for _ in range(60):
        e = q * np.exp(t)[:, None]
        e /= 1 - q + e
        k1, k2 = e @ m, (e * (1 - e)) @ m
        step = np.clip((k1 - at) / np.maximum(k2, 1e-12), -1.0, 1.0)
        t = t - step
        if np.abs(step).max() < 1e-9:
            break
    e = q * np.exp(t)[:, None]
    e /= 1 - q + e
    return t, np.log1p(q * np.expm1(t)[:, None]) @ m, np.maximum((e * (1 - e)) @ m, 1e-300)


def _tilted_tail(n: int, q: np.ndarray, m: np.ndarray) -> float:
    """log P(X >= n), n above the mean, by convolving the size classes under the tilt that moves the mean to n - 0.5."""
    t, k, _ = (x[0] for x in _tilt(np.array([n - 0.5]), q[None, :], m))
    e = np.minimum(q * np.exp(t) / (1 - q + q * np.exp(t)), 1 - 1e-15)
    mass, length = np.ones(1), n + 60
    for p, c in zip(e, m.astype(int)):
        d = np.arange(1, min(c, length) + 1)
        if p > 0:
            mass = np.convolve(mass, np.exp(c * np.log1p(-p) + np.concatenate([[0.0], np.cumsum(np.log((c - d + 1) / d) + np.log(p) - np.log1p(-p))])))[: length + 1]
    d = np.arange(n, len(mass))
    return k - t * n + np.log((mass[n:] * np.exp(-t * (d - n))).sum())


def _saddlepoint(n: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    t, k, k2 = _tilt(n - 0.5, q, m)
    w = np.sign(t) * np.sqrt(np.maximum(2 * (t * (n - 0.5) - k), 0))
    u = 2 * np.sinh(t / 2) * np.sqrt(k2)
    mid = np.abs(w) < 1e-4
    w, u = np.where(mid, 1.0, w), np.where(mid | (u == 0), 1.0, u)
    log_phi = -w * w / 2 - 0.5 * np.log(2 * np.pi)
    # upper normal tail by its continued fraction for large w, by erfc series otherwise
    from math import erfc

    plain = np.array([0.5 * erfc(x / np.sqrt(2)) for x in w])
    ratio = np.where(w > 5, 1 / (w + 1 / (w + 2 / (w + 3 / (w + 4 / np.maximum(w, 1))))), plain / np.exp(log_phi))
    tail = log_phi + np.log(np.maximum(ratio + 1 / u - 1 / w, 1e-300))
    out = np.where(mid, np.log(0.5), np.minimum(tail, 0.0))
    # far above the mean the terms of the formula cancel; there the mass at n and a geometric rest are the tail
    few = (t > 2) & (k2 <= 0.5 * n)  # n is most of what few baskets can hold
    for r in np.flatnonzero(few):
        out[r] = _tilted_tail(int(n[r]), q[r], m)
    far = (t > 2) & ~few
    if far.any():
        t, k, k2 = _tilt(n[far], q[far], m)
        out[far] = k - t * n[far] - 0.5 * np.log(2 * np.pi * k2) - np.log1p(-np.exp(-t)) - 1 / (12 * n[far])
    return out / np.log(10)


def _counted(items: DataFrame, basket: str, item: str, min_count: int, min_lift: float) -> tuple[DataFrame, list, list, DataFrame, int]:
    """(a, b, n) of the numbered items; (s, m) per basket size; (n, k) per item frequency, of all items; (id, item, n) of the paired items; their count."""
    flat = cut(items.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket IS NOT NULL AND item IS NOT NULL").distinct())
    sizes = flat.groupBy("basket").agg(F.count(F.lit(1)).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("m")).collect()  # one row per distinct basket size
    n_baskets = sum(r["m"] for r in sizes)
    most = n_baskets / min_lift if min_lift > 0 else n_baskets
    every = flat.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    freqs = every.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()  # one row per distinct item frequency
    # numbered in their order, so a < b as in item_a < item_b
    counts = cut(dense_ids(every.where((F.col("n") >= min_count) & (F.col("n") <= most)).orderBy("item"), "id"))
    n_items = counts.count()
    # the item dictionary is broadcast only while it is small
    ids = counts.select("item", "id")
    coded = flat.join(F.broadcast(ids) if n_items <= BROADCAST_ITEMS else ids, "item").select("basket", "id")
    large = cut(coded.groupBy("basket").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > ROW_ITEMS).select("basket"))
    has_large = bool(large.limit(1).count())
    small = coded.join(large, "basket", "left_anti") if has_large else coded
    sets = small.groupBy("basket").agg(F.array_sort(F.collect_list("id")).alias("ids")).where("size(ids) > 1")
    # the sum is only a shorter key
    packed = n_items < PACKED_ITEMS
    code = "transform(slice(ids, k + 2, size(ids)), b -> a * 2147483648 + b)" if packed else "transform(slice(ids, k + 2, size(ids)), b -> struct(a, b))"
    pair = sets.select("ids", F.posexplode("ids").alias("k", "a")).select(F.explode(F.expr(code)).alias("pair"))
    if has_large:
        big = coded.join(large, "basket", "left_semi").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int"))
        left = big.select("basket", F.col("id").alias("a"), F.col("block").alias("ba")).withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(63))))
        right = big.select("basket", F.col("id").alias("b"), F.col("block").alias("bb")).withColumn("ba", F.explode(F.sequence(F.lit(0), F.lit(63))))
        pair = pair.unionByName(left.join(right, ["basket", "ba", "bb"]).where("a < b").select(F.expr("a * 2147483648 + b" if packed else "struct(a, b)").alias("pair")))
    counted = pair.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    counted = counted.select(*([F.expr("pair div 2147483648").alias("a"), F.expr("pair % 2147483648").alias("b")] if packed else ["pair.a", "pair.b"]), "n")
    return counted, sizes, freqs, counts, n_items


def _named(counted: DataFrame, counts: DataFrame, n_items: int, n_baskets: int, min_count: int, min_lift: float) -> DataFrame:
    """(item_a, item_b, n, n_a, n_b, n_baskets, lift) of the pairs within the bounds."""
    of = lambda s: counts.select(F.col("id").alias(s), F.col("item").alias(f"item_{s}"), F.col("n").alias(f"n_{s}"))
    side = (lambda s: F.broadcast(of(s))) if n_items <= BROADCAST_ITEMS else of
    rows = counted.join(side("a"), "a").join(side("b"), "b")
    lift = F.col("n") * F.lit(float(n_baskets)) / (F.col("n_a") * F.col("n_b"))
    # the comparison is done in integers where it decides
    keep = F.col("n") * F.lit(n_baskets) >= F.col("n_a") * F.col("n_b") * F.lit(min_lift) if min_lift else F.lit(True)
    return rows.where(keep & (F.col("n") >= min_count)).select("item_a", "item_b", "n", "n_a", "n_b", F.lit(n_baskets).cast("bigint").alias("n_baskets"), lift.alias("lift"))


def pairs(items: DataFrame, basket: str, item: str, min_count: int = 1, min_lift: float = 0.0) -> DataFrame:
    """(item_a, item_b, n, n_a, n_b, n_baskets, lift), item_a < item_b, without a null model.

    Exact for all pairs in at least ``min_count`` baskets with lift ``n * n_baskets / (n_a * n_b)`` of at
    least ``min_lift``: items rarer than min_count or in more than n_baskets / min_lift baskets can't be in
    such a pair and are left out before pairing.
    """
    counted, sizes, _, counts, n_items = _counted(items, basket, item, min_count, min_lift)
    return _named(counted, counts, n_items, sum(r["m"] for r in sizes), min_count, min_lift)


def cooccurrence(items: DataFrame, basket: str, item: str, min_count: int = 1, min_lift: float = 0.0, fdr: float = 0.01) -> DataFrame:
    """(item_a, item_b, n, n_a, n_b, n_baskets, lift, expected, log10_p, surprising), item_a < item_b.

    Rows of ``items`` with a null basket or item are left out, repeated ones count once. Every pair that
    shares a basket is counted, scored and ranked; ``surprising``: kept by Benjamini-Hochberg at ``fdr``
    over all pairs of all items (those that share no basket have p = 1). ``min_count`` and ``min_lift``
    only choose which of them are returned. An empty table gives no rows.
    """
    counted, sizes, freqs, counts, n_items = _counted(items, basket, item, 1, 0.0)
    counted = cut(counted)
    n_baskets = sum(r["m"] for r in sizes)
    s, m = np.array([r["s"] for r in sizes], float), np.array([r["m"] for r in sizes], float)
    n, k = np.array(sorted((r["n"], r["k"]) for r in freqs), float).reshape(-1, 2).T
    held = items.sparkSession.sparkContext.broadcast((n, fit_null(n, k, s, m)))  # frequencies x sizes

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, p = held.value
        for b in batches:
            expected, tail = np.zeros(len(b)), np.zeros(len(b))
            for at in range(0, len(b), 2000):
                part = slice(at, at + 2000)
                q = p[np.searchsorted(n, b["lo"].to_numpy(float)[part])] * p[np.searchsorted(n, b["hi"].to_numpy(float)[part])]
                expected[part], tail[part] = q @ m, _upper_tail_log10(b["n"].to_numpy(float)[part], np.ones(len(q)), q, m)
            b["expected"], b["log10_p"] = expected, tail
            yield b

    # the score depends on the three counts alone: each combination is scored once
    of = lambda s: counts.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"))
    side = (lambda s: F.broadcast(of(s))) if n_items <= BROADCAST_ITEMS else of
    kinds = counted.join(side("a"), "a").join(side("b"), "b").groupBy("n", F.least("n_a", "n_b").alias("lo"), F.greatest("n_a", "n_b").alias("hi")).agg(F.count(F.lit(1)).alias("pairs"))
    tasks = 2 * items.sparkSession.sparkContext.defaultParallelism
    scored = cut(kinds.repartition(tasks).mapInPandas(score, "n long, lo long, hi long, pairs long, expected double, log10_p double"))
    every = sum(r["k"] for r in freqs)
    tests = max(1, every * (every - 1) // 2)
    low = scored.where(F.col("log10_p") <= float(np.log10(fdr)))  # only these can pass
    low = cut(low.select("log10_p", "pairs").orderBy("log10_p").withColumn("part", F.spark_partition_id()))
    before, at = {}, 0
    for r in sorted(low.groupBy("part").agg(F.sum("pairs").alias("pairs")).collect()):
        before[r["part"]], at = at, at + r["pairs"]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part")) if before else F.lit(0)
    upto = F.sum("pairs").over(Window.partitionBy("part").orderBy("log10_p")) + offset
    most = low.withColumn("upto", upto).where(F.col("log10_p") <= F.log10(F.col("upto") * F.lit(fdr / tests))).agg(F.max("log10_p")).first()[0]
    scored = scored.select("n", "lo", "hi", "expected", "log10_p", (F.col("log10_p") <= F.lit(float("-inf") if most is None else most)).alias("surprising"))
    rows = _named(counted, counts, n_items, n_baskets, min_count, min_lift).withColumn("lo", F.least("n_a", "n_b")).withColumn("hi", F.greatest("n_a", "n_b"))
    rows = rows.join(F.broadcast(scored) if scored.count() <= BROADCAST_KINDS else scored, ["n", "lo", "hi"])
    return rows.select("item_a", "item_b", "n", "n_a", "n_b", "n_baskets", "lift", "expected", "log10_p", "surprising")
