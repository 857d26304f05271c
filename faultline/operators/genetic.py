"""Genetic instance selection: chromosomes are sets of training rows, bred per pair of parents in one grouped step.

A population is one table (chrm, pos, key, features..., label); its size is population * chromosome size, both
parameters, so a pair of parents always fits a task. Fitness values, one number a chromosome, steer from the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators import bayes, learners, measures as M, sampling as S
from faultline.session import cut

MUTATION, FLIPS, HALF_FROM, STILL = 0.1, 1, 4000, 1e-6  # fixed values: odds and rows of a mutation, size from which cuts are in the middle, least change of the mean
MEASURES = ["rec", "prec", "f", "gmean1"]


def chromosome_size(fixed: bool, most: int, rng: np.random.Generator) -> int:
    return most if fixed else int(rng.integers(most)) + 10


# ---- fitness


def binary_fitness(scored: DataFrame, by: list[str]) -> DataFrame:
    """``by`` plus fitness: the mean F over validation sets (column ``vset``) of ``actual`` and ``score``, thousandths cut off; 0 where there is none."""
    m = M.with_measures(M.confusion(scored, by=[*by, "vset"]), None)
    mean = F.avg(F.coalesce("f", F.lit(0.0)))
    return m.groupBy(*by).agg((F.floor(F.coalesce(mean, F.lit(0.0)) * 1000) / 1000).alias("fitness"))


def count_fitness(scored: DataFrame, by: list[str]) -> DataFrame:
    """``by`` plus fitness: 1 / (1 + mean absolute relative error over validation sets)."""
    m = M.count_measures(scored, by=[*by, "vset"], digits=12)
    return m.groupBy(*by).agg((1 / (F.avg("are") + 1)).alias("fitness"))


def spread(scored: DataFrame, by: list[str], names: list[str] = MEASURES) -> DataFrame:
    """``by`` plus least, mean and standard deviation of each measure over the validation sets."""
    m = M.with_measures(M.confusion(scored, by=[*by, "vset"]), None)
    return m.groupBy(*by).agg(*[f(n).alias(f"{n}_{k}") for n in names for k, f in (("min", F.min), ("mean", F.avg), ("sd", F.stddev_pop))])


def mean_fitness(fitness: list[float], count: int = 0) -> float:
    """The sum of all over ``count`` of them (all if 0), as the original divides."""
    return float(np.sum(fitness)) / (count or len(fitness))


def standing_still(before: list[float], after: list[float], count: int = 0) -> tuple[float, bool]:
    diff = abs(mean_fitness(before, count) - mean_fitness(after, count))
    return diff, diff < STILL


# ---- order and selection


def ranked(fitness: DataFrame) -> DataFrame:
    """(chrm, fitness, place): best first, ties by number."""
    from faultline.operators.ordered import row_numbers

    return row_numbers(fitness.withColumn("__o", -F.col("fitness")), ["__o", "chrm"], "place").drop("__o")


def combine(old: DataFrame, new: DataFrame) -> DataFrame:
    """The best of two populations' (chrm, fitness), as many as ``old`` has; ties prefer the old. ``is_new`` tells whose they are."""
    both = old.select("chrm", "fitness", F.lit(0).alias("is_new")).unionByName(new.select("chrm", "fitness", F.lit(1).alias("is_new")))
    return both.orderBy(F.desc("fitness"), "is_new", "chrm").limit(old.count())


def tournament(fitness: list[float], rng: np.random.Generator) -> int:
    """The fitter of two drawn at random, the first of equals."""
    a, b = (int(x) for x in rng.integers(len(fitness), size=2))
    return b if fitness[b] > fitness[a] else a


def wheel(fitness: list[float], rng: np.random.Generator) -> int:
    """One drawn with odds in proportion to its fitness; the last if all are 0."""
    stop = rng.random() * sum(fitness)
    past = np.cumsum(fitness) > stop
    return int(past.argmax()) if past.any() else len(fitness) - 1


def parents(fitness: list[float], kind: str, rng: np.random.Generator) -> tuple[int, int]:
    """Two different chromosomes; ``kind``: tournament, wheel or uniform."""
    draw: Callable[[], int] = {"tournament": lambda: tournament(fitness, rng), "wheel": lambda: wheel(fitness, rng), "uniform": lambda: int(rng.integers(len(fitness)))}[kind]
    if len(fitness) < 2:
        raise ValueError("a population needs two chromosomes")
    for _ in range(1000):
        a, b = draw(), draw()
        if a != b:
            return a, b
    others = [c for c in range(len(fitness)) if c != a]  # one takes all of the wheel
    return a, others[int(rng.integers(len(others)))]


# ---- breeding, on two parents at a time


def relabel(d: pd.DataFrame, features: list[str], count: bool) -> pd.DataFrame:
    """Rows with equal features get their majority label (a half makes 1), for counts their mean."""
    mean = d.groupby(features, dropna=False)["label"].transform("mean")
    return d.assign(label=mean.clip(lower=0) if count else (mean >= 0.5).astype(float))


def cross(a: pd.DataFrame, b: pd.DataFrame, features: list[str], fixed: bool, count: bool, rng: np.random.Generator) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Both are shuffled and swap what lies behind a cut: the same one if sizes are fixed, else one each; in the middle for large ones."""
    a, b = a.iloc[rng.permutation(len(a))], b.iloc[rng.permutation(len(b))]
    p = int(rng.integers(len(a)))
    q = p if fixed else int(rng.integers(len(b)))
    if not fixed:
        p, q = (len(a) // 2 if len(a) >= HALF_FROM else p), (len(b) // 2 if len(b) >= HALF_FROM else q)
    return tuple(relabel(pd.concat(x, ignore_index=True), features, count) for x in ((a[:p], b[q:]), (b[:q], a[p:])))


def mutate(d: pd.DataFrame, features: list[str], count: bool, mad: float, rng: np.random.Generator) -> pd.DataFrame:
    """With odds MUTATION, FLIPS rows and all rows with their features change label: to the other class, or by a whole normal step times ``mad``, not below 0."""
    if rng.random() > MUTATION or not len(d):
        return d
    group = d.groupby(features, dropna=False, sort=False).ngroup().to_numpy()
    label = d["label"].to_numpy(float).copy()
    left = list(dict.fromkeys(group[rng.permutation(len(d))]))[:FLIPS]
    for g in left:
        same = group == g
        was = label[same][0]
        label[same] = max(0.0, was + int(rng.standard_normal() * mad)) if count else 1 - was
    return d.assign(label=label)


def breed(pop: DataFrame, pairs: list[tuple[int, int]], first: int, features: list[str], fixed: bool, count: bool, mad: float, seed: int) -> DataFrame:
    """The children of ``pairs`` of chromosomes, numbered from ``first``; every child has two labels unless its parents together have one."""
    spark = pop.sparkSession
    sides = spark.createDataFrame([(k, s, c) for k, p in enumerate(pairs) for s, c in enumerate(p)], "pair int, side int, chrm int")
    cols = ["key", *features, "label"]

    def run(d: pd.DataFrame) -> pd.DataFrame:
        pair = int(d["pair"].iloc[0])
        rng = np.random.default_rng((seed, pair))
        a, b = (d[d["side"] == s].sort_values("pos")[cols] for s in (0, 1))
        mixed = len(set(a["label"]) | set(b["label"])) > 1
        two = lambda x: len(x) and x["label"].nunique() > 1
        for _ in range(1000):
            one, other = cross(a, b, features, fixed, count, rng)
            if not mixed or (two(one) and two(other)):
                break
        out = []
        for k, child in enumerate((one, other)):
            new = mutate(child, features, count, mad, rng)
            child = new if two(new) or not two(child) else child
            out.append(child.assign(chrm=first + 2 * pair + k, pos=np.arange(len(child))))
        return pd.concat(out, ignore_index=True)[["chrm", "pos", *cols]]

    schema = ", ".join(f"`{n}` {pop.schema[n].dataType.simpleString()}" for n in ["chrm", "pos", *cols])
    return pop.join(F.broadcast(sides), "chrm").groupBy("pair").applyInPandas(run, schema)  # as many rows as pairs


def initial(pool: DataFrame, features: list[str], label: str, key: str, population: int, most: int, fixed: bool, seed: int) -> DataFrame:
    """(chrm, pos, key, features..., label): random subsets with two labels, each a bounded head of one written copy of the pool."""
    rng = np.random.default_rng(seed)
    sizes = [chromosome_size(fixed, most, rng) for _ in range(population)]
    base = cut(pool.select(F.col(key).cast("string").alias("key"), *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("label")))
    pop = None
    for c, size in enumerate(sizes):
        head = S.least_hash(base, size, seed * 1000 + c, "key")
        # one row of either kind is always in, so no redrawing is needed
        sure = S.class_limited(base.withColumn("__b", (F.col("label") > 0).cast("double")), "__b", {0.0: 1, 1.0: 1}, seed * 1000 + c, "key").drop("__b")
        part = head.unionByName(sure).dropDuplicates(["key"]).withColumn("chrm", F.lit(c))
        pop = part if pop is None else pop.unionByName(part)
    pos = F.row_number().over(Window.partitionBy("chrm").orderBy("key")) - 1  # a chromosome's rows at most
    return cut(pop.select("chrm", pos.cast("long").alias("pos"), "key", *features, "label"))


def assign_fitness(pop: DataFrame, validation: list[DataFrame], features: list[str], label: str, learner: str = "Naive Bayes", count: bool = False) -> dict[int, float]:
    """Fitness by chromosome of models trained on each, over all ``validation`` sets. Naive Bayes models are fitted in one aggregation."""
    sets: DataFrame | None = None
    for k, v in enumerate(validation):
        part = v.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("actual"), F.lit(k).alias("vset"))
        sets = part if sets is None else sets.unionByName(part)
    if learner == "Naive Bayes" and not count:
        scored = bayes.score(sets, cut(bayes.fit(pop, features, "label", ["chrm"])), features)
    else:
        scored = None
        for c in sorted(r[0] for r in pop.select("chrm").distinct().collect()):
            one = learners.fit_score(learner, pop.where(F.col("chrm") == c), sets, features, "label", count).select("actual", "score", "vset", F.lit(c).alias("chrm"))
            scored = one if scored is None else scored.unionByName(one)
    return {r["chrm"]: float(r["fitness"] or 0.0) for r in (count_fitness if count else binary_fitness)(scored, ["chrm"]).collect()}


@dataclass
class Search:
    """A genetic search and its settings. ``fit`` keeps the best chromosome in ``best`` and its fitness in ``fitness``; ``log`` tells the generations."""

    features: list[str]
    label: str = "label"
    key: str = "id"
    population: int = 10
    generations: int = 10
    size: int = 200
    top: int = 1
    fixed: bool = True
    count: bool = False
    selection: str = "tournament"
    learner: str = "Naive Bayes"
    seed: int = 3
    extra: Callable[[DataFrame], dict[int, float]] | None = None  # a fitness of one's own, by chromosome
    log: list[dict] = field(default_factory=list)
    best: DataFrame | None = None
    fitness: float = 0.0

    def fit(self, train: DataFrame, validation: list[DataFrame] | None = None) -> Search:
        """Breeds until the mean fitness stands still with something found, or for ``generations``."""
        train = cut(train)
        validation = validation or [train]
        assess = self.extra or (lambda p: assign_fitness(p, validation, self.features, self.label, self.learner, self.count))
        mad = float(M.mad(train, self.label).first()[0] or 0.0) if self.count else 0.0
        pop = initial(train, self.features, self.label, self.key, self.population, self.size, self.fixed, self.seed)
        fit = assess(pop)
        for g in range(self.generations):
            order = sorted(range(self.population), key=lambda c: (-fit.get(c, 0.0), c))
            values, rng = [fit.get(c, 0.0) for c in order], np.random.default_rng((self.seed, g))
            self.log.append({"generation": g, "best": values[0], "mean": mean_fitness(values)})
            pairs = [tuple(order[i] for i in parents(values, self.selection, rng)) for _ in range(-(-(self.population - self.top) // 2))]
            places = {c: k for k, c in enumerate(order[: self.top])}
            kept = pop.where(F.col("chrm").isin(list(places))).replace(places, subset=["chrm"])
            young = breed(pop, pairs, self.top, self.features, self.fixed, self.count, mad, self.seed * 1000 + g)
            pop = cut(kept.unionByName(young).where(F.col("chrm") < self.population))
            before, fit = values, assess(pop)
            if standing_still(before, [fit.get(c, 0.0) for c in range(self.population)])[1] and max(fit.values(), default=0.0) > 0:
                break
        won = min(range(self.population), key=lambda c: (-fit.get(c, 0.0), c))
        self.fitness, self.best = fit.get(won, 0.0), cut(pop.where(F.col("chrm") == won).drop("chrm", "pos"))
        return self

    def predict(self, test: DataFrame) -> DataFrame:
        """``test`` plus ``score`` of the learner trained on the best chromosome."""
        if self.best is None:
            raise ValueError("fit first")
        return learners.fit_score(self.learner, self.best, test, self.features, "label", self.count)


def by_parts(train: DataFrame, test: DataFrame, search: Callable[[], Search], parts: int, similarity: Callable[[DataFrame, DataFrame], dict[int, float]], seed: int = 5) -> DataFrame:
    """The test set dealt to parts; for each a search whose fitness is the similarity of its chromosomes to the part; ``test`` plus ``part`` and ``score``, pooled."""
    one = search()
    dealt = cut(S.stratified_folds(test, one.label, parts, seed, one.key).withColumnRenamed("fold", "part"))
    out = None
    for k in range(parts):
        s, part = search(), dealt.where(F.col("part") == k)
        s.extra = lambda p, part=part: similarity(p, part)
        scored = s.fit(train).predict(part)
        out = scored if out is None else out.unionByName(scored)
    return out
