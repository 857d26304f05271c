"""Genetic operators on small frames, searches, and every learner by name."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.operators import experiments as E, genetic as G, learners

FEATURES = ["a", "b"]


def _chrm(n, seed):
    r = np.random.default_rng(seed)
    return pd.DataFrame({"key": [str(k) for k in range(n)], "a": r.integers(0, 4, n).astype(float), "b": r.integers(0, 3, n).astype(float), "label": r.integers(0, 2, n).astype(float)})


@pytest.mark.parametrize("fixed", [True, False])
def test_cross(fixed):
    a, b = _chrm(30, 1), _chrm(30, 2)
    b["key"] = "b" + b["key"]
    one, other = G.cross(a, b, FEATURES, fixed, False, np.random.default_rng(3))
    assert sorted([*one["key"], *other["key"]]) == sorted([*a["key"], *b["key"]])  # nothing lost, nothing twice
    if fixed:
        assert len(one) == len(other) == 30
    for child in (one, other):  # equal features, one label, that of the majority
        for key, g in child.groupby(FEATURES):
            was = pd.concat([a, b]).set_index("key").loc[g["key"], "label"]
            assert set(g["label"]) == {float(was.mean() >= 0.5)}


def test_mutate_and_counts():
    d = _chrm(40, 5).assign(label=lambda x: (x["a"] > 1) * 1.0)
    changed = 0
    for seed in range(300):
        m = G.mutate(d, FEATURES, False, 0.0, np.random.default_rng(seed))
        moved = m["label"] != d["label"]
        changed += bool(moved.any())
        assert d[moved].groupby(FEATURES).ngroups <= 1 and (not moved.any() or moved.sum() == len(d.merge(d[moved][FEATURES].drop_duplicates())))
    assert 10 <= changed <= 60  # odds of a tenth
    counts = d.assign(label=3.0)
    seen = [G.mutate(counts, FEATURES, True, 9.0, np.random.default_rng(s))["label"].min() for s in range(200)]
    assert min(seen) == 0 and all(float(x).is_integer() for x in seen)
    assert set(G.relabel(pd.DataFrame({"a": [1.0, 1.0], "b": [2.0, 2.0], "label": [1.0, 4.0]}), FEATURES, True)["label"]) == {2.5}


def test_selection():
    rng = np.random.default_rng(1)
    fit = [0.9, 0.1, 0.5, 0.0]
    won = [G.tournament(fit, rng) for _ in range(2000)]
    assert won.count(0) > won.count(2) > won.count(1) > won.count(3)
    spun = [G.wheel(fit, rng) for _ in range(3000)]
    assert abs(spun.count(0) / 3000 - 0.6) < 0.04 and 3 not in spun
    assert G.wheel([0.0, 0.0], rng) == 1
    for kind in ("tournament", "wheel", "uniform"):
        a, b = G.parents(fit, kind, rng)
        assert a != b
    assert G.parents([1.0, 0.0], "wheel", rng)[0] == 0
    assert G.chromosome_size(True, 50, rng) == 50 and all(10 <= G.chromosome_size(False, 5, rng) < 15 for _ in range(50))
    assert G.mean_fitness([1.0, 2.0, 3.0], 2) == 3.0 and G.standing_still([1.0], [1.0 + 1e-8])[1] and not G.standing_still([1.0], [1.1])[1]


def test_breed_and_search(spark):
    r = random.Random(2)
    rows = [(str(k), float(r.gauss(2 * (k % 2), 1)), float(r.gauss(0, 1)), float(k % 2)) for k in range(300)]
    df = spark.createDataFrame(rows, "id string, a double, b double, label double")
    pop = G.initial(df, FEATURES, "label", "id", 4, 40, True, 1)
    sizes = {x["chrm"]: (x["n"], x["k"]) for x in pop.groupBy("chrm").agg(F.count("*").alias("n"), F.countDistinct("label").alias("k")).collect()}
    assert set(sizes) == {0, 1, 2, 3} and all(40 <= n <= 42 and k == 2 for n, k in sizes.values())
    young = G.breed(pop, [(0, 1), (2, 3)], 1, FEATURES, True, False, 0.0, 9)
    kids = {x["chrm"]: x["k"] for x in young.groupBy("chrm").agg(F.countDistinct("label").alias("k")).collect()}
    assert set(kids) == {1, 2, 3, 4} and set(kids.values()) == {2}
    search = G.Search(FEATURES, population=4, generations=2, size=40).fit(df)
    scored = search.predict(df)
    right = scored.where((F.col("score") >= 0.5) == (F.col("label") == 1)).count()
    assert search.fitness > 0.6 and right > 210 and search.log[0]["generation"] == 0
    count = G.Search(FEATURES, population=4, generations=1, size=40, count=True, learner="Linear Regression", fixed=False, selection="wheel").fit(df)
    assert 0 < count.fitness <= 1
    pooled = E.distribution_selection(df, df, FEATURES, parts=2, population=4, generations=1, size=40).first()
    assert pooled["tp"] + pooled["tn"] + pooled["fp"] + pooled["fn"] == 300


@pytest.mark.parametrize("name", sorted(learners.BINARY))
def test_binary_learners(spark, monkeypatch, name):
    monkeypatch.setattr(learners, "STUMPS", 4)
    r = random.Random(4)
    rows = [(k, max(0.0, r.gauss(2 + 2.5 * (k % 2), 0.6)), max(0.0, r.gauss(4 - 2.5 * (k % 2), 0.6)), k % 2) for k in range(120)]
    df = spark.createDataFrame(rows, "id int, a double, b double, label int")
    if name == "Bernoulli Naive Bayes":
        df = df.withColumn("a", (F.col("a") > 3.2).cast("double")).withColumn("b", (F.col("b") > 2.7).cast("double"))
    out = learners.fit_score(name, df.where("id < 80"), df.where("id >= 80"), FEATURES).collect()
    cut = 0.0 if "Support" in name else 0.5
    assert len(out) == 40 and sum((x["score"] >= cut) == (x["label"] == 1) for x in out) >= 33, name


@pytest.mark.parametrize("name", sorted(learners.COUNT))
def test_count_learners(spark, name):
    rows = [(k, float(k % 7), float(k % 5), k % 7 + 2 * (k % 5)) for k in range(140)]
    df = spark.createDataFrame(rows, "id int, a double, b double, label int")
    out = learners.fit_score(name, df.where("id < 100"), df.where("id >= 100"), FEATURES, count=True).collect()
    assert len(out) == 40 and np.mean([abs(x["score"] - x["label"]) for x in out]) < 2.6, name


def test_names_of_learners():
    assert learners.get("Bayesian Network") is learners.BINARY["Naive Bayes"] and len(learners.BINARY) == 15 and len(learners.COUNT) == 12
    with pytest.raises(KeyError):
        learners.get("Oracle")


def test_cross_validation_with_any_learner(spark):
    rows = [(k, float(k % 2) + (k % 3) * 0.1, float(k % 5), k % 2, "p" if k % 4 < 2 else "q") for k in range(120)]
    df = spark.createDataFrame(rows, "id int, a double, b double, label int, project string")
    got = E.cross_validation(df, FEATURES, "label", "id", 3, ["project"], learner="Decision Tree").collect()
    assert {x["project"] for x in got} == {"p", "q"} and all(x["f"] > 0.95 for x in got)
