"""Operators that avoid one task per key or group give what the plain computation gives."""

import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline import session
from faultline.operators import lsh, measures as M, relevancy as V, szz


def test_bucket_pairs_of_copies(spark):
    r = random.Random(3)
    kinds = [[r.randrange(4), r.randrange(4)] for _ in range(6)]
    rows = [(k, kinds[0] if k % 3 == 0 else r.choice(kinds)) for k in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, h array<long>").withColumn("rep", F.lit("clash"))
    got = {tuple(x) for x in lsh.candidates(df, df.where("id % 5 = 0"), "id", "h").collect()}
    held = {k: h for k, h in rows if h}
    want = {(q, o) for q in held if q % 5 == 0 for o in held if q != o and any(a == b for a, b in zip(held[q], held[o]))}
    assert got == want
    assert lsh.class_pairs(df, df, "id", "h").count() <= 36 and lsh.bucket_classes(df, "id", "h").select("rep").distinct().count() <= 6


@pytest.mark.parametrize("block", [7, 20_000])
def test_collision_curve(spark, monkeypatch, block):
    monkeypatch.setattr(lsh, "CURVE_BLOCK", block)
    r = np.random.default_rng(2)
    v, h = r.normal(size=(80, 3)), r.integers(0, 3, (80, 2))
    df = spark.createDataFrame([(k, v[k].tolist(), h[k].tolist()) for k in range(80)] + [(90, None, [1, 1])], "vec_id long, v array<double>, hashes array<long>")
    got = {x["bin"]: (x["n"], x["hits"]) for x in lsh.collision_curve(df, df.where("vec_id % 4 = 0")).collect()}
    want = {}
    for q in range(0, 80, 4):
        for k in range(80):
            if k != q:
                b = int(np.floor(v[q] @ v[k] / np.linalg.norm(v[q]) / np.linalg.norm(v[k]) * 10))
                n, c = want.get(b, (0, 0))
                want[b] = (n + 1, c + int((h[q] == h[k]).any()))
    assert got == want
    assert lsh.collision_curve(df, df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [5, 20_000])
def test_radius_vote_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(V, "QUERY_BLOCK", block)
    rows = [(k, [float(k % 10), float(k // 10)], k % 2) for k in range(60)]
    df = spark.createDataFrame(rows + [(70, None, 1)], "vec_id long, v array<double>, label int")
    got = {x["vec_id"]: (x["n"], x["score"]) for x in V.radius_vote(df, df.where("vec_id % 3 = 0"), 1.0, "label").collect()}
    for q, x, _ in rows[::3]:
        near = [y for _, z, y in rows if np.hypot(x[0] - z[0], x[1] - z[1]) <= 1.0]
        assert got[q] == (len(near), round(sum(near) / len(near), 9))
    assert V.radius_vote(df, df.limit(0), 1.0, "label").count() == 0 and V.neighbours(df, df.limit(0), 2).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 9, 200])
def test_whole_median(spark, n):
    r = random.Random(n)
    values = [r.choice([1.5, 2.0, r.random() * 9]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got, off = M.whole_median(df, "x").first()[0], M.mad(df, "x").first()[0]
    if not n:
        assert got is None and off is None
    else:
        assert got == pytest.approx(median(values)) and off == pytest.approx(median(abs(v - median(values)) for v in values))


def test_revisions_of_a_hot_file(spark):
    r = random.Random(5)
    rows = [("hot" if k % 3 else f"f{k % 4}", r.randrange(50), k, f"c{k}", "a") for k in range(300)]
    got = {(x["file"], x["commit"]): x["rev_idx"] for x in szz.file_revisions(spark.createDataFrame(rows, "file string, t int, id int, cid string, who string"), "file", ["t", "id"], "cid", "who").collect()}
    for f in {x[0] for x in rows}:
        assert [got[f, x[3]] for x in sorted(x for x in rows if x[0] == f) for _ in [0]] == list(range(sum(x[0] == f for x in rows)))


def test_spread_and_settle(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert session.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert session.spread(spark.range(5)).count() == 5
    held = session.settle(df.withColumn("y", F.sqrt("id") * 2), "y")
    assert held.columns == ["id", "y"] and held.where("y > 10").count() == 974
    plan = held.where("y > 10")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT") == 1


def test_shared_folder_is_asked_for(spark):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError):
        session.shared_dir(Elsewhere())
