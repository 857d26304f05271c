"""Unit and property tests of the operators that SQL can't check, and of edge cases."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from faultline.functions.csource import minify
from faultline.operators import bayes, experiments as E, history as H, learners, lsh as L, measures as M, relational as R, relevancy as V, sampling as S, szz as Z


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- bug links: literal cases


@pytest.mark.parametrize(
    "message,ids",
    [("bug 123", ["123"]), ("fixed #77 and issue-9", ["77", "9"]), ("[42] pr 7", ["42", "7"]), ("backed out bug 5", []), ("merge", []), ("show_bug.cgi?id=8", ["8"]), ("no number", []), ("bug 1 bug 2", ["1", "2"]), ("", []), (None, []), ("Bug 5" + "x" * 10_000, ["5"])],
)
def test_bug_ids(spark, message, ids):
    df = spark.createDataFrame([(message,)], "m string")
    assert df.select(Z.bug_ids(F.col("m"))).first()[0] == ids


# ---- line links


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment_is_least(n, m, seed):
    c = np.random.default_rng(seed).random((n, m))
    got = Z.assign(c)
    assert len(got) == min(n, m) and len({a for a, _ in got}) == len({b for _, b in got}) == len(got)
    small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
    best = min(sum(c[a, b] if n <= m else c[b, a] for a, b in zip(small, p)) for p in itertools.permutations(large, len(small)))
    assert abs(sum(c[p] for p in got) - best) < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.text("abcd", max_size=9), st.text("abcd", max_size=9))
def test_indel_ratio(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert Z.indel_ratio(a, b) == (2 * t[-1][-1] / (len(a) + len(b)) if a or b else 1.0)


def test_line_rules():
    left = ["a = 1;", "value = compute(x, y);", "z"]
    near, far = ["a = 1;", "value = compute(x, z);", "z"], ["a = 1;", "@@@@", "z"]
    for rule in ("AG", "RAG", "KIM", "LEV"):
        assert Z.link_lines(left, left, rule) == ([(0, 0), (1, 1), (2, 2)], [], set(), set())
        assert Z.link_lines(left, near, rule)[1] == [(1, 1)]
        assert Z.link_lines(left, left[:2], rule)[2] == {2} and Z.link_lines(left[:2], left, rule)[3] == {2}
    assert Z.link_lines(left, far, "AG") == ([(0, 0), (2, 2)], [], {1}, {1})
    assert Z.link_lines(left, far, "LEV")[2:] == ({1}, {1}) and Z.link_lines(left, far, "RAG")[1] == [(1, 1)]
    ten = [f"l{k}" for k in range(10)]
    assert len(Z.link_lines(ten, ["x", "y", "p", "q"] + ten[4:], "KIM")[1]) == 16 and not Z.link_lines(ten, ["x"] + ten[5:], "KIM")[1]


def test_annotation_graph(spark):
    revs = [(1, 0, "r0", "ann", "a\nb\nc"), (1, 1, "r1", "bob", "a\nc"), (1, 2, "r2", "cat", "a\nnew\nc"), (2, 0, "s0", "dan", None)]
    nodes, edges = Z.annotation_graph(spark.createDataFrame(revs, "file_id long, rev_idx long, rev string, author string, text string"), "AG")
    got = {(r["file_id"], r["rev_idx"], r["line_no"]): (r["line"], r["type"], r["author"], r["cm_id"]) for r in nodes.collect()}
    assert got[1, 0, 1] == ("b", "+;-", "ann;bob", "r0;r1") and got[1, 1, 1] == ("c", "", "ann", "r0") and got[1, 2, 1] == ("new", "+", "cat", "r2") and got[1, 2, 2] == ("c", "", "ann", "r0") and got[2, 0, 0] == ("", "+", "dan", "s0")
    e = {tuple(r) for r in edges.collect()}
    assert (1, 1, 1, 0, 2) in e and all((f, tr, tl, r, l) in e for f, r, l, tr, tl in e)


def test_trace(spark):
    nodes = spark.createDataFrame([(1, 0, 0, "+", 1), (1, 1, 0, "*", 5), (1, 2, 0, "", 6), (1, 3, 0, "", 9)], "file_id long, rev_idx long, line_no long, type string, ts long")
    edges = spark.createDataFrame([(1, k, 0, k - 1, 0) for k in (1, 2, 3)], "file_id long, rev_idx long, line_no long, to_rev long, to_line long")
    start = lambda rep: spark.createDataFrame([(7, 1, 3, 0, rep)], "start_id long, file_id long, rev_idx long, line_no long, report_ts long")
    assert rows(Z.trace(start(None), nodes, edges, ["+", "*"])) == [(7, 1, 1, 0, 2)]
    assert rows(Z.trace(start(4), nodes, edges, ["+", "*"])) == [(7, 1, 0, 0, 3)]
    assert rows(Z.trace(start(1), nodes, edges, ["+", "*"])) == [] and rows(Z.trace(start(1).limit(0), nodes, edges, ["+"])) == []


def test_pagerank_and_imputation(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 2), (4, 4), (None, 1)], "src long, dst long")
    r = {x["node"]: x["rank"] for x in Z.pagerank(e).collect()}
    assert abs(sum(r.values()) - 1) < 1e-6 and r[3] > r[1] and Z.pagerank(e.limit(0)).count() == 0
    d = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, "b", True), (4, "x", False), (5, "b", True), (0, "y", False)], "file_id long, component string, dominant boolean")
    assert rows(Z.impute_components(d)) == [(0, None), (1, "a"), (2, "a"), (3, "b"), (4, "a"), (5, "b")]


# ---- measures


def test_measures_edge_cases(spark):
    none = spark.createDataFrame([], "actual double, score double")
    assert M.confusion(none).first()["tp"] is None and M.auc(none).first()["n_pos"] is None
    one = spark.createDataFrame([(1.0, 0.9), (1.0, 0.2), (None, 0.5)], "actual double, score double")
    m = M.with_measures(M.confusion(one)).first()
    assert (m["tp"], m["fn"], m["pf"], m["prec"]) == (1.0, 1.0, 0.0, 1.0)
    assert M.auc(one.where("actual IS NOT NULL")).first()["auc"] == 0.0
    ties = spark.createDataFrame([(k, v) for k, v in enumerate([3.0, 1.0, 3.0, 2.0])], "id int, v double").withColumn("rank", F.lit("clash"))
    assert {r["id"]: r["r"] for r in M.tied_rank(ties, "v", out="r").collect()} == {0: 3.5, 1: 1.0, 2: 3.5, 3: 2.0}


def test_auc_is_permutation_invariant_and_symmetric(spark):
    r = random.Random(3)
    d = [(float(r.random() < 0.4), round(r.random(), 2)) for _ in range(300)]
    a = M.auc(spark.createDataFrame(d, "actual double, score double")).first()["auc"]
    r.shuffle(d)
    b = M.auc(spark.createDataFrame([(x, -y) for x, y in d], "actual double, score double")).first()["auc"]
    assert 0 <= a <= 1 and abs(a + b - 1) < 1e-6
    pos, neg = [y for x, y in d if x], [y for x, y in d if not x]
    assert abs(a - sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))) < 1e-6


# ---- vectors and hashes


def test_lsh(spark):
    c = L.minhash_coefficients(20, 100, 123456)
    assert c == L.minhash_coefficients(20, 100, 123456) and L.signature_size(3) == 9 and L.size_for_error(0.1) == 100
    df = spark.createDataFrame([([0, 3], [0, 2, 3], []), (None, None, [])], "a array<int>, b array<int>, e array<int>")
    r = df.select(L.jaccard(F.col("a"), F.col("b")).alias("j"), L.jaccard(F.col("e"), F.col("e")).alias("z"), L.minhash_signature(F.col("e"), c, 100).alias("s")).collect()
    assert abs(r[0]["j"] - 2 / 3) < 1e-12 and r[0]["z"] == 0.0 and r[0]["s"] is None
    p = L.superbit_planes(8, 4, 2, 1)
    assert np.allclose(p[:4] @ p[:4].T, np.eye(4)) and L.superbit_shape(2, 16, 64) == (16, 1)
    v = spark.createDataFrame([([1.0, 0.0, 2.0], [0.5, 1.0, 0.0])], "a array<double>, b array<double>")
    s = v.select(L.sparse(F.col("a")).alias("a"), L.sparse(F.col("b")).alias("b"))
    got = s.select(L.sparse_dot(F.col("a"), F.col("b")), L.sparse_qgram(F.col("a"), F.col("b")), L.sparse_jaccard(F.col("a"), F.col("b")), F.size(L.dimsum_sample(F.col("a"), 1e6, F.lit(1), 3))).first()
    assert got[0] == 0.5 and got[1] == 3.5 and abs(got[2] - 1 / 3) < 1e-12 and got[3] == 2
    with pytest.raises(ValueError):
        L.superbit_planes(4, 5, 1, 0)


def test_neighbours_brute(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, (40, 3)).astype(float)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(99, None)], "vec_id long, v array<double>")
    got = {(r["query"], r["rank"]): r["neighbour"] for r in V.neighbours(df.where("vec_id > 6"), df.where("vec_id <= 6"), 4).collect()}
    for q in range(7):
        want = sorted(range(7, 40), key=lambda k: (np.sqrt(((x[k] - x[q]) ** 2).sum()), k))[:4]
        assert [got[q, r + 1] for r in range(4)] == want


# ---- learners, samples, trees


def test_bayes_and_learners(spark):
    r = random.Random(5)
    d = [(k, r.gauss(k % 2 * 4, 1), r.gauss(0, 1), float(k % 2), f"p{k % 3}") for k in range(300)]
    df = spark.createDataFrame(d, "id long, a double, b double, label double, project string")
    for scored in (bayes.score(df, bayes.fit(df, ["a", "b"]), ["a", "b"]), learners.fit_score("Logistic Regresson", df, df, ["a", "b"]), bayes.score(df, bayes.fit_leave_one_out(df, ["a", "b"], "project"), ["a", "b"], ["project"])):
        c = M.confusion(scored.withColumn("actual", F.col("label"))).first()
        assert (c["tp"] + c["tn"]) / 300 > 0.95
    folds = S.stratified_folds(df, "label", 5, 1, "id").groupBy("fold").count().collect()
    assert len(folds) == 5
    assert E.cross_validation(df, ["a", "b"], "label", "id").first()["accu"] > 0.9
    mean, comp, share = E.pca(df, ["a", "b"])
    assert share[0] > share[-1] and np.allclose(comp.T @ comp, np.eye(comp.shape[1])) and E.apply_pca(df, ["a", "b"], mean, comp, ["id"]).count() == 300
    assert bayes.score(df, bayes.fit(df.where("label = 1"), ["a"]), ["a"]).select(F.min("score")).first()[0] == 1.0
    with pytest.raises(KeyError):
        learners.get("no such learner")


def test_parse_log(spark):
    lines = ["GIS-VAR-nb:ant.arff: {'rec': 0.5, 'F': 1e-1}", "#CONF-TEST:LSHTune-nb:ivy: {'tp': 4.0}", "noise", None, ""]
    got = rows(E.parse_log(spark.createDataFrame([(x,) for x in lines], "line string")))
    assert got == [("GIS-VR-NB", "ant", "measure", "F", 0.1), ("GIS-VR-NB", "ant", "measure", "rec", 0.5), ("LSH-NB", "ivy", "conf", "tp", 4.0)]
    assert E.result_tree(spark.createDataFrame([(1, ""), (2, None), (3, "{bad")], "id long, results string")).count() == 0


def test_relational_edges(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, 5.0, None), (3, 7.0, "x")], "id long, f double, g string")
    assert rows(R.find_instances(df, df.where("id >= 2"), ["f", "g"])) == [(1, 2), (2, 2), (3, 3)]
    assert rows(R.similar_classes(df, ["f", "g"])) == [(1, 1, 2), (2, 1, 2), (3, 3, 1)]
    assert [r["f"] for r in R.minmax(df, ["f"]).orderBy("id").collect()] == [0.0, 0.0, 1.0]
    assert R.minmax(df.limit(0), ["f"]).count() == 0
    a = spark.createDataFrame([("r", 1, "f", "add"), ("r", 2, "f", "delete"), ("r", 2, "g", "add")], "repoId string, rev_idx int, file string, type string")
    assert rows(H.revision_files(a, 2)) == [("r", "g")] and rows(H.changed_files(a, 1, 2)) == [("r", ["g"], ["f"], [])]
    assert H.differences(df, df).count() == 0


def test_minify():
    assert minify("int  a ; /* x */\nif (a) { b(); } // y\n#define X 1\n") == "int a;\nif(a){\nb();\n}\n#define X 1" and minify(None) == ""


def test_catalogue_names_and_separation():
    import subprocess
    import sys

    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and {f"p{n}_found" for n in (1, 2, 3, 4, 5)} <= set(q)
    # nothing outside the llm subpackage needs it
    code = "import sys; sys.modules['faultline.llm'] = None; import __spark_entry__ as e; assert 'p5_found' in e.queries() and not any(n.startswith(('p6', 'p7', 'p8', 'p9', 'p10')) for n in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rsplit("/", 1)[0]).returncode == 0


def test_runner_and_helpers(spark, tmp_path):
    from faultline.functions import misc

    r = random.Random(8)
    d = [(k, r.gauss(k % 2 * 4, 1), r.gauss(0, 1), float(k % 2), f"p{k % 2 + k % 3 // 2}") for k in range(200)]
    df = spark.createDataFrame(d, "id long, a double, b double, label double, project string")
    for mode in ("all", "pca"):
        got = E.run(df, "project", ["a", "b"], "label", ["Naive Bayes"], mode).collect()
        assert len(got) == df.select("project").distinct().count() and all(x["accu"] > 0.8 for x in got)
    t = E.RejectTracker(0.2)
    assert t.accept(0.5) and not t.accept(0.1) and t.threshold > 0.2
    t.reset()
    assert t.threshold == 0.2 and misc.fresh_name(".png").endswith(".png") and misc.now_millis() > 10**12
    (tmp_path / "q.csv").write_text("component,n\nLayout,3\nAudio,1\n")
    assert rows(misc.read_components(spark, str(tmp_path / "q.csv"))) == [("Audio",), ("Layout",)]
