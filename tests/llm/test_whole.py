"""The operators do the whole job: every pair, every leak, one rule at every size."""

import random
from collections import Counter

import numpy as np

from faultline.llm import cooccur, leak, queries, toxic


def test_surprise_reports_every_pair(spark, tmp_path):
    r = random.Random(5)
    sets = {f"c{c}": {"hot.c", *(f"f{r.randrange(12)}.c" for _ in range(3))} | ({"u.c", "v.c"} if c < 9 else set()) for c in range(200)}
    spark.createDataFrame([(c, "[" + ", ".join(sorted(fs)) + "]") for c, fs in sets.items()], "cid string, files string").write.parquet(str(tmp_path / "logs.parquet"))
    want = {}
    for fs in sets.values():
        for a in fs:
            for b in fs:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    rows = queries.p7_surprise(spark, str(tmp_path)).collect()
    assert {(x["item_a"], x["item_b"]): x["n"] for x in rows} == want and want["hot.c", "u.c"] == 9
    # Benjamini-Hochberg over all pairs of all items
    ps, items = sorted(x["log10_p"] for x in rows), 15
    most = max((p for k, p in enumerate(ps) if p <= np.log10((k + 1) * 0.01 / (items * (items - 1) // 2))), default=-np.inf)
    assert all(x["surprising"] == (x["log10_p"] <= most) for x in rows) and [(x["item_a"], x["item_b"]) for x in rows if x["surprising"]] == [("u.c", "v.c")]
    found = {tuple(x) for x in queries.p7_found(spark, str(tmp_path)).collect()}
    assert found == {("u.c", "v.c")}


def test_found_goes_through_the_null(spark, tmp_path, monkeypatch):
    """p7_found fits the null to all files and commits and scores every pair; its bounds choose afterwards."""
    r = random.Random(12)
    sets = {f"c{c}": {"hot.c", *(f"f{r.randrange(9)}.c" for _ in range(r.randrange(4)))} | ({"u.c", "v.c"} if c < 8 else set()) for c in range(120)}
    sets["c119"] |= {"rare.c"}
    spark.createDataFrame([(c, "[" + ", ".join(sorted(fs)) + "]") for c, fs in sets.items()], "cid string, files string").write.parquet(str(tmp_path / "logs.parquet"))
    fitted, plain = [], cooccur.fit_null
    monkeypatch.setattr(cooccur, "fit_null", lambda *a: fitted.append(a) or plain(*a))
    found = queries.p7_found(spark, str(tmp_path))
    # the margins hold the file in every commit and the one in a single commit, neither of which can be within the bounds
    freq, sizes = Counter(Counter(f for fs in sets.values() for f in fs).values()), Counter(map(len, sets.values()))
    n, k, s, m = fitted[0]
    assert len(fitted) == 1 and dict(zip(n, k)) == freq and dict(zip(s, m)) == sizes and {1, 120} <= set(freq)
    assert "log10_p" in found._jdf.queryExecution().analyzed().toString()  # rows come from the scored pairs
    pairs = Counter((a, b) for fs in sets.values() for a in fs for b in fs if a < b)
    of = Counter(f for fs in sets.values() for f in fs)
    assert {tuple(x) for x in found.collect()} == {(a, b) for (a, b), c in pairs.items() if c >= 8 and c * 120 >= 10 * of[a] * of[b]} == {("u.c", "v.c")}


def test_null_is_fitted(spark):
    r = random.Random(8)
    # skewed on both sides: the products n * s / S pass 1; "all" is in every basket
    sets = [{"all", *(f"i{int(40 * r.random() ** 3)}" for _ in range(30 if b < 6 else 3))} for b in range(80)]
    items, sizes = sorted(set().union(*sets)), [len(x) for x in sets]
    freq = {i: sum(i in x for x in sets) for i in items}
    n, k = map(np.array, zip(*sorted((f, list(freq.values()).count(f)) for f in set(freq.values()))))
    s, m = map(np.array, zip(*sorted((f, sizes.count(f)) for f in set(sizes))))
    p = cooccur.fit_null(n.astype(float), k, s.astype(float), m)
    assert max(a * b for a in n for b in s) / sum(sizes) > 1 and p.min() >= 0 and p.max() <= 1
    assert np.allclose(p @ m, n, rtol=1e-6) and np.allclose(k @ p, s, rtol=1e-6)
    got = cooccur.cooccurrence(spark.createDataFrame([(f"b{c}", i) for c, x in enumerate(sets) for i in x], "basket string, item string"), "basket", "item").collect()
    for x in got:
        q = p[list(n).index(x["n_a"])] * p[list(n).index(x["n_b"])]
        assert abs(x["expected"] - q @ m) < 1e-6
        if x["item_a"] == "all":
            assert abs(x["expected"] - x["n_b"]) < 1e-4  # no more than the other item has


def test_tail_of_small_counts():
    for m in ([500, 80, 3], [3, 2, 1], [2000, 0, 2]):
        for scale in (1e-7, 1e-5, 1e-3, 0.02):
            q = scale * np.array([1.0, 4.0, 30.0])
            mass = np.array([1.0])
            for x in np.repeat(q, m):
                mass = np.convolve(mass, [1 - x, x])[:60]
            for n in (1, 2, 3, 5):
                got = cooccur._upper_tail_log10(np.array([float(n)]), np.ones(1), q[None, :], np.array(m, float))[0]
                assert abs(got - np.log10(mass[n:].sum())) < 0.05, (n, scale, m)


def test_leaks_without_slots(spark):
    shared = "the quiet river bends around seven old mills before it meets the wide grey sea and slows down at last"
    tail = "but number {0} of gorut{0} was never told which bulen{0} had taken pelat{0} away"
    # three items share the wording, so none of its words is a slot
    items = spark.createDataFrame([(k, f"{shared} {tail.format(k)}") for k in (1, 2, 3)] + [(9, shared)] * 3 + [(5, "an unrelated item about paper boats " * 4)], "item_id long, passage string")
    docs = spark.createDataFrame([(1, f"As they say: {shared.title()}, or so."), (2, " ".join(shared.split()[3:18])), (3, " ".join(shared.split()[3:13])), (4, f"{shared} {tail.format(2)}")], "doc_id long, text string")
    got = sorted(tuple(r) for r in leak.LeakIndex(items).leaks(docs).collect())
    assert got == sorted((d, i) for d in (1, 2, 4) for i in (1, 2, 3, 9))


def test_no_sentence_of_the_data_in_the_library():
    """Nothing abusive is written down: no string of the library of three words or more stands in the documents."""
    import ast
    import pathlib

    import pandas as pd

    sf = pathlib.Path("/root/testdata/sf0.01")
    if not sf.exists():
        return
    texts = " \n ".join(" ".join(leak.words(t)) for t in pd.read_parquet(sf / "documents.parquet")["text"] if t)
    tree = ast.parse(pathlib.Path(toxic.__file__).read_text())
    docs = {ast.get_docstring(n, clean=False) for n in ast.walk(tree) if isinstance(n, (ast.Module, ast.FunctionDef, ast.ClassDef))}
    said = [leak.words(n.value) for n in ast.walk(tree) if isinstance(n, ast.Constant) and isinstance(n.value, str) and n.value not in docs]
    assert not [w for w in said if len(w) >= 3 and f" {' '.join(w)} " in texts]


def test_long_disguised_runs():
    said = ["worthless", "pathetic", "idiot", "moron", "loser", "stupid", "arrogant", "scumbag", "imbecile", "parasite"]
    read = toxic.Reader.of(["You worthless, pathetic idiot! Moron, loser, stupid arrogant scumbag: imbecile parasite. Are you a fool"])
    assert read.tokens(" ".join("".join(said))) == said  # 72 letters
    assert read.tokens("you " + " ".join("areyouafool")) == ["you", "are", "you", "a", "fool"]
    assert read.tokens("q w e r t z") == ["qwertz"]
    assert read.tokens("f**x p@rasite 1d10t m***n stuuuupid w-o-r-t-h-l-e-s-s") == ["masked", "parasite", "idiot", "moron", "stupid", "worthless"]


def test_reparameterised_fragments(spark):
    made = lambda k, a, b: f"Line {k}88 of zuyom{k}/file{k}.cc was born in cb5{k}a7df, moved by {a} in step {k}3, and last changed when plutak{k} took over from {b}."
    items = [(k, made(k, f"vacuz{k}", f"vacuz{k}")) for k in range(1, 5)]
    other = made(7, "gorut", "gorut")
    docs = [(1, " ".join(other.split()[4:])), (2, items[0][1] + " word" * 40 + " " + other), (3, items[1][1]), (4, made(7, "gorut", "bulen"))]
    got = leak.LeakIndex(spark.createDataFrame(items, "item_id long, passage string")).reparameterised(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    # a fragment, a whole one beside a verbatim item; not the verbatim item and not the one with two values for one
    assert [(r["doc_id"], r["item_id"]) for r in sorted(got)] == [(1, 1), (2, 1)]


def test_reparameterised_recall(spark):
    """Planted variants of whole and cut items, with production parameters."""
    r = random.Random(21)
    name = lambda: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(4))
    forms = [
        "between tags {n} and {n} the class {a} gained {n} methods, its coupling went from {n} to {n}, and {b} became abstract after {a} was cut.",
        "a report numbered {n} says that {a} loses {n} bytes whenever {b} is resized while {c} holds the lock of {a} and {n} readers wait.",
        "dataset {a} holds {n} classes of which {n} are faulty; removing column {b} lowers the score of learner {c} by {n} points on {a}.",
    ]

    def fill(form):
        value = {x: name() for x in "abc"}
        return "".join(str(r.randrange(10, 9999)) if x == "{n}" else value[x[1]] if x[0] == "{" else x for x in __import__("re").split(r"(\{.\})", form) if x)

    items = [(k, " ".join(fill(f) for f in r.sample(forms, 2))) for k in range(40)]
    docs = [(k, "unrelated words stand here " * 5 + fill(forms[k % 3]) + " and some more of them") for k in range(60)] + [(100 + k, items[k][1]) for k in range(20)] + [(200 + k, "nothing of the kind is in this text " * 9) for k in range(20)]
    got = leak.LeakIndex(spark.createDataFrame(items, "item_id long, passage string")).reparameterised(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = {x["doc_id"] for x in got}
    assert len(found & set(range(60))) >= 54 and not found - set(range(60))


def test_sizes_only_change_the_plan(spark, monkeypatch):
    """What is broadcast, packed or paired at once below a size gives the same beyond it."""
    r = random.Random(4)
    rows = [(f"b{b}", f"i{min(r.randrange(15), r.randrange(15))}") for b in range(80) for _ in range(r.randint(1, 6))]
    items = spark.createDataFrame(rows, "basket string, item string")
    key = lambda x: (x["item_a"], x["item_b"], x["n"], round(x["expected"], 9), round(x["log10_p"], 9), x["surprising"])
    small = {key(x) for x in cooccur.cooccurrence(items, "basket", "item").collect()}
    for name in ("BROADCAST_ITEMS", "BROADCAST_KINDS", "PACKED_ITEMS", "ROW_ITEMS"):
        monkeypatch.setattr(cooccur, name, 1 if name == "ROW_ITEMS" else 0)
        assert {key(x) for x in cooccur.cooccurrence(items, "basket", "item").collect()} == small, name
    passages = [(k, " ".join(f"w{r.randrange(40)}" if j % 4 else str(r.randrange(999)) for j in range(30))) for k in range(12)]
    docs = spark.createDataFrame([(k, "before " + (p if k % 2 else " ".join(p.split()[:17])) + " after") for k, p in passages] + [(50, "nothing of it")], "doc_id long, text string")
    held = spark.createDataFrame(passages, "item_id long, passage string")
    want = sorted(tuple(x) for x in leak.LeakIndex(held).leaks(docs).collect())
    monkeypatch.setattr(leak, "BROADCAST_WINDOWS", 0)
    index = leak.LeakIndex(held)
    assert want == sorted((k, k) for k, _ in passages) == sorted(tuple(x) for x in index.leaks(docs).collect()) and index.templates is None
