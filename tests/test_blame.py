"""Blame against a walk written out by hand, the whole run, saved graphs, landed logs."""

import random

from pyspark.sql import functions as F

from faultline.operators import blame, history, szz
from faultline.sources import logs

NODES = "file_id long, rev_idx long, line_no long, type string, line string, cm_id string"
EDGES = "file_id long, rev_idx long, line_no long, to_rev long, to_line long"


def _walk(fixes, revs, nodes, edges):
    """Every path by itself."""
    kind_of = {(f, r, n): (t, line, c) for f, r, n, t, line, c in nodes}
    up = {}
    for f, r, n, tr, tn in edges:
        if tr < r:
            up.setdefault((f, r, n), []).append((f, tr, tn))
    when = {(f, r): ts for f, r, _, ts in revs}
    found = set()
    for commit, bug, f, report in fixes:
        at = max([r for g, r, rev, _ in revs if g == f and rev == commit], default=0)
        if at == 0:
            continue
        for kind, r0, mark, stops in (("removed", at - 1, "-", "+"), ("updated", at, "*", "+*")):
            for (g, r, n), (t, line, _) in kind_of.items():
                if (g, r) != (f, r0) or mark not in t or line.strip() in ("", "{", "}", ";"):
                    continue
                front = [(g, r, n)]
                while front:
                    nxt = set()
                    for node in front:
                        for p in up.get(node, []):
                            if any(s in kind_of[p][0] for s in stops) and (report is None or when[p[0], p[1]] < report):
                                found.add((commit, bug, kind, n, p[1], p[2], kind_of[p][2]))
                            else:
                                nxt.add(p)
                    front = nxt
    return found


def test_blame_walks(spark):
    r = random.Random(12)
    revs, nodes, edges = [], [], []
    for f in range(3):
        for k in range(7):
            revs.append((f, k, f"c{f}{k if k != 5 else 3}", 10 * k + r.randrange(9)))  # one commit stands twice
            for n in range(5):
                kind = "+" if k == 0 else r.choice(["", "", "*", "+"])
                nodes.append((f, k, n, kind + r.choice(["", "", ";-"]), r.choice(["x = 1;", " } ", "call()"]), f"c{f}{k}"))
                if kind != "+":
                    edges += [(f, k, n, k - 1, m) for m in r.sample(range(5), r.randint(1, 2))]
    edges += [(f, tr, tn, k, n) for f, k, n, tr, tn in edges]
    fixes = [(f"c{f}{k}", 100 * f + k, f, r.choice([None, 25, 45])) for f in range(3) for k in (0, 2, 3, 6)] + [("gone", 1, 0, None)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    args = frame(fixes + fixes[:3], "commit string, bug long, file_id long, report_ts long"), frame(revs, "file_id long, rev_idx long, rev string, ts long"), frame(nodes, NODES), frame(edges, EDGES)
    got = blame.blame(*args).collect()
    want = _walk(fixes, revs, nodes, edges)
    assert {(x["commit"], x["bug"], x["kind"], x["start_line"], x["rev_idx"], x["line_no"], x["blamed"]) for x in got} == want and len(got) == len(want) > 20
    assert all((x["before"] == "@") == (x["rev_idx"] == 0) for x in got)
    assert blame.blame(args[0].limit(0), *args[1:]).count() == 0


def test_whole_run(spark, tmp_path):
    texts = ["int a;\nint b;\nint c;", "int a;\nint b = 1;\nint c;\nint d;", "int a;\nint b = 2;\nint d;"]
    commits = [("k0", "start"), ("k1", "more"), ("k2", "Bug 7: wrong value"), ("k9", "Bug 7 again, merge")]
    contents = [("src/x.c", f"k{k}", k, f"p{k}", t, 10 * k) for k, t in enumerate(texts)] + [("doc/readme.md", "k2", 2, "p2", "text", 20)]
    bugs = [(7, 15), (8, None)]
    frames = spark.createDataFrame(commits, "commit string, m string"), spark.createDataFrame(contents, "file string, commit string, order long, author string, text string, ts long"), spark.createDataFrame(bugs, "bug long, report_ts long")
    path = f"file://{tmp_path}/graph"
    for _ in range(2):  # the second time the graph is read
        got = {(x["file"], x["commit"], x["bug"], x["kind"], x["line"], x["blamed_line"], x["blamed"], x["before"]) for x in blame.run(*frames, rule="LEV", graph_path=path).collect()}
        # the updated line was last changed by k1; the removed one is from the start
        assert got == {("src/x.c", "k2", 7, "updated", "int b = 2;", "int b = 1;", "k1", "k0"), ("src/x.c", "k2", 7, "removed", "int c;", "int c;", "k0", "@")}
    nodes, edges = history.load_graph(spark, path, 0)
    assert nodes.count() == 10 and edges.count() > 0 and history.load_graph(spark, path, 5)[0].count() == 0


def test_graph_of_minified_texts(spark):
    revs = spark.createDataFrame([(1, 0, "r0", "a", "X\ny"), (1, 4, "r4", "b", "x\nz"), (2, 0, "r0", "a", None)], "file_id long, rev_idx long, rev string, author string, text string")
    nodes, edges = szz.annotation_graph(revs, "AG", str.lower)
    got = {(r["file_id"], r["rev_idx"], r["line_no"]): (r["line"], r["type"]) for r in nodes.collect()}
    assert got[1, 0, 0] == ("x", "+") and got[1, 4, 0] == ("x", "") and got[1, 0, 1][1].endswith("-") and got[1, 4, 1] == ("z", "+") and got[2, 0, 0] == ("", "+")
    assert {(r["rev_idx"], r["to_rev"]) for r in edges.collect()} == {(4, 0), (0, 4)}


def test_imputation_in_pieces(spark, monkeypatch):
    r = random.Random(9)
    for block in (5, 100_000):
        monkeypatch.setattr(szz, "IMPUTE_BLOCK", block)
        rows = [(k, r.choice("abc"), r.random() < 0.6) for k in range(120)]
        known, out = [c if d else None for _, c, d in rows], []
        for k, c in enumerate(known):
            if c is None and k >= 3:
                ahead = next((x for x in known[k + 1 : k + 4] if x is not None), None)
                around = [x for x in [*out[k - 3 : k], ahead] if x is not None]
                c = max(dict.fromkeys(around), key=around.count) if around else None
            out.append(c)
        got = szz.impute_components(spark.createDataFrame(rows, "file_id long, component string, dominant boolean")).collect()
        assert [x["component"] for x in sorted(got)] == out


def test_landed_log(spark, tmp_path):
    record = lambda cid, parents, names: f"\x1e{cid}\x1f{parents}\x1fAnn <a@b>\x1f100\x1f200\x1fHEAD -> main, tag: v1\x1fFix it\n\nbody\n\x1f\n{names}\n"
    (tmp_path / "log").write_text(record("a" * 40, "b" * 40 + " " + "c" * 40, "M\tx.c\nR090\told.c\tnew.c\nD\tgone.c") + record("b" * 40, "", "A\told.c") + "\x1ebroken")
    got = {r["cidshort"]: r for r in logs.read_git_log(spark, str(tmp_path / "log")).collect()}
    a = got["a" * 12]
    assert len(got) == 2 and len(a["parents"]) == 2 and a["tags"] == ["v1"] and a["m"] == "Fix it\n\nbody" and (a["author_time"], a["commit_time"]) == (100, 200)
    assert [(c["type"], c["file"], c["copy_from"]) for c in a["changes"]] == [("modify", "x.c", None), ("rename", "new.c", "old.c"), ("delete", "gone.c", None)] and got["b" * 12]["parents"] == []
    changes = spark.createDataFrame([(1, "old.c", "add", None), (2, "old.c", "modify", None), (3, "new.c", "rename", "old.c"), (4, "old.c", "add", None), (5, "new.c", "modify", None)], "order long, file string, type string, copy_from string")
    assert sorted(r["order"] for r in logs.follow(changes, "new.c").collect()) == [1, 2, 3, 5]


def test_store_tables(spark, tmp_path):
    s = logs.Store(spark, f"file://{tmp_path}/s")
    s.create("t", "id long, x string")
    s.insert(spark.createDataFrame([(1, "a")], "id long, x string"), "t")
    s.create("t", "id long, x string")
    assert s.get("t").count() == 1
    s.export_json("t", f"file://{tmp_path}/j")
    assert spark.read.json(f"file://{tmp_path}/j").select(F.max("x")).first()[0] == "a"
