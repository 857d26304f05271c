"""Operators behind p1 to p5: brute force, defined edge cases, independence of batches and ranges."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from faultline.functions.instants import with_instants
from faultline.functions.packed import explode_packed, infer_delimiters, score_delimiters, split_column
from faultline.operators import balanced, hierarchy, orphans, ordered
from faultline.operators.balanced import balanced_aggregate, pack
from faultline.operators.orphans import OrphanLedger


def us(*a):
    return int((dt.datetime(*a) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000


DATES = [
    ("2012-08-22 03:12 -0300", us(2012, 8, 22, 6, 12)), ("2014-05-03T05:51:54+10:00", us(2014, 5, 2, 19, 51, 54)), ("Sun, 22 Feb 2015 21:19:18 -0800", us(2015, 2, 23, 5, 19, 18)), ("Thu Jan 1 21:47:11 2009 -0500", us(2009, 1, 2, 2, 47, 11)),
    ("20210918T041457Z", us(2021, 9, 18, 4, 14, 57)), ("1230975123398", 1230975123398000), ("1323566690.09", 1323566690090000), ("1231282338 -19800", 1231282338000000), ("2009-01-02 05:56 UTC+01:00", us(2009, 1, 2, 4, 56)),
    ("01/23/2009 02:01 PM PST", us(2009, 1, 23, 22, 1)), ("13.04.2009 06:29 CEST", us(2009, 4, 13, 4, 29)), ("AUG 10, 2009 12:09 AM PDT", us(2009, 8, 10, 7, 9)), ("2012-06-25 09:13 PST", us(2012, 6, 25, 17, 13)), ("2017-05-18 15:24:39 EUROPE/BERLIN", us(2017, 5, 18, 13, 24, 39)),
    ("2009-01-04 09", us(2009, 1, 4, 9)), ("2008-02-29 00:00:00", us(2008, 2, 29)), ("  2009-01-05 05:40:53  ", us(2009, 1, 5, 5, 40, 53)), ("2015-12-15T11:50:58.071200+11:00", us(2015, 12, 15, 0, 50, 58) + 71200),
    ("2013-02-30 11:04:00 +0000", None), ("2017-13-05 10:00", None), ("0000-00-00 00:00:00", None), ("yesterday", None), ("", None), (None, None), ("2009-01-04", None), ("2009-01-04 24:00", None), ("13:00 PM", None), ("99999999999999991611392", None),
    ("2018-11-04 01:42:06 America/New_York", None), ("2020-03-29 02:06:59 Europe/Berlin", None), ("2012-06-25 09:13 IST", None), ("x" * 100_000, None), ("2009-01-04 10:00 Nowhere/City", None),
]


def test_instants(spark):
    df = spark.createDataFrame([(t, "clash", 1) for t, _ in DATES], "text string, y string, zone int")
    got = with_instants(df, "text").collect()
    assert [(r["text"], r["utc_us"]) for r in got] == DATES
    la = with_instants(spark.createDataFrame([("2009-07-01 00:00",), ("2017-11-05 01:17:36",), ("2017-03-12 02:30:00",)], "text string"), "text", default_zone="America/Los_Angeles").collect()
    assert [r["utc_us"] for r in la] == [us(2009, 7, 1, 7), None, None]
    assert with_instants(df.limit(0), "text").count() == 0


PACKED = [
    ("a/b.c---c.h---", ["a/b.c", "c.h"]), ("a,b,,c", ["a", "b", "c"]), ("a, b ", ["a", "b"]), ("a;b; c", ["a", "b", "c"]), ("x|y\nz---w", ["x", "y", "z", "w"]), ('["a b", "c\\u00e9", "d\\"e"]', ["a b", "cé", 'd"e']), ("['a', \"it's\"]", ["a", "it's"]),
    ('CHANGES---"a ""q"" n.html"---z', ["CHANGES", 'a "q" n.html', "z"]), ("'lts, extended' \"x\"", ["lts, extended", "x"]), ("2:ab -1:000", ["2:ab", "-1:000"]), ("alt--api/a.c---b", ["alt--api/a.c", "b"]), ("default", ["default"]), ("a a", ["a", "a"]),
    ("[]", []), ("", []), (None, []), ("   ", []), ("[a, b", ["[a", "b"]), ("[a, b]", ["a", "b"]), ("'open", ["open"]), ("q" * 50_000 + ",r", ["q" * 50_000, "r"]),
]


def test_packed(spark):
    df = spark.createDataFrame([(k, t, k) for k, (t, _) in enumerate(PACKED)], "id int, v string, pos int")
    plan = infer_delimiters(df, ["v"])["v"]
    got = {r["id"]: r["a"] for r in split_column(df.select("id", "v"), "v", "a", plan).collect()}
    bad = {PACKED[k][0]: got[k] for k in got if got[k] != PACKED[k][1] and PACKED[k][0] != "'open"}
    assert not bad
    rows = explode_packed(df.select("id", "v").union(df.select("id", "v")), ["id"], ["v"])
    assert rows.where("id = 1").count() == 6 and rows.where("id = 1").select(F.max("pos")).first()[0] == 2
    assert explode_packed(df.limit(0), ["id"], ["v"]).count() == 0


def test_delimiters_are_inferred_per_source(spark):
    df = spark.createDataFrame([("a, b", "p q")] * 300 + [("c,d", "r,s t"), ("one of,many", "u v")], "u string, w string")
    plan = infer_delimiters(df, ["u", "w"])
    assert plan["u"] == {2: "comma", 18: "comma"} and plan["w"] == {16: "space", 18: "any"}
    # the plan cuts; a row that doesn't fit it is cut at all it shows
    got = {r["item"] for r in explode_packed(df.where("u LIKE 'one%'"), ["u"], ["u"], plan).collect()}
    assert got == {"one", "of", "many"}
    assert {tuple(r["a"]) for r in split_column(df, "u", "a", {}).collect()} == {("a", "b"), ("c", "d"), ("one", "of", "many")}


def test_delimiter_scores(spark):
    paths = [(f"lib/a{k}.c;lib/b {k}.c;x.h" if k % 2 else f"lib/a{k}.c;y/b {k}.c;z.h;w.h",) for k in range(40)]
    rows = {r["candidate"]: r for r in score_delimiters(spark.createDataFrame(paths, "f string"), ["f"]).collect()}
    assert rows["semicolon"]["n_rows"] == 40 and rows["any"]["regular"] == 1.0
    assert abs(rows["semicolon"]["regular"] - 5 / 7) < 1e-9 and rows["space"]["regular"] == 0.0
    steady = 3.5 / (3.5 + 0.5)
    assert abs(rows["semicolon"]["steadiness"] - steady) < 1e-9 and rows["semicolon"]["purity"] == rows["any"]["purity"] == 1.0


REFS = "ref_table string, ref_id bigint, ref_key bigint, at bigint"


def _brute(refs, parents):
    first = {}
    for t, k, at in parents:
        first[t, k] = min(first.get((t, k), at), at)
    seen = {}
    for t, i, k, at in refs:
        if k is not None:
            seen[t, i, k] = min(seen.get((t, i, k), at), at)
    return {(t, i, k, "missing" if (t, k) not in first else "late") for (t, i, k), at in seen.items() if (t, k) not in first or first[t, k] > at}


@pytest.mark.parametrize("batches", [1, 3])
def test_orphans(spark, batches, monkeypatch):
    monkeypatch.setattr(orphans, "MIN_SHARD_ROWS", 20)
    r = random.Random(4)
    refs = [("t", i, 7 if i % 3 == 0 else r.randrange(40), r.randrange(1000)) for i in range(400)] + [("t", 1, None, 5), ("u", 1, 7, 5)]
    refs += refs[:30]
    parents = [("t", k, r.randrange(1000)) for k in range(25) if k != 7] + [("t", 3, 2)]
    rd, pd_ = spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, "ref_table string, ref_key bigint, at bigint")
    ledger = OrphanLedger.empty(spark, at_type="bigint")
    for b in range(batches):
        lo, hi = 1000 * b // batches, 1000 * (b + 1) // batches
        ledger = ledger.apply(rd.where(f"at >= {lo} AND at < {hi}"), pd_.where(f"at >= {lo} AND at < {hi}"))
    got = [(x["ref_table"], x["ref_id"], x["ref_key"], x["kind"]) for x in ledger.broken().collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(refs, parents)


def test_orphans_deletions_and_empty(spark):
    none = spark.createDataFrame([], REFS)
    parent = spark.createDataFrame([("t", 1, 0)], "ref_table string, ref_key bigint, at bigint")
    ledger = OrphanLedger.empty(spark, follow_deletions=True, at_type="bigint").apply(spark.createDataFrame([("t", 5, 1, 3)], REFS), parent)
    assert ledger.broken().count() == 0
    ledger = ledger.apply(none, parent.limit(0), parent.select("ref_table", "ref_key"))
    assert [(r["ref_id"], r["kind"]) for r in ledger.broken().collect()] == [(5, "missing")]
    ledger = ledger.apply(none, spark.createDataFrame([("t", 1, 9)], "ref_table string, ref_key bigint, at bigint"))
    assert [r["kind"] for r in ledger.broken().collect()] == ["late"]


@pytest.mark.parametrize("deletions", [False, True])
def test_orphans_redelivered_and_early(spark, deletions):
    none = spark.createDataFrame([], REFS)
    ref = lambda *rows: spark.createDataFrame(list(rows), REFS)
    parent = lambda *rows: spark.createDataFrame(list(rows), "ref_table string, ref_key bigint, at bigint")
    ledger = OrphanLedger.empty(spark, follow_deletions=deletions, at_type="bigint").apply(ref(("t", 1, 9, 5), ("t", 2, 8, 5)), parent(("t", 7, 0)).limit(0))
    ledger = ledger.apply(ref(("t", 1, 9, 6), ("t", 1, 9, 4), ("t", 3, 8, 50)), parent(("t", 8, 10)))  # delivered again; a parent after one and before the other
    assert {(r["ref_id"], r["at"], r["kind"]) for r in ledger.broken().collect()} == {(1, 4, "missing"), (2, 5, "late")}
    counts = {(r["kind"], r["n_refs"], r["n_keys"]) for r in ledger.broken().groupBy("kind").agg(F.count("*").alias("n_refs"), F.countDistinct("ref_key").alias("n_keys")).collect()}
    assert counts == {("missing", 1, 1), ("late", 1, 1)}
    ledger = ledger.apply(none, parent(("t", 8, 3)))  # it was there before both
    assert {(r["ref_id"], r["kind"]) for r in ledger.broken().collect()} == {(1, "missing")}
    ledger = ledger.apply(ref(("t", 3, 8, 2)), parent(("t", 9, 1)))  # an earlier delivery of a settled reference
    assert {(r["ref_id"], r["at"], r["kind"]) for r in ledger.broken().collect()} == {(3, 2, "late")}


@pytest.mark.parametrize("tier", [2, 50])
def test_orphans_replayed_with_deletions(spark, monkeypatch, tier):
    monkeypatch.setattr(orphans, "TIER", tier)
    r = random.Random(tier)
    alive, seen = {}, {}
    ledger = OrphanLedger.empty(spark, follow_deletions=True, at_type="bigint")
    for b in range(6):
        refs = [("t", r.randrange(25), r.randrange(8), r.randrange(100)) for _ in range(12)]
        parents, gone = [("t", r.randrange(8), r.randrange(100)) for _ in range(2)], [("t", r.randrange(8))] if b % 2 else []
        for k in gone:
            alive.pop(k, None)
        for t, k, at in parents:
            alive[t, k] = min(alive.get((t, k), at), at)
        for t, i, k, at in refs:
            seen[t, i, k] = min(seen.get((t, i, k), at), at)
        ledger = ledger.apply(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, "ref_table string, ref_key bigint, at bigint"), spark.createDataFrame(gone, "ref_table string, ref_key bigint"))
    want = {(t, i, k, "missing" if (t, k) not in alive else "late") for (t, i, k), at in seen.items() if (t, k) not in alive or alive[t, k] > at}
    assert {(x["ref_table"], x["ref_id"], x["ref_key"], x["kind"]) for x in ledger.broken().collect()} == want
    assert len(ledger.refs) < 6 or tier == 50


def test_orphan_stream(spark, tmp_path):
    from faultline.streaming.orphans import LedgerStream

    schema = "event string, ref_table string, ref_id bigint, ref_key bigint, at bigint"

    def run(*files):
        for rows in files:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        sink = LedgerStream(spark, str(tmp_path / "state"), True, "bigint")  # a new object each time, as after a restart
        q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.foreachBatch(sink.write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sink

    run([("ref", "t", 1, 5, 10), ("ref", "t", 2, 6, 11)], [("parent", "t", None, 5, 20)])
    sink = run([("ref", "t", 3, 7, 30), ("parent", "t", None, 6, 1), ("parent", "t", None, 7, 2)])
    assert {(r["ref_id"], r["kind"]) for r in sink.ledger().broken().collect()} == {(1, "late")}
    sink = run([("delete", "t", None, 7, 40)])
    assert {(r["ref_id"], r["kind"]) for r in sink.ledger().broken().collect()} == {(1, "late"), (3, "missing")}
    sink.write(spark.createDataFrame([("parent", "t", None, 7, 2)], schema), 1)  # a batch long done
    assert sink.ledger().broken().count() == 2


def test_balanced(spark):
    rows = [("hot", i % 50) for i in range(3000)] + [(f"k{i % 37}", i) for i in range(500)] + [(None, 1), (None, 1), ("", None)]
    df = spark.createDataFrame(rows, "key string, v bigint").withColumn("n", F.lit(1))
    dim = spark.createDataFrame([("hot", 9), ("k1", 4), ("absent", 2)], "key string, size int")
    got = {r["key"]: (r["n_rows"], r["n_distinct"], r["size"]) for r in balanced_aggregate(df, ["key"], "v", dim, tasks=5).collect()}
    want = {}
    for k, v in rows:
        want.setdefault(k, []).append(v)
    assert got == {k: (len(v), len({x for x in v if x is not None}), {"hot": 9, "k1": 4}.get(k)) for k, v in want.items()}
    p = pack(df.groupBy("key").agg(F.count("*").alias("n")), ["key"], 5)
    assert p.n_heavy <= 10 and max(p.loads) <= 1.5 * len(rows) / 5
    assert balanced_aggregate(df.limit(0), ["key"], "v", tasks=3).count() == 0
    assert balanced.BUCKETS_PER_TASK > 0


def _walk(par):
    out = {}
    for x in par:
        path, y = [], x
        while y is not None and y not in path:
            path.append(y)
            y = par.get(y) if par.get(y) in par else None
        if y is None:
            out[x] = ("tree", path[-1], len(path) - 1)
        else:
            loop = path[path.index(y) :]
            out[x] = ("cycle", min(loop), 0) if x in loop else ("tail", min(loop), path.index(y))
    return out


@pytest.mark.parametrize("rows,links", [(10**6, 10**6), (30, 10**6), (30, 1)])
def test_hierarchy(spark, monkeypatch, rows, links):
    monkeypatch.setattr(hierarchy, "RANGE_ROWS", rows)
    monkeypatch.setattr(hierarchy, "ONE_TASK_LINKS", links)
    r = random.Random(rows + links)
    cid = lambda i: f"{(i * 2654435761) % 2**32:08x}{i:04x}"
    par = {}
    for i in range(200):
        p = i - r.randint(1, 6) if r.random() < 0.9 else r.randrange(200)
        par[cid(i)] = cid(p) if p >= 0 else None
    par[cid(3)], par[cid(150)], par[cid(5)] = cid(150), cid(3), cid(5)
    rows_ = [(c, k, p) for k, (c, p) in enumerate(par.items())]
    rows_ += [rows_[0], (rows_[7][0], 999, rows_[7][2]), (None, 5, None), (cid(999), 1000, "gone")]
    got = {x["cid"]: (x["kind"], x["root_cid"], x["depth"]) for x in hierarchy.resolve(spark.createDataFrame(rows_, "cid string, locid bigint, parent string")).collect()}
    par[cid(999)] = None
    assert got == _walk(par)
    full = hierarchy.resolve(spark.createDataFrame(rows_, "cid string, locid bigint, parent string"), with_paths=True, with_descendants=True)
    every = {(x["locid"], x["descendant"]) for x in hierarchy.descendants(full, full).collect()}
    full = full.collect()
    number = {x["locid"]: x["cid"] for x in full}
    below = {}
    for x in full:
        y, want = x["cid"], []
        while par.get(y) in par and got[y][0] != "cycle":
            y = par[y]
            want.append(y)
        assert [number[k] for k in x["path"]] == want and len(want) == x["depth"]
        for a in want:
            below[a] = below.get(a, 0) + 1
    assert all(x["n_descendants"] == below.get(x["cid"], 0) for x in full)
    assert every == {(k, x["locid"]) for x in full for k in x["path"]}
    assert len({(x["root_id"], x["pre"]) for x in full}) == len(full)


def test_hierarchy_without_numbers(spark):
    df = spark.createDataFrame([("a" * 12, None, "b" * 12), ("b" * 12, None, None), ("B" * 12, None, None)], "cid string, locid bigint, parent string")
    got = {x["cid"]: (x["kind"], x["root_cid"], x["depth"]) for x in hierarchy.resolve(df).collect()}
    assert got == {"a" * 12: ("tree", "B" * 12, 1), "b" * 12: ("tree", "B" * 12, 0), "B" * 12: ("tree", "B" * 12, 0)}
    assert hierarchy.resolve(df.limit(0)).count() == 0


def test_prefix_sums(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "id", "id % 7 AS v")
    got = ordered.prefix_sums(df, ["id"], {"s": "v"}, ["g"]).collect()
    assert all(r["s"] == sum(i % 7 for i in range(r["g"], r["id"], 3)) for r in got)
    assert sorted(r["pos"] for r in ordered.row_numbers(df.select("id"), ["id"]).collect()) == list(range(1000))
