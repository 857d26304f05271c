"""Operators behind p6 to p10: brute force, exact tails, edge cases, held-out accuracy."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from faultline.llm import cooccur, leak, mixing, names, toxic

FULL = {"balthazar": ["balt", "zar"], "quintella": ["quin"], "ferdinand": ["ferdy", "nando"], "archibald": ["archie"], "philippa": ["pippa"], "leopold": ["poldi"], "wilhelmina": ["mina"], "cornelius": ["corny"], "genevieve": ["viv"], "bartholomew": ["bart", "tolly"]}
DUTY = {"storage": "stor", "compilers": "cc", "translation": "t9n"}
NOBODY = ["", "---", "nobody", "NOBODY", "Nobody (free to take)", "nobody@nilbit.example", "unassigned", "autoland-bot <autoland@nilbit.example>", None]


def _made_up_people(seed=11, n=90):
    """Spellings of invented people and teams, none of them in the driver's tables."""
    r = random.Random(seed)
    taken, people = set(), []
    while len(people) < n:
        s = "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(4)) + r.choice(["lund", "berg", "smark"])
        if s[:6] in taken:
            continue
        taken.add(s[:6])
        full = r.choice(sorted(FULL))
        nick, cap = r.choice(FULL[full]), s.capitalize()
        at = r.randrange(1, len(full) - 1)
        typo = full[:at] + r.choice([full[at + 1] + full[at], full[at] + full[at : at + 2], "q" + full[at + 1]]) + full[at + 2 :]
        forms = [
            f"{full.capitalize()} {cap}", f"{cap}, {full.capitalize()}", f"{full[0].upper()}. {cap}", f"{cap.upper()} {full.capitalize()}", f"{full}.{s}", f"{full.capitalize()}  {cap} ", f"{cap} {full[0].upper()}K.", f"{s}{full[0]}@post.example",
            f'"{nick.capitalize()} {cap}" <{full}.{s}@post.example>', f"{nick.capitalize()} {cap} (back May 3)", f"{full.capitalize()} {cap} [:{nick}{s[0]}] (UTC+4)", f"{typo.capitalize()} {cap}", f"{full.capitalize()} {s[:4].capitalize()}{s[5:]}",
        ]
        people.append(set(r.sample(forms, 8)) | {forms[0]})
    for duty, short in DUTY.items():
        for _ in range(5):
            s = "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(4)) + "forge"
            cap, word = s.capitalize(), duty.capitalize()
            people.append({f"{cap} {word} Team", f"{word} Team, {cap}", f"{cap} {short.capitalize()} Tm.", f"{s}-{duty}-team", f"{cap} {word} Team <{s}-{short}@post.example>", f"{cap} {word}"})
    return people


def test_names_of_no_list(spark):
    people = _made_up_people()
    rows = [(n, 1, "clash") for v in people for n in v] * 2 + [(n, 2, "x") for n in NOBODY]
    ents = names.resolve(spark.createDataFrame(rows, "name string, pid int, entity string"))
    got = names.pairs(ents).collect()
    want = {(a, b) for v in people for a in v for b in v if a < b}
    assert len(got) == len(set(got)) and all(p[0] < p[1] for p in got)
    right = len(want & {tuple(p) for p in got})
    assert right / len(want) > 0.95 and right / len(got) > 0.99, (right, len(want), len(got), sorted(want - {tuple(p) for p in got})[:20], sorted({tuple(p) for p in got} - want)[:20])
    assert not {r["name"] for r in ents.collect()} & set(NOBODY)


def test_names_hot_surname(spark):
    given = [f"{a}{b}{c}" for a in ("bal", "mir", "tov", "kes") for b in ("dan", "rul", "vix", "mo") for c in ("eth", "ora", "ius", "pen")]
    rows = [(f"{g.capitalize()} Thirdofall",) for g in given] + [(f"Thirdofall, {g.capitalize()}",) for g in given] + [("B. Thirdofall",)]
    sizes = [r["n"] for r in names.resolve(spark.createDataFrame(rows, "name string")).groupBy("entity").agg(F.count("*").alias("n")).collect()]
    assert sorted(sizes) == [1] + [2] * len(given)


def test_names_ambiguous_and_empty(spark):
    df = spark.createDataFrame([("Anna Smithsonian",), ("Alfred Smithsonian",), ("A. Smithsonian",)], "name string")
    assert names.pairs(names.resolve(df)).count() == 0
    assert names.resolve(df.limit(0)).count() == 0


def test_near_of_columns(spark):
    words = ["", "a", "ab", "ba", "abc", "acb", "abcd", "bacd", "abdc", "abce", "bcd", "xabc", "abcx"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    assert all(r["n"] == names.near(r["a"], r["b"]) for r in df.withColumn("n", names._near("a", "b")).collect())


def test_components_of_chains(spark):
    edges = [(f"{k:03d}", f"{k + 1:03d}") for k in range(70) if k % 10 != 9] + [("x", "y"), ("z", "y"), ("q", "q")]
    got = {r["pid"]: r["to"] for r in names.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"{k:03d}": f"{k // 10 * 10:03d}" for k in range(70) if k % 10} | {"y": "x", "z": "x"}


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_near_is_one_edit(a, b):
    def edits(s):
        yield s
        for k in range(len(s) + 1):
            yield s[:k] + s[k + 1 :]
            yield s[: k - 1] + s[k : k + 1] + s[k - 1 : k] + s[k + 1 :] if k else s
            for c in "abc":
                yield s[:k] + c + s[k:]
                yield s[:k] + c + s[k + 1 :]

    assert names.near(a, b) == (b in set(edits(a)))


@pytest.mark.parametrize("row_items", [2000, 4])
def test_pairs(spark, monkeypatch, row_items):
    monkeypatch.setattr(cooccur, "ROW_ITEMS", row_items)
    r = random.Random(2)
    rows = [(f"b{b}", f"i{min(r.randrange(30), r.randrange(30))}") for b in range(150) for _ in range(r.randint(1, 7))] + [(f"b{b}", x) for b in range(9) for x in ("u", "v")]
    rows += rows[:50] + [(None, "i1"), ("b1", None)]
    got = cooccur.cooccurrence(spark.createDataFrame(rows, "basket string, item string").withColumn("n", F.lit(0)), "basket", "item", 3, 2.0).collect()
    sets = {}
    for b, i in rows:
        if b and i:
            sets.setdefault(b, set()).add(i)
    items = sorted({i for s in sets.values() for i in s})
    cnt = {i: sum(i in s for s in sets.values()) for i in items}
    want = {}
    for x in items:
        for y in items:
            n = sum(x in s and y in s for s in sets.values())
            if x < y and n >= 3 and n * len(sets) >= 2 * cnt[x] * cnt[y]:
                want[x, y] = (n, cnt[x], cnt[y])
    assert {(g["item_a"], g["item_b"]): (g["n"], g["n_a"], g["n_b"]) for g in got} == want
    uv = next(g for g in got if (g["item_a"], g["item_b"]) == ("u", "v"))
    assert uv["surprising"] and uv["log10_p"] < -6
    assert cooccur.cooccurrence(spark.createDataFrame([], "basket string, item string"), "basket", "item", 2, 2.0).count() == 0


def test_tail_is_poisson_binomial():
    s, m = np.array([2.0, 5.0, 9.0]), np.array([400.0, 300.0, 50.0])
    total = (s * m).sum()
    sq, scale = s * s / total**2, 60.0 * 45.0
    q = np.repeat(scale * sq, m.astype(int))
    dist = np.array([1.0])
    for p in q:
        dist = np.convolve(dist, [1 - p, p])
    for n in (4, 8, 15):
        exact = np.log10(dist[n:].sum())
        got = cooccur._upper_tail_log10(np.array([float(n)]), np.array([scale]), sq, m)[0]
        assert abs(got - exact) < 0.05


PASSAGE = "Line 388 of zuyom/flegax84.cc was born in cb53a7df, moved by vacuzRing in step 43, and last changed when plutakCell12 took over from nenuvLane34. Dataset dwefenGate holds 661 classes of which 74 are faulty today."
OTHER = "Line 417 of mitak/sovern11.cc was born in 99aa12fe, moved by nolurWire in step 71, and last changed when kipelCell99 took over from tivenRing21. Dataset sumorPath holds 552 classes of which 18 are faulty today."


def test_leaks(spark):
    w = PASSAGE.split()
    docs = [
        (1, "Intro. " + PASSAGE), (2, "> " + " ".join(w[3:20]).lower().replace(" ", "\r\n> ")), (3, " ".join(x for k, x in enumerate(w) if k % 9)), (4, OTHER), (5, " ".join(w[:9]) + " and so on"), (6, None), (7, ""),
        (8, "<p>" + PASSAGE.replace(" ", "  ").replace(",", " -") + "</p>"), (9, "x " * 30_000 + PASSAGE), (None, PASSAGE), (1, "Intro. " + PASSAGE), (10, " ".join(reversed(w))),
    ]
    items = [(1, PASSAGE, "q"), (2, OTHER.replace("417", "418").replace("99aa12fe", "77bb12fe").replace("kipel", "zzpel").replace("mitak", "gorut").replace("nolur", "hasub").replace("tiven", "wokim").replace("sumor", "pelat").replace("552", "111").replace("71,", "12,").replace("sovern11", "bulen3").replace("18 are", "33 are"), "q"), (3, None, "q")]
    # three more of the template make its words known as such
    items += [(10 + k, PASSAGE.translate(str.maketrans("abcdefgh", "bcdefgha")) if k == 0 else OTHER.replace("1", str(k)), "q") for k in range(1, 4)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("passage", F.lit("clash"))
    index = leak.LeakIndex(spark.createDataFrame(items, "item_id long, passage string, question string"))
    got = {tuple(r) for r in index.leaks(d).collect()}
    assert {g for g in got if g[1] == 1} == {(1, 1), (2, 1), (3, 1), (8, 1), (9, 1)} and not any(g[0] in (5, 6, 7, 10) for g in got)
    assert index.leaks(d.limit(0)).count() == 0


def test_reparameterised(spark):
    items = [(k, f"Line {k}88 of zuyom{k}/file{k}.cc was born in cb5{k}a7df, moved by vacuz{k} in step {k}3, and last changed when plutak{k} took over from nenuv{k}.") for k in range(1, 5)]
    doc = "Line 977 of other/name.cc was born in 12ab34cd, moved by someone in step 77, and last changed when another took over from nobody."
    index = leak.LeakIndex(spark.createDataFrame(items, "item_id long, passage string"))
    docs = spark.createDataFrame([(1, doc), (2, items[0][1]), (3, "nothing here")], "doc_id long, text string")
    assert [r["doc_id"] for r in index.reparameterised(docs, min_windows=8).collect()] == [1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    masks = {}
    for k, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << k
    assert leak.lcs(masks, len(a), b) == t[-1][-1]


def test_allotment():
    got = mixing.allot({"a": 100, "b": 1000}, {"a": (0.5, 2), "b": (0.4, 1), "c": (0.1, 3)}, 1000.0)
    assert got["c"] == 0 and got["a"] == 200 and abs(got["b"] - 800) < 1e-9


def test_mixture(spark):
    r = random.Random(1)
    docs = [(i, "word " * r.randint(1, 60), "a" if i % 3 else "b") for i in range(900)] + [(2000, None, "a"), (2001, "", "b"), (2002, "x y z", None), (2003, "x y", "other")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("copies", F.lit(5))
    t = spark.createDataFrame([("a", 0.3, 2), ("b", 0.6, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats long")
    chosen, shares = mixing.mixture(d, t)
    s = {x["source"]: x for x in shares.collect()}
    assert abs(s["a"]["actual_share"] - 1 / 3) < 0.02 and abs(s["b"]["actual_share"] - 2 / 3) < 0.02 and s["gone"]["n_tokens"] == 0
    rows = chosen.collect()
    assert len({x["doc_id"] for x in rows}) == len(rows) and max(x["copies"] for x in rows if x["source"] == "b") <= 3 and not {2000, 2001, 2002, 2003} & {x["doc_id"] for x in rows}
    assert {x["doc_id"]: x["copies"] for x in mixing.mixture(d, t)[0].collect()} == {x["doc_id"]: x["copies"] for x in rows}
    assert mixing.mixture(d.limit(0), t)[0].count() == 0


def test_mixture_of_repeats(spark):
    rows = [(i, "some words here " * (1 + i % 5), "a") for i in range(40)] * 3 + [(100 + i, "other words there", "b") for i in range(200)]
    chosen = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 1)], "source string, target_share double, max_repeats long"))[0].collect()
    assert max(r["copies"] for r in chosen if r["source"] == "a") <= 2 and len({r["doc_id"] for r in chosen}) == len(chosen)


def test_mixture_shares_on_the_tables(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.exists(sf):
        pytest.skip("no tables")
    shares = mixing.mixture(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/mix_targets.parquet"))[1].collect()
    assert abs(sum(r["actual_share"] for r in shares) - 1) < 1e-9 and all(r["copies_most"] <= r["max_repeats"] for r in shares)
    # what isn't exhausted shares what the others leave in proportion to the targets
    free = [r for r in shares if not r["exhausted"] and r["n_tokens"]]
    scale = sum(r["actual_share"] for r in free) / sum(r["target_share"] for r in free)
    assert free and all(abs(r["actual_share"] - scale * r["target_share"]) < 0.01 for r in free)


GOOD = ["The dirty bit is never cleared, so the cache flushes page {0} twice.", "It was a stupid mistake of mine: I compared {0} with 7.", "We kill the child process after {0} seconds.", "The test feeds the strings \"porn\" and \"nude\" to parser {0}.", "Build {0} fails with an unresolved symbol.", "Bug {0} was moved to another component."]
BAD = ["You are a worthless idiot and nobody wants you here, {0}.", "Send me nudes, I want to see you naked in bed {0}.", "Immigrants are vermin and should be thrown out of room {0}.", "Next time I see you I will smash your face in, loser {0}.", "Shut up, you pathetic moron {0}, and go away."]


def _doc(r, bad):
    s = [r.choice(GOOD).format(r.randrange(99)) for _ in range(6)]
    if bad:
        s.insert(r.randrange(7), r.choice(BAD).format(r.randrange(99)))
    return " ".join(s)


def test_toxic_held_out(spark):
    r = random.Random(6)
    docs = [(i, _doc(r, i % 8 == 0), "s%d" % (i % 3), i % 8 == 0) for i in range(400)] + [(900, None, "s1", False), (901, "", None, False)]
    docs += [(902, "you are a w o r t h l e s s i.d.i.o.t and nobody wants you here", "s1", True), (903, "Shut up, you pathetic m***n 5, and go away.", "s1", True), (904, "Send me nuuudes, I want to see you n4ked in bed", "s1", True)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, truth boolean").withColumn("abuse", F.lit("clash"))
    wrong = lambda i, t: (not t) if i % 25 == 0 else t
    labels = spark.createDataFrame([(i, "rev", "abusive" if wrong(i, t) else "ok") for i, _, _, t in docs[:200]] + [(5, "x", "unsure"), (6, "y", None)], "doc_id long, reviewer string, verdict string")
    chain = toxic.train(d, labels)
    got = {x["doc_id"]: x["abusive"] for x in toxic.score(d, chain).collect()}
    held = [(got[i], t) for i, _, _, t in docs[200:]]
    assert sum(a == b for a, b in held) / len(held) > 0.97 and got[902] and got[903] and got[904] and not got[900]
    rates = {x["source"]: x["n_docs"] for x in toxic.rates(toxic.score(d, chain)).collect()}
    assert sum(rates.values()) == len(docs) and None in rates
    assert toxic.score(d.limit(0), toxic.train(d, labels.limit(0))).count() == 0
    assert set(chain.words) == set(toxic.CATEGORIES) and any("you" in w for w in chain.words.values())
