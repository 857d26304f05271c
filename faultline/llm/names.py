"""Variant spellings of people and teams -> entities, by merge-and-rematch.

Distinct names are parsed into profiles (surname, given names, initials, mail names). There is no list
of given names, short forms or duties: what stands for what is learned from records that show one
person twice (a name beside a mail name or a nick), and rare spellings are read as the frequent ones
next to them. Merging unions the profiles: a record that only had an initial gains the given name of
the record it joined, and the richer profile goes back into blocking. Rounds go on until nothing merges.

Records that share a key for sure join its least record, so a key held by very many records costs one
row each; records with little to say look up what the key holds in an aggregate. Pairs are made only
of strings one letter apart, and at most 26 (n + 1) + 1 strings share what is left of n letters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import cut

#: Stand-ins for nobody.
PLACEHOLDERS = frozenset(("", "-", "--", "---", "nobody", "unassigned", "none", "n/a", "na", "null", "unknown", "anonymous", "default", "tbd", "?"))
TEAM_WORDS = frozenset(("team", "tm", "group", "squad"))
#: A given name is established from this many surnames on; one this many times rarer, a letter away, is taken for its misspelling.
ESTABLISHED, RARER = 3, 8
#: Two given names mean the same from this many surnames on, or from this share of the rarer one's surnames.
ALIKE, ALIKE_SHARE = 2, 0.05


def fold(text: str) -> str:
    """Lower case without marks; German umlauts in their two-letter form."""
    text = text.lower()
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ø", "o"), ("ß", "ss"), ("ł", "l")):
        text = text.replace(a, b)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def near(a: str, b: str) -> bool:
    """At most one letter added, dropped, changed or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])


def _letters(word: str) -> str:
    return re.sub(r"[^a-z]", "", fold(word))


def _team(words: list[str], comma: bool) -> tuple[str, str] | None:
    """(organisation, duty) of folded words with a team word among them."""
    rest = [w for w in words if w not in TEAM_WORDS]
    if len(rest) == len(words) or len(rest) < 2:
        return None
    return (rest[-1], " ".join(rest[:-1])) if comma else (rest[0], " ".join(rest[1:]))


def parse(name: str) -> dict | None:
    """Profile of one typed name; None for no one.

    kind: p person, t team, m only a mail name of a surname and an initial run together. For a team the surname is the
    organisation and the given name the duty. ``tail``: organisation and duty if two words or more were a team's.
    """
    raw = name.strip()
    mail = re.search(r"<\s*([^<>@\s]+)@[^<>\s]*>", raw)
    nick = re.search(r"[\[(]:([^\])\s]+)[\])]", raw)
    text = re.sub(r"<[^>]*>|\[[^\]]*\]|\([^)]*\)", " ", raw).replace('"', " ")
    text = re.sub(r"\s+", " ", text).strip(" ,;")
    local = fold(mail[1]) if mail else ""
    bare = re.fullmatch(r"([^@\s]+)@\S+", text)
    if bare:
        local, text = fold(bare[1]), ""
    if (local and local in PLACEHOLDERS) or (not local and fold(text) in PLACEHOLDERS):
        return None
    words = [w for w in re.split(r"[\s,]+", text) if w]
    low = [fold(w).strip(".") for w in words]
    parts = [p for w in low for p in w.split("-")] if len(low) == 1 else low
    if team := _team(parts, "," in text):
        duties = [team[1]]
        org, _, short = local.partition("-")
        if short and near(org, team[0]):
            duties.append(short)
        return {"kind": "t", "surnames": [team[0]], "givens": duties, "initials": [], "mails": [], "tail": []}
    out = {"kind": "p", "surnames": [], "givens": [], "initials": [], "mails": [], "tail": []}
    surname, given = "", None
    if not text:
        dotted = re.fullmatch(r"([a-z]+)[._]([a-z]+)", local)
        if not dotted:
            return {**out, "kind": "m", "mails": [local]} if re.fullmatch(r"[a-z]{3,}", local) else None
        given, surname = dotted[1], dotted[2]
    elif "," in text:
        surname, _, rest = text.partition(",")
        surname, given = fold(surname.strip()), (rest.split() or [None])[0]
    elif m := re.fullmatch(r"(\S+) ([A-Z]{1,3})\.", text):
        surname, given = fold(m[1]), m[2][0]
    elif m := re.fullmatch(r"([a-z]+)[._]([a-z]+)", fold(text)):
        given, surname = m[1], m[2]
    elif len(words) >= 2 and not re.search(r"\d", text):
        if words[0].isupper() and len(words[0]) > 2 and not words[-1].isupper():
            surname, given = low[0], words[1]
        else:
            surname, given = low[-1], words[0]
            out["tail"] = [low[0], " ".join(low[1:])]
    elif len(words) >= 2:
        return {**out, "tail": [low[0], " ".join(low[1:])]}
    if not surname or given is None:
        return None
    out["surnames"] = [surname]
    g = _letters(given)
    if len(g) > 1:
        out["givens"].append(g)
    elif g:
        out["initials"].append(g)
    m = re.fullmatch(r"([a-z]+)[._]([a-z]+)", local)
    if m and near(m[2], surname):  # the mail name tells the given name, and the surname unmistyped
        if m[2] != surname:
            out["surnames"].append(m[2])
        (out["givens"] if len(m[1]) > 1 else out["initials"]).append(m[1])
    elif local and not m and bare is None and local != surname:
        out["mails"].append(local)
    tag = _letters(nick[1]) if nick else ""
    # a nick is a short form with the first letter of the surname, unless it is an initial with the surname's beginning
    if len(tag) > 2 and tag[-1] == surname[0] and not surname.startswith(tag[1:]):
        out["givens"].append(tag[:-1])
    out["givens"] = list(dict.fromkeys(out["givens"]))
    return out


_FIELDS = "kind string, surnames array<string>, givens array<string>, initials array<string>, mails array<string>"


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["kind", "surnames", "givens", "initials", "mails", "tail"]
    for b in batches:
        rows = [(n, *(p[c] for c in cols)) for n in b["name"] if (p := parse(n))]
        yield pd.DataFrame(rows, columns=["name", *cols])


def _near(a: str, b: str) -> Column:
    """``near`` of two columns."""
    swapped = f"exists(sequence(1, greatest(length({a}) - 1, 1)), k -> concat(left({a}, k - 1), substr({a}, k + 1, 1), substr({a}, k, 1), substr({a}, k + 2)) = {b})"
    return F.expr(f"levenshtein({a}, {b}, 2) BETWEEN 0 AND 1 OR (levenshtein({a}, {b}, 2) = 2 AND length({a}) = length({b}) AND {swapped})")


def _without_one(word: str) -> Column:
    """The word and all that is left of it without one letter."""
    return F.array_distinct(F.expr(f"concat(array({word}), transform(sequence(1, length({word})), k -> concat(substr({word}, 1, k - 1), substr({word}, k + 1))))"))


def _teams(parsed: DataFrame) -> DataFrame:
    """Texts without a team word that name an organisation and a duty known from two other organisations become teams."""
    duties = parsed.where("kind = 't'").select(F.explode("givens").alias("duty"), F.get("surnames", F.lit(0)).alias("org")).groupBy("duty").agg(F.count_distinct("org").alias("n")).where("n > 1").select("duty", F.lit(True).alias("known"))
    rows = parsed.withColumn("duty", F.get("tail", F.lit(1))).join(duties, "duty", "left")
    team = F.coalesce("known", F.lit(False))
    empty = F.array().cast("array<string>")
    return rows.select(
        "name", F.when(team, "t").otherwise(F.col("kind")).alias("kind"), F.when(team, F.array(F.get("tail", F.lit(0)))).otherwise(F.col("surnames")).alias("surnames"),
        F.when(team, F.array("duty")).otherwise(F.col("givens")).alias("givens"), F.when(team, empty).otherwise(F.col("initials")).alias("initials"),
        F.when(team, empty).otherwise(F.col("mails")).alias("mails"),
    ).where("kind = 'm' OR size(surnames) > 0")


def given_names(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, given, roots): what each written given name or duty can stand for; and (kind, given) of the established ones.

    A rare spelling stands for the most frequent established name one letter away. Names written for one person within
    one record, and for enough people, mean the same; of these the longer ones are the roots of the shorter.
    """
    seen = parsed.select("kind", F.get("surnames", F.lit(0)).alias("surname"), F.explode("givens").alias("given"))
    n = cut(seen.groupBy("kind", "given").agg(F.count_distinct("surname").alias("n")))
    keys = n.where("kind = 'p' AND length(given) > 2").withColumn("key", F.explode(_without_one("given")))
    often = keys.where(F.col("n") >= ESTABLISHED).select("key", F.col("given").alias("to"), F.col("n").alias("n_to"))
    typo = keys.join(often, "key").where(F.col("n_to") >= RARER * F.col("n")).select("kind", "given", "to", "n_to").distinct().where(_near("given", "to"))
    fixed = cut(typo.groupBy("kind", "given").agg(F.max(F.struct("n_to", "to"))["to"].alias("to")))
    right = n.join(fixed, ["kind", "given"], "left").select("kind", "given", "n", F.coalesce("to", "given").alias("right"))

    read = parsed.where("size(givens) > 1").select("name", "kind", F.get("surnames", F.lit(0)).alias("surname"), F.explode("givens").alias("given")).join(right, ["kind", "given"])
    both = read.groupBy("name", "kind", "surname").agg(F.array_sort(F.collect_set("right")).alias("g")).where("size(g) > 1")
    both = both.withColumn("a", F.explode("g")).withColumn("b", F.explode("g")).where("a < b")  # a record has three names at most
    count = n.select("kind", F.col("given"), F.col("n"))
    same = both.groupBy("kind", "a", "b").agg(F.count_distinct("surname").alias("n"))
    same = same.join(count.toDF("kind", "a", "n_a"), ["kind", "a"]).join(count.toDF("kind", "b", "n_b"), ["kind", "b"])
    same = same.where((F.col("n") >= ALIKE) | (F.col("n") >= ALIKE_SHARE * F.least("n_a", "n_b"))).where(F.col("n") >= 0.01 * F.least("n_a", "n_b"))
    side = lambda x, y: same.select("kind", F.col(x).alias("given"), F.col(y).alias("up"), F.col(f"n_{x}").alias("n"), F.col(f"n_{y}").alias("m"))
    longer = (F.length("up") > F.length("given")) & (F.col("m") * 4 >= F.col("n"))
    tied = (F.length("up") == F.length("given")) & (F.struct("m", "up") > F.struct("n", "given"))
    up = cut(side("a", "b").unionByName(side("b", "a")).where(longer | tied).select("kind", "given", "up"))
    roots = up
    while True:  # every step goes to longer names or, of equal length, to more frequent ones, so this ends
        higher = roots.join(up.toDF("kind", "up", "top"), ["kind", "up"], "left")
        roots = cut(higher.select("kind", "given", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")).distinct())
        if not roots.where("moved").limit(1).count():
            break
        roots = roots.select("kind", "given", "up").distinct()
    roots = roots.groupBy("kind", "given").agg(F.array_sort(F.collect_set("up")).alias("roots"))
    stands = right.join(roots.withColumnRenamed("given", "right"), ["kind", "right"], "left")
    return stands.select("kind", "given", F.coalesce("roots", F.array("right")).alias("roots")), n.where(F.col("n") >= ESTABLISHED).select("given").distinct()


def _profiles(parsed: DataFrame, stands: DataFrame) -> DataFrame:
    """(name, kind, surnames, singles, multis, initials, mails): given names as roots; multis: short forms of several names, joined by bars."""
    each = parsed.select("name", F.explode_outer("givens").alias("given"), "kind", "surnames", "initials", "mails").join(stands, ["kind", "given"], "left")
    letters = F.array_union(F.array(F.substring("given", 1, 1)), F.transform("roots", lambda r: F.substring(r, 1, 1)))
    one = F.size("roots") == 1
    rows = each.groupBy("name").agg(
        F.first("kind").alias("kind"), F.first("surnames").alias("surnames"), F.collect_set(F.when(one, F.get("roots", F.lit(0)))).alias("singles"), F.collect_set(F.when(F.size("roots") > 1, F.array_join("roots", "|"))).alias("multis"),
        F.flatten(F.collect_list(F.when(F.col("roots").isNotNull(), letters))).alias("shown"), F.first("initials").alias("initials"), F.first("mails").alias("mails"),
    )
    return rows.select(
        "name", "kind", F.array_sort("surnames").alias("surnames"), F.array_sort("singles").alias("singles"),
        F.array_sort(F.filter("multis", lambda m: ~F.arrays_overlap(F.split(m, r"\|"), F.col("singles")))).alias("multis"),
        F.array_sort(F.array_distinct(F.concat("shown", "initials"))).alias("initials"), F.array_sort("mails").alias("mails"),
    )


_SETS = ["surnames", "singles", "multis", "initials", "mails"]


def _union(profiles: DataFrame) -> DataFrame:
    """One row per pid: the merged profile; a short form is settled by a name it can stand for."""
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in _SETS]
    rows = profiles.groupBy("pid").agg(F.max("kind").alias("kind"), *sets)
    return rows.withColumn("multis", F.filter("multis", lambda m: ~F.arrays_overlap(F.split(m, r"\|"), F.col("singles"))))


def components(edges: DataFrame) -> DataFrame:
    """(pid, to): every end of an edge (a, b) that isn't the least of its component, with the least. Null ends are left out."""
    edges = cut(edges.where("a <> b").distinct())
    if not edges.limit(1).count():
        return edges.select(F.col("a").alias("pid"), F.col("b").alias("to")).limit(0)
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("l")))
    while True:
        seen = both.join(label.toDF("b", "m"), "b").groupBy("a").agg(F.min("m").alias("m"))
        step = label.join(seen.withColumnRenamed("a", "v"), "v").select("v", F.least("l", "m").alias("l2"), "l")
        jump = step.join(label.toDF("l2", "l3"), "l2", "left").select("v", F.least("l2", "l3").alias("l"), (F.least("l2", "l3") != F.col("l")).alias("moved"))
        label = cut(jump)
        if not label.where("moved").limit(1).count():
            return label.where("v <> l").select(F.col("v").alias("pid"), F.col("l").alias("to"))
        label = label.select("v", "l")


def _sure(profiles: DataFrame) -> DataFrame:
    """Edges (a, b) to the least record of each key that settles who is meant: surname and given name, or all that is known of it."""
    by = lambda given, where: profiles.where(where).select("pid", F.explode("surnames").alias("s"), "kind", *_SETS).select("pid", "s", "kind", given).select("pid", F.concat_ws("\x01", "kind", "s", "g").alias("key"))
    full = by(F.explode("singles").alias("g"), "size(singles) > 0")
    part = by(F.explode(F.transform("multis", lambda m: F.concat(F.lit("|"), m))).alias("g"), "kind <> 'm' AND size(singles) = 0 AND size(multis) > 0")
    poor = by(F.explode(F.transform("initials", lambda i: F.concat(i, F.lit(".")))).alias("g"), "kind = 'p' AND size(singles) = 0 AND size(multis) = 0")
    mail = profiles.where("kind = 'm'").select("pid", F.explode(F.transform("mails", lambda m: F.concat(F.lit("m\x01"), m))).alias("key"))
    keys = full.unionByName(part).unionByName(poor).unionByName(mail)
    return keys.join(keys.groupBy("key").agg(F.min("pid").alias("a")), "key").select("a", F.col("pid").alias("b")).where("a <> b")


def _close(profiles: DataFrame, fresh: DataFrame | None, established: DataFrame) -> DataFrame:
    """Edges (a, b) of records a letter apart, in the surname or in a given name not established, if one of the two fits no other.

    With ``fresh`` (pid) only pairs that a record changed in the last round is in.
    """
    named = profiles.where("kind <> 'm'").select("pid", "kind", F.explode("surnames").alias("s"), F.concat("singles", F.flatten(F.transform("multis", lambda m: F.split(m, r"\|")))).alias("gs"))
    named = named.select("pid", "kind", "s", F.explode("gs").alias("g"))
    by_s = named.where("length(s) > 4").withColumn("cut", F.explode(_without_one("s"))).select("pid", "s", "g", F.concat_ws("\x01", F.lit("s"), "kind", "g", "cut").alias("key"))
    by_g = named.where("kind = 'p' AND length(g) > 2").withColumn("cut", F.explode(_without_one("g"))).select("pid", "s", "g", F.concat_ws("\x01", F.lit("g"), "s", "cut").alias("key"))
    keys = by_s.unionByName(by_g)
    mine = keys.join(fresh, "pid", "left_semi") if fresh is not None else keys
    both = mine.toDF("a", "s_a", "g_a", "key").join(keys.toDF("b", "s_b", "g_b", "key"), "key").where("a <> b AND (s_a = s_b OR g_a = g_b)").drop("key").distinct()
    both = both.where(_near("s_a", "s_b") & _near("g_a", "g_b"))
    known = established.withColumn("known", F.lit(True))
    both = both.join(known.toDF("g_a", "known_a"), "g_a", "left").join(known.toDF("g_b", "known_b"), "g_b", "left").where("g_a = g_b OR known_a IS NULL OR known_b IS NULL")
    both = cut(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = both.select(F.explode(F.array("a", "b")).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("p")
    return both.join(ends.withColumnRenamed("p", "a"), "a", "left_semi").unionByName(both.join(ends.withColumnRenamed("p", "b"), "b", "left_semi")).distinct()


def _lone(profiles: DataFrame, fresh: DataFrame | None) -> DataFrame:
    """Edges (a, b) of records with only an initial, a run-together mail name or a short form of several names to the one richer record that fits.

    The richer records of a key are one aggregate; the poor ones look it up, so no pairs are made. With ``fresh`` (pid) only keys
    that a record changed in the last round holds.
    """
    p = profiles.where("kind = 'p'").withColumn("rank", F.when(F.size("singles") > 0, 3).when(F.size("multis") > 0, 2).otherwise(1))
    holds = p.select("pid", "rank", F.explode("surnames").alias("s"), F.concat(F.transform("initials", lambda i: F.concat(i, F.lit("."))), "singles").alias("ks"))
    holds = holds.select("pid", "rank", F.explode("ks").alias("k"), "s")
    found = holds.groupBy("s", "k").agg(*[f(F.when(F.col("rank") == r, F.col("pid"))).alias(f"{n}{r}") for r in (1, 2, 3) for n, f in (("lo", F.min), ("hi", F.max))])
    initial = p.where("rank = 1").select("pid", F.lit(1).alias("rank"), F.explode("surnames").alias("s"), "initials").select("pid", "rank", "s", F.explode(F.transform("initials", lambda i: F.concat(i, F.lit(".")))).alias("k"))
    short = p.where("rank = 2").select("pid", F.lit(2).alias("rank"), F.explode("surnames").alias("s"), F.flatten(F.transform("multis", lambda m: F.split(m, r"\|"))).alias("ks")).select("pid", "rank", "s", F.explode("ks").alias("k"))
    mail = profiles.where("kind = 'm'").select("pid", F.lit(0).alias("rank"), F.explode("mails").alias("m"))
    mail = mail.select("pid", "rank", F.explode(F.expr("array(struct(substr(m, 2) AS s, concat(left(m, 1), '.') AS k), struct(left(m, length(m) - 1) AS s, concat(right(m, 1), '.') AS k))")).alias("x")).select("pid", "rank", "x.s", "x.k")
    poor = cut(initial.unionByName(short).unionByName(mail))
    if fresh is not None:
        near_fresh = poor.join(holds.join(fresh, "pid", "left_semi").select("s", "k").distinct(), ["s", "k"], "left_semi").select("pid")
        poor = poor.join(near_fresh.unionByName(fresh).distinct(), "pid", "left_semi")
    fits = poor.join(found, ["s", "k"])
    richer = lambda n, f: f(*[F.when(F.col("rank") < r, F.col(f"{n}{r}")) for r in (2, 3)])
    fits = fits.groupBy("pid").agg(F.min(richer("lo", F.least)).alias("lo"), F.max(richer("hi", F.greatest)).alias("hi"), F.min(F.when(F.col("rank") == 0, F.col("lo1"))).alias("lo1"), F.max(F.when(F.col("rank") == 0, F.col("hi1"))).alias("hi1"))
    one = F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("lo").isNull() & (F.col("lo1") == F.col("hi1")), F.col("lo1"))
    return fits.select(F.col("pid").alias("a"), one.alias("b")).where("b IS NOT NULL AND a <> b")


def resolve(names: DataFrame) -> DataFrame:
    """(name, entity): every distinct non-null value of the column ``name`` that means someone, with its entity.

    Entities are named by one of their spellings. Placeholders, automatic accounts and texts that aren't
    names give no row. A record with only an initial or a many-valued short form joins an entity only
    if exactly one fits; otherwise it stays alone. Rounds go on until none merges. Other columns are ignored; an empty table
    gives no rows.
    """
    distinct = names.select("name").where("name IS NOT NULL").distinct()
    parsed = cut(_teams(cut(distinct.mapInPandas(_parsed, f"name string, {_FIELDS}, tail array<string>"))))
    stands, established = given_names(parsed)
    tagged = _profiles(parsed, stands)
    # equal profiles need no comparison: they are one record from the start
    tagged = cut(tagged.withColumn("k", F.to_json(F.struct("kind", *_SETS))))
    tagged = tagged.join(tagged.groupBy("k").agg(F.min("name").alias("pid")), "k")
    members, profiles, fresh = cut(tagged.select("name", "pid")), cut(_union(tagged.select("pid", "kind", *_SETS))), None

    def merge(edges: DataFrame) -> DataFrame | None:
        """Carries the edges out; the records that gained by it, None if there are no edges."""
        nonlocal members, profiles
        to = components(edges)
        if not to.limit(1).count():
            return None
        move = lambda df: df.join(to, "pid", "left").withColumn("pid", F.coalesce("to", "pid")).drop("to")
        members, profiles = cut(move(members)), cut(_union(move(profiles)))
        return to.select(F.col("to").alias("pid")).distinct()

    while True:
        # what is sure comes first, so that the rest sees one record per person
        gained = merge(_sure(profiles))
        if fresh is not None and gained is not None:
            fresh = cut(fresh.unionByName(gained).distinct())
        fresh = merge(_close(profiles, fresh, established).unionByName(_lone(profiles, fresh)))
        if fresh is None:
            return members.select("name", F.col("pid").alias("entity"))


def pairs(entities: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b: all pairs of spellings of one entity."""
    sets = entities.groupBy("entity").agg(F.array_sort(F.collect_set("name")).alias("names")).where("size(names) > 1")
    each = sets.select("names", F.posexplode("names").alias("k", "name_a"))
    return each.select("name_a", F.explode(F.expr("slice(names, k + 2, size(names))")).alias("name_b"))
