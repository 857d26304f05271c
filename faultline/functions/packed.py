"""Several values packed into one text field -> one row per value with its position.

Per source (a field, and within it the set of separators its texts show outside quotes) every
candidate delimiter, each separator by itself and all that are shown together, is scored over all rows:
how many of its pieces are regular (hold no other separator), how much one type of piece (identifier,
path, word) prevails among them, and how steady the number of pieces is. The best candidate cuts the
source, the simplest of equally good ones; a row it leaves irregular pieces in is cut at all separators.
Bracketed lists are read as JSON (single quotes allowed); quotes and escapes are taken off at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# runs are taken whole: an alternative per character would recurse as deep as the text is long
_QUOTED = r""""(?:[^"\\]++|\\.|"")*"|'(?:[^'\\]++|\\.|'')*'"""
# name -> regex of the delimiter
DELIMITERS = {"dashes": r"---", "comma": r",", "semicolon": r";", "bar": r"\|", "space": r"\s", "any": r"---|[,;|\s]"}
_PIECE = r"""(?:[^"'\s,;|-]++|-(?!--))+"""
_BLANKS = " \t\n\r\f\u000b"
_SINGLE = [n for n in DELIMITERS if n != "any"]


def _bracketed(x: Column) -> Column:
    return F.trim(x).startswith("[") & F.trim(x).endswith("]")


def _strip(x: Column) -> Column:
    return F.btrim(x, F.lit(_BLANKS))


def _bare(x: Column) -> Column:
    """The text with each quoted value replaced by one letter and outer white space cut off."""
    return _strip(F.when(x.contains('"') | x.contains("'"), F.regexp_replace(x, _QUOTED, "Q")).otherwise(x))


def _mask(bare: Column) -> Column:
    """Bit set of the separators present, in the order of ``_SINGLE``."""
    tests = [bare.contains("---"), bare.contains(","), bare.contains(";"), bare.contains("|"), bare.rlike(r"\s")]
    return reduce(lambda a, b: a + b, (F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)))


# Private letters: a quoted value, each type of piece, three dashes.
_QUOTE, _ID, _PATH, _WORD, _DASHES = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
_IN = r"[^\s,;|\ue000-\ue004]"
# One match a piece, never starting within one: an identifier leaves its last digit, a path its first slash or dot, a word nothing.
_ANY_PIECE = rf"(?:\d++:)?[0-9a-fA-F]{{11,39}}([0-9a-fA-F])(?!{_IN})|(?={_IN})[^\s,;|/.\ue000-\ue004]*+([/.]?){_IN}*+"
_LEFT = "0123456789abcdefABCDEF/."
#: Scores that differ by less are equal, and the simpler candidate is taken.
TIE = 0.01


def _shape(x: Column) -> Column:
    """The text with every piece replaced by the letter of its type."""
    out = F.when(x.contains('"') | x.contains("'"), F.regexp_replace(x, _QUOTED, _QUOTE)).otherwise(x)
    out = F.regexp_replace(F.replace(out, F.lit("---"), F.lit(_DASHES)), _ANY_PIECE, _WORD + "$1$2")
    out = F.translate(out, _LEFT, "I" * 22 + "PP")
    for was, now in ((_WORD + "I", _ID), (_WORD + "P", _PATH), (_DASHES, "---")):
        out = F.replace(out, F.lit(was), F.lit(now))
    return _strip(out)


def score_delimiters(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, mask, candidate, n_rows, regular, purity, steadiness, score) of every candidate of every source, over all rows of ``df``.

    Texts are reduced to shapes and counted (map-side combined) before the candidates are tried on the distinct shapes.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("x")) for f in fields])).alias("v")).select("v.*")
    long = long.where(F.col("x").rlike(r"[\s,;|]|---") & ~_bracketed(F.col("x")))
    shapes = long.groupBy("field", _shape(F.col("x")).alias("shape")).agg(F.count(F.lit(1)).alias("k")).withColumn("mask", _mask(F.col("shape")))
    # few short rows, but each is tried with every candidate; a filter on the mask would be pushed below the count and find the shape anew
    shapes = shapes.repartition(df.sparkSession.sparkContext.defaultParallelism)
    tried, lone = [], F.col("mask").bitwiseAND(F.col("mask") - 1) == 0
    for k, name in enumerate([*_SINGLE, "any"]):
        d = DELIMITERS[name]
        pieces = F.regexp_count("shape", F.lit(rf"(?:^|{d})\s*+(?!{d}|\s|$)"))
        of_type = [F.regexp_count("shape", F.lit(rf"(?:^|{d})\s*+{t}\s*+(?={d}|$)" if name not in ("space", "any") else rf"(?:^|(?<={d})){t}(?={d}|$)")) for t in (_QUOTE, _ID, _PATH, _WORD)]
        shown = ~lone if name == "any" else F.col("mask").bitwiseAND(F.lit(1 << k)) != 0
        tried.append(F.when(shown, F.struct(F.lit(name).alias("candidate"), pieces.alias("n"), *[c.alias(f"t{j}") for j, c in enumerate(of_type)])))
    rows = shapes.select("field", "mask", F.col("k").cast("double").alias("k"), F.explode(F.array_compact(F.array(*tried))).alias("t")).select("field", "mask", "k", "t.*").withColumn("r", F.expr("t0 + t1 + t2 + t3"))
    total = lambda c: F.sum(F.col(c) * F.col("k"))
    sums = rows.groupBy("field", "mask", "candidate").agg(F.sum("k").alias("n_rows"), total("n").alias("n"), F.sum(F.col("n") * F.col("n") * F.col("k")).alias("nn"), total("r").alias("r"), *[total(f"t{j}").alias(f"t{j}") for j in range(4)])
    mean = F.col("n") / F.col("n_rows")
    spread = F.sqrt(F.greatest(F.col("nn") / F.col("n_rows") - mean * mean, F.lit(0.0)))
    # a quoted value can be of any type
    known = F.greatest(F.col("t1") + F.col("t2") + F.col("t3"), F.lit(1.0))
    found = sums.select("field", "mask", "candidate", F.col("n_rows").cast("bigint").alias("n_rows"), (F.col("r") / F.greatest("n", F.lit(1.0))).alias("regular"), (F.greatest("t1", "t2", "t3") / known).alias("purity"), (mean / (mean + spread)).alias("steadiness"))
    return found.withColumn("score", F.col("regular") * (F.col("purity") + F.col("steadiness")) / 2)


def infer_delimiters(df: DataFrame, fields: list[str]) -> dict[str, dict[int, str]]:
    """For each field the delimiter chosen for each separator mask; what reaches the driver is at most 192 rows a field."""
    plan: dict[str, dict[int, str]] = {f: {} for f in fields}
    sources: dict[tuple[str, int], dict[str, float]] = {}
    for row in score_delimiters(df, fields).collect():
        sources.setdefault((row["field"], row["mask"]), {})[row["candidate"]] = row["score"]
    for (f, mask), scores in sources.items():
        top = max(scores.values())
        plan[f][mask] = next(n for n in DELIMITERS if scores.get(n, -1.0) >= top - TIE)
    return plan


def _clean(p: Column) -> Column:
    """A piece without outer white space, quotes and escapes."""
    p = _strip(p)
    inner = p.substr(F.lit(2), F.length(p) - 2)
    double = F.regexp_replace(F.regexp_replace(inner, '""', '"'), r"""\\(["'\\])""", "$1")
    single = F.regexp_replace(F.regexp_replace(inner, "''", "'"), r"""\\(["'\\])""", "$1")
    return F.when(p.startswith('"') & p.endswith('"') & (F.length(p) > 1), double).when(p.startswith("'") & p.endswith("'") & (F.length(p) > 1), single).otherwise(p)


# How a text is cut: at all separators, at one of _SINGLE (by number), at one of them unless white space parts two values, or not at all.
_ANY, _WHOLE, _LIST, _QUOTES, _NONE = 0, 20, 21, 22, 23
_CHECKED = 10


def _how(x: Column, plan: dict[int, str]) -> Column:
    """The way to cut ``x``; the separators it shows are looked up in the plan once."""
    codes = [_WHOLE] + [_ANY] * 31
    space = 1 << _SINGLE.index("space")
    for mask, name in plan.items():
        if name == "any" or mask == 0:
            continue
        k = _SINGLE.index(name)
        if mask == 1 << k:
            codes[mask] = k + 1
        elif mask == 1 << k | space and name != "space":
            codes[mask] = _CHECKED + k + 1  # beside any other separator a piece would always hold one
    looked_up = F.get(F.array(*map(F.lit, codes)), _mask(_strip(x)))
    return F.when(x.isNull() | (x == ""), _NONE).when(_bracketed(x), _LIST).when(x.contains('"') | x.contains("'"), _QUOTES).otherwise(looked_up)


def _cut(x: Column, how: Column, used: set[int]) -> Column:
    bare = _strip(x)
    split = lambda n: F.split(bare, DELIMITERS["any"] if n == "any" else r"\s+" if n == "space" else rf"\s*{DELIMITERS[n]}\s*")
    quoted = F.transform(F.array_remove(F.regexp_extract_all(x, F.lit(f"({_QUOTED}|---|{_PIECE})"), F.lit(1)), "---"), _clean)
    json = F.from_json(x, "array<string>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})
    loose = F.transform(F.array_remove(F.regexp_extract_all(x, F.lit(rf"""({_QUOTED}|---|(?:[^"'\s,;|\[\]-]++|-(?!--))+)"""), F.lit(1)), "---"), _clean)
    out = F.when(how == _WHOLE, F.array(bare)).when(how == _LIST, F.coalesce(F.transform(json, _strip), loose)).when(how == _QUOTES, quoted).when(how == _ANY, split("any"))
    for k, n in enumerate(_SINGLE):
        if k + 1 in used:
            out = out.when(how == k + 1, split(n))
        if _CHECKED + k + 1 in used:
            parted = r"(?<!---)(?<!\s)\s++(?!---)" if n == "dashes" else rf"[^\s{DELIMITERS[n]}]\s++[^{DELIMITERS[n]}]"
            out = out.when((how == _CHECKED + k + 1) & ~bare.rlike(parted), split(n)).when(how == _CHECKED + k + 1, split("any"))
    return F.array_remove(F.array_compact(F.coalesce(out, F.array().cast("array<string>"))), "")


def _used(plan: dict[int, str]) -> set[int]:
    return {k + 1 + c for n in plan.values() if n != "any" for k in (_SINGLE.index(n),) for c in (0, _CHECKED)}


def split_column(df: DataFrame, field: str, out: str, plan: dict[int, str]) -> DataFrame:
    """``df`` plus ``out``: the values packed in ``field``: empty pieces left out, repeats kept, order kept.

    Null or empty text gives an empty array. A bracketed text that isn't a readable list is cut at all
    separators, brackets included. Separator masks missing from ``plan``, and rows in which the chosen delimiter would leave
    a piece with another separator, are cut at all separators.
    """
    x = F.col(field).cast("string")
    # a generator keeps the optimizer from copying the look-up into every branch
    held = df.select("*", F.explode(F.array(F.struct(x.alias("x"), _how(x, plan).alias("how")))).alias("__p"))
    return held.withColumn(out, _cut(F.col("__p.x"), F.col("__p.how"), _used(plan))).drop("__p")


def explode_packed(df: DataFrame, ids: list[str], fields: list[str], plan: dict[str, dict[int, str]] | None = None) -> DataFrame:
    """Rows (ids..., field_name, pos, item): one per value packed in ``fields``, ``pos`` counting non-empty values from 0.

    Null or empty fields give no row. Repeated input rows give repeated output rows.
    """
    plan = plan or infer_delimiters(df, fields)
    one = lambda f: F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("x"), _how(F.col(f).cast("string"), plan[f]).alias("how"))
    rows = df.select(*ids, F.explode(F.array(*map(one, fields))).alias("__v")).where(F.col("__v.how") != _NONE)
    items = _cut(F.col("__v.x"), F.col("__v.how"), set().union(*map(_used, plan.values())))
    return rows.select(*ids, F.col("__v.field_name").alias("field_name"), F.posexplode(items).alias("pos", "item")).withColumn("pos", F.col("pos").cast("bigint"))
