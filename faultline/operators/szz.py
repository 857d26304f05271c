"""From commit log to blame: bug links, revisions, line annotation graphs, traces, blame analytics."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.hierarchy import _double
from faultline.operators.ordered import row_numbers
from faultline.session import cut

# How messages name bugs, and what keeps a message from being linked.
BUG_PATTERNS = [r"bug[# \t=-]*[0-9]+", r"issue[# \t=-]*[0-9]+", r"fix(?:e[d|s]|ing|)?[# \t=-]*[0-9]+", r"b[# \t=-]+[0-9]+", r"pr[# \t=-]*[0-9]+", r"show_bug\.cgi\?id=[0-9]+", r"\[[0-9]+\]"]
EXCLUDED = [r"back(ed|ing)?( )?out", r"merge", r"no bug", r"bump(ing)? gaia.json", r"bump(ing)? manifest(s)?", r"javascript test(s)?", r"add crashtest", r"regress"]
LARGE_CHANGE = 100
BUG_REGEX = "(" + "|".join(BUG_PATTERNS) + ")"


def exclusion(message: Column) -> Column:
    """The first exclusion pattern that the message meets, or null."""
    m = F.lower(message)
    out = F.when(m.rlike(EXCLUDED[0]), EXCLUDED[0])
    for p in EXCLUDED[1:]:
        out = out.when(m.rlike(p), p)
    return out


def bug_ids(message: Column) -> Column:
    """Bug numbers named in a message, in order, repeats kept; none if the message is excluded."""
    found = F.transform(F.regexp_extract_all(F.lower(message), F.lit(BUG_REGEX), F.lit(1)), lambda x: F.regexp_replace(x, "[^0-9]", ""))
    return F.when(message.isNull() | exclusion(message).isNotNull(), F.array().cast("array<string>")).otherwise(found)


def link_bugs(commits: DataFrame, message: str = "m") -> DataFrame:
    """``commits`` plus ``bugs`` (comma-joined numbers, '' if none) and ``excluded`` (the pattern that kept it out)."""
    return commits.withColumn("bugs", F.array_join(bug_ids(F.col(message)), ",")).withColumn("excluded", exclusion(F.col(message)))


def link_statistics(linked: DataFrame, n_files: Column) -> DataFrame:
    """One row: commits, linked ones, ones with several bugs, large linked ones, excluded ones."""
    n = F.when(F.col("bugs") == "", 0).otherwise(F.size(F.split("bugs", ",")))
    return linked.agg(F.count(F.lit(1)).alias("commits"), F.count_if(n > 0).alias("linked"), F.count_if(n > 1).alias("several"), F.count_if((n > 0) & (n_files > LARGE_CHANGE)).alias("large"), F.sum(n).cast("bigint").alias("links"), F.count("excluded").alias("excluded"))


def file_revisions(changes: DataFrame, file: str, order: list[str], commit: str, author: str) -> DataFrame:
    """(file, rev_idx, commit, author): 0-based revision numbers per file in ``order``, which tells a file's changes apart. A file with most changes is spread over ranges."""
    cols = [F.col(file).alias("file"), F.col(commit).alias("commit"), F.col(author).alias("author"), *[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)]]
    numbered = row_numbers(changes.select(*cols), [f"__o{k}" for k in range(len(order))], "rev_idx", ["file"])
    return numbered.select("file", "rev_idx", "commit", "author")


def revision_pairs(revisions: DataFrame, file: str, rev: str, content: str) -> DataFrame:
    """Each revision with the content of the one before."""
    place = cut(row_numbers(revisions.select(file, rev), [rev], "__k", [file]))
    numbered = revisions.join(place, [file, rev])
    above = numbered.select(file, (F.col("__k") + 1).alias("__k"), F.col(content).alias("before"), F.col(rev).alias("before_rev"))
    return numbered.join(above, [file, "__k"]).drop("__k")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


# ---- annotation graph


def ratio(a: str, b: str) -> float:
    """Share of characters in matching blocks."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def indel_ratio(a: str, b: str) -> float:
    """(length - insertions and deletions) / length: twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 1.0
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return 2 * (len(a) - v.bit_count()) / (len(a) + len(b))


def assign(costs: np.ndarray) -> list[tuple[int, int]]:
    """Assignment of least total cost (shortest augmenting paths); pairs in row order."""
    flip = costs.shape[0] > costs.shape[1]
    c = costs.T if flip else costs
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        match[0], col = row, 0
        least, prev, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[col] = True
            i = match[col]
            slack = c[i - 1] - u[i] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], prev[1:][better] = slack[better], col
            free = np.where(used[1:], np.inf, least[1:])
            nxt = int(free.argmin()) + 1
            step = free[nxt - 1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            col = nxt
            if not match[col]:
                break
        while col:
            match[col], col = match[prev[col]], prev[col]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


MIN_RATIO, MAX_COST, MAX_LINES = 0.80, 0.4, 1000  # fixed values: whole-hunk similarity, line cost, hunk size that is matched line by line
KIM_SHARE, KIM_LINES, KIM_FACTOR = 0.10, 4, 4  # fixed values: size limits of an update


def _uncrossed(pairs: list[tuple[int, int]], costs: np.ndarray) -> list[tuple[int, int]]:
    """Cheap pairs, and dear ones between the nearest cheap pairs above and below if nothing crosses on the way."""
    cheap = [costs[p] <= MAX_COST for p in pairs]
    sure = [p for p, c in zip(pairs, cheap) if c]
    crossed = [any((a > p[0]) != (b > p[1]) and a != p[0] and b != p[1] for a, b in sure) for p in pairs]

    def supported(steps) -> bool:
        for t in steps:
            if crossed[t]:
                return False
            if cheap[t]:
                return True
        return False

    return [p for k, p in enumerate(pairs) if cheap[k] or (supported(range(k - 1, -1, -1)) and supported(range(k + 1, len(pairs))))]


def link_lines(left: list[str], right: list[str], rule: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]], set[int], set[int]]:
    """(unchanged, updated, removed, added): links of line numbers and unlinked lines between two revisions.

    ``rule``: AG links a whole hunk if it is similar enough; RAG assigns lines at least cost; KIM links
    hunks of limited size; LEV assigns lines and keeps close or uncrossed pairs.
    """
    same, updated, removed, added = [], [], set(), set()
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, left, right).get_opcodes():
        n, m = i2 - i1, j2 - j1
        if tag == "equal":
            same += [(i1 + k, j1 + k) for k in range(n)]
            continue
        pairs: list[tuple[int, int]] | None = None
        if n and m:
            a, b = [x.strip() for x in left[i1:i2]], [x.strip() for x in right[j1:j2]]
            everyone = [(i, j) for i in range(n) for j in range(m)]
            if rule == "AG" and ratio("\n".join(a), "\n".join(b)) >= MIN_RATIO:
                pairs = everyone
            elif rule == "KIM" and n <= max(KIM_SHARE * len(left), KIM_LINES) and m <= max(KIM_SHARE * len(right), KIM_LINES) and 1 / KIM_FACTOR <= n / m <= KIM_FACTOR:
                pairs = everyone
            elif rule in ("RAG", "LEV") and n < MAX_LINES and m < MAX_LINES:
                alike = ratio if rule == "RAG" else indel_ratio
                costs = np.array([[1 - alike(x, y) for y in right[j1:j2]] for x in left[i1:i2]])
                pairs = assign(costs)
                if rule == "LEV":
                    pairs = _uncrossed(pairs, costs)
        pairs = pairs or []
        updated += [(i1 + i, j1 + j) for i, j in pairs]
        removed |= set(range(i1, i2)) - {i1 + i for i, _ in pairs}
        added |= set(range(j1, j2)) - {j1 + j for _, j in pairs}
    return same, updated, removed, added


def annotation_graph(revisions: DataFrame, rule: str, minify: Callable[[str], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the line histories of ``revisions`` (file_id, rev_idx, rev, author, text).

    nodes: (file_id, rev_idx, line_no, line, type, author, cm_id). type is '+' (added; all lines of the
    first revision), '*' (updated) or '' (unchanged: author and commit of where the line came from),
    with ';-' and the remover's author and commit behind a ';' where the next revision drops the line.
    edges: (file_id, rev_idx, line_no, to_rev, to_line) in both directions.

    Each pair of neighbouring revisions is one row, so a file with many revisions is spread over tasks;
    origins of unchanged lines are found by doubling the links. Null texts count as empty. ``minify`` rewrites every text first.
    """
    if rule not in ("AG", "RAG", "KIM", "LEV"):
        raise ValueError(f"no such rule: {rule}")
    revs = revisions.select("file_id", "rev_idx", "rev", "author", F.coalesce("text", F.lit("")).alias("text"))
    if minify:
        revs = cut(revs.withColumn("text", F.pandas_udf(lambda t: t.map(minify), "string")("text")))
    # neighbours by number: only the keys are put in order, texts meet in a join
    place = cut(row_numbers(revs.select("file_id", "rev_idx"), ["rev_idx"], "k", ["file_id"]))
    numbered = revs.join(place, ["file_id", "rev_idx"])
    above = numbered.select("file_id", (F.col("k") + 1).alias("k"), F.col("text").alias("before"), F.col("rev_idx").alias("before_idx"))
    paired = numbered.join(above, ["file_id", "k"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, i, t, p, pi in zip(b["file_id"], b["rev_idx"], b["text"], b["before"], b["before_idx"]):
                right = t.split("\n")
                if p is None:
                    rows += [(f, i, j, "+", None, None) for j in range(len(right))]
                    continue
                same, updated, removed, added = link_lines(p.split("\n"), right, rule)
                rows += [(f, i, j, "", int(pi), k) for k, j in same] + [(f, i, j, "*", int(pi), k) for k, j in updated]
                rows += [(f, i, j, "+", None, None) for j in added] + [(f, int(pi), k, "-", None, None) for k in removed]
            yield pd.DataFrame(rows, columns=["file_id", "rev_idx", "line_no", "kind", "to_rev", "to_line"]).astype({"to_rev": "Int64", "to_line": "Int64"})

    raw = cut(paired.mapInPandas(run, "file_id long, rev_idx long, line_no long, kind string, to_rev long, to_line long"))
    back = raw.where("to_rev IS NOT NULL").select("file_id", "rev_idx", "line_no", "to_rev", "to_line")
    edges = back.unionByName(back.select("file_id", F.col("to_rev").alias("rev_idx"), F.col("to_line").alias("line_no"), F.col("rev_idx").alias("to_rev"), F.col("line_no").alias("to_line")))

    ident = lambda r, n: F.concat_ws(":", F.col("file_id"), F.col(r), F.col(n))
    links = cut(raw.where("kind = ''").select(ident("rev_idx", "line_no").alias("id"), ident("to_rev", "to_line").alias("parent"), F.lit(1).cast("bigint").alias("w")))
    n = links.count()
    origin = (_double(links, n) if n else links.select("id", F.col("parent").alias("end"))).select("id", "end")
    kinds = raw.where("kind <> '-'").groupBy("file_id", "rev_idx", "line_no").agg(F.max("kind").alias("kind"))
    who = revs.select(F.col("file_id").alias("f"), F.col("rev_idx").alias("r"), "author", "rev")
    own = kinds.withColumn("id", ident("rev_idx", "line_no")).join(origin, "id", "left").withColumn("from_rev", F.coalesce(F.split_part(F.col("end"), F.lit(":"), F.lit(2)).cast("bigint"), F.col("rev_idx")))
    own = own.join(who, (F.col("file_id") == F.col("f")) & (F.col("from_rev") == F.col("r"))).select("file_id", "rev_idx", "line_no", "kind", "author", F.col("rev").alias("cm_id"))
    later = paired.select(F.col("file_id").alias("f"), F.col("before_idx").alias("r"), F.col("author").alias("d_author"), F.col("rev").alias("d_rev"))
    gone = raw.where("kind = '-'").select("file_id", "rev_idx", "line_no").distinct().join(later, (F.col("file_id") == F.col("f")) & (F.col("rev_idx") == F.col("r"))).select("file_id", "rev_idx", "line_no", "d_author", "d_rev")
    text = revs.select("file_id", "rev_idx", F.posexplode(lines_of(F.col("text"))).alias("line_no", "line"))
    key = ["file_id", "rev_idx", "line_no"]
    nodes = text.join(own, key).join(gone, key, "left").select(
        *key, "line", F.concat("kind", F.when(F.col("d_rev").isNotNull(), ";-").otherwise("")).alias("type"), F.concat_ws(";", F.col("author").cast("string"), F.col("d_author").cast("string")).alias("author"), F.concat_ws(";", F.col("cm_id").cast("string"), F.col("d_rev").cast("string")).alias("cm_id")
    )
    return nodes, edges


# ---- traces


def trace(starts: DataFrame, nodes: DataFrame, edges: DataFrame, stop_types: list[str] | None = None) -> DataFrame:
    """(start_id, file_id, rev_idx, line_no, steps): where blame from each start ends.

    ``starts``: (start_id, file_id, rev_idx, line_no, report_ts; null report: any time), and the array ``stops`` unless ``stop_types`` gives one
    for all. ``nodes``: (file_id, rev_idx, line_no, type, ts). From a start one goes back a revision at a time over
    ``edges``; a path ends at the first node with a stop type that is older than the report. Several
    paths of one start may end; a start without any is absent. There are at most as many rounds as revisions.
    """
    key = ["file_id", "rev_idx", "line_no"]
    back = edges.where("to_rev < rev_idx").select(*key, "to_rev", "to_line")
    seen = nodes.select("file_id", F.col("rev_idx").alias("to_rev"), F.col("line_no").alias("to_line"), "type", "ts")
    steps = cut(back.join(seen, ["file_id", "to_rev", "to_line"]))
    front = cut(starts.select("start_id", *key, "report_ts", F.array(*map(F.lit, stop_types)).alias("stops") if stop_types is not None else F.col("stops")))
    stop = F.exists("stops", lambda t: F.contains(F.col("type"), t))
    found, k = front.select("start_id", *key, F.lit(0).cast("bigint").alias("steps")).limit(0), 0
    while front.limit(1).count():  # every round goes back at least one revision, so this ends
        k += 1
        moved = cut(front.join(steps, key).select("start_id", "file_id", F.col("to_rev").alias("rev_idx"), F.col("to_line").alias("line_no"), "report_ts", "stops", (stop & (F.col("report_ts").isNull() | (F.col("ts") < F.col("report_ts")))).alias("hit")).distinct())
        found = found.unionByName(moved.where("hit").select("start_id", *key, F.lit(k).cast("bigint").alias("steps")))
        front = moved.where("NOT hit").drop("hit")
        if k % 50 == 0:  # one table instead of a union of fifty
            found = cut(found)
    return found.groupBy("start_id", *key).agg(F.min("steps").alias("steps"))


# ---- blame analytics over (blamer, blamed, bug, file_id, component, kind, blamer_author, blamed_author, blamer_ts, bug_ts)


def blame_groups(blames: DataFrame) -> DataFrame:
    """Per kind and blamed commit: lines, distinct blamers, bugs and files."""
    return blames.groupBy("kind", "blamed").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("blamer").alias("n_blamers"), F.countDistinct("bug").alias("n_bugs"), F.countDistinct("file_id").alias("n_files"))


def author_overlap(blames: DataFrame) -> DataFrame:
    """One row: distinct blaming and blamed authors, and those that are both."""
    a, b = blames.select(F.col("blamer_author").alias("a")).distinct(), blames.select(F.col("blamed_author").alias("a")).distinct()
    both = a.intersect(b).agg(F.count(F.lit(1)).alias("both"))
    return blames.agg(F.countDistinct("blamer_author").alias("blamers"), F.countDistinct("blamed_author").alias("blamed")).crossJoin(both)


def fan(blames: DataFrame, digits: int = 9) -> DataFrame:
    """(side, total, mean, sd) of how many commits a commit blames (out) and is blamed by (in)."""
    e = blames.select("blamer", "blamed").distinct()
    one = lambda side, c: e.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("total"), F.round(F.avg("n"), digits).alias("mean"), F.round(F.stddev_pop("n"), digits).alias("sd")).withColumn("side", F.lit(side))
    return one("out", "blamer").unionByName(one("in", "blamed"))


def future_bugs(blames: DataFrame) -> DataFrame:
    return blames.groupBy("blamed").agg(F.countDistinct("bug").alias("n_bugs"))


def time_spans(blames: DataFrame, by: str, ts: str, digits: int = 6) -> DataFrame:
    """Days between the first and the last ``ts`` per ``by``; 0 for a single one."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return blames.groupBy(by).agg(F.round((F.max(us) - F.min(us)) / 86_400_000_000.0, digits).alias("days"))


def span_statistics(spans: DataFrame, digits: int = 6) -> DataFrame:
    """Mean, sd, median of all and of non-zero spans; MAD, median + MAD and the share above it."""
    from faultline.operators.measures import mad, whole_median

    d = F.col("days")
    nz = F.when(d > 0, d)
    base = spans.agg(F.avg(d).alias("mean"), F.stddev_pop(d).alias("sd"), F.avg(nz).alias("mean_nz"), F.stddev_pop(nz).alias("sd_nz"))
    base = cut(base.crossJoin(whole_median(spans, "days")).crossJoin(whole_median(spans.where("days > 0"), "days", "median_nz")).crossJoin(mad(spans, "days")))
    above = spans.crossJoin(F.broadcast(base.select((F.col("median") + F.col("mad")).alias("umad")))).agg(F.avg((d > F.col("umad")).cast("double")).alias("share_above"), F.max("umad").alias("umad"))
    return base.crossJoin(above).select(*[F.round(c, digits).alias(c) for c in ("mean", "sd", "median", "mean_nz", "sd_nz", "median_nz", "mad", "umad", "share_above")])


def pagerank(edges: DataFrame, alpha: float = 0.1, steps: int | None = None, tolerance: float = 1e-6, max_steps: int = 100) -> DataFrame:
    """(node, rank) over distinct (src, dst); uniform start, dangling mass spread evenly.

    Runs ``steps`` rounds, or until the change is below tolerance * nodes; an error after ``max_steps`` without that. Every round is written
    out, so plans don't grow.
    """
    e = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    nodes = cut(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    weighted = cut(e.join(out, "src").select("src", "dst", "deg"))
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    sinks = nodes.join(out.select(F.col("src").alias("node")), "node", "left_anti")
    for _ in range(steps or max_steps):
        dangling = rank.join(sinks, "node").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("d"))
        got = weighted.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        new = nodes.join(got, "node", "left").crossJoin(F.broadcast(dangling)).select("node", (F.lit(alpha) * (F.coalesce("got", F.lit(0.0)) + F.col("d") / n) + F.lit((1 - alpha) / n)).alias("new"))
        both = cut(new.join(rank, "node"))
        rank = both.select("node", F.col("new").alias("rank"))
        if steps is None and both.agg(F.sum(F.abs(F.col("new") - F.col("rank")))).first()[0] < n * tolerance:
            return rank
    if steps is None:
        raise RuntimeError(f"no convergence within {max_steps} rounds")
    return rank


def dominance(blames: DataFrame, file: str = "file_id", component: str = "component", least: float = 1 / 3) -> DataFrame:
    """(file_id, component, n, share, dominant): the largest component of each file; ties by name."""
    c = blames.groupBy(file, component).agg(F.count(F.lit(1)).alias("n"))
    w, o = Window.partitionBy(file), Window.partitionBy(file).orderBy(F.desc("n"), component)
    top = c.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("k", F.row_number().over(o)).where("k = 1")
    return top.select(file, component, "n", F.round("share", 9).alias("share"), (F.col("share") > least).alias("dominant"))


def heat(blames: DataFrame) -> DataFrame:
    """(file_id, component, n_blamed, n_bugs): counts per file and component."""
    return blames.groupBy("file_id", "component").agg(F.count(F.lit(1)).alias("n_blamed"), F.countDistinct("bug").alias("n_bugs"))


IMPUTE_BLOCK = 100_000  # files whose neighbours one task looks up


def impute_components(dominant: DataFrame) -> DataFrame:
    """(file_id, component): files without a dominant component take the mode of the three before (imputed ones included) and the next known within three; the first in that order wins a tie.

    The rule feeds on its own results, but where the three files before are known it starts afresh: there the order is cut, and the
    pieces are worked out by themselves. The first three files stay as they are; file_id is unique and not null.
    """
    from faultline.operators.ordered import prefix_sums

    spark = dominant.sparkSession
    rows = cut(row_numbers(dominant.select("file_id", F.when(F.col("dominant"), F.col("component")).alias("known")), ["file_id"], "pos"))
    # every block also gets the three rows on either side of it
    home = F.floor(F.col("pos") / IMPUTE_BLOCK)
    seen = rows.withColumn("block", F.explode(F.array_distinct(F.array(F.floor((F.col("pos") - 3) / IMPUTE_BLOCK), home, F.floor((F.col("pos") + 3) / IMPUTE_BLOCK)))))
    w = Window.partitionBy("block").orderBy("pos")
    near = seen.select("*", *[F.lag("known", k).over(w).alias(f"b{k}") for k in (3, 2, 1)], F.coalesce(*[F.lead("known", k).over(w) for k in (1, 2, 3)]).alias("ahead"))
    near = near.where(F.col("block") == home).withColumn("fresh", F.expr("CAST(b1 IS NOT NULL AND b2 IS NOT NULL AND b3 IS NOT NULL AS bigint)"))
    pieces = prefix_sums(near.drop("block"), ["pos"], {"before": "fresh"}).withColumn("piece", F.col("before") + F.col("fresh"))

    def run(d: pd.DataFrame) -> pd.DataFrame:
        out, piece, last = [], None, [None] * 3
        for r in d.sort_values("pos").itertuples(index=False):
            if r.piece != piece:
                piece, last = r.piece, [r.b3, r.b2, r.b1]
            c = r.known
            if c is None and r.pos >= 3:
                around = [x for x in [*last, r.ahead] if x is not None]
                c = max(dict.fromkeys(around), key=around.count) if around else None
            out.append((r.file_id, c))
            last = [*last[1:], c]
        return pd.DataFrame(out, columns=["file_id", "component"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return pieces.groupBy(F.pmod(F.xxhash64("piece"), F.lit(tasks * 8))).applyInPandas(run, "file_id long, component string")


def variants(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: sizes of union and intersection of two blame variants, and what only the second has."""
    tagged = a.select(key).distinct().withColumn("ia", F.lit(1)).join(b.select(key).distinct().withColumn("ib", F.lit(1)), key, "full")
    return tagged.agg(F.count(F.lit(1)).alias("either"), F.count_if(F.col("ia").isNotNull() & F.col("ib").isNotNull()).alias("both"), F.count_if(F.col("ia").isNull()).alias("only_second"))
