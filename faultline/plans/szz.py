"""Queries over the commit log, annotation graphs, traces and blame analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.operators import blame as B, history as H, ordered, relational as R, szz as Z
from faultline.session import cut, table


def _commits(s, d):
    """Distinct delivered commits with their files as array."""
    logs = table(s, d, "repolog").select("id", "repoId", "cid", "m", "author", "files", "parents", "revIndex").distinct()
    return logs.withColumn("files", F.from_json("files", "array<string>"))


_COMMITS = "commits AS (SELECT DISTINCT id, repoId, cid, m, author, files::JSON AS fj, revIndex FROM repolog)"
_BUG = "'" + Z.BUG_REGEX + "'"
_EXCL = "CASE " + " ".join(f"WHEN regexp_matches(lower(m), '{p}') THEN '{p}'" for p in Z.EXCLUDED) + " END"
_LINKED = f"{_COMMITS}, linked AS (SELECT *, {_EXCL} AS excluded, CASE WHEN m IS NULL OR {_EXCL} IS NOT NULL THEN '' ELSE array_to_string(list_transform(regexp_extract_all(lower(m), {_BUG}, 1), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), ',') END AS bugs FROM commits)"


def _linked(s, d):
    return Z.link_bugs(_commits(s, d))


def _valid_links(s, d):
    """Commit and bug pairs whose bug is known, with the bug's component."""
    pairs = _linked(s, d).where("bugs <> ''").select("id", F.explode(F.split("bugs", ",")).alias("b")).select("id", F.expr("try_cast(b AS bigint)").alias("bug"))
    return pairs.distinct().join(table(s, d, "validbugs").select("bug").distinct(), "bug", "left_semi").select("id", "bug")


def _changes(s, d):
    return _commits(s, d).select("repoId", "revIndex", "id", "cid", "author", F.explode("files").alias("file")).withColumn("path", F.concat_ws(":", "repoId", "file"))


# line revisions of documents: revision r drops the lines whose digest mod 8 is r and changes the case of those with r + 4


def _revisions(s, d):
    docs = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    k = F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "i")), 1, 4), 16, 10).cast("bigint") % 8
    rev = docs.withColumn("k", k).withColumn("rev_idx", F.explode(F.sequence(F.lit(0), F.lit(3)))).where("k <> rev_idx")
    return rev.withColumn("line", F.when(F.col("k") == F.col("rev_idx") + 4, F.upper("line")).otherwise(F.col("line")))


_REV = """docs AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS i FROM documents WHERE text IS NOT NULL),
 rev AS (SELECT doc_id, i, r::INT AS rev_idx, CASE WHEN k = r + 4 THEN upper(line) ELSE line END AS line FROM (SELECT *, ('0x' || substr(md5(doc_id || ':' || i), 1, 4))::BIGINT % 8 AS k FROM docs), range(4) t(r) WHERE k <> r)"""


def _texts(s, d):
    t = _revisions(s, d).groupBy("doc_id", "rev_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x.line), "\n").alias("text"))
    return t.select(F.col("doc_id").alias("file_id"), F.col("rev_idx").cast("bigint").alias("rev_idx"), F.concat(F.lit("r"), "rev_idx").alias("rev"), F.concat(F.lit("a"), F.col("rev_idx") % 2).alias("author"), "text")


def _graph(rule):
    return lambda s, d: Z.annotation_graph(_texts(s, d), rule)[0]


# blame stand-in: the orders of a part are its revisions, one line each


def _history(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_suppkey", "l_quantity")
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    w = Window.partitionBy("l_partkey").orderBy("o_orderdate", "o_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag")
    kind = F.when((F.col("k") == 0) | (F.col("l_returnflag") == "R"), "+").when(F.col("l_returnflag") == "A", "*").otherwise("")
    return j.withColumn("k", (F.row_number().over(w) - 1).cast("bigint")).withColumn("type", kind).withColumn("prev", F.lag("o_orderkey").over(w)).withColumn("prev_cust", F.lag("o_custkey").over(w))


_HIST = """hist AS (SELECT *, CASE WHEN k = 0 OR l_returnflag = 'R' THEN '+' WHEN l_returnflag = 'A' THEN '*' ELSE '' END AS type FROM (SELECT l_partkey, o_orderkey, o_custkey, o_orderdate, o_orderpriority, l_returnflag, row_number() OVER w - 1 AS k, lag(o_orderkey) OVER w AS prev, lag(o_custkey) OVER w AS prev_cust
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY l_partkey ORDER BY o_orderdate, o_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag)))"""


def _trace(stop, reported):
    def run(s, d):
        h = cut(_history(s, d))
        zero = F.lit(0).cast("bigint")
        nodes = h.select(F.col("l_partkey").alias("file_id"), F.col("k").alias("rev_idx"), zero.alias("line_no"), "type", F.col("o_orderdate").alias("ts"))
        edges = h.where("k > 0").select(F.col("l_partkey").alias("file_id"), F.col("k").alias("rev_idx"), zero.alias("line_no"), (F.col("k") - 1).alias("to_rev"), zero.alias("to_line"))
        last = h.groupBy("l_partkey").agg(F.max("k").alias("k"), F.max_by("o_orderdate", "k").alias("ts"))
        starts = last.select(F.col("l_partkey").alias("start_id"), F.col("l_partkey").alias("file_id"), F.col("k").alias("rev_idx"), zero.alias("line_no"), (F.expr("ts - interval 60 days") if reported else F.lit(None).cast("timestamp_ntz")).alias("report_ts"))
        return Z.trace(starts, nodes, edges, stop).select("start_id", "rev_idx", "steps")

    return run


def _trace_sql(types: str, reported: bool) -> str:
    older = " AND h.o_orderdate < l.ts - INTERVAL 60 DAY" if reported else ""
    return f"WITH {_HIST}, l AS (SELECT l_partkey, max(k) AS last, arg_max(o_orderdate, k) AS ts FROM hist GROUP BY 1) SELECT h.l_partkey AS start_id, max(h.k) AS rev_idx, max(l.last) - max(h.k) AS steps FROM hist h JOIN l USING (l_partkey) WHERE h.k < l.last AND h.type IN ({types}){older} GROUP BY 1"


# three lines per revision of a part, with branching links: a graph that SQL can build too


def _lined(s, d):
    h = _history(s, d).select("l_partkey", "k", "o_orderkey", "o_orderdate")
    n = h.select("*", F.explode(F.expr("sequence(0L, 2L)")).alias("j"))
    kind = F.when(F.expr("k = 0 OR (k * 3 + j + l_partkey) % 5 = 0"), "+").when(F.expr("(k * 3 + j + l_partkey) % 5 = 1"), "*").otherwise("")
    n = cut(n.select("*", kind.alias("base"), F.expr("(k * 7 + j * 2 + l_partkey) % 6 = 0").alias("gone")))
    nodes = n.select(F.col("l_partkey").alias("file_id"), F.col("k").alias("rev_idx"), F.col("j").alias("line_no"), F.concat("base", F.when(F.col("gone"), ";-").otherwise("")).alias("type"), F.expr("CASE WHEN j = 2 AND k % 4 = 0 THEN '}' ELSE 'x' || j END").alias("line"), F.col("o_orderkey").cast("string").alias("cm_id"))
    edges = n.where("base <> '+'").select("l_partkey", "k", "j", F.explode(F.expr("CASE WHEN base = '*' THEN array_distinct(array(cast((j + k) % 3 as bigint), j)) ELSE array(cast((j + k) % 3 as bigint)) END")).alias("t")).where("((k - 1) * 7 + t * 2 + l_partkey) % 6 <> 0")
    edges = edges.select(F.col("l_partkey").alias("file_id"), F.col("k").alias("rev_idx"), F.col("j").alias("line_no"), (F.col("k") - 1).alias("to_rev"), F.col("t").alias("to_line"))
    revisions = h.select(F.col("l_partkey").alias("file_id"), F.col("k").alias("rev_idx"), F.col("o_orderkey").alias("rev"), F.col("o_orderdate").alias("ts"))
    last = h.groupBy("l_partkey", "o_orderkey").agg(F.max_by("o_orderdate", "k").alias("ts"))
    fixes = last.select(F.col("o_orderkey").alias("commit"), F.col("l_partkey").alias("bug"), F.col("l_partkey").alias("file_id"), F.expr("ts - interval 60 days").alias("report_ts"))
    return fixes, revisions, nodes, edges


_LINES = f"""WITH RECURSIVE {_HIST}, n AS (SELECT l_partkey AS f, k, j::BIGINT AS j, o_orderkey AS rev, o_orderdate AS ts, CASE WHEN k = 0 OR (k * 3 + j + l_partkey) % 5 = 0 THEN '+' WHEN (k * 3 + j + l_partkey) % 5 = 1 THEN '*' ELSE '' END AS base, (k * 7 + j * 2 + l_partkey) % 6 = 0 AS gone, NOT (j = 2 AND k % 4 = 0) AS told FROM hist, range(3) t(j)),
 e AS (SELECT DISTINCT f, k, j, t, base FROM (SELECT f, k, j, base, (j + k) % 3 AS t FROM n WHERE base <> '+' UNION ALL SELECT f, k, j, base, j FROM n WHERE base = '*') WHERE ((k - 1) * 7 + t * 2 + f) % 6 <> 0),
 fx AS (SELECT l_partkey AS f, o_orderkey AS fix, max(k) AS at, arg_max(o_orderdate, k) - INTERVAL 60 DAY AS report FROM hist GROUP BY 1, 2 HAVING max(k) > 0),
 st AS (SELECT 'removed' AS kind, fx.*, n.k, n.j FROM fx JOIN n ON n.f = fx.f AND n.k = fx.at - 1 WHERE gone AND told UNION ALL SELECT 'updated', fx.*, n.k, n.j FROM fx JOIN n ON n.f = fx.f AND n.k = fx.at WHERE base = '*' AND told)"""
_BLAMED = f"""{_LINES}, tr AS (SELECT kind, f, fix, report, j AS start_line, k, j, false AS hit FROM st
 UNION SELECT kind, tr.f, fix, report, start_line, n.k, n.j, (n.base = '+' OR (n.base = '*' AND kind = 'updated')) AND n.ts < report FROM tr JOIN e ON e.f = tr.f AND e.k = tr.k AND e.j = tr.j JOIN n ON n.f = e.f AND n.k = e.k - 1 AND n.j = e.t WHERE NOT hit)
 SELECT kind, tr.fix AS commit, tr.f AS file_id, start_line, tr.k AS rev_idx, tr.j AS line_no, n.rev::VARCHAR AS blamed, coalesce(p.rev::VARCHAR, '@') AS before FROM tr JOIN n ON n.f = tr.f AND n.k = tr.k AND n.j = tr.j LEFT JOIN n p ON p.f = tr.f AND p.k = tr.k - 1 AND p.j = 0 WHERE hit"""


def _run(s, d):
    """The whole way over the line revisions of documents: revision r of a document is a commit that says it fixes the bug of that number."""
    texts = _texts(s, d).select("*", F.concat_ws("-", "file_id", "rev_idx").alias("commit"))
    commits = texts.select("commit", F.when(F.col("rev_idx") > 0, F.concat(F.lit("Bug "), F.col("file_id").cast("string"), F.lit(": tidy up"))).otherwise("Start").alias("m"))
    contents = texts.select(F.concat(F.lit("doc/"), "file_id", F.lit(".c")).alias("file"), "commit", F.col("rev_idx").alias("order"), "author", "text", F.col("rev_idx").alias("ts"))
    bugs = table(s, d, "documents").select(F.col("doc_id").alias("bug"), F.lit(3).cast("bigint").alias("report_ts"))
    return B.run(commits, contents, bugs, "LEV").select("file", "commit", "bug", "kind", "start_line", "rev_idx", "line_no", "blamed", "before")


def _blames(s, d):
    part = table(s, d, "part").select("p_partkey", F.col("p_type").alias("component"))
    h = _history(s, d).where("prev IS NOT NULL AND prev <> o_orderkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    kind = F.when(F.col("l_returnflag") == "R", "removed").otherwise("updated")
    return h.select(F.col("o_orderkey").alias("blamer"), F.col("prev").alias("blamed"), F.col("o_custkey").alias("bug"), F.col("l_partkey").alias("file_id"), "component", kind.alias("kind"), F.col("o_custkey").alias("blamer_author"), F.col("prev_cust").alias("blamed_author"), F.col("o_orderdate").alias("blamer_ts"))


_BL = f"{_HIST}, blames AS (SELECT o_orderkey AS blamer, prev AS blamed, o_custkey AS bug, l_partkey AS file_id, p_type AS component, CASE WHEN l_returnflag = 'R' THEN 'removed' ELSE 'updated' END AS kind, o_custkey AS blamer_author, prev_cust AS blamed_author, o_orderdate AS blamer_ts FROM hist JOIN part ON p_partkey = l_partkey WHERE prev IS NOT NULL AND prev <> o_orderkey)"
STEPS = 4


def _typed(s, d):
    c = _changes(s, d).select("repoId", F.col("revIndex").alias("rev_idx"), "id", "file")
    return H.with_change_types(c, "repoId", "file", ["rev_idx", "id"])


def _range(s, d):
    c = H.changed_files(_typed(s, d), 10, 60)
    return c.select("repoId", F.size("added").cast("bigint").alias("n_added"), F.size("modified").cast("bigint").alias("n_modified"), F.md5(F.array_join("added", ",")).alias("added"))


def _merges(s, d):
    """Of the commits with a known bug, those that merge."""
    parents = F.filter(F.from_json("parents", "array<string>"), lambda p: ~p.startswith("-1"))
    c = _commits(s, d).select(F.col("id").alias("commit"), parents.alias("parents"), "m")
    return H.merge_blames(_valid_links(s, d).select(F.col("id").alias("blamed")), c)


def _minified(s, d):
    from faultline.functions.csource import minified

    return minified(table(s, d, "documents").where("text IS NOT NULL"), "doc_id", "text")


def _stored(s, d):
    """Links of a log that was stored without its last part."""
    a = _linked(s, d).select("id", "bugs")
    return H.differences(a.where("id % 50 <> 0"), a)




def _ranks(s, d):
    b = _blames(s, d)
    return Z.pagerank(b.select(F.col("blamer").alias("src"), F.col("blamed").alias("dst")), steps=STEPS)


def _overlap(s, d):
    """Commits in the top tenth by rank and in the top quarter by future bugs."""
    b = cut(_blames(s, d))
    top = ordered.row_numbers(cut(Z.pagerank(b.select(F.col("blamer").alias("src"), F.col("blamed").alias("dst")), steps=STEPS).withColumn("o", -F.round(F.col("rank") * 1e6, 6))), ["o", "node"])
    fb = ordered.row_numbers(cut(Z.future_bugs(b).withColumn("o", -F.col("n_bugs"))), ["o", "blamed"])
    n, m = top.count(), fb.count()
    return top.where(F.col("pos") < n // 10).select(F.col("node").alias("commit")).join(fb.where(F.col("pos") < m // 4).select(F.col("blamed").alias("commit")), "commit", "left_semi")


def _rank_sql() -> str:
    q = [f"WITH {_BL}, e AS MATERIALIZED (SELECT DISTINCT blamer AS src, blamed AS dst FROM blames), nodes AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e), nn AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM nodes), deg AS MATERIALIZED (SELECT src, count(*) AS deg FROM e GROUP BY 1), r0 AS MATERIALIZED (SELECT node, 1.0 / n AS rank FROM nodes, nn)"]
    for k in range(1, STEPS + 1):
        p = f"r{k - 1}"
        q.append(f"d{k} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) AS d FROM {p} WHERE node NOT IN (SELECT src FROM deg)), g{k} AS MATERIALIZED (SELECT dst AS node, sum(rank / deg) AS got FROM e JOIN deg USING (src) JOIN {p} ON node = src GROUP BY 1), r{k} AS MATERIALIZED (SELECT node, 0.1 * (coalesce(got, 0) + d / n) + 0.9 / n AS rank FROM nodes LEFT JOIN g{k} USING (node), d{k}, nn)")
    return ", ".join(q)


QUERIES = {
    "bug_links": lambda s, d: _linked(s, d).select("id", "bugs", "excluded"),
    "bug_link_stats": lambda s, d: Z.link_statistics(_linked(s, d), F.size("files")),
    "exclusion_counts": lambda s, d: _linked(s, d).where("excluded IS NOT NULL").groupBy("excluded").agg(F.count(F.lit(1)).alias("n")),
    "valid_bug_links": _valid_links,
    "file_revisions": lambda s, d: Z.file_revisions(_changes(s, d), "path", ["revIndex", "id"], "cid", "author"),
    "all_files": lambda s, d: _changes(s, d).select("file").distinct(),
    "valid_ext_filter": lambda s, d: _changes(s, d).where(R.is_source(F.col("file"))).select("id", "file").distinct(),
    "dashed_names": lambda s, d: _changes(s, d).select("file").distinct().select("file", R.dashed(F.col("file")).alias("dashed"), R.graph_path("graphs", "AG", F.col("file")).alias("path")),
    "commit_order": lambda s, d: ordered.row_numbers(_commits(s, d).select("id", "repoId", "revIndex").distinct(), ["revIndex", "id"], "pos", ["repoId"]).select("id", "pos"),
    "revision_pairs": lambda s, d: Z.revision_pairs(_texts(s, d), "file_id", "rev_idx", "text").select("file_id", "rev_idx", "before_rev", F.md5("text").alias("now"), F.md5("before").alias("before")),
    "revision_nodes": lambda s, d: _texts(s, d).select("file_id", "rev_idx", F.posexplode(Z.lines_of(F.col("text"))).alias("line_no", "line")).select("file_id", "rev_idx", "line_no", "line", R.blank_line(F.col("line")).alias("skipped")),
    "annotation_graph_ag": _graph("AG"), "annotation_graph_rag": _graph("RAG"), "annotation_graph_kim": _graph("KIM"), "annotation_graph_lev": _graph("LEV"),
    "szz_trace": _trace(["+", "*"], False),
    "szz_blame": _trace(["+"], True),
    "blame_starts": lambda s, d: B.starts(*_lined(s, d)[:3]).select("kind", "commit", "file_id", "rev_idx", "line_no"),
    "blame_lines": lambda s, d: B.blame(*_lined(s, d)).select("kind", "commit", "file_id", "start_line", "rev_idx", "line_no", "blamed", "before"),
    "szz_run": _run,
    "blame_by_file": lambda s, d: B.by_file(_blames(s, d)).select("file_id", "kind", "blamed", "n_lines", F.array_join(F.array_sort(F.col("blamers").cast("array<string>")), ",").alias("blamers")),
    "blame_metrics": lambda s, d: B.with_metrics(_blames(s, d).select("file_id", "blamed", "kind"), table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("file_id"), F.col("l_orderkey").alias("rev")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("loc"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("loc").alias("loc")),
    "blame_groups": lambda s, d: Z.blame_groups(_blames(s, d)),
    "blame_authors": lambda s, d: Z.author_overlap(_blames(s, d)),
    "blame_fan": lambda s, d: Z.fan(_blames(s, d)),
    "future_bugs": lambda s, d: Z.future_bugs(_blames(s, d)),
    "bug_timespan": lambda s, d: Z.time_spans(_blames(s, d), "blamed", "blamer_ts"),
    "timespan_stats": lambda s, d: Z.span_statistics(Z.time_spans(_blames(s, d), "bug", "blamer_ts")),
    "top_blamed": lambda s, d: R.top_k(Z.future_bugs(_blames(s, d)), [F.desc("n_bugs"), F.col("blamed")], 20),
    "pagerank": lambda s, d: _ranks(s, d).select("node", F.round(F.col("rank") * 1e6, 4).alias("rank")),
    "pagerank_overlap": _overlap,
    "file_component_heat": lambda s, d: Z.heat(_blames(s, d)),
    "component_dominance": lambda s, d: Z.dominance(_blames(s, d).withColumn("component", F.concat(F.lit("c"), F.pmod("blamed", F.lit(4))))),
    "component_imputation": lambda s, d: Z.impute_components(Z.dominance(_blames(s, d).withColumn("component", F.concat(F.lit("c"), F.pmod("blamed", F.lit(4)))), least=0.35)),
    "changed_files": _range,
    "revision_files": lambda s, d: H.revision_files(_typed(s, d), 40),
    "merge_blames": _merges,
    "reply_tree": lambda s, d: H.replies(table(s, d, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "n", F.md5(F.array_join(F.col("children").cast("array<string>"), ",")).alias("children")),
    "graph_differences": _stored,
    "minified_sources": _minified,
    "blame_variants": lambda s, d: Z.variants(_blames(s, d).where("kind = 'removed'"), _blames(s, d).where("kind = 'updated'"), "blamed"),
}
_CH = f"WITH {_COMMITS}, ch AS (SELECT repoId, revIndex, id, cid, author, unnest(from_json(fj, '[\"VARCHAR\"]')) AS file FROM commits)"
_DOM = f"WITH {_BL}, c AS (SELECT file_id, 'c' || (blamed % 4) AS component, count(*) AS n FROM blames GROUP BY 1, 2), w AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY file_id) AS share, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, component) AS k FROM c)"
_N = lambda x: " + ".join(f"coalesce(({x} = {y})::INT, 0)" for y in ("t.o3", "t.o2", "t.o1", "n.ahead"))
_MODE = f"CASE WHEN t.o3 IS NOT NULL AND {_N('t.o3')} >= greatest({_N('t.o2')}, {_N('t.o1')}, {_N('n.ahead')}) THEN t.o3 WHEN t.o2 IS NOT NULL AND {_N('t.o2')} >= greatest({_N('t.o1')}, {_N('n.ahead')}) THEN t.o2 WHEN t.o1 IS NOT NULL AND {_N('t.o1')} >= {_N('n.ahead')} THEN t.o1 ELSE n.ahead END"
_IMPUTED = _DOM.replace("WITH ", "WITH RECURSIVE ", 1) + f""", d AS MATERIALIZED (SELECT file_id, CASE WHEN share > 0.35 THEN component END AS known, row_number() OVER (ORDER BY file_id) - 1 AS pos FROM w WHERE k = 1),
 n AS MATERIALIZED (SELECT *, coalesce(lead(known, 1) OVER o, lead(known, 2) OVER o, lead(known, 3) OVER o) AS ahead FROM d WINDOW o AS (ORDER BY pos)),
 t AS (SELECT file_id, pos, known AS o1, NULL::VARCHAR AS o2, NULL::VARCHAR AS o3 FROM n WHERE pos = 0 UNION ALL SELECT n.file_id, n.pos, CASE WHEN n.known IS NOT NULL OR n.pos < 3 THEN n.known ELSE {_MODE} END, t.o1, t.o2 FROM t JOIN n ON n.pos = t.pos + 1) SELECT file_id, o1 AS component FROM t"""
_SPAN = f"WITH {_BL}, sp AS (SELECT bug, round((epoch_us(max(blamer_ts)) - epoch_us(min(blamer_ts))) / 86400000000.0, 6) AS days FROM blames GROUP BY 1), b AS (SELECT avg(days) AS mean, stddev_pop(days) AS sd, median(days) AS median, avg(days) FILTER (days > 0) AS mean_nz, stddev_pop(days) FILTER (days > 0) AS sd_nz, median(days) FILTER (days > 0) AS median_nz, mad(days) AS mad FROM sp)"
_EXT = " OR ".join(f"ends_with(lower(file), '{x}')" for x in R.SOURCE_SUFFIXES)
_TY = _CH + ", ty AS (SELECT repoId, revIndex AS rev_idx, file, CASE WHEN row_number() OVER (PARTITION BY repoId, file ORDER BY revIndex, id) = 1 THEN 'add' ELSE 'modify' END AS type FROM ch)"
ORACLES = {
    "changed_files": f"{_TY} SELECT repoId, count(DISTINCT file) FILTER (type = 'add') AS n_added, count(DISTINCT file) FILTER (type = 'modify') AS n_modified, md5(coalesce(string_agg(DISTINCT file, ',' ORDER BY file) FILTER (type = 'add'), '')) AS added FROM ty WHERE rev_idx > 10 AND rev_idx <= 60 GROUP BY 1",
    "revision_files": f"{_TY} SELECT DISTINCT repoId, file FROM ty WHERE rev_idx <= 40",
    "merge_blames": f"WITH {_LINKED}, v AS (SELECT DISTINCT id FROM (SELECT id, try_cast(unnest(string_split(bugs, ',')) AS BIGINT) AS bug FROM linked WHERE bugs <> '') WHERE bug IN (SELECT bug FROM validbugs)), c AS (SELECT DISTINCT id, m, parents FROM repolog SEMI JOIN v USING (id)) SELECT count(*) AS blamed, count(*) FILTER (len(list_filter(from_json(parents, '[\"VARCHAR\"]'), lambda p: NOT starts_with(p, '-1'))) > 1) AS merges, count(*) FILTER (contains(lower(m), 'merge')) AS mentions FROM c",
    "reply_tree": "SELECT o_custkey, count(*) AS n, md5(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS children FROM orders GROUP BY 1",
    "graph_differences": f"WITH {_LINKED} SELECT id, bugs, 'source' AS side FROM linked WHERE id % 50 = 0",
    "bug_links": f"WITH {_LINKED} SELECT id, bugs, excluded FROM linked",
    "bug_link_stats": f"WITH {_LINKED}, k AS (SELECT *, CASE WHEN bugs = '' THEN 0 ELSE len(string_split(bugs, ',')) END AS n FROM linked) SELECT count(*) AS commits, count(*) FILTER (n > 0) AS linked, count(*) FILTER (n > 1) AS several, count(*) FILTER (n > 0 AND json_array_length(fj) > 100) AS large, sum(n)::BIGINT AS links, count(excluded) AS excluded FROM k",
    "exclusion_counts": f"WITH {_LINKED} SELECT excluded, count(*) AS n FROM linked WHERE excluded IS NOT NULL GROUP BY 1",
    "valid_bug_links": f"WITH {_LINKED} SELECT DISTINCT id, bug FROM (SELECT id, try_cast(unnest(string_split(bugs, ',')) AS BIGINT) AS bug FROM linked WHERE bugs <> '') WHERE bug IN (SELECT bug FROM validbugs)",
    "file_revisions": f"{_CH} SELECT repoId || ':' || file AS file, row_number() OVER (PARTITION BY repoId, file ORDER BY revIndex, id) - 1 AS rev_idx, cid AS commit, author FROM ch",
    "all_files": f"{_CH} SELECT DISTINCT file FROM ch",
    "valid_ext_filter": f"{_CH} SELECT DISTINCT id, file FROM ch WHERE {_EXT}",
    "dashed_names": f"{_CH} SELECT file, regexp_replace(file, '[/\\\\]', '---', 'g') AS dashed, 'graphs/AG/' || regexp_replace(file, '[/\\\\]', '---', 'g') AS path FROM (SELECT DISTINCT file FROM ch)",
    "commit_order": f"WITH {_COMMITS} SELECT id, row_number() OVER (PARTITION BY repoId ORDER BY revIndex, id) - 1 AS pos FROM (SELECT DISTINCT id, repoId, revIndex FROM commits)",
    "revision_pairs": f"WITH {_REV}, t AS (SELECT doc_id AS file_id, rev_idx::BIGINT AS rev_idx, string_agg(line, chr(10) ORDER BY i) AS text FROM rev GROUP BY 1, 2) SELECT file_id, rev_idx, before_rev, md5(text) AS now, md5(b) AS before FROM (SELECT *, lag(rev_idx) OVER w AS before_rev, lag(text) OVER w AS b FROM t WINDOW w AS (PARTITION BY file_id ORDER BY rev_idx)) WHERE before_rev IS NOT NULL",
    "revision_nodes": f"WITH {_REV} SELECT doc_id AS file_id, rev_idx::BIGINT AS rev_idx, (row_number() OVER (PARTITION BY doc_id, rev_idx ORDER BY i) - 1)::INT AS line_no, line, trim(line) IN ('', '{{', '}}', ';') AS skipped FROM rev",
    "szz_trace": _trace_sql("'+', '*'", False),
    "szz_blame": _trace_sql("'+'", True),
    "blame_starts": f"{_LINES} SELECT kind, fix AS commit, f AS file_id, k AS rev_idx, j AS line_no FROM st",
    "blame_lines": _BLAMED,
    "blame_by_file": f"WITH {_BL} SELECT file_id, kind, blamed, count(*) AS n_lines, string_agg(DISTINCT blamer::VARCHAR, ',' ORDER BY blamer::VARCHAR) AS blamers FROM blames GROUP BY 1, 2, 3",
    "blame_metrics": f"WITH {_BL}, m AS (SELECT l_partkey AS file_id, l_orderkey AS blamed, sum(l_quantity::BIGINT)::BIGINT AS loc FROM lineitem GROUP BY 1, 2) SELECT kind, count(*) AS n, sum(loc)::BIGINT AS loc FROM blames LEFT JOIN m USING (file_id, blamed) GROUP BY 1",
    "blame_groups": f"WITH {_BL} SELECT kind, blamed, count(*) AS n_lines, count(DISTINCT blamer) AS n_blamers, count(DISTINCT bug) AS n_bugs, count(DISTINCT file_id) AS n_files FROM blames GROUP BY 1, 2",
    "blame_authors": f"WITH {_BL} SELECT count(DISTINCT blamer_author) AS blamers, count(DISTINCT blamed_author) AS blamed, (SELECT count(*) FROM (SELECT blamer_author FROM blames INTERSECT SELECT blamed_author FROM blames)) AS both FROM blames",
    "blame_fan": f"WITH {_BL}, e AS (SELECT DISTINCT blamer, blamed FROM blames), o AS (SELECT 'out' AS side, count(*) AS n FROM e GROUP BY blamer UNION ALL SELECT 'in', count(*) FROM e GROUP BY blamed) SELECT side, sum(n)::BIGINT AS total, round(avg(n), 9) AS mean, round(stddev_pop(n), 9) AS sd FROM o GROUP BY 1",
    "future_bugs": f"WITH {_BL} SELECT blamed, count(DISTINCT bug) AS n_bugs FROM blames GROUP BY 1",
    "bug_timespan": f"WITH {_BL} SELECT blamed, round((epoch_us(max(blamer_ts)) - epoch_us(min(blamer_ts))) / 86400000000.0, 6) AS days FROM blames GROUP BY 1",
    "timespan_stats": f"{_SPAN} SELECT round(mean, 6) AS mean, round(sd, 6) AS sd, round(median, 6) AS median, round(mean_nz, 6) AS mean_nz, round(sd_nz, 6) AS sd_nz, round(median_nz, 6) AS median_nz, round(mad, 6) AS mad, round(median + mad, 6) AS umad, round((SELECT avg((days > b.median + b.mad)::INT) FROM sp), 6) AS share_above FROM b",
    "top_blamed": f"WITH {_BL} SELECT blamed, count(DISTINCT bug) AS n_bugs FROM blames GROUP BY 1 ORDER BY n_bugs DESC, blamed LIMIT 20",
    "pagerank": _rank_sql() + f" SELECT node, round(rank * 1e6, 4) AS rank FROM r{STEPS}",
    "pagerank_overlap": _rank_sql() + f", a AS (SELECT node, row_number() OVER (ORDER BY round(rank * 1e6, 6) DESC, node) AS k, count(*) OVER () AS n FROM r{STEPS}), f AS (SELECT blamed, row_number() OVER (ORDER BY nb DESC, blamed) AS k, count(*) OVER () AS n FROM (SELECT blamed, count(DISTINCT bug) AS nb FROM blames GROUP BY 1)) SELECT node AS commit FROM a WHERE k <= n // 10 AND node IN (SELECT blamed FROM f WHERE k <= n // 4)",
    "file_component_heat": f"WITH {_BL} SELECT file_id, component, count(*) AS n_blamed, count(DISTINCT bug) AS n_bugs FROM blames GROUP BY 1, 2",
    "component_dominance": f"{_DOM} SELECT file_id, component, n, round(share, 9) AS share, share > 1.0 / 3 AS dominant FROM w WHERE k = 1",
    "component_imputation": _IMPUTED,
    "blame_variants": f"WITH {_BL}, a AS (SELECT DISTINCT blamed FROM blames WHERE kind = 'removed'), b AS (SELECT DISTINCT blamed FROM blames WHERE kind = 'updated') SELECT (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either, (SELECT count(*) FROM a SEMI JOIN b USING (blamed)) AS both, (SELECT count(*) FROM b ANTI JOIN a USING (blamed)) AS only_second",
}
