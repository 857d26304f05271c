"""Blame: from bug-fixing commits back over the annotation graph to the changes that brought the bug in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators import relational as R, szz as Z
from faultline.operators.history import load_graph, save_graph
from faultline.operators.ordered import row_numbers
from faultline.session import cut, exists

LINE = ["file_id", "rev_idx", "line_no"]


def starts(fixes: DataFrame, revisions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(commit, bug, file_id, at, report_ts, kind, rev_idx, line_no, line): the lines that bug-fixing commits removed or updated.

    ``fixes``: (commit, bug, file_id, report_ts). ``revisions``: (file_id, rev_idx, rev). ``nodes``: LINE, type, line. The history of a
    file ends for a fix with the last revision ``at`` that is the commit. ``removed``: lines of the revision before that it drops; ``updated``:
    lines of its own. Blank lines and lone braces don't count, nor does a file's first revision; a fix that isn't among the revisions gives no row.
    """
    at = fixes.distinct().join(revisions.select("file_id", F.col("rev").alias("commit"), "rev_idx"), ["file_id", "commit"])
    at = at.groupBy("commit", "bug", "file_id").agg(F.max("rev_idx").alias("at"), F.min("report_ts").alias("report_ts")).where("at > 0")
    side = at.select("*", F.explode(F.array(F.struct(F.lit("removed").alias("kind"), (F.col("at") - 1).alias("rev_idx")), F.struct(F.lit("updated").alias("kind"), F.col("at").alias("rev_idx")))).alias("s")).select(*at.columns, "s.kind", "s.rev_idx")
    seen = nodes.where((F.col("type").contains("-") | F.col("type").contains("*")) & ~R.blank_line(F.col("line"))).select(*LINE, "type", "line")
    lines = side.join(seen, ["file_id", "rev_idx"]).where("(kind = 'removed' AND type LIKE '%-%') OR (kind = 'updated' AND type LIKE '%*%')")
    return lines.select("commit", "bug", "file_id", "at", "report_ts", "kind", "rev_idx", "line_no", "line")


def blame(fixes: DataFrame, revisions: DataFrame, nodes: DataFrame, edges: DataFrame, removed_stops: tuple[str, ...] = ("+",), updated_stops: tuple[str, ...] = ("+", "*")) -> DataFrame:
    """(commit, bug, file_id, kind, start_rev, start_line, line, rev_idx, line_no, blamed_line, blamed, before, steps): one row per line to blame.

    ``revisions``: (file_id, rev_idx, rev, ts); ``nodes`` also has cm_id. A trace ends at additions for removed lines, at additions or
    updates for updated ones, if these are older than the report (a null report takes any). ``blamed``: the commit of the line found, ``before``:
    the revision before it, @ for the first.
    """
    dated = nodes.join(revisions.select("file_id", "rev_idx", "ts"), ["file_id", "rev_idx"])
    first = starts(fixes, revisions, nodes).withColumn("start_id", F.concat_ws("\x01", "commit", "bug", "file_id", "kind", "line_no"))
    stops = F.when(F.col("kind") == "removed", F.array(*map(F.lit, removed_stops))).otherwise(F.array(*map(F.lit, updated_stops)))
    first = cut(first.withColumn("stops", stops))
    found = Z.trace(first, dated.select(*LINE, "type", "ts"), edges)
    told = found.join(first.select("start_id", "commit", "bug", "kind", F.col("rev_idx").alias("start_rev"), F.col("line_no").alias("start_line"), "line"), "start_id")
    at = nodes.select(*LINE, F.col("line").alias("blamed_line"), F.col("cm_id").alias("blamed"))
    before = revisions.select("file_id", (F.col("rev_idx") + 1).alias("rev_idx"), F.col("rev").cast("string").alias("before"))
    out = told.join(at, LINE).join(before, ["file_id", "rev_idx"], "left")
    return out.select("commit", "bug", "file_id", "kind", "start_rev", "start_line", "line", "rev_idx", "line_no", "blamed_line", "blamed", F.coalesce("before", F.lit("@")).alias("before"), "steps")


def run(commits: DataFrame, contents: DataFrame, bugs: DataFrame, rule: str = "AG", graph_path: str | None = None) -> DataFrame:
    """The whole way from a log to blamed lines: links, file revisions, annotation graph, traces. The columns of ``blame`` and ``file``.

    ``commits``: (commit, m). ``contents``: (file, commit, order, author, text, ts), one row per commit and file; ``order`` sorts the commits of a file.
    ``bugs``: (bug, report_ts). Only source files and known bugs count. With ``graph_path`` the graph is read from there if it exists and
    else built and saved there.
    """
    linked = Z.link_bugs(commits.dropDuplicates(["commit"])).where("bugs <> ''").select("commit", F.explode(F.split("bugs", ",")).alias("b")).select("commit", F.expr("try_cast(b AS bigint)").alias("bug")).distinct()
    known = bugs.where("bug IS NOT NULL").groupBy("bug").agg(F.min("report_ts").alias("report_ts"))
    kept = cut(contents.where(R.is_source(F.col("file"))))
    files = cut(row_numbers(kept.select("file").distinct(), ["file"], "file_id"))
    numbered = row_numbers(kept.join(files, "file"), ["order", "commit"], "rev_idx", ["file_id"])
    revisions = cut(numbered.select("file_id", "rev_idx", F.col("commit").alias("rev"), "author", "text", "ts"))
    spark = commits.sparkSession
    if graph_path and exists(spark, f"{graph_path}/edges/_SUCCESS"):
        nodes, edges = load_graph(spark, graph_path)
    else:
        nodes, edges = (cut(x) for x in Z.annotation_graph(revisions.select("file_id", "rev_idx", "rev", "author", "text"), rule))
        if graph_path:
            save_graph(nodes, edges, graph_path)
    fixes = linked.join(known, "bug").join(kept.select("commit", "file").distinct(), "commit").join(files, "file").select("commit", "bug", "file_id", "report_ts")
    return blame(fixes, revisions, nodes, edges).join(files, "file_id")


def by_file(blames: DataFrame) -> DataFrame:
    """(file_id, kind, blamed, n_lines, blamers): the commits that blame each commit, per file and kind, in order."""
    return blames.groupBy("file_id", "kind", "blamed").agg(F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_set("blamer")).alias("blamers"))


def with_metrics(blames: DataFrame, metrics: DataFrame) -> DataFrame:
    """Blames with the metrics of the revision of the file that is blamed (null where none were taken). ``metrics``: (file_id, rev, ...)."""
    return blames.join(metrics.withColumnRenamed("rev", "blamed"), ["file_id", "blamed"], "left")
