"""Revision history as tables: what changed, what exists, what a file said, and small graph helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def changed_files(changes: DataFrame, first: int, last: int, repo: str = "repoId") -> DataFrame:
    """(repo, added, deleted, modified): sorted distinct files by change type over revisions in (first, last].

    ``changes``: (repo, rev_idx, file, type in add, delete, modify).
    """
    pick = lambda t: F.array_sort(F.collect_set(F.when(F.col("type") == t, F.col("file"))))
    return changes.where((F.col("rev_idx") > first) & (F.col("rev_idx") <= last)).groupBy(repo).agg(pick("add").alias("added"), pick("delete").alias("deleted"), pick("modify").alias("modified"))


def with_change_types(touches: DataFrame, repo: str, file: str, order: list[str]) -> DataFrame:
    """Touches of files with a type: the first touch in ``order``, which tells a file's touches apart, adds, later ones modify."""
    first = touches.groupBy(repo, file).agg(F.min(F.struct(*order)).alias("__first"))
    # a row a file on one side; a null in the order counts as the least
    return touches.join(first, [repo, file]).withColumn("type", F.when(F.struct(*order) == F.col("__first"), "add").otherwise("modify")).drop("__first")


def revision_files(changes: DataFrame, rev: int, repo: str = "repoId") -> DataFrame:
    """(repo, file): files that exist after revision ``rev``: last touched at or before it, not by a deletion."""
    upto = changes.where(F.col("rev_idx") <= rev)
    return upto.groupBy(repo, "file").agg(F.max_by("type", "rev_idx").alias("t")).where("t <> 'delete'").select(repo, "file")


def source_at(contents: DataFrame, file: Column | str, rev: int) -> DataFrame:
    """(file, text) at revision ``rev``: '' where deleted, no row where the file was never touched."""
    return contents.where(F.col("rev_idx") <= rev).where(F.col("file") == file).groupBy("file").agg(F.coalesce(F.max_by("text", "rev_idx"), F.lit("")).alias("text"))


def replies(comments: DataFrame, parent: str, child: str) -> DataFrame:
    """(parent, n, children): the answers to each comment, in order; roots under null."""
    return comments.groupBy(parent).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(child)).alias("children"))


def differences(stored: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with ``side``; empty when both hold the same bag."""
    cols = stored.columns
    return stored.exceptAll(source.select(cols)).withColumn("side", F.lit("stored")).unionByName(source.select(cols).exceptAll(stored).withColumn("side", F.lit("source")))


def merge_blames(blames: DataFrame, commits: DataFrame) -> DataFrame:
    """One row: distinct blamed commits, those with several parents, those whose message mentions a merge. ``commits``: (commit, parents array, m)."""
    b = blames.select(F.col("blamed").alias("commit")).distinct().join(commits, "commit")
    return b.agg(F.count(F.lit(1)).alias("blamed"), F.count_if(F.size("parents") > 1).alias("merges"), F.count_if(F.lower("m").contains("merge")).alias("mentions"))


def utf8(col: Column) -> Column:
    """Bytes as UTF-8 text; unreadable bytes become the replacement mark."""
    return F.decode(col, "UTF-8")


#: Folders over which the files of a saved graph are spread by hash.
GRAPH_FOLDERS = 64


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge tables, in GRAPH_FOLDERS folders by the hash of the file, so that one file is read from one folder."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.withColumn("folder", F.pmod(F.xxhash64("file_id"), F.lit(GRAPH_FOLDERS)).cast("int")).hint("rebalance", "folder").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str, file_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What ``save_graph`` wrote; of one file only its folder is read."""
    out = []
    for name in ("nodes", "edges"):
        df = spark.read.parquet(f"{path}/{name}")
        if file_id is not None:
            df = df.where((F.col("folder") == F.pmod(F.xxhash64(F.lit(file_id).cast("bigint")), F.lit(GRAPH_FOLDERS)).cast("int")) & (F.col("file_id") == file_id))
        out.append(df.drop("folder"))
    return tuple(out)
