"""Text sources and sinks of repository mining: log dumps, metric files, blame records, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.instants import instant
from faultline.operators.relational import csv_row
from faultline.session import exists

# Separators of the dump, of packed lists and of blame records.
RECORD_END = ";=;;-\n============================\n"
FIELD_END = ";=;;-\n"
LIST_SEP = "---"
BLAME_SEP = ";;=;-;;"
BLAME_END = BLAME_SEP + "\n\n\n"


def read_log_dump(spark: SparkSession, path: str) -> DataFrame:
    """(locid, cid, cidshort, author, date, m, branches, tags, parents, files, timestamp) of a template dump.

    Records under 30 characters are dropped; parents lose the null revision; the date becomes seconds
    of the true instant in UTC, null if it names none.
    """
    rec = spark.read.option("lineSep", RECORD_END).text(path).where(F.length("value") >= 30)
    pairs = F.transform(F.filter(F.split("value", FIELD_END), lambda x: x.contains(":")), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), x.substr(F.instr(x, F.lit(":")) + 1, F.length(x)).alias("value")))
    m = rec.select(F.map_from_entries(pairs).alias("m"))
    g = lambda k: F.try_element_at(F.col("m"), F.lit(k))
    parents = F.filter(F.split(g("parents"), " "), lambda p: (p != "") & ~p.startswith("-1"))
    files = F.filter(F.split(g("files"), LIST_SEP), lambda f: F.trim(f) != "")
    return m.select(
        F.expr("try_cast(trim(try_element_at(m, 'revision')) AS bigint)").alias("locid"), g("changeset").alias("cid"), g("changeshort").alias("cidshort"), g("author").alias("author"), g("date").alias("date"), g("summary").alias("m"),
        g("branches").alias("branches"), g("tags").alias("tags"), parents.alias("parents"), files.alias("files"), (instant(g("date"), F.lit("UTC")) / 1e6).alias("timestamp"),
    )


def read_metric_files(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(fid, rev_index, rev_id, metrics array<double>) of ``fid;revIndex;revID;tab-separated metrics``; blanks count 0, short rows are filled to ``n``."""
    p = F.split("value", ";", 4)
    vals = F.transform(F.split(p[3], "\t"), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))
    t = spark.read.text(path).where(F.size(p) == 4)
    return t.select(p[0].try_cast("bigint").alias("fid"), p[1].try_cast("bigint").alias("rev_index"), p[2].alias("rev_id"), F.slice(F.concat(vals, F.array_repeat(F.lit(0.0), n)), 1, n).alias("metrics"))


# The format a version-control log is landed in, one record a commit, and the separators of its fields.
GIT_FORMAT = "--format=%x1e%H%x1f%P%x1f%an <%ae>%x1f%at%x1f%ct%x1f%D%x1f%B%x1f --name-status -M"
_RECORD, _FIELD = "\x1e", "\x1f"


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """(cid, cidshort, parents, author, author_time, commit_time, tags, m, changes) of logs landed in GIT_FORMAT.

    changes: array of (type, file, copy_from): add, delete, modify or rename. A record that lacks fields gives no row.
    """
    p = F.split("value", _FIELD)
    rec = spark.read.option("lineSep", _RECORD).text(path).where(F.size(p) >= 8)
    names = F.filter(F.transform(F.split(F.get(p, F.lit(7)), "\n"), lambda x: F.split(x, "\t")), lambda x: F.size(x) >= 2)
    kind = lambda x: F.when(x[0].startswith("A"), "add").when(x[0].startswith("D"), "delete").when(x[0].startswith("R") | x[0].startswith("C"), "rename").otherwise("modify")
    changes = F.transform(names, lambda x: F.struct(kind(x).alias("type"), F.element_at(x, -1).alias("file"), F.when(F.size(x) > 2, x[1]).alias("copy_from")))
    tags = F.filter(F.transform(F.split(p[5], ","), lambda t: F.trim(t)), lambda t: t.startswith("tag: "))
    return rec.select(
        F.trim(p[0]).alias("cid"), F.left(F.trim(p[0]), F.lit(12)).alias("cidshort"), F.filter(F.split(p[1], " "), lambda x: x != "").alias("parents"), p[2].alias("author"), p[3].try_cast("bigint").alias("author_time"), p[4].try_cast("bigint").alias("commit_time"),
        F.transform(tags, lambda t: F.substring(t, 6, 1000)).alias("tags"), F.btrim(p[6], F.lit(" \n")).alias("m"), changes.alias("changes"),
    )


def follow(changes: DataFrame, file: str) -> DataFrame:
    """The changes (order, file, type, copy_from, ...) of a file under all the names it had, newest first back to where it was added.

    One step per renaming: each takes the changes under a name from before the renaming that gave the next.
    """
    out, name, before = None, file, None
    while True:
        mine = changes.where((F.col("file") == name) if before is None else (F.col("file") == name) & (F.col("order") < before))
        out = mine if out is None else out.unionByName(mine)
        last = mine.where("copy_from IS NOT NULL").orderBy(F.desc("order")).limit(1).collect()
        if not last:
            return out
        out = out.where((F.col("file") != name) | (F.col("order") >= last[0]["order"]))
        name, before = last[0]["copy_from"], last[0]["order"]


BLAME_FIELDS = ["commit", "bug", "file", "blamed", "fixing", "blamed_code", "fixing_code"]


def blame_text(blames: DataFrame) -> DataFrame:
    """One text a blame record; null fields are empty."""
    return blames.select(F.concat_ws(BLAME_SEP, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in BLAME_FIELDS]).alias("value"))


def write_blames(blames: DataFrame, path: str) -> None:
    blame_text(blames).write.mode("overwrite").option("lineSep", BLAME_END).text(path)


def read_blames(spark: SparkSession, path: str) -> DataFrame:
    """BLAME_FIELDS of records longer than three characters; the file is cut into number and name, revisions into their parts."""
    p = F.split("value", BLAME_SEP)
    t = spark.read.option("lineSep", BLAME_END).text(path).where((F.length("value") > 3) & (F.size(p) >= len(BLAME_FIELDS)))
    cols = [p[k].alias(c) for k, c in enumerate(BLAME_FIELDS)]
    part = lambda c, k: F.regexp_extract(c, r"^([^:]*):(.*)-(\d+)-(\d+)$", k)
    return t.select(*cols).select("*", F.split_part("file", F.lit(":"), F.lit(1)).alias("file_id"), F.substring_index("file", ":", -1).alias("file_name"), part("blamed", 2).alias("blamed_rev"), part("blamed", 3).try_cast("bigint").alias("blamed_idx"), part("blamed", 4).try_cast("bigint").alias("blamed_line"))


def write_instances(df: DataFrame, cols: list[str], path: str) -> None:
    """Comma rows with four decimals, no header."""
    df.select(csv_row(cols).alias("value")).write.mode("overwrite").text(path)


class Store:
    """Tables of the study as Parquet folders: filtered scans, appends, replacement."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def get(self, name: str, fields: list[str] | None = None, where: str | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{name}")
        df = df.where(where) if where else df
        return df.selectExpr(*fields) if fields else df

    def create(self, name: str, schema: str) -> None:
        """An empty table of that schema unless there is one."""
        if not exists(self.spark, f"{self.root}/{name}"):
            self.replace(self.spark.createDataFrame([], schema), name)

    def export_json(self, name: str, path: str) -> None:
        self.get(name).write.mode("overwrite").json(path)

    def insert(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").parquet(f"{self.root}/{name}")

    def replace(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")

    def clean(self, name: str) -> None:
        schema = self.get(name).schema
        self.replace(self.spark.createDataFrame([], schema), name)

    def query(self, sql: str, *names: str) -> DataFrame:
        for n in names:
            self.get(n).createOrReplaceTempView(n)
        return self.spark.sql(sql)
