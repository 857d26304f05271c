"""The core data-quality queries p1 to p5 over the project tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.instants import with_instants
from faultline.functions.packed import explode_packed, infer_delimiters, split_column
from faultline.operators import hierarchy
from faultline.operators.balanced import balanced_aggregate
from faultline.operators.orphans import OrphanLedger
from faultline.plans import dates_sql, packed_sql
from faultline.session import cut, settle, spread, table

PACKED = ["files", "parents", "tags", "branches"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = spread(table(spark, sf_dir, "logs").select("locid", "date")).select(F.lit("logs").alias("tab_name"), F.col("locid").alias("rec_id"), F.lit("date").alias("field_name"), F.col("date").alias("text"), F.lit("UTC").alias("zone"))
    both = F.explode(F.create_map(F.lit("reportDateText"), "reportDateText", F.lit("modDateText"), "modDateText")).alias("field_name", "text")
    bugs = spread(table(spark, sf_dir, "validbugs").select("bug", "reportDateText", "modDateText")).select(F.lit("validbugs").alias("tab_name"), F.col("bug").alias("rec_id"), both, F.lit("America/Los_Angeles").alias("zone"))
    found = with_instants(logs.unionByName(bugs), "text", "utc_us", default_zone_col="zone")
    return settle(found, "utc_us").where("utc_us IS NOT NULL").select("tab_name", "rec_id", "field_name", "utc_us").dropDuplicates()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = spread(table(spark, sf_dir, "logs").select("locid", *PACKED))
    plan = infer_delimiters(logs, PACKED)
    return explode_packed(logs, ["locid"], PACKED, plan).dropDuplicates()


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All references (ref_table, ref_id, ref_key, at) of the three referring tables."""
    log = table(spark, sf_dir, "repolog").select(F.lit("repolog").alias("ref_table"), F.col("id").alias("ref_id"), F.explode(F.split("bugs", ",")).alias("entry"), F.col("loaded_at").alias("at"))
    log = log.withColumn("digits", F.regexp_replace("entry", "[^0-9]", "")).where("digits <> ''").select("ref_table", "ref_id", F.expr("try_cast(digits AS bigint)").alias("ref_key"), "at")
    direct = lambda t, c: table(spark, sf_dir, t).select(F.lit(t).alias("ref_table"), F.col("id").alias("ref_id"), F.expr(f"try_cast({c} AS bigint)").alias("ref_key"), F.col("loaded_at").alias("at"))
    return log.unionByName(direct("experimentprediction", "expId")).unionByName(direct("experiment", "userId")).where("ref_key IS NOT NULL")


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals (ref_table, ref_key, at) of the records the three tables refer to."""
    of = lambda t, t2, c: table(spark, sf_dir, t2).select(F.lit(t).alias("ref_table"), F.col(c).alias("ref_key"), F.col("loaded_at").alias("at"))
    return of("repolog", "validbugs", "bug").unionByName(of("experimentprediction", "experiment", "id")).unionByName(of("experiment", "users", "id")).where("ref_key IS NOT NULL")


P2_BATCHES = 8


def _ledger(spark: SparkSession, sf_dir: str, deletions: DataFrame | None = None) -> OrphanLedger:
    """The ledger after replaying all arrivals in P2_BATCHES batches of loading time, and at last the deletions."""
    refs, parents = cut(_references(spark, sf_dir)), cut(_parents(spark, sf_dir))
    probs = [k / P2_BATCHES for k in range(1, P2_BATCHES)]
    cuts = refs.agg(F.percentile_approx("at", probs, 1000)).first()[0] or []
    edges = [None, *cuts, None]
    ledger = OrphanLedger.empty(spark, follow_deletions=deletions is not None)
    for lo, hi in zip(edges, edges[1:]):
        # rows without a time belong to the first batch
        during = (F.col("at").isNull() if lo is None else F.col("at") > F.lit(lo)) | (F.lit(False) if lo is not None else F.lit(True) if hi is None else F.col("at") <= F.lit(hi))
        during = during if hi is None or lo is None else during & (F.col("at") <= F.lit(hi))
        ledger = ledger.apply(refs.where(during), parents.where(during))
    return ledger if deletions is None else ledger.apply(refs.limit(0), parents.limit(0), deletions)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir).broken().select("ref_table", "ref_id", "ref_key", "kind", F.date_format("at", "yyyy-MM").alias("ref_month"))


def p2_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir).snapshot()


def p2_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken references per table and kind once the bugs that were duplicates are deleted."""
    gone = table(spark, sf_dir, "validbugs").where("status = 'RESOLVED DUPLICATE'").select(F.lit("repolog").alias("ref_table"), F.col("bug").alias("ref_key"))
    return _ledger(spark, sf_dir, gone).broken().groupBy("ref_table", "kind").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("ref_key").alias("n_keys"))


_P2_SQL = """
WITH refs AS (
  SELECT ref_table, ref_id, ref_key, min(seen) AS seen FROM (
    SELECT 'repolog' AS ref_table, id AS ref_id, try_cast(nullif(regexp_replace(e, '[^0-9]', '', 'g'), '') AS BIGINT) AS ref_key, loaded_at AS seen
    FROM (SELECT id, unnest(string_split(bugs, ',')) AS e, loaded_at FROM repolog)
    UNION ALL SELECT 'experimentprediction', id, CAST(expId AS BIGINT), loaded_at FROM experimentprediction
    UNION ALL SELECT 'experiment', id, CAST(userId AS BIGINT), loaded_at FROM experiment)
  WHERE ref_key IS NOT NULL GROUP BY 1, 2, 3),
parents AS (
  SELECT ref_table, ref_key, min(seen) AS first_seen FROM (
    SELECT 'repolog' AS ref_table, bug AS ref_key, loaded_at AS seen FROM validbugs
    UNION ALL SELECT 'experimentprediction', id, loaded_at FROM experiment
    UNION ALL SELECT 'experiment', id, loaded_at FROM users)
  GROUP BY 1, 2),
broken AS (
  SELECT r.ref_table, r.ref_id, r.ref_key, CASE WHEN p.ref_key IS NULL THEN 'missing' ELSE 'late' END AS kind, strftime(r.seen, '%Y-%m') AS ref_month
  FROM refs r LEFT JOIN parents p USING (ref_table, ref_key) WHERE p.ref_key IS NULL OR p.first_seen > r.seen)
"""


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key_kind, key_text, locid): one row per stored row of logs and author, and per row and distinct file."""
    logs = spread(table(spark, sf_dir, "logs").select("locid", "author", "files"))
    logs = split_column(logs, "files", "items", infer_delimiters(logs, ["files"])["files"])
    files = F.array_distinct("items")
    keys = F.concat(
        F.transform(F.when(F.col("author") != "", F.array("author")).otherwise(F.array().cast("array<string>")), lambda a: F.struct(F.lit("author").alias("key_kind"), a.alias("key_text"))),
        F.transform(files, lambda f: F.struct(F.lit("files").alias("key_kind"), f.alias("key_text"))),
    )
    return logs.select("locid", F.explode(keys).alias("k")).select("k.key_kind", "k.key_text", "locid")


P4_SHARE = 0.04


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "logs").count()
    return p4_profiles(spark, sf_dir).where(F.col("n_rows") >= P4_SHARE * n).select("key_kind", "key_text")


def p4_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per author and per file: stored rows, distinct commits and, as matching side, the bugs a person of that spelling holds."""
    bugs = table(spark, sf_dir, "validbugs").where("assignedTo <> ''").groupBy(F.col("assignedTo").alias("key_text")).agg(F.countDistinct("bug").alias("n_bugs")).withColumn("key_kind", F.lit("author"))
    return balanced_aggregate(cut(_keyed(spark, sf_dir)), ["key_kind", "key_text"], "locid", bugs)


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cid, locid, parent): parent is the first 12 lower-case digits of the first parent that isn't the null revision."""
    logs = spread(table(spark, sf_dir, "logs").where("cid IS NOT NULL").select("cid", "locid", "parents"))
    logs = split_column(logs, "parents", "entries", infer_delimiters(logs, ["parents"])["parents"])
    first = F.get(F.filter("entries", lambda e: ~e.startswith("-1:")), F.lit(0))
    return logs.select("cid", "locid", F.lower(F.substring(F.substring_index(first, ":", -1), 1, 12)).alias("parent"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.resolve(_links(spark, sf_dir)).select("cid", "kind", "root_cid", "depth")


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every commit with the locids above it, nearest first, joined by slashes."""
    return hierarchy.resolve(_links(spark, sf_dir), with_paths=True).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every commit with the number of those below it, and its number in pre-order, which names them."""
    return hierarchy.resolve(_links(spark, sf_dir), with_descendants=True).select("cid", "locid", "root_id", "pre", "n_descendants")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_monthly": p2_monthly, "p3_found": p3_found, "p4_found": p4_found, "p4_profiles": p4_profiles, "p5_found": p5_found, "p5_paths": p5_paths, "p5_descendants": p5_descendants, "p2_deleted": p2_deleted}
ORACLES = {
    "p1_found": dates_sql.P1_FOUND,
    "p3_found": packed_sql.P3_FOUND,
    "p4_found": packed_sql.P4_FOUND,
    "p4_profiles": packed_sql.P4_PROFILES,
    "p5_found": packed_sql.P5_FOUND,
    "p5_paths": packed_sql.P5_PATHS,
    "p5_descendants": packed_sql.P5_DESCENDANTS,
    "p2_found": _P2_SQL + "SELECT * FROM broken",
    "p2_deleted": _P2_SQL.replace("FROM validbugs", "FROM validbugs WHERE bug NOT IN (SELECT bug FROM validbugs WHERE status = 'RESOLVED DUPLICATE' AND bug IS NOT NULL)") + "SELECT ref_table, kind, count(*) AS n_refs, count(DISTINCT ref_key) AS n_keys FROM broken GROUP BY 1, 2",
    "p2_monthly": _P2_SQL + "SELECT ref_table, kind, ref_month, count(*) AS n_refs, count(DISTINCT ref_key) AS n_keys FROM broken GROUP BY 1, 2, 3",
}
