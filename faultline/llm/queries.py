"""The queries of the llm subpackage (p6 to p10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.packed import infer_delimiters, split_column
from faultline.llm import cooccur, leak, mixing, names, toxic
from faultline.plans.packed_sql import PIECES
from faultline.session import spread, table


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    bugs = table(spark, sf_dir, "validbugs").select(F.explode(F.array("assignedTo", "reporter")).alias("name"))
    return table(spark, sf_dir, "logs").select(F.col("author").alias("name")).unionByName(bugs)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.pairs(names.resolve(_names(spark, sf_dir)))


def p6_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.resolve(_names(spark, sf_dir))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = spread(table(spark, sf_dir, "logs").select("cid", "files"))
    plan = infer_delimiters(logs, ["files"])["files"]
    return split_column(logs, "files", "items", plan).select("cid", F.explode("items").alias("file"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored pairs within the bounds; every pair is counted, scored and ranked before they choose."""
    return cooccur.cooccurrence(_files(spark, sf_dir), "cid", "file", min_count=8, min_lift=10.0).select(F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"))


def p7_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccur.cooccurrence(_files(spark, sf_dir), "cid", "file")


def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of files that shares a commit, with its count and its ratio to chance, without the null model."""
    return cooccur.pairs(_files(spark, sf_dir), "cid", "file").withColumn("lift", F.round("lift", 6))


def _index(spark: SparkSession, sf_dir: str) -> leak.LeakIndex:
    return leak.LeakIndex(table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).leaks(table(spark, sf_dir, "documents"))


def p8_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).reparameterised(table(spark, sf_dir, "documents"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic.score(docs, toxic.train(docs, table(spark, sf_dir, "doc_labels")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("abusive AND doc_id IS NOT NULL").select("doc_id").dropDuplicates()


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.rates(_scored(spark, sf_dir))


QUERIES = {
    "p6_found": p6_found, "p6_entities": p6_entities, "p7_found": p7_found, "p7_surprise": p7_surprise, "p7_pairs": p7_pairs,
    "p8_found": p8_found, "p8_reparameterised": p8_reparameterised, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates,
}
P7_FOUND = f"""WITH {PIECES}, f AS (SELECT DISTINCT cid, item FROM pieces JOIN (SELECT DISTINCT locid, cid FROM logs) USING (locid) WHERE field_name = 'files'), k AS (SELECT item, count(*) AS n FROM f GROUP BY 1), t AS (SELECT count(DISTINCT cid) AS n FROM f),
 p AS (SELECT a.item AS file_a, b.item AS file_b, count(*) AS n FROM f a JOIN f b ON a.cid = b.cid AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= 8)
 SELECT file_a, file_b FROM p JOIN k ka ON ka.item = file_a JOIN k kb ON kb.item = file_b, t WHERE p.n * t.n >= 10 * ka.n * kb.n"""
P7_PAIRS = P7_FOUND.split(" HAVING")[0] + ") SELECT file_a AS item_a, file_b AS item_b, p.n, ka.n AS n_a, kb.n AS n_b, t.n AS n_baskets, round(p.n * t.n::DOUBLE / (ka.n * kb.n), 6) AS lift FROM p JOIN k ka ON ka.item = file_a JOIN k kb ON kb.item = file_b, t"
ORACLES = {"p7_found": P7_FOUND, "p7_pairs": P7_PAIRS}
