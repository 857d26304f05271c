"""Projection, look-up, pairing and ordering operators over instance tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The ordered replacements that shorten method names in experiment logs.
REPLACEMENTS = [
    ("END", r"\\\hline"), ("-log", "-LOG"), ("-nb", "-NB"), ("-dt", "-DT"), ("-bn", "-BN"), ("-j48", "-J48"), ("FIXED-", "FX-"), ("VAR-", "VR-"), ("LSHTune", "LSH"), ("GEN", "GIS"),
    ("TNNFILTER-A", "NNF"), ("NNFILTER-A", "NNF"), (".arff", ""), ("ALL-TOP-", ""), ("SUPER-", ""), ("CLFTU-TUNE-v20-vmx250--", "LRNTune-"), ("TUNE-v20-vmx250--", "-"), ("TUNEDCLF", "LRNTune"),
    ("LRNTune-", "Tuned"), ("NNF-10", "NNF"), ("--", "-"), ("FX-VNN-GIS", "GIS(FX-VNN)"), ("VR-VNN-GIS", "GIS(VR-VNN)"), ("VR-VMUL-GIS", "GIS(VR-VMUL)"), ("FX-VMUL-GIS", "GIS(FX-VMUL)"),
    ("TunedNNF-0", "NNF"), ("TuneNNF-0", "NNF"), ("LOC-50", "LOC50"),
]
# Suffixes of source files.
SOURCE_SUFFIXES = [".c", ".cpp", ".h", ".cc", ".py", ".hh", ".java", ".perl", ".pl", ".rb"]
CPP_SUFFIXES = [".c", ".cpp", ".h", ".cc", ".hh"]


def replace_all(text: Column) -> Column:
    """REPLACEMENTS applied in order."""
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), REPLACEMENTS, text)


def is_source(name: Column, suffixes: list[str] = SOURCE_SUFFIXES) -> Column:
    low = F.lower(name)
    return reduce(lambda a, b: a | b, (low.endswith(s) for s in suffixes))


def dashed(name: Column) -> Column:
    return F.regexp_replace(name, r"[/\\]", "---")


def graph_path(root: str, kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"{root}/{kind}/"), dashed(name))


def blank_line(line: Column) -> Column:
    """Lines that blame passes over: empty, a lone brace or semicolon."""
    return F.trim(line).isin("", "{", "}", ";")


def binarize(label: Column) -> Column:
    return F.when(label > 0, 1.0).otherwise(0.0)


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(v, F.lit(hi)))


def csv_row(cols: list[str]) -> Column:
    return F.concat_ws(",", *[F.format_string("%.4f", F.col(c)) for c in cols])


def minmax(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns scaled to [0, 1]; constant ones stay as they are. The one-row range is broadcast."""
    ranges = df.agg(*[F.min(c).alias(f"__lo_{c}") for c in cols], *[F.max(c).alias(f"__hi_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(ranges))
    out = {c: F.when(F.col(f"__hi_{c}") == F.col(f"__lo_{c}"), F.col(c)).otherwise((F.col(c) - F.col(f"__lo_{c}")) / (F.col(f"__hi_{c}") - F.col(f"__lo_{c}"))) for c in cols}
    return j.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name; columns missing on one side are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def find_instances(needles: DataFrame, hay: DataFrame, cols: list[str], key: str = "id", none: int = -1) -> DataFrame:
    """(key, found): the least hay key with equal ``cols`` (nulls equal), ``none`` if there is none. One shuffle each side; hay is reduced first."""
    side = hay.groupBy(*[F.col(c).alias(f"__{c}") for c in cols]).agg(F.min(key).alias("__found"))
    cond = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cols))
    return needles.join(side, cond, "left").select(key, F.coalesce("__found", F.lit(none)).cast("bigint").alias("found"))


def similar_classes(df: DataFrame, cols: list[str], key: str = "id") -> DataFrame:
    """(key, class_id, n_similar): rows with equal ``cols`` share the least key as class and its size; no pairs are made."""
    groups = df.groupBy(*[F.col(c).alias(f"__{c}") for c in cols]).agg(F.min(key).alias("__class"), F.count(F.lit(1)).alias("__n"))
    cond = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cols))
    return df.join(groups, cond).select(key, F.col("__class").alias("class_id"), F.col("__n").alias("n_similar"))


def majority_relabel(df: DataFrame, cols: list[str], label: str = "label", counts: bool = False, by: list[str] | None = None) -> DataFrame:
    """Rows with equal ``cols`` (within ``by``) get one label: the majority (a tie counts as 1), or the mean for counts."""
    keys = [*(by or []), *cols]
    means = df.groupBy(*[F.col(c).alias(f"__{c}") for c in keys]).agg(F.avg(label).alias("__m"))
    cond = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys))
    new = F.col("__m") if counts else (F.col("__m") >= 0.5).cast("double")
    return df.join(means, cond).select(*[F.col(c) if c != label else new.alias(label) for c in df.columns])


def project_pairs(df: DataFrame, project: str) -> DataFrame:
    """(test, train): leave-one-out pairing of projects, as names; instances are joined per fold when used."""
    p = df.select(F.col(project).alias("test")).distinct()
    q = df.select(F.col(project).alias("train")).distinct()
    return p.join(F.broadcast(q), F.col("test") != F.col("train"))  # a pair of short name lists


def earlier_versions(names: DataFrame, col: str, prefix: int = 3) -> DataFrame:
    """(test, train): projects with the same first letters and an earlier name."""
    a = names.select(F.col(col).alias("test"), F.substring(col, 1, prefix).alias("p")).distinct()
    b = names.select(F.col(col).alias("train"), F.substring(col, 1, prefix).alias("p")).distinct()
    return a.join(b, "p").where("train < test").select("test", "train")


def top_k(df: DataFrame, order: list[Column], k: int, by: list[str] | None = None) -> DataFrame:
    """The first ``k`` rows in ``order``; per group if ``by`` is given."""
    if not by:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")
