"""Mixing sources to target weights by Pareto order sampling.

Every source gets an allotment of tokens: its share of the total, at most max_repeats times what it
has; what a capped source can't give goes to the others in proportion. Whole copies are certain; for
the rest documents are drawn without replacement with unequal inclusion odds: the fixed number of
documents with the least (random odds / inclusion odds).
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BINS = 4096
# Fixed value: how the byte-level vocabulary cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens), tokens of a public tokenizer whose file lies at ``path`` on every node; null text has 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": n})

    return spread(docs.select("doc_id", "source", "text")).mapInPandas(run, "doc_id long, source string, n_tokens long")


def allot(have: dict[str, int], targets: dict[str, tuple[float, int]], total: float) -> dict[str, float]:
    """Tokens of each source: proportional to the target shares, none above repeats * have; the total is kept if the caps allow."""
    caps = {s: have.get(s, 0) * r for s, (_, r) in targets.items()}
    fixed: dict[str, float] = {}
    while True:
        free = {s: w for s, (w, _) in targets.items() if s not in fixed}
        scale = (total - sum(fixed.values())) / sum(free.values()) if sum(free.values()) > 0 else 0.0
        over = [s for s, w in free.items() if w * scale > caps[s]]
        if not over:
            return fixed | {s: w * scale for s, w in free.items()}
        fixed |= {s: float(caps[s]) for s in over}


def mixture(docs: DataFrame, targets: DataFrame, total: float | None = None, size_power: float = 0.5, seed: int = 7, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares).

    chosen: (doc_id, source, n_tokens, copies) with copies >= 1. shares: per target source its tokens,
    documents, target and actual share and whether its repeats ran out. ``total`` defaults to the
    tokens of all documents. Inclusion odds follow n_tokens ** size_power. Sources without a target and
    documents without tokens are left out, repeated rows of a doc_id count once (the least source); a target without documents gets 0. ``targets`` has one row a
    source (shares of repeated rows add up) and is collected: it is bounded by the number of sources.
    """
    spark = docs.sparkSession
    tokens = cut(count_tokens(docs, tokenizer))
    goal = {r["source"]: (float(r["w"] or 0), int(r["m"] or 0)) for r in targets.where("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("w"), F.max("max_repeats").alias("m")).collect()}
    # repeated rows of a document are one document, so that its copies stay within the bound
    sized = cut(tokens.where("n_tokens > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("v")).select("doc_id", "v.source", "v.n_tokens"))
    sums = sized.groupBy(F.when(F.col("source").isin(list(goal)), F.col("source")).alias("source")).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    have = {r["source"]: r["t"] for r in sums if r["source"] is not None}
    total = float(sum(r["t"] for r in sums)) if total is None else float(total)
    plan = allot(have, goal, total)
    whole = {s: min(int(plan[s] // have[s]), goal[s][1]) for s in have}
    rest = {s: plan[s] - whole[s] * have[s] if whole[s] < goal[s][1] else 0.0 for s in have}

    weight = F.pow(F.col("n_tokens").cast("double"), F.lit(size_power))
    mine = sized.where(F.col("source").isin(list(have))).withColumn("w", weight)
    column = lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("source")) if d else F.lit(None)
    # scale c with sum(min(1, c w) n_tokens) = rest; a round can only add certain documents (c w >= 1), so this ends
    c = {r["source"]: (rest[r["source"]] / r["s"] if r["s"] else 0.0) for r in mine.groupBy("source").agg(F.sum(F.col("w") * F.col("n_tokens")).alias("s")).collect()}
    while True:
        sure = column(c) * F.col("w") >= 1
        got = mine.groupBy("source").agg(F.sum(F.when(sure, F.col("n_tokens")).otherwise(0)).alias("cert"), F.sum(F.when(~sure, F.col("w") * F.col("n_tokens")).otherwise(0.0)).alias("s")).collect()
        new = {r["source"]: (max(rest[r["source"]] - r["cert"], 0.0) / r["s"] if r["s"] else c[r["source"]]) for r in got}
        done = all(abs(new[s] - c[s]) <= 1e-9 * max(new[s], 1e-12) for s in new)
        c = {s: max(c[s], new[s]) for s in new}
        if done:
            break
    if not have:
        chosen = sized.select("doc_id", "source", "n_tokens", F.lit(1).alias("copies")).limit(0)
        return chosen, _shares(spark, chosen, goal, plan, have)
    p = F.least(F.lit(1.0), column(c) * F.col("w"))
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    drawn = mine.withColumn("p", p).withColumn("q", F.when(F.col("p") >= 1, 0.0).when(F.col("p") <= 0, None).otherwise((u / (1 - u)) / (F.col("p") / (1 - F.col("p")))))
    drawn = cut(drawn.withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.col("q") / (1 + F.col("q")) * BINS)).cast("int")))
    sizes = {r["source"]: round(r["n"]) for r in drawn.groupBy("source").agg(F.sum("p").alias("n")).collect()}
    # the least n of each source without sorting it: whole bins below the border, ranks only inside the border bin
    per_bin = drawn.where("bin IS NOT NULL").groupBy("source", "bin").agg(F.count(F.lit(1)).alias("n")).collect()  # at most sources * BINS rows
    border, below = {}, {}
    for s in sizes:
        left = sizes[s]
        border[s] = BINS
        for b, n in sorted((r["bin"], r["n"]) for r in per_bin if r["source"] == s):
            if n > left:
                border[s], below[s] = b, left
                break
            left -= n
    from pyspark.sql import Window

    edge = drawn.where(F.col("bin") == column(border))
    ranked = edge.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("q", "doc_id"))).where(F.col("k") <= F.coalesce(column(below), F.lit(0))) if below else edge.withColumn("k", F.lit(0)).limit(0)
    extra = drawn.where(F.col("bin") < column(border)).select("doc_id", "source", "n_tokens").unionByName(ranked.select("doc_id", "source", "n_tokens")).withColumn("copies", F.lit(1))
    certain = mine.select("doc_id", "source", "n_tokens", column(whole).cast("int").alias("copies")).where("copies > 0")
    chosen = cut(certain.unionByName(extra).groupBy("doc_id", "source", "n_tokens").agg(F.sum("copies").cast("int").alias("copies")))
    return chosen, _shares(spark, chosen, goal, plan, have)


def _shares(spark, chosen: DataFrame, goal: dict, plan: dict, have: dict) -> DataFrame:
    got = {r["source"]: r for r in chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t"), F.count(F.lit(1)).alias("n"), F.max("copies").alias("c")).collect()}
    total = sum(r["t"] for r in got.values()) or 1
    rows = [(s, w, (got[s]["t"] if s in got else 0) / total, int(got[s]["t"]) if s in got else 0, int(got[s]["n"]) if s in got else 0, int(got[s]["c"]) if s in got else 0, m, plan.get(s, 0.0) >= have.get(s, 0) * m) for s, (w, m) in sorted(goal.items())]
    return spark.createDataFrame(rows, "source string, target_share double, actual_share double, n_tokens long, n_docs long, copies_most int, max_repeats int, exhausted boolean")
