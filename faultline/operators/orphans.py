"""References to records that do not exist, kept as incremental keyed state.

The ledger is two logs of changes: the parent index (key -> first arrival, null once deleted) and the
references that are broken (or, if deletions are to be followed, all of them). A batch appends one
segment to each and rewrites nothing: new references probe the index, arriving parents look up the
references waiting at their keys, deletions reopen those settled by theirs. Segments are divided by the
hash of the key, so a batch reads only the divisions its keys fall into, and merged in tiers like the
runs of a log-structured tree. A snapshot counts what is broken per table and month.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import cut, scratch

KEYS = ["ref_table", "ref_key"]
REF = ["ref_table", "ref_id", "ref_key", "at"]
ONE = ["ref_table", "ref_id", "ref_key"]
#: A key with more references than this share of a task's load is spread over several tasks.
MIN_SHARD_ROWS = 200_000
DIVISIONS = 8
#: So many segments of one tier are merged into one of the next.
TIER = 6


def probe(refs: DataFrame, index: DataFrame) -> DataFrame:
    """The rows of ``refs`` without a parent at their time: REF plus ``first_seen`` (null: no parent at all).

    References are first counted per key (map-side combined), so the join with the index has one row
    a key on either side. Only keys with something broken come back to the references; of these, keys
    with many rows are salted in proportion to their count. Null keys are no references.
    """
    spark = refs.sparkSession
    refs = refs.where("ref_key IS NOT NULL")
    counts = refs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))
    verdict = cut(counts.join(index, KEYS, "left").where("first_seen IS NULL OR first_seen > first_at").select(*KEYS, "n", "first_seen"))
    total = verdict.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    share = max(MIN_SHARD_ROWS, math.ceil(total / tasks))
    verdict = verdict.withColumn("shards", F.ceil(F.col("n") / share).cast("int"))
    if total > share:  # at most total / share <= tasks keys can be this heavy, so the list is bounded
        heavy = verdict.where("shards > 1").select(*KEYS, F.col("shards").alias("spread"))
        refs = refs.join(F.broadcast(heavy), KEYS, "left").withColumn("salt", F.when(F.col("spread").isNull(), 0).otherwise(F.pmod(F.xxhash64("ref_id", "at"), F.col("spread"))).cast("int")).drop("spread")
    else:
        refs = refs.withColumn("salt", F.lit(0))
    verdict = verdict.select(*KEYS, "first_seen", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("salt"))
    return refs.join(verdict, [*KEYS, "salt"]).where("first_seen IS NULL OR first_seen > at").select(*REF, "first_seen")


def _division():
    return F.pmod(F.xxhash64(*KEYS), F.lit(DIVISIONS)).cast("int")


@dataclass
class OrphanLedger:
    """State after the batches so far: (path, tier) of the segments of both logs, oldest first.

    Rows of ``index``: KEYS, first_seen, seq; of ``refs``: REF, kind (``missing``, ``late``, ``settled``, or null: no longer in the
    state), seq. Of the rows of one key (one reference) the one with the highest seq holds. ``at`` has the type ``at_type``.
    """

    spark: SparkSession
    root: str
    follow_deletions: bool = False
    at_type: str = "timestamp"
    seq: int = 0
    index: list[tuple[str, int]] = field(default_factory=list)
    refs: list[tuple[str, int]] = field(default_factory=list)

    @classmethod
    def empty(cls, spark: SparkSession, follow_deletions: bool = False, root: str | None = None, at_type: str = "timestamp") -> OrphanLedger:
        """Segments go into ``root``, by default a new folder of the shared one."""
        return cls(spark, root or scratch(spark), follow_deletions, at_type)

    def _read(self, name: str, segments: list[tuple[str, int]], divisions: list[int] | None = None) -> DataFrame:
        schema = self._schema[name]
        if not segments:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(f"{schema}, division int").parquet(p) for p, _ in segments]
        rows = reduce(DataFrame.unionByName, parts)
        return (rows if divisions is None or len(divisions) == DIVISIONS else rows.where(F.col("division").isin(divisions))).drop("division")

    @property
    def _schema(self) -> dict[str, str]:
        return {"index": f"ref_table string, ref_key bigint, first_seen {self.at_type}, seq int", "refs": f"ref_table string, ref_id bigint, ref_key bigint, at {self.at_type}, kind string, seq int"}

    @staticmethod
    def _last(rows: DataFrame, key: list[str]) -> DataFrame:
        rest = [c for c in rows.columns if c not in key]
        return rows.groupBy(*key).agg(F.max(F.struct("seq", *[c for c in rest if c != "seq"])).alias("v")).select(*key, *[f"v.{c}" for c in rest])

    def _append(self, segments: list[tuple[str, int]], rows: DataFrame, key: list[str], name: str) -> list[tuple[str, int]]:
        """The segments with ``rows`` as a new one; full tiers are merged."""

        def write(df: DataFrame) -> str:
            path = f"{self.root}/{name}-{self.seq}-{uuid.uuid4().hex}"
            df.withColumn("division", _division()).hint("rebalance", "division").write.partitionBy("division").parquet(path)
            return path

        segments = [*segments, (write(rows), 0)]
        while len(segments) >= TIER and len({t for _, t in segments[-TIER:]}) == 1:
            whole, tier = len(segments) == TIER, segments[-1][1]
            merged = self._last(self._read(name, segments[-TIER:]), key)
            if whole and name == "refs":  # nothing older is left for these to cover
                merged = merged.where("kind IS NOT NULL")
            segments = [*segments[:-TIER], (write(merged), tier + 1)]
        return segments

    def apply(self, refs: DataFrame, parents: DataFrame, deletions: DataFrame | None = None) -> OrphanLedger:
        """The state after one batch of new references, arriving parents and deleted parent keys.

        ``refs``: REF; a reference delivered again, in this or a later batch, is the same one and counts with its earliest
        ``at``. ``parents``: KEYS and ``at``; one that arrives late but was there early settles late references too. ``deletions``:
        KEYS; needs ``follow_deletions``; a key deleted and arriving in one batch is taken as deleted first. Null keys are
        left out, a parent without a time doesn't count; empty frames are fine.
        """
        if deletions is not None and not self.follow_deletions:
            raise ValueError("deletions need a ledger that follows them")
        seq = self.seq + 1
        fresh = cut(refs.where("ref_key IS NOT NULL").groupBy(*ONE).agg(F.min("at").alias("at")).select(*REF))
        moved = parents.where("ref_key IS NOT NULL").groupBy(*KEYS).agg(F.min("at").alias("came")).withColumn("gone", F.lit(False))
        if deletions is not None:
            moved = moved.unionByName(deletions.where("ref_key IS NOT NULL").select(*KEYS, F.lit(None).cast(self.at_type).alias("came"), F.lit(True).alias("gone")))
            moved = moved.groupBy(*KEYS).agg(F.min("came").alias("came"), F.max("gone").alias("gone"))
        moved = cut(moved)
        touched = moved.select(*KEYS).unionByName(fresh.select(*KEYS)).distinct()
        divisions = [r[0] for r in touched.select(_division()).distinct().collect()] if self.index or self.refs else []  # DIVISIONS numbers at most
        known = self._last(self._read("index", self.index, divisions).join(touched, KEYS, "left_semi"), KEYS)
        both = moved.join(known.select(*KEYS, F.col("first_seen").alias("was")), KEYS, "full")
        now = F.when(F.coalesce("gone", F.lit(False)), F.col("came")).otherwise(F.least("was", "came"))
        index = cut(both.select(*KEYS, now.alias("first_seen"), F.col("gone").isNotNull().alias("changed")))
        # of the old references only those at moved keys and those delivered again
        log = self._read("refs", self.refs, divisions)
        old = log.join(moved.select(*KEYS), KEYS, "left_semi").unionByName(log.join(fresh.select(*ONE), ONE, "left_semi"))
        old = cut(self._last(old, ONE).where("kind IS NOT NULL")) if self.refs else None
        open_refs = fresh if old is None else cut(fresh.unionByName(old.select(*REF)).groupBy(*ONE).agg(F.min("at").alias("at")).select(*REF))
        broken = cut(probe(open_refs, index.select(*KEYS, "first_seen")))
        delta = broken.select(*REF, F.when(F.col("first_seen").isNull(), "missing").otherwise("late").alias("kind"))
        rest = open_refs if self.follow_deletions else old
        if rest is not None:
            settled = rest.select(*REF).join(broken.select(*ONE), ONE, "left_anti")
            delta = delta.unionByName(settled.withColumn("kind", F.lit("settled" if self.follow_deletions else None).cast("string")))
        after = OrphanLedger(self.spark, self.root, self.follow_deletions, self.at_type, seq, self.index, self.refs)
        after.index = after._append(self.index, index.where("changed").select(*KEYS, "first_seen", F.lit(seq).alias("seq")), KEYS, "index")
        after.refs = after._append(self.refs, delta.withColumn("seq", F.lit(seq)), ONE, "refs")
        return after

    def broken(self) -> DataFrame:
        """REF plus kind: ``missing`` (no parent) or ``late`` (the parent came after the reference)."""
        return self._last(self._read("refs", self.refs), ONE).where("kind IN ('missing', 'late')").select(*REF, "kind")

    def snapshot(self) -> DataFrame:
        """Counts of broken references per referring table, kind and month of the reference."""
        return self.broken().groupBy("ref_table", "kind", F.date_format("at", "yyyy-MM").alias("ref_month")).agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("ref_key").alias("n_keys"))
