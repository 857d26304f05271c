"""Per-key results without stragglers: fragment-replicate by estimated load.

Keys are packed into tasks by their load. Keys above half a task's share are split into
proportionate shards over several tasks, and the matching side (one row a key) is replicated to just
those shards; all other keys travel in hash buckets that are packed whole. What reaches the driver
is bounded by the number of tasks, never by the number of keys.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS_PER_TASK = 8


@dataclass
class Packing:
    """Where keys go. ``heavy``: frame (keys..., slots array<int>), at most 2 * tasks rows; ``buckets``: task of each light bucket."""

    keys: list[str]
    tasks: int
    heavy: DataFrame
    n_heavy: int
    buckets: list[int]
    loads: list[float]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(len(self.buckets))).cast("int")

    def _light(self) -> Column:
        return F.element_at(F.array(*[F.lit(t) for t in self.buckets]), self._bucket() + 1)

    def route(self, facts: DataFrame, spread: Column) -> DataFrame:
        """``facts`` plus ``__task``: rows of a split key are spread over its shards by the hash of ``spread``."""
        if not self.n_heavy:
            return facts.withColumn("__task", self._light())
        size = F.size("__slots")
        slot = F.expr("__slots[cast(pmod(__spread, size(__slots)) as int)]")
        routed = facts.withColumn("__spread", F.xxhash64(spread)).join(F.broadcast(self.heavy), self.keys, "left")
        return routed.withColumn("__task", F.when(size > 0, slot).otherwise(self._light())).drop("__slots", "__spread")

    def replicate(self, dim: DataFrame) -> DataFrame:
        """``dim`` plus ``__task``: one copy for each shard of a split key, one for any other key."""
        one = F.array(self._light())
        if not self.n_heavy:
            return dim.withColumn("__task", F.explode(one))
        return dim.join(F.broadcast(self.heavy), self.keys, "left").withColumn("__task", F.explode(F.when(F.col("__slots").isNotNull(), F.array_distinct("__slots")).otherwise(one))).drop("__slots")


def pack(loads: DataFrame, keys: list[str], tasks: int, load: str = "n") -> Packing:
    """Bin-pack keys with known loads (one row a key) onto ``tasks`` tasks, largest piece first."""
    total = float(loads.agg(F.sum(load)).first()[0] or 0)
    half = max(total / tasks / 2, 1.0)
    heavy_rows = loads.where(F.col(load) > half).select(*keys, F.col(load).cast("double").alias("__n")).collect()  # fewer than 2 * tasks rows
    n_buckets = tasks * BUCKETS_PER_TASK
    light = {r["b"]: float(r["s"]) for r in loads.where(F.col(load) <= half).groupBy(F.pmod(F.xxhash64(*keys), F.lit(n_buckets)).cast("int").alias("b")).agg(F.sum(load).alias("s")).collect()}
    pieces = []  # (load, heavy index or None, bucket)
    for k, r in enumerate(heavy_rows):
        shards = math.ceil(r["__n"] / half)
        pieces += [(r["__n"] / shards, k, None)] * shards
    pieces += [(n, None, b) for b, n in light.items()]
    pieces.sort(key=lambda p: (-p[0], p[1] is None, p[1] or 0, p[2] or 0))
    heap = [(0.0, t) for t in range(tasks)]
    slots: list[list[int]] = [[] for _ in heavy_rows]
    buckets = [b % tasks for b in range(n_buckets)]
    for n, k, b in pieces:
        have, t = heapq.heappop(heap)
        heapq.heappush(heap, (have + n, t))
        if b is None:
            slots[k].append(t)
        else:
            buckets[b] = t
    spark = loads.sparkSession
    schema = ", ".join(f"`{k}` {loads.schema[k].dataType.simpleString()}" for k in keys) + ", __slots array<int>"
    heavy = spark.createDataFrame([tuple(r[k] for k in keys) + (slots[i],) for i, r in enumerate(heavy_rows)], schema)
    return Packing(keys, tasks, heavy, len(heavy_rows), buckets, [n for n, _ in heap])


def balanced_aggregate(facts: DataFrame, keys: list[str], spread: str, dim: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """One row a key: keys, ``n_rows``, ``n_distinct`` (distinct values of ``spread``), the columns of ``dim``.

    Null key values form a key of their own. ``spread`` must be a column of ``facts``; equal values go
    to one shard, so distinct counts add up over shards. ``dim`` has one row a key; keys without one
    give nulls. Columns of ``dim`` must not clash with ``keys``, ``n_rows`` and ``n_distinct``.
    """
    spark = facts.sparkSession
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    loads = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    packing = pack(loads, keys, tasks)
    extra = [c for c in dim.columns if c not in keys] if dim is not None else []
    rows = packing.route(facts.select(*keys, F.col(spread).alias("__v")), F.col("__v")).withColumn("__fact", F.lit(1))
    for c in extra:
        rows = rows.withColumn(c, F.lit(None).cast(dim.schema[c].dataType))
    if dim is not None:  # the matching side meets the facts in the same tasks, without a join
        side = packing.replicate(dim.select(*keys, *extra)).withColumn("__v", F.lit(None).cast(facts.schema[spread].dataType)).withColumn("__fact", F.lit(0))
        rows = rows.unionByName(side)
    placed = rows.repartitionById(tasks, F.col("__task"))
    shard = placed.groupBy("__task", *keys).agg(F.sum("__fact").alias("n_rows"), F.countDistinct("__v").alias("n_distinct"), *[F.max(c).alias(c) for c in extra])
    merged = shard.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_distinct").alias("n_distinct"), *[F.max(c).alias(c) for c in extra])
    return merged.where("n_rows > 0")
