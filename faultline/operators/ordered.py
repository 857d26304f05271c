"""Ordered computations without a global single-task sort: prefix sums over ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import cut


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Add, for each ``out: column`` of ``sums``, the sum of ``column`` over all rows before this one in ``order`` (within ``by``).

    ``order`` must be unique within ``by`` and free of nulls. Rows are ranged by (by, order); each range
    is summed by itself, and the totals of earlier ranges, one row a range and group, are added.
    """
    by = by or []
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(df.repartitionByRange(n, *by, *order).withColumn("__p", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "__p").agg(*[F.sum(c).alias(f"__t_{o}") for o, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1) if by else Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(c).alias(f"__b_{c}") for c in by], F.col("__p").alias("__q"), *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__s_{o}") for o in sums])
    inner = Window.partitionBy(*by, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"__l_{o}") for o, c in sums.items()])
    same = F.col("__p") == F.col("__q")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    return local.join(starts, same).select(*df.columns, *[(F.col(f"__l_{o}") + F.col(f"__s_{o}")).alias(o) for o in sums])


def row_numbers(df: DataFrame, order: list[str], out: str = "pos", by: list[str] | None = None) -> DataFrame:
    """Add 0-based row numbers in ``order`` (unique within ``by``)."""
    return prefix_sums(df.withColumn("__one", F.lit(1).cast("bigint")), order, {out: "__one"}, by).drop("__one")
