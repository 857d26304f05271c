"""Small helpers: fresh names, the time, component lists."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_name(suffix: str = "") -> str:
    return uuid.uuid4().hex + suffix


def now_millis() -> int:
    return int(time.time() * 1000)


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """(component): the first field of a CSV file with a header."""
    df = spark.read.csv(path, header=True)
    return df.select(df[df.columns[0]].alias("component")).where("component IS NOT NULL")
