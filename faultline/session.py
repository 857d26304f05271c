"""Session settings and storage helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build(app: str = "faultline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (UTC, AQE, small local shuffles)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where none is set, as in tests."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    held = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not held and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return held or "file://" + os.path.join(tempfile.gettempdir(), "faultline-shared")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in one step: whoever reads ``path`` sees the old text or the new."""
    jvm = spark.sparkContext._jvm
    to, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(part, to, overwrite)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    The copy survives the loss of any executor, unlike a local checkpoint, and is columnar, so later
    reads prune columns. The files go with the folder; ``drop_cuts`` removes those of this session.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_CUTS: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder; what is written there goes with ``drop_cuts``."""
    path = f"{shared_dir(spark).rstrip('/')}/faultline-{uuid.uuid4().hex}"
    _CUTS.append((spark, path))
    return path


def drop_cuts() -> None:
    """Delete everything written by ``cut`` or into a ``scratch`` folder in this process."""
    while _CUTS:
        spark, path = _CUTS.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except (AttributeError, OSError):  # the session is gone; the cluster's own clean-up removes the folder
            return


def settle(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the columns ``names`` worked out once: a later filter on them isn't pushed below, where their expressions would be copied.

    They pass through a generator of one row, which the optimizer doesn't look through.
    """
    held = F.explode(F.array(F.struct(*names))).alias("__s")
    return df.select(*[c for c in df.columns if c not in names], held).select(*[F.col(f"__s.{c}").alias(c) if c in names else F.col(c) for c in df.columns])


#: A task of heavy work per row should have no more input than this.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is a small table in a few files, which would otherwise be read by as many tasks; larger ones stay as they are.

    For work that costs far more than a shuffle of its input. The order of rows and the result don't change.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SPREAD_BYTES and 0 < len(df.inputFiles()) < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
