"""Defect datasets in ARFF: a reader over text files, and a Python data source named ``arff``."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from faultline.operators.relational import binarize


def list_files(path: str, suffix: str = ".arff") -> list[str]:
    return sorted(p for p in glob.glob(os.path.join(path, "*")) if p.endswith(suffix))


def parse(text: str) -> tuple[str, list[str], list[list[float]]]:
    """(relation, attribute names, rows). Data rows are stripped lines after @data with five characters or more and a comma."""
    relation, names, rows, data = "", [], [], False
    for line in text.splitlines():
        word = line.split(" ")
        if data:
            s = line.strip()
            if len(s) >= 5 and "," in s:
                rows.append([float(x) for x in s.split(",")])
        elif "@relation" in line.lower() and not relation:
            relation = word[1].strip() if len(word) > 1 else ""
        elif line.lower().startswith("@attribute"):
            names.append(line.split()[1].strip("'\""))
        elif line.lower().strip().startswith("@data"):
            data = True
    return relation, names, rows


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], names: list[str]):
        self.paths, self.names = paths, names

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf8") as f:
            relation, _, rows = parse(f.read())
        for k, r in enumerate(rows):
            yield (f"{relation}-{k}", relation, *r[: len(self.names)])


class ArffSource(DataSource):
    """spark.read.format("arff").load(folder or file): id, project, one double per attribute; the last is the label."""

    @classmethod
    def name(cls) -> str:
        return "arff"

    def _files(self) -> list[str]:
        path = self.options["path"]
        return list_files(path) if os.path.isdir(path) else [path]

    def _names(self) -> list[str]:
        with open(self._files()[0], encoding="utf8") as f:
            return parse(f.read())[1]

    def schema(self) -> str:
        return "id string, project string, " + ", ".join(f"`{n}` double" for n in self._names())

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._files(), self._names())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArffSource)


def read(spark: SparkSession, paths: list[str], features: list[int] | None = None, to_binary: bool = False) -> DataFrame:
    """(id, project, f0.., label) of one or more files on shared storage, all in DataFrame operators.

    ``features``: indexes of attributes to keep (all if None). ``to_binary``: label > 0 becomes 1. Files
    are split into lines by the JVM; an empty data part gives no rows.
    """
    text = spark.read.text(paths, wholetext=True).select(F.split("value", r"\r?\n").alias("lines"))
    text = text.withColumn("at", F.expr("array_position(transform(lines, x -> startswith(lower(trim(x)), '@data')), true)"))
    head = F.get(F.filter("lines", lambda x: F.lower(x).contains("@relation")), F.lit(0))
    data = F.filter(F.transform(F.expr("slice(lines, int(at) + 1, size(lines))"), lambda x: F.trim(x)), lambda x: (F.length(x) >= 5) & x.contains(","))
    body = text.select(F.trim(F.get(F.split(head, " "), F.lit(1))).alias("project"), data.alias("rows"), "at")
    rows = body.where("at > 0").select("project", F.posexplode("rows").alias("n", "line")).select("project", "n", F.split("line", ",").cast("array<double>").alias("v"))
    first = rows.limit(1).collect()
    width = len(first[0]["v"]) if first else 1
    keep = list(range(width - 1)) if features is None else features
    label = F.element_at("v", -1)
    return rows.select(F.concat_ws("-", "project", "n").alias("id"), "project", *[F.col("v")[k].alias(f"f{k}") for k in keep], (binarize(label) if to_binary else label).alias("label"))
