"""Books in parts: a part is a value of a column, what is done is on record, and order is global.

run_parts() applies a plan to the parts that are not done, several at once, and writes their rows in one job by part. A
part is done when its record says so, and the record names the folder of its rows: a run that breaks off leaves the parts
before it done, and folders that no record names count for nothing. Records hold a fingerprint of a part's input, so a part
whose rows have changed is done again, and one that has not is not even planned.

Order over all parts is by ranges: rows are dealt by range of their natural keys and sorted in their ranges, and a row's
number is its place in its range behind the ranges before it. No task sees more than a range.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.plans.stages import Persist
from folioforge.sources.keyed import KeyedTable


def fingerprints(rows: DataFrame, part: str) -> DataFrame:
    """(part, n_rows, mark): how many rows a part has and the sum of their hashes, in any order."""
    mark = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("decimal(38,0)")).cast("string")
    return rows.groupBy(F.col(part).cast("string").alias("part")).agg(F.count(F.lit(1)).alias("n_rows"), mark.alias("mark"))


class Parts:
    """The records and rows of a run in a folder; part is the column that names a row's part."""

    def __init__(self, spark: SparkSession, folder: str, part: str):
        self.spark, self.folder, self.part = spark, folder.rstrip("/"), part
        self.records = KeyedTable(spark, f"{self.folder}/records", "part", buckets=1)

    def done(self) -> DataFrame:
        """(part, n_rows, mark, run): the parts that are done."""
        if not self.records.versions():
            return self.spark.createDataFrame([], "part string, n_rows bigint, mark string, run string")
        return self.records.read().select("part", "n_rows", "mark", "run")

    def left(self, rows: DataFrame) -> list[str]:
        """Names of the parts, in natural order, that are not done as they are now."""
        now = fingerprints(rows, self.part).join(self.done().select("part", "n_rows", "mark"), ["part", "n_rows", "mark"], "left_anti")
        return [r["part"] for r in now.orderBy(T.natural_key(F.col("part")), "part").collect()]  # names only

    def run(self, rows: DataFrame, plan: Callable[[DataFrame], DataFrame], at_once: int = 16) -> list[str]:
        """Applies plan, which keeps the part's column, to what is left, at_once parts at a time; returns the parts it did."""
        todo = self.left(rows)
        for first in range(0, len(todo), at_once):
            names = todo[first : first + at_once]
            wave = rows.where(F.col(self.part).cast("string").isin(names))
            run = f"r{uuid.uuid4().hex}"
            plan(wave).withColumn("_part", F.col(self.part).cast("string")).write.partitionBy("_part").parquet(f"{self.folder}/rows/_run={run}")
            self.records.write(fingerprints(wave, self.part).withColumn("run", F.lit(run)))
        return todo

    def read(self) -> DataFrame:
        """The rows of all parts that are done."""
        runs = [r["run"] for r in self.done().select("run").distinct().collect()]
        if not runs:
            raise ValueError(f"{self.folder}: no part is done")
        root = f"{self.folder}/rows"
        rows = self.spark.read.option("basePath", root).parquet(*[f"{root}/_run={r}" for r in runs])
        recorded = self.done().select(F.col("part").alias("_part"), F.col("run").alias("_run"))
        named = rows.withColumn("_part", F.col(self.part).cast("string"))
        return named.join(recorded, ["_part", "_run"], "left_semi").drop("_part", "_run")


def in_order(rows: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """Rows in global order over their partitions; written as files, the files are in order too."""
    n = ranges or max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order)


def numbered(rows: DataFrame, order: list[Column], persist: Persist, ranges: int | None = None) -> DataFrame:
    """Adds rank, the row's number from 1 in global order. order must tell all rows apart."""
    keyed = rows.withColumns({f"_o{k}": c for k, c in enumerate(order)})
    names = [f"_o{k}" for k in range(len(order))]
    placed = persist(in_order(keyed, [F.col(c) for c in names], ranges).withColumn("_range", F.spark_partition_id()), "ordered")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = sizes.select("_range", (F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*names))
    return placed.join(F.broadcast(before), "_range").withColumn("rank", F.col("_before") + own).drop("_range", "_before", *names)
