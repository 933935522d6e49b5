"""Cutting a plan's past, and numbering rows in order without one task that sees them all."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir: a lost executor costs its tasks, not the plan's past.

    Where the setting is empty, a local master gets a temporary folder; a cluster must name one that all share."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="loomspan-"))
    return df.checkpoint()


PART_ROWS = 50_000  # rows of a panel in a partition


def compact(df: DataFrame) -> DataFrame:
    """df checkpointed, so that the raw rows behind a panel are read once, and in as few partitions as its rows need.

    A fit of trees is thousands of small jobs, each with a task a partition."""
    kept = cut(df)
    return kept.coalesce(max(1, -(-kept.count() // PART_ROWS)))


def numbered(names: DataFrame, by: str, name: str, first: int = 0) -> DataFrame:
    """names with `name`, the row's place in the order of the column `by`, from `first`. The column is unique and without nulls.

    Rows are dealt by ranges and numbered inside them; what lies before a range is the
    sum of the others' counts, one number a partition. The ranges are checkpointed, so
    that a row's partition is the same for the counts and for the numbers."""
    ranged = cut(names.repartitionByRange(by)).withColumn("_part", F.spark_partition_id())
    before, offsets = first, []
    for part, n in sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()):  # a row a partition
        offsets.append((part, before))
        before += n
    table = names.sparkSession.createDataFrame(offsets, "_part int, _before long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    placed = ranged.withColumn("_n", within).join(F.broadcast(table), "_part")
    return placed.withColumn(name, (F.col("_before") + F.col("_n") - 1).cast("int")).drop("_part", "_n", "_before")
