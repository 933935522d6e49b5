"""What the operators share: tables, the shared folder, cutting lineage, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words, as every operator here means them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
MOST_IDS = 1_000_000  # ids of 8 bytes that may be broadcast


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a temporary one (tests), a cluster an error."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="loomspan-")
        sc.setCheckpointDir(path)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: a lost executor costs its tasks, not the plan's past."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, path: str | None = None, **options: str) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder (or at path) and read back; for rows too wide for a checkpoint."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/loomspan-{uuid.uuid4().hex}"
    df.write.options(**options).mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that stored() wrote."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def slim(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow or mapInPandas; what it has freed goes back to the system at its end, as Python workers live on beside those of later stages."""

    def then_trim(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
                trim(0)

    return then_trim


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", most: int = MOST_IDS) -> DataFrame:
    """docs without the rows whose id gone names; rows with a null id stay.

    gone is counted first: up to `most` ids go to the rows by broadcast, so that
    texts don't move; more are joined by a shuffle."""
    ids = cut(gone.where(F.col(id_col).isNotNull()).select(id_col).distinct())
    n = ids.count()
    if not n:
        return docs
    return docs.join(F.broadcast(ids) if n <= most else ids.hint("merge"), id_col, "left_anti")


def among(docs: DataFrame, ids: DataFrame, n: int, id_col: str = "doc_id", most: int = MOST_IDS) -> DataFrame:
    """The rows whose id is one of the n different ones of ids, in the same two ways."""
    return docs.join(F.broadcast(ids) if n <= most else ids.hint("merge"), id_col, "left_semi")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component): the smallest id that each id of edges (a, b) reaches.

    Alternating large-star and small-star steps over the edge table; every step is
    a minimum per node (combined before the shuffle) joined back to the edges, so a
    node with very many edges is never gathered in one place. Ids that no edge
    names are not returned; loops and nulls are ignored.
    """
    edges = cut(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def total(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    state = total(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # each row now points down (a > b); the small step hangs a's lower neighbours on their minimum
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = cut(small.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")).distinct())
        if (now := total(edges)) == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    star = edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return star.union(edges.select("a", "a").distinct())
