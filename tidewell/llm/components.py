"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import fresh_dir, work_dir


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written below the shared folder and read again: lineage ends there."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt out by a key and written to the checkpoint folder: lineage ends there, and groups by the key need no shuffle."""
    spark = df.sparkSession
    work_dir(spark)
    # An adaptive plan does not tell how its rows lie; there is nothing to adapt in this one.
    with set_for(spark, "spark.sql.adaptive.enabled", "false"):
        return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key).checkpoint()


@contextmanager
def arrow_batches(spark: SparkSession, size: str) -> Iterator[None]:
    """Arrow batches of at most about ``size`` for the jobs that run inside."""
    with set_for(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size):
        yield


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each job that runs inside go when it ends: its rows are stored."""
    with set_for(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextmanager
def set_for(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def large_star(links: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbourhood."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``node, root`` for every node of the links ``u, v``; the root is the least node reachable.

    Links are kept as u > v. Each round is written to the shared folder, so a lost executor costs a
    part of one round. The number of rounds grows with the logarithm of the longest path.
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = stored(links, "links")
    state = None
    for _ in range(most_rounds):
        links = stored(small_star(large_star(links)), "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("v", "u"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
