"""Two-pass external shuffle into shards, with DataFrame functions only.

First pass: a seeded hash scatters records into buckets, as many as memory-sized buckets need.
Second pass: each bucket, held by one task, is put in a defined order and shuffled by Fisher-Yates
(Spark's ``shuffle``), and written. Buckets follow one another, and the whole sequence is cut into shards of equal
row counts (at most one apart), so a bucket is written straight to its shard and no record moves twice.

Bucket counts come from a pass of their own; the offsets they give are summed in two levels, so no task
sees all buckets. The order does not depend on how tasks run or are repeated: buckets, their order
and the seeds are set by the data, and the number of partitions by the number of buckets.

Defined results: size is the UTF-8 bytes of the text plus one, a null text has size one; null ids are
records like others; rows equal in id and text fall into one bucket, copies under other ids do not; an
empty table gives an empty one; columns of the input named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.components import stored
from tidewell.llm.text import without
from tidewell.session import fresh_dir

SHARDS = 16
SEED = 1_000_003
BUCKET_BYTES = 8 << 20


def size() -> Column:
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")


def offsets(counts: DataFrame, step: int = 1024) -> DataFrame:
    """``__bucket, __before``: the records in buckets before each."""
    tens = counts.withColumn("__ten", F.floor(F.col("__bucket") / step))
    within = W.partitionBy("__ten").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    over = W.orderBy("__ten").rowsBetween(W.unboundedPreceding, -1)
    sums = tens.groupBy("__ten").agg(F.sum("__n").alias("__sum")).withColumn("__start", F.coalesce(F.sum("__sum").over(over), F.lit(0)))
    inner = tens.withColumn("__inner", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    return inner.join(sums.select("__ten", "__start"), "__ten").select("__bucket", (F.col("__start") + F.col("__inner")).alias("__before"))


def external_shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The records with ``shard`` and ``slot`` (their place in it, from 0), in a random order."""
    docs = without(docs, ["shard", "slot"])
    total_rows, total_bytes = docs.agg(F.count("*"), F.sum(size())).first()
    buckets = max(1, math.ceil((total_bytes or 0) / bucket_bytes))
    rows = docs.select(
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(buckets)).alias("__bucket"),
        F.xxhash64(F.lit(~seed), "doc_id", "text").alias("__order"),
        F.struct(*docs.columns).alias("__row"),
    )
    before = offsets(stored(rows.groupBy("__bucket").agg(F.count("*").alias("__n")), "bucket-counts"))
    earlier = lambda a, b: F.when(a["__order"] < b["__order"], -1).when(a["__order"] > b["__order"], 1).otherwise(0)
    held = rows.repartition(buckets, "__bucket").groupBy("__bucket").agg(F.collect_list(F.struct("__order", "__row")).alias("__all"))
    # Spark draws the random numbers of a task's rows one after the other, so buckets come in a fixed order.
    mixed = held.join(before, "__bucket").sortWithinPartitions("__bucket").select("__before", F.shuffle(F.array_sort("__all", earlier), seed).alias("__all"))
    placed = mixed.select("__before", F.posexplode("__all").alias("__at", "__each"))
    placed = placed.select(F.col("__each.__row").alias("__row"), (F.col("__before") + F.col("__at")).alias("__place"))
    placed = placed.withColumn("shard", F.expr(f"CAST(__place * {shards} DIV {max(1, total_rows)} AS INT)"))
    first = F.expr(f"(CAST(shard AS BIGINT) * {total_rows} + {shards - 1}) DIV {shards}")
    return placed.select("__row.*", "shard", (F.col("__place") - first).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """One folder a shard: the task that holds a bucket writes it, in order of its slots, and nothing is dealt out again."""
    placed = external_shuffle(docs, shards, seed, bucket_bytes)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The shards written below the shared folder, and read from there."""
    spark = docs.sparkSession
    path = fresh_dir(spark, "shards")
    write_shards(docs, path, shards, seed, bucket_bytes)
    kinds = T.StructType([*without(docs, ["shard", "slot"]).schema, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(kinds).parquet(path)
