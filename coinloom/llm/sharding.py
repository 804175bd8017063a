"""Two-pass external shuffle into shards, native DataFrame operations only.

Pass 1 scatters rows into buckets of about `bucket_bytes` by a seeded hash of each row's
number: every scan task writes its rows to the folders of coarse buckets, runs of neighbouring
buckets, in the shared folder, and no row crosses an exchange. Pass 2 takes one coarse bucket at a
time: an exchange over its rows alone brings each bucket together, Spark's `shuffle` of the
bucket's index array gives it a Fisher-Yates permutation, and the permuted buckets are written.
A row's place is its bucket's offset plus its permuted index, and the places are cut into
shards whose row counts differ by one at most. The answer is what pass 2 has written.

There are as many coarse buckets as the root of the number of partitions that pass 2 needs in
all, MOST_COARSE at most: 100 TB are 128 exchanges of about 3,000 by 3,000 partitions, one after
another, instead of one of 390,000 by 390,000, and only one coarse bucket is in flight. Only the bucket
table (bucket, rows, offset) is built by aggregation; offsets are a two-level prefix sum.

Nulls, empty and very long texts, ties and repeated rows are rows like any other: each has
a number and gets its own slot, alike rows spread over all buckets. An empty table gives an
empty table. Reruns agree while the input comes in the same partitions. Other columns pass
through; a column named like a result (`law`, `shard`, `slot`, `grown_shard`) is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, scratch_path

BUCKET_BYTES = 8 << 20
SEED = 20240229
#: Partitions of pass 2: one a bucket up to LEAST_PARTS, for larger tables PART_BUCKETS buckets in each.
LEAST_PARTS = 64
PART_BUCKETS = 32
#: Folders of pass 1: a scan task writes a file to each, so their number has a bound.
MOST_COARSE = 128
_GROUP = 1024
#: Seeds of two coarse buckets lie further apart than there are partitions.
_APART = 1 << 24


def text_size(text_col: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 8).cast("long")


def coarse_buckets(parts: int) -> int:
    """Number of coarse buckets for pass 2's number of partitions."""
    return min(MOST_COARSE, math.isqrt(max(parts, 1) - 1) + 1)


def scatter(df: DataFrame, buckets: int, seed: int, coarse: int = 1) -> DataFrame:
    """Pass 1: df with `__row`, a number for each row, `__bucket` and, as folders, `__coarse`, written once so that all stay."""
    path = scratch_path(df.sparkSession, "scattered")
    bucket = F.pmod(F.xxhash64(F.lit(seed), "__row"), F.lit(buckets).cast("long"))
    rows = df.withColumn("__row", F.monotonically_increasing_id()).withColumn("__bucket", bucket)
    rows = rows.withColumn("__coarse", F.expr(f"cast(__bucket * {coarse}L div {buckets}L as int)"))
    rows.write.partitionBy("__coarse").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def bucket_table(scattered: DataFrame) -> DataFrame:
    """One row a bucket: its coarse bucket, rows in it, rows before it."""
    counts = scattered.groupBy("__coarse", "__bucket").agg(F.count("*").alias("__rows"))
    counts = counts.withColumn("__group", F.floor(F.col("__bucket") / _GROUP))
    groups = counts.groupBy("__group").agg(F.sum("__rows").alias("__group_rows"))
    before = Window.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("__group", F.coalesce(F.sum("__group_rows").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__group").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__inside", F.coalesce(F.sum("__rows").over(inside), F.lit(0)))
    return counts.join(groups, "__group").select("__coarse", "__bucket", "__rows", (F.col("__base") + F.col("__inside")).alias("__offset"))


def permuted(rows: DataFrame, table: DataFrame, parts: int, seed: int) -> DataFrame:
    """Pass 2 over one coarse bucket: its rows with `__place`, each bucket in the order of its permutation."""
    # shuffle() draws from one generator a partition: a fixed count and order of buckets makes reruns agree
    table = table.drop("__coarse").repartition(parts, "__bucket").sortWithinPartitions("__bucket")
    index = F.sequence(F.lit(0), (F.col("__rows") - 1).cast("int"))
    table = table.select("__bucket", "__offset", F.shuffle(index, seed).alias("__order"))
    order = Window.partitionBy("__bucket").orderBy("__row")
    # dealt out like the bucket table, so that the join moves no row again
    dealt = rows.drop("__coarse").repartition(parts, "__bucket").withColumn("__index", F.row_number().over(order))
    place = F.col("__offset") + F.element_at("__order", F.col("__index"))
    return dealt.join(table, "__bucket").withColumn("__place", place).drop("__bucket", "__row", "__index", "__offset", "__order").sortWithinPartitions("__place")


def shard(df: DataFrame, shards: int, size: Column | None = None, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """All rows and columns of df with `law`, `shard`, `slot` and `grown_shard`, read from the permuted buckets."""
    size = text_size() if size is None else size
    rows, volume = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    df = df.drop("law", "shard", "slot", "grown_shard")
    spark, schema = df.sparkSession, df.schema
    buckets = max(1, -(-volume // bucket_bytes))
    parts = min(buckets, max(LEAST_PARTS, buckets // PART_BUCKETS))
    coarse = coarse_buckets(parts)
    scattered = scatter(df, buckets, seed, coarse)
    table = materialize(bucket_table(scattered.select("__coarse", "__bucket")), "buckets")
    out = scratch_path(spark, "permuted")
    for c in range(coarse):
        here = F.col("__coarse") == c
        permuted(scattered.where(here), table.where(here), -(-parts // coarse), seed + c * _APART).write.mode("append").option("compression", "zstd").parquet(out)
    placed = T.StructType([*schema.fields, T.StructField("__place", T.LongType())])
    dealt = spark.read.schema(placed).parquet(out)
    at = F.expr(f"cast((__place * {shards}L) div {max(rows, 1)}L as int)")
    first = F.expr(f"(shard * {max(rows, 1)}L + {shards - 1}L) div {shards}L")
    dealt = dealt.withColumn("law", F.lit("rows")).withColumn("shard", at)
    return dealt.withColumn("slot", F.col("__place") - first).withColumn("grown_shard", F.lit(None).cast("int")).drop("__place")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard; every task writes the runs of slots of its buckets, so no task gathers a shard."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
