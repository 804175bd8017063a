"""What the corpus operators share: tables, scratch folders, bounded label samples."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of the contracts: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and executors are local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder its executors share")
        base = "file://" + tempfile.mkdtemp(prefix="coinloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder, removed when the application ends."""
    path = f"{scratch_dir(spark).rstrip('/')}/coinloom/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may already be gone; the folder is scratch
        pass


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def unit_hash(column: Column, seed: int) -> Column:
    """A double in [0, 1) decided by the column's value and the seed."""
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(1 << 40)) / F.lit(float(1 << 40))


def crc_mod(id_col: str, divisor: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


def bounded_sample(df: DataFrame, id_col: str, limit: int, seed: int) -> DataFrame:
    """At most `limit` rows, the ones with the smallest seeded hash of id_col.

    A hash threshold from the row count leaves about 1.3 times `limit` rows for the
    sort, so no task meets the whole table.
    """
    total = df.count()
    h = unit_hash(F.col(id_col), seed)
    if total > limit:
        df = df.where(h < 1.3 * limit / total)
    return df.orderBy(h, id_col).limit(limit)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def rows_batches(batches: Iterable[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one holds about max_bytes; a longer text stands alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * max_bytes / max(batch.nbytes, 1)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def join_by_count(rows: DataFrame, unique: DataFrame, keys: list[str], how: str = "inner", share: int = 50) -> DataFrame:
    """rows joined by keys to `unique`, which has one row a key and in `n` the key's number of rows.

    Keys with over one in `share` of all rows are broadcast, so that none of them is a task's;
    there can't be `share` of them. The others are shuffled.
    """
    most = max(rows.count() // share, 1)
    if unique.where(F.col("n") > most).isEmpty():
        return rows.join(unique, keys, how)
    hot = F.broadcast(unique.where(F.col("n") > most))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(unique.where(F.col("n") <= most), keys, how)
    return rows.join(hot, keys, how).unionByName(rest)


#: Bits of one native bitmap, and most bitmaps of a filter (16 MB).
_BITMAP, _MOST_BITMAPS = 1 << 15, 1 << 12


def maybe_in(df: DataFrame, listed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rows of df whose keys are in `listed`, and some others, fewer the fewer keys are listed; the join itself must follow."""
    return maybe_flagged(df, listed, keys, True)


def maybe_flagged(df: DataFrame, listed: DataFrame, keys: tuple[str, ...], only: bool = False) -> DataFrame:
    """df with `__maybe`, false only where the keys are not in `listed`: a bitmap of 16 MB at most decides. `only` gives the true rows without it."""
    size = min(listed.count() * 8 // _BITMAP + 1, _MOST_BITMAPS)
    place = F.pmod(F.xxhash64(*keys), F.lit(size * _BITMAP))
    maps = listed.select(place.alias("p")).groupBy(F.expr(f"p div {_BITMAP}").alias("k")).agg(F.bitmap_construct_agg(F.expr(f"p % {_BITMAP}")).alias("m")).collect()
    bits = np.zeros((size, _BITMAP // 8), np.uint8)
    for r in maps:
        bits[r.k] = np.frombuffer(bytes(r.m), np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(bits.reshape(-1))
    n = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(n).to_numpy()
            flags = pa.array((shared.value[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool))
            if only:
                yield batch.filter(flags).select(range(n))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], flags], [*batch.schema.names[:n], "__maybe"])

    schema = df.schema if only else T.StructType([*df.schema.fields, T.StructField("__maybe", T.BooleanType())])
    return df.select("*", place.alias("__place")).mapInArrow(run, schema)
