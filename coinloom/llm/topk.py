"""Exact top-k by inner product with vector-approximation files.

The approximation file holds a one-byte cell a component, and for each block of rows the
range of each component; the exact vectors stay in a table of their own. Phase 1 scans the
cells alone, without a shuffle, for each block of queries: cells bound every score from below
and above, and only rows whose upper bound reaches the kth best lower bound are left. Phase
2 reads exact vectors in the order of their upper bounds: the READ * k first of each query,
then those of the rest whose upper bound reaches the kth exact score found by then.

Queries meet all rows in blocks of QUERY_BLOCK, the only part of a table that comes to the
driver. Rows alike in id and vector are stored once with their number; of rows with one
vector the k + 1 smallest ids are enough for any query.

Vectors that are null or hold null or non-finite components take no part, nor do rows
without an id; vectors of another length than the query's are no candidates; a query's own
rows are all rows with its id; every other row is a candidate, those with one id each for
itself; queries that share an id are ranked together; ties go to the smaller id; fewer than
k candidates are returned all; an empty table gives an empty table. Scores must fit in 64
bits. Only the id and vector columns are read, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, maybe_in

BLOCK, QUERY_BLOCK, READ = 4096, 4096, 2
CELLS = 256
_INDEX = "dim int, ids binary, hs binary, cells binary, low binary, width binary"
_FOUND = "query_id long, qh long, id long, h long, lower double, upper double"


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(id, h, v, n): floor(scale * x) of every component of the valid vectors, a hash of them, how many rows are alike."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    ok = df.where(v.isNotNull() & F.col(id_col).isNotNull() & ~F.coalesce(bad, F.lit(False)))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = ok.select(F.col(id_col).cast("long").alias("id"), whole.alias("v")).withColumn("h", F.xxhash64("v"))
    return rows.groupBy("id", "h", "v").agg(F.count("*").alias("n"))


def least_ids(vectors: DataFrame, k: int) -> DataFrame:
    """Of the rows with one vector those with the k + 1 smallest ids."""
    rank = F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))
    return vectors.withColumn("__r", rank).where(F.col("__r") <= k + 1).drop("__r")


def _by_length(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their vectors) for each length of the vectors of a batch, empty ones left out."""
    column = batch.column(at)
    sizes = np.diff(column.offsets.to_numpy())
    for dim in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == dim)
        yield int(dim), rows, column.take(pa.array(rows)).flatten().to_numpy().reshape(-1, dim)


def build_index(vectors: DataFrame) -> DataFrame:
    """A row a block: ids, hashes and cells of its vectors; cell c of a component spans low + c * width to low + (c + 1) * width - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                ids, hs = (batch.column(c).to_numpy() for c in (0, 1))
                for dim, rows, v in _by_length(batch, 2):
                    low = v.min(0)
                    width = (v.max(0) - low) // CELLS + 1
                    cells = ((v - low) // width).astype(np.uint8)
                    row = (dim, *(x.tobytes() for x in (ids[rows], hs[rows], cells, low, width)))
                    yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *(pa.array([x]) for x in row[1:])], ["dim", "ids", "hs", "cells", "low", "width"])

    return vectors.select("id", "h", "v").mapInArrow(run, _INDEX)


def bounds(cells: np.ndarray, low: np.ndarray, width: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of each score, a row a query."""
    q, w, base = queries.astype(np.float64), width.astype(np.float64), low.astype(np.float64)
    corner = (q * w) @ cells.T.astype(np.float64) + (q @ base)[:, None]
    inside = q * (w - 1)
    slack = 1 + 1e-9 * (np.abs(q) @ (np.abs(base) + CELLS * w))  # rounding of the doubles
    return corner + (np.minimum(inside, 0).sum(1) - slack)[:, None], corner + (np.maximum(inside, 0).sum(1) + slack)[:, None]


class _Best:
    """Candidates of one task for one block of queries, pruned by the kth best lower bound of each query."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, k: int):
        self.keys, self.vectors, self.k = keys, vectors, k
        self.kth = np.full(len(keys), -np.inf)
        self.lows = np.full((len(keys), k), -np.inf)
        self.parts: list[np.ndarray] = []

    def add(self, cells: np.ndarray, low: np.ndarray, width: np.ndarray, ids: np.ndarray, hs: np.ndarray) -> None:
        lower, upper = bounds(cells, low, width, self.vectors)
        own = self.keys[:, :1] == ids[None, :]
        lower[own] = upper[own] = -np.inf
        best = np.concatenate((self.lows, lower), 1)
        self.lows = np.partition(best, best.shape[1] - self.k, 1)[:, -self.k :]
        self.kth = self.lows.min(1)
        q, i = np.nonzero((upper >= self.kth[:, None]) & ~own)
        self.parts.append(np.rec.fromarrays([q, ids[i], hs[i], lower[q, i], upper[q, i]], names="q,id,h,lower,upper"))
        if sum(map(len, self.parts)) > 4 * self.k * len(self.keys) + 100_000:
            self.prune()

    def prune(self) -> None:
        rows = np.concatenate(self.parts)
        self.parts = [rows[rows["upper"] >= self.kth[rows["q"]]]]

    def batch(self) -> pa.RecordBatch:
        self.prune()
        rows = self.parts[0]
        columns = [self.keys[rows["q"], 0], self.keys[rows["q"], 1], rows["id"], rows["h"], rows["lower"], rows["upper"]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["query_id", "qh", "id", "h", "lower", "upper"])


def scan(index: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    """Each task's candidates for the queries (id, h, v): rows whose upper bound reaches the task's kth lower bound."""
    queries = {}
    for batch in asked.combine_chunks().to_batches():
        keys = np.stack([batch.column(c).to_numpy() for c in (0, 1)], 1)
        for dim, rows, v in _by_length(batch, 2):
            queries[dim] = keys[rows], v
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: _Best(keys, v, k) for dim, (keys, v) in shared.value.items()}
        for batch in batches:
            for dim, *row in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if dim in best:
                    ids, hs, cells, low, width = (np.frombuffer(x, t) for x, t in zip(row, (np.int64, np.int64, np.uint8, np.int64, np.int64)))
                    cells = cells.reshape(-1, dim)
                    step = max(1, (1 << 22) // len(best[dim].keys))  # bounds of at most 4 million scores at a time
                    for at in range(0, len(ids), step):
                        best[dim].add(cells[at : at + step], low, width, ids[at : at + step], hs[at : at + step])
        for b in best.values():
            if b.parts:
                yield b.batch()

    return index.mapInArrow(run, _FOUND)


def exact_scores(found: DataFrame, vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, score, n) of the listed pairs, from the exact vectors."""
    read = maybe_in(vectors, found.select("id", "h"), ("id", "h"))
    to = asked.select(F.col("id").alias("query_id"), F.col("h").alias("qh"), F.col("v").alias("qv"))
    both = found.select("query_id", "qh", "id", "h").join(read, ["id", "h"]).join(to, ["query_id", "qh"])
    score = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    return both.select("query_id", "id", score.alias("score"), "n")


def top_k(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest scores among all rows of df but its own."""
    vectors = materialize(least_ids(integer_vectors(df, id_col, vector_col, scale), k), "vectors")
    asked = materialize(integer_vectors(queries, id_col, vector_col, scale), "queries")
    index = materialize(build_index(vectors), "cells")
    blocks = max(1, -(-asked.count() // query_block))
    part = F.pmod(F.xxhash64("id", "h"), F.lit(blocks))
    found = None
    for i in range(blocks):
        some = materialize(scan(index, asked.where(part == i).select("id", "h", "v").toArrow(), k), "bounds")
        found = some if found is None else found.unionByName(some)
    by_query = Window.partitionBy("query_id", "qh")
    kth = F.row_number().over(by_query.orderBy(F.desc("lower"), "id", "h"))
    floors = found.withColumn("__r", kth).where(F.col("__r") <= k).groupBy("query_id", "qh").agg(F.min("lower").alias("__floor"), F.count("*").alias("__n"))
    # fewer than k candidates: all of them are results
    left = found.join(floors, ["query_id", "qh"]).where((F.col("upper") >= F.col("__floor")) | (F.col("__n") < k))
    left = left.withColumn("__r", F.row_number().over(by_query.orderBy(F.desc("upper"), "id", "h"))).drop("__floor", "__n")
    left = materialize(left, "candidates")
    first = materialize(exact_scores(left.where(F.col("__r") <= READ * k), vectors, asked), "first")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    sure = first.withColumn("__r", rank).where(F.col("__r") == k).select("query_id", F.col("score").alias("__kth"))
    rest = left.where(F.col("__r") > READ * k).join(sure, "query_id", "left").where(F.col("__kth").isNull() | (F.col("upper") >= F.col("__kth")))
    second = exact_scores(materialize(rest, "rest"), vectors, asked)
    hits = first.unionByName(second).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
