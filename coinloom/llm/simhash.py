"""SimHash near-duplicates by covering locality-sensitive hashing.

Each document gets a 64-bit SimHash of its word shingles. For radius r the 2^(r+1) - 1
covering masks are built from a map of the bit places to the non-zero vectors of r + 1
bits: mask v keeps the places whose vector has an odd inner product with v. Any r places
span fewer than r + 1 dimensions, so some v is orthogonal to all of them: a pair within
the radius agrees under some mask, always. Only distinct fingerprints enter the tables.

A bucket is compared inside one task only while it holds at most `bucket_cap`
fingerprints. A fuller bucket is cut by r + 1 blocks of the places its mask leaves open
(a pair within the radius agrees in one of the blocks), and again until it fits; each cut
fixes more places, so this ends, and no pair is lost. Buckets emit a spanning star of
their linked fingerprints, not the pairs. Components come from large-star and small-star
rounds, each written to the shared folder.

Null and empty texts have fingerprint zero and link like any other; rows without an id
keep their fingerprint and take part under their group's smallest id; repeated rows link
to each other; very long texts are hashed whole; an empty table gives an empty table.
Only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, rows_batches, text_bytes

#: Fixed values of the fingerprint: words a shingle, hash seed, most differing bits of a link.
SHINGLE = 3
HASH_SEED = 42
RADIUS = 3
BUCKET_CAP = 1024
_BITS = 64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of one text: a bit is set where over half the shingle hashes have it set."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words)
    if n <= shingle:
        return digest(joined, HASH_SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], HASH_SEED) for a, b in spans], "<u8")
    ones = np.zeros(_BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id_col as `doc_id` and `fp`, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_batches(batches):
            fps = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int = RADIUS, bits: int = _BITS) -> list[int]:
    """Kept places, of the first `bits`, of each table, as signed numbers."""
    size = (1 << radius + 1) - 1
    vectors = [1 + i % size for i in range(bits)]
    return [_signed(sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1)) for v in range(1, size + 1)]


def _cut_masks(kept: int, radius: int) -> list[int]:
    """The kept places with one more block of the open ones, for each of radius + 1 blocks."""
    kept &= (1 << 64) - 1
    places = [i for i in range(_BITS) if not kept >> i & 1]
    blocks = [places[j :: radius + 1] for j in range(radius + 1)]
    return [_signed(kept | sum(1 << i for i in b)) for b in blocks if b]


def stars(buckets: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """For each list of fingerprints: (member, least member) of each linked set in it."""
    for batch in buckets:
        out_u, out_v = [], []
        lists = batch.column(0)
        sizes = np.diff(lists.offsets.to_numpy())
        values = lists.values.to_numpy(zero_copy_only=False)
        starts = lists.offsets.to_numpy()[:-1]
        two = np.flatnonzero(sizes == 2)
        a, b = values[starts[two]], values[starts[two] + 1]
        near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
        out_u.append(np.maximum(a, b)[near])
        out_v.append(np.minimum(a, b)[near])
        for i in np.flatnonzero(sizes > 2):
            x = np.sort(values[starts[i] : starts[i] + sizes[i]])
            link = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= radius
            label = np.arange(len(x))
            while True:
                least = np.where(link, label[None, :], len(x)).min(1)
                least = least[least]
                if (least == label).all():
                    break
                label = least
            moved = label != np.arange(len(x))
            out_u.append(x[moved])
            out_v.append(x[label[moved]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_u)), pa.array(np.concatenate(out_v))], ["u", "v"])


def links(fps: DataFrame, radius: int = RADIUS, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """Edges (u, v), u > v, whose components are those of all pairs of distinct fps within the radius."""
    spark = fps.sparkSession
    masks = covering_masks(radius)
    found = None
    keyed = fps.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    while True:
        keyed = keyed.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        counts = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        sized = keyed.join(counts, ["mask", "key"])
        fits = sized.where(F.col("n") <= bucket_cap).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        edges = fits.select("fps").mapInArrow(lambda it: stars(it, radius), "u long, v long")
        edges = materialize(edges.distinct(), "links")
        found = edges if found is None else found.unionByName(edges)
        full = counts.where(F.col("n") > bucket_cap)
        open_masks = [r.mask for r in full.select("mask").distinct().collect()]  # of a fixed set of masks
        if not open_masks:
            return found.distinct()
        cuts = spark.createDataFrame([(m, c) for m in open_masks for c in _cut_masks(m, radius)], "mask long, cut long")
        keyed = keyed.join(full.select("mask", "key"), ["mask", "key"]).join(cuts, "mask")
        keyed = materialize(keyed.select("fp", F.col("cut").alias("mask")).distinct(), "cut")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; root is the least node of its component."""
    edges = edges.select("u", "v")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable over links."""
    fps = materialize(fingerprints(df, id_col, text_col, shingle), "fps")
    groups = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    roots = components(links(groups.select("fp"), radius, bucket_cap))
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
