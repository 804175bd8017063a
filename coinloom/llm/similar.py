"""SimHash near-duplicates by similarity: covering LSH over the words of a long fingerprint.

Texts are linked if their long SimHash fingerprints of distinct lower-cased five-word
shingles differ in a sixth of the bits at most and the shingles' Jaccard similarity is 0.8
or more. Two sets of Jaccard similarity s differ in
about acos(2s / (1 + s)) / pi of the bits, so a sixth stands for a similarity of 0.79; with
768 bits the estimate's standard deviation is 0.03. Up to an eleventh of the bits (an
estimate of 0.92, four standard deviations above) links hold without a look at the texts;
for all others the shingles are counted. Groups are the components.

A fingerprint is a row of 64-bit words. Each of the first words has the 15 covering tables
of radius 3 (see simhash): pairs that differ in 3 bits or less in some word always meet,
so all pairs within 4 * words - 1 bits do. More distant ones meet in a share of the tables;
how many words have tables, and how many of their bits the tables read, follows from the
number of rows, so that keys stay selective and a pair at 0.8 meets with a probability of
RECALL or more at any size.

Tables hold one word and a hash of the text. Only texts that agree well in the rest of that
word with another of their bucket are compared by whole fingerprints. A bucket of over CAP
texts is cut by quarters of the word (within 3 bits, one quarter agrees), three times;
what is still fuller is compared in slices of CAP, to each of which the linked sets
before it lend a representative. A bucket emits a tree of links for each linked set, not
all pairs: a text whose links in all its buckets' trees are under 0.8 stays apart, even if
it has a neighbor at 0.8 that they passed by.

Null texts count as empty, empty texts are equal, texts under five words are one shingle.
Equality of texts and shingles is that of 64-bit hashes. Rows without an id take part and
come last in order; repeated rows are documents alike; very long texts are hashed whole;
an empty table gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_count, materialize, maybe_in, rows_batches, text_bytes
from .linededup import WordHashes
from .simhash import RADIUS, components, covering_masks
from .textbatch import mix

SHINGLE, SIMILARITY = 5, 0.8
#: Fewest words of a fingerprint, least probability of meeting at SIMILARITY, one in so many bits may differ.
WORDS, RECALL, BITS_A_LINK = 12, 0.98, 6
#: Of links that differ in more than one in so many bits the shingles are compared; most comparisons that share a copy of one text's shingles.
BITS_A_SURE_LINK, COMPARISONS_A_COPY = 11, 2_000
CAP, MOST_CUTS = 32_768, 3
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SCHEMA = "key long, id long, word long"


def differing_share(similarity: float = SIMILARITY) -> float:
    """Expected share of differing bits of two sets of that Jaccard similarity and equal size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def meets(bits: int, p: float, dims: int = RADIUS + 1) -> float:
    """Probability that words of which each of `bits` read bits differs with probability p share a table.

    They do unless the vectors of the differing places span all dimensions.
    """

    def spans_all(d: int) -> float:
        total, ways = 0.0, 1.0  # ways: subspaces of codimension i, by the Gaussian binomial
        for i in range(dims + 1):
            share = ((1 << dims - i) - 1) / ((1 << dims) - 1)
            total += (-1) ** i * 2 ** (i * (i - 1) // 2) * ways * (share**d if d else 1.0)
            ways *= ((1 << dims - i) - 1) / ((1 << i + 1) - 1)
        return total

    return sum(math.comb(bits, d) * p**d * (1 - p) ** (bits - d) * (1 - spans_all(d)) for d in range(bits + 1))


def table_plan(rows: int) -> tuple[int, int]:
    """(bits of a word that its tables read, words with tables): keys of about log2(rows) bits."""
    bits = min(64, max(24, math.ceil(math.log2(max(rows, 2)) * 15 / 8)))
    one = meets(bits, differing_share())
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - one)))


def distinct_shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    found = WordHashes(text.lower())
    width = min(shingle, found.n)
    if not width:
        return np.zeros(0, np.uint64)
    at = np.arange(found.n - width + 1)
    return np.unique(found.runs(at, at + width))


def long_fingerprint(text: bytes, words: int, shingle: int = SHINGLE) -> np.ndarray:
    """The SimHash of the text's distinct shingles as so many 64-bit words."""
    hashes = distinct_shingles(text, shingle)
    if not len(hashes):
        return np.zeros(words, np.uint64)
    ones = np.zeros(64 * words, np.int64)
    salts = np.arange(1, words + 1, dtype=np.uint64) * _GOLDEN
    for a in range(0, len(hashes), 2048):
        part = mix(hashes[a : a + 2048, None] ^ salts)
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def fingerprints(df: DataFrame, words: int) -> DataFrame:
    """(doc_id, id, words) of df (doc_id, text): id is a hash of the text."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_batches(batches):
            flat = np.concatenate([long_fingerprint(t, words) for t in text_bytes(batch.column(2))]).view(np.int64)
            offsets = pa.array(np.arange(0, len(flat) + 1, words, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(offsets, pa.array(flat))], ["doc_id", "id", "words"])

    text = F.coalesce("text", F.lit(""))
    return df.select("doc_id", F.xxhash64(text).alias("id"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, id long, words array<long>")


def tables(prints: DataFrame, words: int, bits: int, tabled: int) -> DataFrame:
    """(key, id, word) of each of the tables of each fingerprint."""
    masks = np.array(covering_masks(RADIUS, bits), np.int64).view(np.uint64)
    salts = (np.arange(tabled * len(masks), dtype=np.uint64) + np.uint64(1)).reshape(tabled, -1) * _GOLDEN
    step = max(1, 500_000 // salts.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                word = batch.column(1).flatten().to_numpy().view(np.uint64).reshape(-1, words)[:, :tabled]
                keys = mix((word[:, :, None] & masks) ^ mix(salts))
                ids = np.repeat(batch.column(0).to_numpy(), salts.size)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids), pa.array(np.repeat(word.reshape(-1), len(masks)).view(np.int64))], ["key", "id", "word"])

    return prints.select("id", "words").mapInArrow(run, _SCHEMA)


def quarters(rows: DataFrame, level: int) -> DataFrame:
    """Full buckets cut: each row under four new keys, the old one with a quarter of its word."""
    masks = np.array([sum(1 << i for i in range(64) if (i >> 2 * level) % 4 == j) for j in range(4)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, word = (batch.column(c).to_numpy().view(np.uint64)[:, None] for c in (0, 2))
            keys = mix(key ^ mix((word & masks) + np.arange(1, 5, dtype=np.uint64) * _GOLDEN))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), *(pa.array(np.repeat(batch.column(c).to_numpy(), 4)) for c in (1, 2))], ["key", "id", "word"])

    return rows.select("key", "id", "word").mapInArrow(run, _SCHEMA)


def in_buckets(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Rows sorted by `key` in batches of whole buckets; buckets too full to be held come in pieces, marked True."""
    held, open_key = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        held, key = None, rows.column(0).to_numpy()
        if open_key is not None:
            n = int(np.searchsorted(key, open_key, "right"))
            if n:
                yield rows.slice(0, n), True
            if n == len(key):
                continue
            rows, key, open_key = rows.slice(n), key[n:], None
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield rows.slice(0, last), False
        held = rows.slice(last)
        if held.num_rows > cap:
            yield held, True
            held, open_key = None, key[-1]
    if held is not None:
        yield held, False


def _buckets(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each bucket of two rows or more."""
    starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
    for i in np.flatnonzero(np.diff(starts) > 1):
        yield int(starts[i]), int(starts[i + 1])


def _has_close(word: np.ndarray, most: int) -> np.ndarray:
    """Which words of a bucket differ in at most so many bits from another."""
    out, left = np.zeros(len(word), bool), np.arange(len(word))
    while len(left):
        hit = np.bitwise_count(word ^ word[left[0]]) <= most
        if hit.sum() > 1:
            out |= hit
        left = left[1:][~hit[left[1:]]]
    return out


def close(batches: Iterator[pa.RecordBatch], most: int, cap: int, cuts_left: bool) -> Iterator[pa.RecordBatch]:
    """Rows whose word is close to another of their bucket, and all rows of full buckets, marked `full` while they can be cut."""
    for rows, piece in in_buckets(batches, cap):
        if piece:
            keep, full = np.ones(rows.num_rows, bool), np.full(rows.num_rows, cuts_left)
        else:
            key, word = rows.column(0).to_numpy(), rows.column(2).to_numpy().view(np.uint64)
            keep, full = np.zeros(len(key), bool), np.zeros(len(key), bool)
            two = (key[1:] == key[:-1]) & (np.bitwise_count(word[1:] ^ word[:-1]) <= most)
            keep[1:] = two
            keep[:-1] |= two
            for a, b in _buckets(key):
                if b - a > 2:
                    keep[a:b] = _has_close(word[a:b], most)
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(full)], ["key", "id", "word", "full"]).filter(pa.array(keep))


def linked_tree(words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the first row of its linked set, the row of the set that it was found from and the bits they differ in, over what no set has taken yet."""
    label, parent = np.arange(len(words)), np.arange(len(words))
    differ = np.zeros(len(words), np.int32)
    left = np.arange(len(words))
    while len(left):
        seed, queue, left = left[0], [left[0]], left[1:]
        rest = words[left]
        while queue and len(left):
            at = queue.pop()
            bits = np.bitwise_count(rest ^ words[at]).sum(1)
            hit = bits <= most
            if hit.any():
                found = left[hit]
                label[found], parent[found], differ[found] = seed, at, bits[hit]
                queue += found.tolist()
                left, rest = left[~hit], rest[~hit]
    return label, parent, differ


def linked_sets(words: np.ndarray, most: int) -> np.ndarray:
    """For each row the first row of its linked set."""
    return linked_tree(words, most)[0]


def trees(batches: Iterator[pa.RecordBatch], most: int, cap: int) -> Iterator[pa.RecordBatch]:
    """(member, member it is linked to, bits they differ in) of each linked set of each bucket of rows (key, id, words)."""
    lent: tuple | None = None  # of the pieces before: key, ids and words of representatives
    for rows, piece in in_buckets(batches, cap):
        key, ids = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        words = rows.column(2).flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
        u, v, bits = [], [], []
        if piece and lent and lent[0] == key[0]:
            ids, words = np.concatenate((lent[1], ids)), np.concatenate((lent[2], words))
            key = np.full(len(ids), key[0])
        for a, b in _buckets(key):
            _, parent, differ = linked_tree(words[a:b], most)
            moved = parent != np.arange(b - a)
            u.append(ids[a:b][moved])
            v.append(ids[a:b][parent[moved]])
            bits.append(differ[moved])
            if piece:
                lent = key[0], ids[~moved], words[~moved]
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (u, v, bits)], ["u", "v", "bits"])


def links(prints: DataFrame, words: int, plan: tuple[int, int], cap: int = CAP) -> DataFrame:
    """Edges (u, v, bits) whose components are the groups of prints (id, words) by estimate, one row an id."""
    bits, tabled = plan
    others = 64 - bits * 8 // 15
    p = differing_share()
    most = math.ceil(others * p + 3 * math.sqrt(others * p * (1 - p)))
    by_bucket: Callable[[DataFrame], DataFrame] = lambda df: df.repartition("key").sortWithinPartitions("key", "id")
    rows, level, near = tables(prints, words, bits, tabled), 0, None
    while True:
        cuts_left = level < MOST_CUTS
        found = by_bucket(rows).mapInArrow(lambda it, m=most, c=cuts_left: close(it, m, cap, c), _SCHEMA + ", full boolean")
        found = materialize(found, "close")
        near = found if near is None else near.unionByName(found)
        full = found.where("full")
        if full.isEmpty():
            break
        rows, level = quarters(full, level), level + 1
    some = near.where("not full").select("key", "id").join(prints, "id").select("key", "id", "words")
    differ = 64 * words // BITS_A_LINK
    return materialize(by_bucket(some).mapInArrow(lambda it: trees(it, differ, cap), "u long, v long, bits int").distinct(), "edges")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(id, shingles) of (id, text): the hashes of the distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_batches(batches):
            sets = [distinct_shingles(t).view(np.int64) for t in text_bytes(batch.column(1))]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["id", "shingles"])

    return texts.mapInArrow(run, "id long, shingles array<long>")


def exact_links(edges: DataFrame, df: DataFrame, words: int, similarity: float = SIMILARITY) -> DataFrame:
    """The edges (u, v) of texts of df (id, text) that are as similar as that; ids may repeat in df, with one text.

    A text that many are compared with lends each COMPARISONS_A_COPY of them a copy of its shingles.
    """
    sure = 64 * words // BITS_A_SURE_LINK
    doubtful = materialize(edges.where(F.col("bits") > sure).select("u", "v"), "doubtful")
    copies = F.ceil(F.col("n") / COMPARISONS_A_COPY).cast("int")
    shared = materialize(doubtful.groupBy("v").agg(F.count("*").alias("n")), "shared")
    ids = materialize(doubtful.select(F.col("u").alias("id")).unionByName(shared.select(F.col("v").alias("id"))).distinct(), "compared")
    once = maybe_in(df.select("id", "text"), ids, ("id",)).groupBy("id").agg(F.first("text").alias("text"))
    sets = materialize(shingle_sets(once.join(ids, "id", "left_semi").select("id", "text")), "shingles")
    lent = sets.join(shared, sets["id"] == shared["v"]).select("v", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), F.col("shingles").alias("theirs"))
    asked = join_by_count(doubtful, shared, ["v"]).select("u", "v", F.pmod(F.xxhash64("u"), copies.cast("long")).cast("int").alias("copy"))
    pairs = asked.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("ours")), "u").join(lent, ["v", "copy"])
    common = F.size(F.array_intersect("ours", "theirs"))
    alike = common >= similarity * (F.size("ours") + F.size("theirs") - common) - 1e-9
    held = pairs.where(alike).select("u", "v")
    return materialize(edges.where(F.col("bits") <= sure).select("u", "v").unionByName(held), "links")


def similar_groups(df: DataFrame, cap: int = CAP) -> DataFrame:
    """(doc_id, id, component_id, first) of each row of df (doc_id, text): id is a hash of its text, component_id the
    smallest doc_id of its group, `first` whether doc_id and text are those of the group's first document."""
    plan = table_plan(df.count())
    words = max(WORDS, plan[1])
    rows = materialize(fingerprints(df, words), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    prints = materialize(rows.groupBy("id").agg(F.min(order).alias("least"), F.first("words").alias("words")), "prints")
    texts = df.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    roots = components(exact_links(links(prints.select("id", "words"), words, plan, cap), texts, words))
    rooted = prints.select("id", "least").join(roots, prints["id"] == roots["node"], "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    rooted = materialize(rooted, "rooted")
    firsts = rooted.groupBy("root").agg(F.min(F.struct("least", F.col("id").alias("at"))).alias("f")).select("root", "f.least", "f.at")
    named = rooted.select("id", "root").join(firsts, "root").select("id", F.col("least.doc_id").alias("component_id"), "at")
    first = (F.col("id") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    return rows.select("doc_id", "id").join(named, "id").select("doc_id", "id", "component_id", first.alias("first"))


def keep_first(df: DataFrame, cap: int = CAP) -> DataFrame:
    """The rows of df that are the first of their group; of rows alike in id and text one."""
    groups = materialize(similar_groups(df, cap), "groups")
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    lost = groups.where("not first").select(F.col("doc_id").alias("__doc"), F.col("id").alias("__id")).distinct()
    same = (key == F.col("__id")) & F.col("doc_id").eqNullSafe(F.col("__doc"))
    kept = df.join(lost, same, "left_anti")
    again = groups.where("first").groupBy(F.col("doc_id").alias("__doc"), F.col("id").alias("__id")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    again = materialize(again, "again")
    if again.isEmpty():
        return kept
    one = kept.join(again, same, "left_semi").withColumn("__key", key).dropDuplicates(["doc_id", "__key"]).drop("__key")
    return kept.join(again, same, "left_anti").unionByName(one)
