"""Line dedup: winnowing, positions joined, matches extended both ways.

The result: a word goes if and only if it lies in a run of min_words words or more that
occurred earlier (by id, then word). Lines that lose all their words go with their line
end, other lines keep their remaining words, blank lines stay. Words are the runs between
ASCII white space and are compared as bytes. Runs may start and end inside lines, so the
hashes that are winnowed are those of word k-grams, not of whole lines: hashes of whole
lines can't see a passage that is broken into lines differently.

1. Winnowing. Of each window of min_words words the least k-gram hash is its fingerprint.
   Only the selected minima are stored, with their place and the run of windows that
   selected them (a span). Equal windows have equal fingerprints at equal places in them.
2. Joining positions. Fingerprints that occur once are no repeats. A place whose whole span
   equals that of an earlier place is matched to the earliest one.
3. Extending. Places of one fingerprint whose spans differ agree up to some word to the
   left and to the right. From the earliest place of each different span the match is
   carried on window by window both ways; the earliest place of a window always lies in
   the earliest span of its content, so no repeat is lost.
4. All windows but the earliest of their content are deleted.

Null texts stay null; texts of which every word goes become empty, but for blank lines;
rows without an id keep their text and lend none; rows that share an id are documents of
their own, in the order of a hash of their texts, rows alike in id and text are one; very
long texts are read whole; an empty table gives an empty table. Equality is that of 64-bit
hashes. A text that repeats itself with overlaps keeps only the words before its second
occurrence. Other columns pass through; internal names begin with two underscores.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_by_count, materialize, maybe_in, rows_batches, text_bytes

MIN_WORDS = 50
#: Bytes of text winnowed at a time; a longer text stands alone.
WINNOWED = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_DOC = ("id", "h")


class WordHashes:
    """Prefix sums over the word hashes of texts laid end to end, from which any run's hash follows."""

    powers = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __init__(self, *texts: bytes):
        words = [t.split() for t in texts]
        self.counts = np.array([len(w) for w in words], np.int64)
        self.n = int(self.counts.sum())
        if len(self.powers[0]) <= self.n:
            WordHashes.powers = tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(2 * self.n, b, np.uint64)))) for b in (_BASE, _BACK))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, self.n)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * self.powers[0][: self.n])))

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = (self.sums[ends] - self.sums[starts]) * self.powers[1][starts]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def spans(texts: list[bytes], min_words: int = MIN_WORDS) -> np.ndarray:
    """(text, first window, last window, fingerprint, content hash) of each selected minimum; windows are numbered by their first word."""
    words = WordHashes(*texts)
    if words.n < min_words:
        return np.zeros((0, 5), np.int64)
    k = max(1, min_words // 5)
    at = np.arange(words.n - k + 1)
    grams = words.runs(at, at + k)
    least, width, reach = grams, 1, min_words - k + 1
    while width < reach:
        step = min(width, reach - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    windows = len(least)
    owner = np.repeat(np.arange(len(texts)), words.counts)[:windows]
    ends = np.cumsum(words.counts)
    across = at[:windows] + min_words > ends[owner]  # from one text into the next: no window of either
    begins = across.copy()
    begins[0] = True
    begins[1:] |= (least[1:] != least[:-1]) | (grams[: windows - 1] == least[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(begins)
    last = np.concatenate((first[1:], [windows])) - 1
    first, last = first[~across[first]], last[~across[first]]
    of = owner[first]
    zero = (ends - words.counts)[of]
    return np.stack([of, first - zero, last - zero, least[first].view(np.int64), words.runs(first, last + min_words).view(np.int64)], 1)


def winnow(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, h, first, last, print, content) of every selected minimum of docs (id, h, text)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_batches(batches, WINNOWED):
            found = spans(text_bytes(batch.column(2)), min_words)
            owner, *columns = (pa.array(found[:, i].copy()) for i in range(5))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), *columns], ["id", "h", "first", "last", "print", "content"])

    return docs.select("id", "h", "text").mapInArrow(run, f"id {kind}, h long, first long, last long, print long, content long")


def extend(docs: DataFrame, ranges: DataFrame, min_words: int) -> DataFrame:
    """(id, h, first, content) of each window in the listed ranges (id, h, first, last) of docs."""
    # disjoint ranges of one document
    listed = materialize(ranges.groupBy(*_DOC).agg(F.collect_list("first").alias("a"), F.collect_list("last").alias("b")), "ranges")
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_batches(batches):
            starts, hashes = [], []
            for i, text in enumerate(text_bytes(batch.column(2))):
                words = WordHashes(text)
                a, b = (batch.column(c)[i].values.to_numpy() for c in (3, 4))
                first = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(a, b)]))
                starts.append(first)
                hashes.append(words.runs(first, first + min_words).view(np.int64))
            owner = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in starts]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(np.concatenate(starts)), pa.array(np.concatenate(hashes))], ["id", "h", "first", "content"])

    texts = maybe_in(docs.select("id", "h", "text"), listed, _DOC).join(listed, list(_DOC))
    return texts.select("id", "h", "text", "a", "b").mapInArrow(run, f"id {kind}, h long, first long, content long")


def _later(rows: DataFrame, keys: list[str], origins: DataFrame) -> DataFrame:
    repeated = origins.where("n > 1").select(*keys, "n", "origin")
    return join_by_count(rows, repeated, keys).where(F.struct(*_DOC, "first") > F.col("origin"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, h, first, end): word ranges of windows of docs (id, h, text) that occurred earlier."""
    found = materialize(winnow(docs, min_words), "minima")
    prints = materialize(found.groupBy("print").agg(F.count("*").alias("n")).where("n > 1"), "prints")
    joined = materialize(join_by_count(found, prints, ["print"], "left_semi"), "joined")
    origin = F.min(F.struct(*_DOC, "first")).alias("origin")
    earliest = materialize(joined.groupBy("print", "content").agg(F.count("*").alias("n"), origin, F.min(F.col("last") - F.col("first")).alias("more")), "earliest")
    whole = _later(joined, ["print", "content"], earliest).select(*_DOC, "first", (F.col("last") + min_words).alias("end"))
    several = earliest.groupBy("print").agg(F.count("*").alias("n")).where("n > 1")
    differing = join_by_count(earliest.drop("n"), materialize(several, "differing"), ["print"], "left_semi")
    ranges = differing.select("origin.id", "origin.h", "origin.first", (F.col("origin.first") + F.col("more")).alias("last"))
    windows = materialize(extend(docs, ranges, min_words), "windows")
    twice = materialize(windows.groupBy("content").agg(F.count("*").alias("n")).where("n > 1").select("content"), "twice")
    windows = materialize(maybe_in(windows, twice, ("content",)), "repeated")
    borders = _later(windows, ["content"], materialize(windows.groupBy("content").agg(F.count("*").alias("n"), origin), "borders"))
    return whole.unionByName(borders.select(*_DOC, "first", (F.col("first") + min_words).alias("end")))


def cut_words(text: bytes, first: np.ndarray, end: np.ndarray) -> tuple[bytes, int]:
    """The text without the words in the ranges, and the number of lines that went."""
    edges = np.zeros(len(text.split()) + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, end, -1)
    gone = np.cumsum(edges) > 0
    out, at, deleted = [], 0, 0
    for line in text.split(b"\n"):
        words = line.split()
        lost = gone[at : at + len(words)]
        at += len(words)
        if not lost.any():
            out.append(line)
        elif lost.all():
            deleted += 1
        else:
            kept, place = [], 0
            for word, cut in zip(words, lost):
                begin = line.index(word, place)
                if not cut:
                    kept.append(line[place:begin] + word if kept else word)
                place = begin + len(word)
            out.append(b"".join(kept))
    return b"\n".join(out), deleted


def drop_repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of df, texts without the later copies of repeated runs, `__deleted_words` and `__deleted_lines`."""
    row_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    docs = df.where(row_id.isNotNull() & text.isNotNull()).select(row_id.alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    runs = repeated_runs(docs, min_words).groupBy(F.col("id").alias("__id"), F.col("h").alias("__h")).agg(F.collect_set(F.struct("first", "end")).alias("__runs"))
    cuts = runs.select("__id", "__h", F.col("__runs.first").alias("__first"), F.col("__runs.end").alias("__end"))
    joined = df.join(cuts, (row_id == F.col("__id")) & (F.xxhash64(text) == F.col("__h")), "left").drop("__id", "__h")
    names, at, n = df.columns, df.columns.index(text_col), len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_batches(batches):
            hit = np.flatnonzero(batch.column(n).is_valid().to_numpy(zero_copy_only=False))
            texts = batch.column(at).to_pylist() if len(hit) else batch.column(at)
            words, lines = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i in hit:
                old = texts[i].encode()
                new, lines[i] = cut_words(old, *(batch.column(c)[int(i)].values.to_numpy() for c in (n, n + 1)))
                words[i] = len(old.split()) - len(new.split())
                texts[i] = new.decode()
            columns = list(batch.columns[:n])
            columns[at] = pa.array(texts, batch.schema.field(at).type) if len(hit) else texts
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words), pa.array(lines)], [*names, "__deleted_words", "__deleted_lines"])

    schema = T.StructType([*df.schema.fields, T.StructField("__deleted_words", T.LongType()), T.StructField("__deleted_lines", T.LongType())])
    return joined.mapInArrow(run, schema)
