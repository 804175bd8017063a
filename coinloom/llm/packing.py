"""Best-fit packing of token sequences, after Martello-Toth dominance reduction.

What a packing needs of the table is how many pieces have each length: one row a length,
so at most `capacity` rows, whatever the table. From these the plan is made: sets that
provably dominate every alternative are fixed, the rest goes best-fit decreasing, always a
whole length at a time, so plan and planning are bounded by the capacity too. The pieces
themselves are numbered within their lengths and take their places by number, in Spark.

Null texts are empty; an empty text is its end token alone; texts of any length are cut
whole; repeated rows are pieces of their own; an empty table gives an empty table. Pieces
without a length, or of length 0, have no place (null); one above the capacity is an error.
Columns named like results are left out.
"""

from __future__ import annotations

import json
import math
import os
import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_alphabet
from .common import materialize, rows_batches, text_bytes

BATCH_BYTES = 2 << 20
#: Characters in one call of the tokenizer.
STEP_CHARS = 1 << 18
#: Words and ids that a worker keeps.
CACHE_WORDS, CACHE_IDS = 500_000, 4_000_000


#: Characters that normalisation leaves alone whatever stands beside them, and that a lower-case letter, or none, stands for: ASCII, Latin (but dotted I), Cyrillic and dashes, quotes and bullets.
_SETTLED = re.compile("[\x00-\x7f\xa1-įı-ſЀ-ҁҊ-ԯ‐-‧‰-‴]*")
#: Letters, digits and white space among these, lower case.
_LETTERS, _DIGITS, _BLANKS = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſЀ-ҁҊ-ԯ", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t\n\x0b\x0c\r"


class LibraryModel:
    """The tokenizers library, one call for many distinct words.

    Texts of settled characters are cut into words here, by the tokenizer's own pattern; the
    words go to its merges as they are, a word's last token being the one that ends a word. A
    worker keeps the tokens of words it has met. Other texts, and those with a special token,
    go through the whole tokenizer.
    """

    def __init__(self, file_text: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        spec = json.loads(file_text)
        self.whole = _plain(Tokenizer.from_str(file_text))
        bare = spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
        self.merges = _plain(Tokenizer.from_str(json.dumps(bare)))
        names = spec["model"]["vocab"]
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.specials = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        for name, inside in ((r"\p{L}", _LETTERS), (r"\p{N}", _DIGITS), (r"\s", _BLANKS)):
            split = split.replace(f"[{name}]", f"[{inside}]").replace(name, inside)
        self.words = re.compile(split)
        self.letters = byte_alphabet()
        self._forget()

    def _forget(self) -> None:
        """No words: their numbers, where their ids begin, how many they are."""
        self.number: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after another, and how many each has."""
        cut = [self._split(t) for t in texts]
        used = set().union(*[x for x in cut if x is not None])
        if len(self.number) + len(used) > CACHE_WORDS or len(self.ids) > CACHE_IDS:
            self._forget()
        self._learn([w for w in used if w not in self.number])
        lone = [np.array(self.whole.encode(t, add_special_tokens=False).ids, np.int32) for t, x in zip(texts, cut) if x is None]
        get = self.number.__getitem__
        numbers = np.fromiter(chain.from_iterable([map(get, x) for x in cut if x is not None]), np.int64)
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[numbers] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        words = np.array([len(x) for x in cut if x is not None], np.int64)
        found = np.append(0, ends)[np.cumsum(words)]
        if not lone:
            return ids, np.diff(found, prepend=0)
        settled, others, parts = iter(np.split(ids, found[:-1]) if len(found) else ()), iter(lone), []
        for x in cut:
            parts.append(next(others) if x is None else next(settled))
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _split(self, text: str) -> list[str] | None:
        if not (text.isascii() or _SETTLED.fullmatch(text)) or "<" in text and self.specials.search(text):
            return None
        return self.words.findall(text.lower())

    def _learn(self, words: list[str]) -> None:
        letters = self.letters
        for some in _steps(words):
            spelt = [w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()]) for w in some]
            ids = np.array(self.merges.encode_batch_fast([" ".join(spelt)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            starts = np.append(0, ends[:-1])
            self.number.update(zip(some, range(len(self.starts), len(self.starts) + len(some))))
            self.starts = np.append(self.starts, starts + len(self.ids))
            self.sizes = np.append(self.sizes, ends - starts)
            self.ids = np.append(self.ids, ids)


def _plain(tokenizer):
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _steps(items: list[str]) -> Iterator[list[str]]:
    """The items in lists of some ten thousands, long ones in shorter lists."""
    step, size = [], 0
    for x in items:
        step.append(x)
        size += len(x) + 1
        if size > STEP_CHARS:
            yield step
            step, size = [], 0
    if step:
        yield step


@lru_cache(maxsize=4)
def library_model(file_text: str) -> LibraryModel:
    return LibraryModel(file_text)


def encode_pieces(df: DataFrame, tokenizer_json: str, capacity: int, end_id: int, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, `piece`, `start`, `length` and `token_ids`: every text's ids and then end_id, cut only where longer than the capacity."""
    spec = df.sparkSession.sparkContext.broadcast(tokenizer_json)
    made = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType()))]
    names = [*keep, *[f.name for f in made]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = library_model(spec.value)
        for batch in rows_batches(batches, BATCH_BYTES):
            texts = [b.decode("utf-8", "replace") for b in text_bytes(batch.column(batch.num_columns - 1))]
            ids, sizes = model.encode(texts)
            ids = np.insert(ids, np.cumsum(sizes), end_id)
            sizes = sizes + 1
            pieces = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            offsets = np.append(0, np.cumsum(length))
            cut = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32, copy=False)))
            kept = [c.take(pa.array(row)) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), cut], names)

    df = df.select(*keep, F.col(text_col).alias("__text"))
    return df.mapInArrow(run, T.StructType([*df.schema.fields[:-1], *made]))


class Fixed(NamedTuple):
    """A set of lengths that shares a sequence, so many times."""

    times: int
    lengths: tuple[int, ...]


def reduce_dominated(counts: dict[int, int], capacity: int) -> list[Fixed]:
    """Sets that some best packing holds, taken out of counts (pieces a length).

    For a piece, longest first, with room beside it: alone if nothing fits; with the longest
    that fits if that fills the sequence, if no two fit, or if that is as long as any two that
    fit; with the best two if the longer is the longest that fits and no two pieces longer
    than the shorter fit. Such a set can take the place of the piece's set in any packing, as
    what it drives out fits where its members were.
    """
    fixed: list[Fixed] = []
    live = sorted(n for n in counts if counts[n])

    def take(times: int, lengths: tuple[int, ...]) -> None:
        fixed.append(Fixed(times, lengths))
        for length, n in Counter(lengths).items():
            counts[length] -= n * times
            if not counts[length]:
                live.remove(length)

    changed = True
    while changed:
        changed = False
        for long in reversed(live.copy()):
            while counts[long] and (lengths := _dominating(counts, live, long, capacity - long)):
                take(min(counts[x] // n for x, n in Counter(lengths).items()), lengths)
                changed = True
    return fixed


def _dominating(counts: dict[int, int], live: list[int], long: int, room: int) -> tuple[int, ...] | None:
    """The set that a piece `long` may be fixed in with what is left (live: the lengths, ascending), if one is known."""
    # the three shortest of the others: whether none, one, two or more fit together
    short = []
    for length in live:
        short += [length] * min(3, counts[length] - (length == long))
        if len(short) >= 3:
            break
    fit = sum(total <= room for total in accumulate(short[:3]))
    if not fit:
        return (long,)
    at = bisect_right(live, room) - 1
    if live[at] == long and counts[long] == 1:
        at -= 1
    most = live[at]
    if fit == 1 or most == room:
        return long, most
    if fit == 2:
        others = np.array(live if counts[long] > 1 else [x for x in live if x != long])
        second = np.searchsorted(others, room - others, "right") - 1
        beside = np.where(second >= 0, others[second], 0)
        # one piece can't be both
        few = np.array([counts[int(x)] - (x == long) for x in others])
        twice = (beside == others) & (few < 2)
        beside = np.where(twice, np.where(second > 0, others[second - 1], 0), beside)
        total = np.where((beside > 0) & (others + beside <= room), others + beside, 0)
        best = int(total.argmax())
        a, b = sorted((int(others[best]), int(beside[best])), reverse=True)
        if most >= a + b:
            return long, most
        if most == a:
            longer = []
            for x in live[bisect_right(live, b) :]:
                longer += [x] * min(2, counts[x] - (x == long))
                if len(longer) >= 2:
                    break
            if len(longer) < 2 or longer[0] + longer[1] > room:
                return long, a, b
    return None


class Span(NamedTuple):
    """Pieces of one length by number, from `first` on: `each` a sequence, from sequence `sequence` on, placed from `offset` on."""

    first: int
    length: int
    each: int
    sequence: int
    offset: int


class _Like(NamedTuple):
    """So many sequences filled alike: spans with the sequences still to be numbered."""

    times: int
    spans: tuple[tuple[int, int, int, int], ...]

    def split(self, times: int) -> tuple[_Like, _Like]:
        rest = tuple((first + times * each, length, each, offset) for first, length, each, offset in self.spans)
        return _Like(times, self.spans), _Like(self.times - times, rest)

    def plus(self, first: int, length: int, each: int, offset: int) -> _Like:
        return _Like(self.times, (*self.spans, (first, length, each, offset)))


def plan(counts: dict[int, int], capacity: int, reduce: bool = True) -> tuple[list[Span], int]:
    """Places for all pieces, numbered by length and then within it, and the number of sequences.

    A step of the best fit places as many pieces of a length as sequences of the best residual
    take. It makes two more sorts of sequences at most, so there are a few for each length.
    """
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError(f"a piece is longer than {capacity}")
    number = dict(zip(sorted(counts), accumulate((counts[n] for n in sorted(counts)), initial=0)))
    left = dict(counts)
    done: list[_Like] = []

    def numbered(length: int, n: int) -> int:
        number[length] += n
        return number[length] - n

    for times, lengths in reduce_dominated(left, capacity) if reduce else ():
        offsets = accumulate(lengths, initial=0)
        done.append(_Like(times, tuple((numbered(x, times), x, 1, offset) for x, offset in zip(lengths, offsets))))

    open_: dict[int, list[_Like]] = {capacity: [_Like(sum(left.values()), ())]}
    residuals = [capacity]

    def put(residual: int, like: _Like) -> None:
        if not residual:
            done.append(like)
        elif like.times:
            if residual not in open_:
                insort(residuals, residual)
            open_.setdefault(residual, []).append(like)

    for length in sorted((x for x in left if left[x]), reverse=True):
        n = left[length]
        while n:
            residual = residuals[bisect_left(residuals, length)]
            like = open_[residual].pop()
            if not open_[residual]:
                del open_[residual]
                residuals.remove(residual)
            each = residual // length
            full = min(like.times, n // each)
            if full:
                filled, like = like.split(full)
                put(residual - each * length, filled.plus(numbered(length, full * each), length, each, capacity - residual))
                n -= full * each
            if n and n < each and like.times:
                last, like = like.split(1)
                put(residual - n * length, last.plus(numbered(length, n), length, n, capacity - residual))
                n = 0
            put(residual, like)

    spans, sequence = [], 0
    for times, inside in (*done, *(like for group in open_.values() for like in group if like.spans)):
        spans += [Span(first, length, each, sequence, offset) for first, length, each, offset in inside]
        sequence += times
    return sorted(spans), sequence


def pack(pieces: DataFrame, capacity: int, length_col: str = "length") -> DataFrame:
    """All columns, and each piece's `sequence_id` and `offset` there.

    The table is written once with a number a row, which orders equal rows for good. Numbers
    within a length come from counts by (length, bucket): there are about as many buckets as
    a bucket has rows, so neither a common length nor the counts of one meet in one task.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    size = F.coalesce(F.col(f"`{length_col}`").cast("long"), F.lit(0)).alias("__length")
    rows = materialize(pieces.select(*[F.col(f"`{c}`") for c in names], size, F.monotonically_increasing_id().alias("__row")), "pieces")
    found = rows.groupBy("__length").count().limit(capacity + 2).collect()  # a row a length: `capacity`, 0 and one too long
    counts = {r["__length"]: r["count"] for r in found if r["__length"]}
    spans, _ = plan(counts, capacity)
    lengths = sorted(counts)
    base = np.zeros((lengths[-1] if lengths else 0) + 2, np.int64)
    for length, before in zip(lengths, accumulate((counts[n] for n in lengths), initial=0)):
        base[length] = before
    shared = rows.sparkSession.sparkContext.broadcast((base, *np.array(spans or [(0, 0, 1, 0, 0)], np.int64).T))

    buckets = math.isqrt(sum(r["count"] for r in found)) + 1
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("__row"), F.lit(buckets)))
    upto = Window.partitionBy("__length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("__length", "__bucket").agg(F.count("*").alias("__n"))
    cells = cells.select("__length", "__bucket", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__length", "__bucket").orderBy("__row"))
    placed = rows.withColumn("__place", inside - 1).join(cells, ["__length", "__bucket"])
    n, fields = len(names), rows.schema.fields[: len(names)]
    # by number, as names with dots can't go to Python
    placed = placed.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)], "__length", (F.col("__before") + F.col("__place")).alias("__number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, first, length, each, sequence, offset = shared.value
        for batch in batches:
            own = batch.column(n).to_numpy()
            number = base[own] + batch.column(n + 1).to_numpy()
            at = np.searchsorted(first, number, "right") - 1
            turn = number - first[at]
            none = own == 0
            found = [pa.array(sequence[at] + turn // each[at], mask=none), pa.array(offset[at] + turn % each[at] * length[at], mask=none)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *found], [*names, "sequence_id", "offset"])

    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return placed.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """`sequence_id`, `token_ids` and `boundaries` (where each piece begins) of the sequences; one holds `capacity` tokens at most."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "token_ids")))
    whole = packed.where("sequence_id IS NOT NULL").groupBy("sequence_id").agg(inside.alias("__pieces"))
    return whole.select("sequence_id", F.flatten("__pieces.token_ids").alias("token_ids"), F.col("__pieces.offset").alias("boundaries"))
