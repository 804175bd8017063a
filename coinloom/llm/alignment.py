"""Alignment of two tokenizers' tokens over the same bytes: a byte-level BPE (A) and a piece BPE with byte fallback (B).

Both tokenizers give where their tokens lie: A in characters, B in bytes of the text. Places
where both have an end are the coarse cuts. Between two of them only a character that tokens
part (several A tokens of one character, or B's byte tokens, whose spans are empty but for
the last) can hide more common ends; these cells are refined by the tokens' own bytes.

A text is aligned in chunks that begin with a space after a character that isn't white
space: no token of either tokenizer reaches over such a place, so a chunk's tokens are the
same wherever it stands, and a worker aligns a chunk once. Corpus counts of linked id pairs:
of two tokens that end together one is a suffix of the other, so the vocabularies alone bound
the pairs, and their counts are small enough to go to every task.

Texts null, empty, or whose tokens don't spell them have no tokens. Texts of any length are
aligned whole; repeated rows count each; an empty table gives an empty table. Only the kept
columns and the text are read, so others can't clash.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_alphabet
from .common import materialize, rows_batches, text_bytes

BATCH_BYTES = 1 << 20
#: Chunks a worker keeps.
CACHE_CHUNKS = 350_000
#: Characters given to the tokenizers at once.
STEP_CHARS = 1 << 16
SPACE = "\u2581"
_CUT = re.compile(r"(?<=[^\s\u180e\u200b\ufeff])(?= +[^ ])")
#: A space that is not a cut on its own: beside another or other white space, or at an end.
_UNEVEN = re.compile(r"[\s\u180e\u200b\ufeff] | \Z|\A ")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Step(NamedTuple):
    """Aligned chunks: groups as text, and by chunk the numbers of A tokens, of B tokens and of groups; the linked pairs' numbers, one a group."""

    groups: list[str]
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    links: np.ndarray


class Aligner:
    """The tokenizers, their tokens' bytes, the numbers of the pairs that can be linked, and the chunks met so far."""

    def __init__(self, file_text: str, model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(file_text)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        to_byte = {c: b for b, c in byte_alphabet().items()}
        names = self.a.get_vocab()
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(to_byte[c] for c in name) if all(c in to_byte for c in name) else name.encode()
        self.b_bytes = [self._piece_bytes(i) for i in range(self.b.get_piece_size())]
        self.keys = possible_pairs(self.a_bytes, self.b_bytes)
        self.written_a = Written(len(self.a_bytes), (",", "|"))
        self.written_b = Written(len(self.b_bytes), (",", ";", ""))
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in of], np.int64) for of in (self.a_bytes, self.b_bytes))
        self._forget()

    def _piece_bytes(self, i: int) -> bytes:
        name = self.b.id_to_piece(i)
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        return bytes([int(_BYTE.fullmatch(name)[1], 16)]) if self.b.is_byte(i) else name.replace(SPACE, " ").encode()

    def _forget(self) -> None:
        """No chunks: their numbers, groups, numbers of tokens and groups, and where their links begin."""
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.n_a, self.n_b, self.n_groups, self.first = (np.zeros(0, np.int64) for _ in range(4))
        self.links = np.zeros(0, np.int32)

    def align(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, list[str]]:
        """By text the numbers of A tokens, B tokens and groups, then all links one after another, and the groups as text."""
        cut = [_chunks(t) if t else [] for t in texts]
        used = set().union(*cut)
        if len(self.number) + len(used) > CACHE_CHUNKS:
            self._forget()
        self._learn([c for c in used if c not in self.number])
        lengths = np.array([len(x) for x in cut], np.int64)
        numbers = np.fromiter(chain.from_iterable([map(self.number.__getitem__, x) for x in cut]), np.int64)
        owner = np.repeat(np.arange(len(cut)), lengths)
        # a text with a chunk that its tokens don't spell has no tokens
        bad = np.bincount(owner[self.n_a[numbers] == 0], minlength=len(cut)) > 0
        numbers = numbers[~bad[owner]]
        lengths = np.where(bad, 0, lengths)
        bounds = np.append(0, np.cumsum(lengths))
        total = lambda x: np.diff(np.append(0, np.cumsum(x[numbers]))[bounds])
        sizes = self.n_groups[numbers]
        ends = np.cumsum(sizes)
        links = self.links[np.repeat(self.first[numbers] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        written = [self.groups[n] for n in numbers.tolist()]
        groups = [";".join(written[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
        return [total(x) for x in (self.n_a, self.n_b, self.n_groups)], links, groups

    def _learn(self, chunks: list[str]) -> None:
        """Chunks one after another are tokenized as each alone, but for spaces at an end, which would join those of the next."""
        spelt = [c for c in chunks if SPACE not in c and c[-1] != " "]
        steps = chain(_steps(spelt), ([c] for c in chunks if SPACE not in c and c[-1] == " "))
        found = [(some, self._step(some)) for some in steps]
        none = [c for c in chunks if SPACE in c]  # B reads the sign as a space
        found.append((none, self._none(len(none))))
        order = list(chain.from_iterable(some for some, _ in found))
        parts = [step for _, step in found]
        self.number.update(zip(order, range(len(self.groups), len(self.groups) + len(order))))
        self.groups += chain.from_iterable(step.groups for step in parts)
        n_groups = np.concatenate([step.n_groups for step in parts])
        self.first = np.append(self.first, len(self.links) + np.cumsum(n_groups) - n_groups)
        self.n_groups = np.append(self.n_groups, n_groups)
        self.n_a = np.concatenate([self.n_a, *[step.n_a for step in parts]])
        self.n_b = np.concatenate([self.n_b, *[step.n_b for step in parts]])
        self.links = np.concatenate([self.links, *[step.links for step in parts]])

    def _none(self, n: int) -> Step:
        zero = np.zeros(n, np.int64)
        return Step([""] * n, zero, zero, zero, np.zeros(0, np.int32))

    def _step(self, chunks: list[str]) -> Step:
        text = "".join(chunks)
        data = text.encode()
        coded = self.a.encode(text, add_special_tokens=False)
        spans = self.b.encode(text[1:], return_type="offset_mapping")  # B puts the space before a text itself
        a, b = np.array(coded.ids, np.int64), np.array(spans["ids"], np.int64)
        if b"".join([self.a_bytes[i] for i in coded.ids]) != data or b"".join([self.b_bytes[i] for i in spans["ids"]]) != data:
            if len(chunks) == 1:
                return self._none(1)
            half = len(chunks) // 2
            first, second = self._step(chunks[:half]), self._step(chunks[half:])
            return Step(first.groups + second.groups, *[np.concatenate(x) for x in list(zip(first, second))[1:]])
        a_spans, b_spans = (np.fromiter(chain.from_iterable(x), np.int64).reshape(-1, 2) for x in (coded.offsets, spans["offsets"]))
        b_spans += 1
        b_spans[0, 0] = 0
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        octets = np.frombuffer(data, np.uint8)
        place = np.append(np.flatnonzero(octets & 0xC0 != 0x80), len(octets))
        cuts, upto_a, upto_b = self._cuts(a_spans, b_spans, ends_a, ends_b, place)
        each_a, each_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        last = np.searchsorted(cuts, place[np.cumsum([len(c) for c in chunks])])  # each chunk's last group
        sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        sign_a[upto_a - 1] = 1
        sign_b[upto_b - 1] = 1
        sign_b[upto_b[last] - 1] = 2
        at_a, at_b = np.arange(len(a)) + np.repeat(upto_b - each_b, each_a), np.arange(len(b)) + np.repeat(upto_a, each_b)
        parts, lengths = np.empty(len(a) + len(b), object), np.zeros(len(a) + len(b), np.int64)
        for at, ids, sign, written in ((at_a, a, sign_a, self.written_a), (at_b, b, sign_b, self.written_b)):
            parts[at] = written.text[sign, ids]
            lengths[at] = written.length[sign, ids]
        whole, ends = "".join(parts.tolist()), np.cumsum(lengths)[upto_a[last] + upto_b[last] - 1].tolist()
        groups = [whole[i:j] for i, j in zip([0, *ends], ends)]
        links = np.searchsorted(self.keys, a[upto_a - 1] << 32 | b[upto_b - 1]).astype(np.int32)
        return Step(groups, np.diff(upto_a[last], prepend=0), np.diff(upto_b[last], prepend=0), np.diff(last, prepend=-1), links)

    def _cuts(self, a_spans: np.ndarray, b_spans: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte places where tokens of both end, and the tokens of each up to there; spans are in characters, `place` has each character's first byte."""
        # a token of A ends at a character's end if the next doesn't begin before it; B's tokens do, but for those of an empty span
        done_a = np.append(a_spans[1:, 0], len(place) - 1) >= a_spans[:, 1]
        done_b = b_spans[:, 0] < b_spans[:, 1]
        coarse = np.intersect1d(a_spans[done_a, 1], b_spans[done_b, 1], assume_unique=True)
        cuts = place[coarse]
        upto_a, upto_b = np.searchsorted(ends_a, cuts) + 1, np.searchsorted(ends_b, cuts) + 1
        each_a, each_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        # ends inside a character: only where both have several tokens and a character has several bytes
        fine = (each_a > 1) & (each_b > 1) & (np.diff(cuts, prepend=0) > np.diff(coarse, prepend=0))
        if not fine.any():
            return cuts, upto_a, upto_b
        cuts = np.union1d(cuts, np.intersect1d(ends_a[np.repeat(fine, each_a)], ends_b[np.repeat(fine, each_b)], assume_unique=True))
        return cuts, np.searchsorted(ends_a, cuts) + 1, np.searchsorted(ends_b, cuts) + 1


def _chunks(text: str) -> list[str]:
    """A space and the text, cut before each space that follows no white space and isn't at the end."""
    return _CUT.split(" " + text) if _UNEVEN.search(text) else [" " + word for word in text.split(" ")]


class Written:
    """Ids as text, each with each sign after it, and the lengths."""

    def __init__(self, n: int, signs: tuple[str, ...]):
        self.text = np.array([[f"{i}{sign}" for i in range(n)] for sign in signs], object)
        self.length = np.array([[len(x) for x in row] for row in self.text], np.int64)


def _steps(chunks: list[str]) -> Iterator[list[str]]:
    step, size = [], 0
    for chunk in chunks:
        step.append(chunk)
        size += len(chunk)
        if size > STEP_CHARS:
            yield step
            step, size = [], 0
    if step:
        yield step


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Pairs of ids whose tokens can end together, sorted, a's in the upper half of a number: one's bytes end with the other's. At most the sum of all lengths, times the ids that share bytes."""
    by_a: dict[bytes, list[int]] = {}
    by_b: dict[bytes, list[int]] = {}
    for names, of in ((a, by_a), (b, by_b)):
        for i, name in enumerate(names):
            if name:
                of.setdefault(name, []).append(i)
    found = array("q")
    for j, name in enumerate(b):
        for k in range(len(name)):
            found.extend([i << 32 | j for i in by_a.get(name[k:], ())])
    for i, name in enumerate(a):
        for k in range(1, len(name)):
            found.extend([i << 32 | j for j in by_b.get(name[k:], ())])
    return np.unique(np.frombuffer(found, np.int64))


@lru_cache(maxsize=2)
def load_aligner(file_text: str, model: bytes) -> Aligner:
    return Aligner(file_text, model)


def align(df: DataFrame, file_text: str, model: bytes, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, `n_a`, `n_b`, `n_groups`, `links` (pair numbers, one a group) and `groups` (`a1,a2|b1;a3|b2`)."""
    shared = df.sparkSession.sparkContext.broadcast((file_text, model))
    made = [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups")]
    made += [T.StructField("links", T.ArrayType(T.IntegerType())), T.StructField("groups", T.StringType())]
    names = [*keep, *[f.name for f in made]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load_aligner(*shared.value)
        collects = gc.isenabled()
        gc.disable()  # lists of spans have no cycles
        try:
            for batch in rows_batches(batches, BATCH_BYTES):
                texts = [b.decode("utf-8", "replace") for b in text_bytes(batch.column(batch.num_columns - 1))]
                totals, links, groups = aligner.align(texts)
                listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(totals[2])), pa.int32()), pa.array(links))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, totals), listed, pa.array(groups, pa.string())], names)
        finally:
            if collects:
                gc.enable()

    df = df.select(*keep, F.col(text_col).alias("__text"))
    return df.mapInArrow(run, T.StructType([*df.schema.fields[:-1], *made]))


def with_counts(aligned: DataFrame, file_text: str, model: bytes) -> DataFrame:
    """All columns but `links`, and of the links: `n_best` (whose pair is the corpus's most frequent of its B id) and `count_sum` (their pairs' counts).

    The table is written once; its pairs are counted by number, a row a possible pair at most.
    """
    rows = materialize(aligned, "aligned")
    keys = load_aligner(file_text, model).keys
    found = rows.select(F.explode("links").alias("pair")).groupBy("pair").count().toArrow()  # len(keys) rows at most
    counts = np.zeros(len(keys), np.int64)
    counts[found["pair"].to_numpy()] = found["count"].to_numpy()
    to = keys & 0xFFFFFFFF
    most = np.zeros(to.max(initial=0) + 1, np.int64)
    np.maximum.at(most, to, counts)
    shared = rows.sparkSession.sparkContext.broadcast((counts, counts == most[to]))
    names = [c for c in rows.columns if c not in ("links", "n_best", "count_sum")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for batch in batches:
            links = batch.column(len(names))
            inside, offsets = links.flatten().to_numpy(), np.append(0, np.cumsum(np.diff(links.offsets.to_numpy())))
            sums = [np.append(0, np.cumsum(of[inside], dtype=np.int64)) for of in (best, counts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *[pa.array(np.diff(x[offsets])) for x in sums]], [*names, "n_best", "count_sum"])

    rows = rows.select(*names, "links")
    made = [T.StructField(n, T.LongType()) for n in ("n_best", "count_sum")]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *made]))
