"""BPE encoding and decoding by a prefix-sharing trie.

In a byte-pair encoding the last token of a prefix fixes the encoding of that prefix:
token t ends a prefix when the pair (last token of what precedes t, t) is one that the
merges leave alone. The distinct words of an Arrow batch go into a trie; one depth-first
walk hands each node's last token to its children, so a shared prefix is encoded once.

Null texts are empty; empty texts have no tokens; texts of any length are encoded whole;
repeated rows are encoded alike; an empty table gives an empty table. Only the id column
and the text column are read, so other columns can't clash.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .affix import EndingEntries
from .common import rows_batches, text_bytes

#: Chunks kept between batches and tasks of a worker; when full, those of the current batch stay.
CACHE_CHUNKS = 300_000
#: Longer chunks are encoded each time they occur, so the store's memory is bounded.
CACHE_CHARS = 80
#: Token pairs whose fit is remembered.
MOST_PAIRS = 400_000
BATCH_BYTES = 2 << 20
END = "\n"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Letters and numbers that Unicode 16 adds to Python's tables (15.1). Fixed values.
ADDED_IN_16 = {
    "L": "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E 11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0",
    "N": "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA",
}


#: Marks that Unicode gave a combining class, or a composition, after the tokenizer's composition tables (9.0); to it they begin anew. Fixed values.
NEWER_MARKS = """07FD-07FD 0898-089F 08CA-08D3 09FE-09FE 0C3C-0C3C 0D3B-0D3C 0EBA-0EBA 1715-1715 1ABF-1ACE 1DF6-1DFA A82C-A82C
    10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070-11070 1133B-1133B 1145E-1145E 11839-1183A 11930-11930
    1193D-1193E 11943-11943 119E0-119E0 11A34-11A34 11A47-11A47 11A99-11A99 11D42-11D42 11D44-11D45 11D97-11D97 11F41-11F42
    16FF0-16FF1 1E08F-1E08F 1E130-1E136 1E2AE-1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"""
_NEWER = re.compile("([" + "".join(f"\\U{a:0>8}-\\U{b:0>8}" for a, b in (span.split("-") for span in NEWER_MARKS.split())) + "]+)")


def composed(text: str) -> str:
    """NFC as the tokenizer's tables have it: what they don't know stays as it is, in its order."""
    parts = _NEWER.split(text)
    parts[::2] = [unicodedata.normalize("NFC", part) for part in parts[::2]]
    return "".join(parts)


def category_class(major: str) -> str:
    """The characters of a Unicode 16 major category as the inside of a character class."""
    flags = [unicodedata.category(chr(c))[0] == major for c in range(0x110000)]
    for span in ADDED_IN_16[major].split():
        first, last = (int(x, 16) for x in span.split("-"))
        flags[first : last + 1] = [True] * (last + 1 - first)
    starts = [c for c, (a, b) in enumerate(zip([False, *flags], flags)) if b and not a]
    ends = [c for c, (a, b) in enumerate(zip(flags, [*flags[1:], False])) if a and not b]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


def newer_lower_case() -> dict[int, int]:
    """Lower case of letters newer than Python's tables (Unicode 16 and 17, as the tokenizer's): pairs, and two alphabets by distance. Fixed values."""
    pairs = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
    return pairs | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


class BpeModel:
    """Vocabulary, merges and split rules of one tokenizer file with word ends."""

    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = self.vocab
        self.made: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            out = ids[a + b]
            self.made[ids[a], ids[b]] = (rank, out)
            self.parts.setdefault(out, (rank, ids[a], ids[b]))
        end = len(self.suffix)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        # END stands for the word's end, so that what may end a word is an entry of its own
        self.ending = EndingEntries({t[:-end] + END if end and t.endswith(self.suffix) else t: i for t, i in ids.items() if t not in self.special})
        self.alphabet = {b: c for b, c in byte_alphabet().items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # the tokenizer's classes are those of Unicode 16; chunks hold no white space
        pattern = split["pattern"]["Regex"].replace(r"[^\s", "[^")
        for major in "LN":
            pattern = pattern.replace(rf"[\p{{{major}}}]", rf"[{category_class(major)}]").replace(rf"\p{{{major}}}", category_class(major))
        self.pieces = re.compile(pattern)
        self.specials = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        # letter by letter: no final sigma
        self.lower = newer_lower_case() | {ord("Σ"): ord("σ")}
        self.pairs: dict[int, bool] = {}
        self.store: dict[str, bytes] = {}

    def keeps(self, left: int, right: int) -> bool:
        """Whether the merges leave the tokens left, right side by side: no pair across the seam merges before both are whole."""
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 20 | right] = self._seam(left, right)
        return known

    def _seam(self, left: int, right: int) -> bool:
        # The edges of both tokens change as they grow; a merge across the seam wins if it ranks before the next growth
        # (at equal rank the leftmost pair merges first).
        lefts, rights = [left], [right]
        while lefts[-1] in self.parts:
            lefts.append(self.parts[lefts[-1]][2])
        while rights[-1] in self.parts:
            rights.append(self.parts[rights[-1]][1])
        a, b = lefts.pop(), rights.pop()
        while True:
            grow_a = self.parts[lefts[-1]][0] if lefts else None
            grow_b = self.parts[rights[-1]][0] if rights else None
            across = self.made.get((a, b))
            if across and (grow_a is None or across[0] < grow_a) and (grow_b is None or across[0] <= grow_b):
                return False
            if grow_a is None and grow_b is None:
                return True
            if grow_b is None or (grow_a is not None and grow_a <= grow_b):
                a = lefts.pop()
            else:
                b = rights.pop()

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Token ids, as int32 bytes, of each distinct word (in the byte alphabet).

        A trie node maps a character to a node, or to the word itself where only one goes on;
        "" holds the words whose last character comes next.
        """
        root: dict = {}
        deepest = 0
        for word in words:
            node, end = root, len(word) - 1
            deepest = max(deepest, end)
            for i, c in enumerate(word):
                if i == end:
                    node.setdefault("", []).append(word)
                    break
                child = node.get(c)
                if child is None:
                    node[c] = word
                    break
                if child.__class__ is str:
                    lone, child = child, {}
                    node[c] = child
                    if len(lone) == i + 2:
                        child[""] = [lone]
                    else:
                        child[lone[i + 1]] = lone
                node = child
        out: dict[str, bytes] = {}
        ending, pairs, seam = self.ending, self.pairs, self.keeps
        last, size = [-1] * (deepest + 2), [0] * (deepest + 2)  # of each prefix on the path: its last token, that token's length

        def finish(word: str, depth: int, state: str) -> None:
            for length, token in ending[state + word[-1] + END][1]:
                before = last[depth + 2 - length]
                if before < 0 or (pairs[k] if (k := before << 20 | token) in pairs else seam(before, token)):
                    break
            ids, at = [token], depth + 2 - length
            while at:
                ids.append(last[at])
                at -= size[at]
            ids.reverse()
            out[word] = array("i", ids).tobytes()

        stack: list[tuple[dict, int, str, int, int]] = [(root, 0, "", -1, 0)]
        while stack:
            node, depth, state, last[depth], size[depth] = stack.pop()
            for c, child in node.items():
                if not c:
                    for word in child:
                        finish(word, depth, state)
                    continue
                at, after, rest = depth, state, c if child.__class__ is dict else child[depth:-1]
                for c in rest:
                    after, tokens = ending[after + c]
                    at += 1
                    for length, token in tokens:
                        before = last[at - length]
                        if before < 0 or (pairs[k] if (k := before << 20 | token) in pairs else seam(before, token)):
                            break
                    last[at], size[at] = token, length
                if child.__class__ is dict:
                    stack.append((child, at, after, token, length))
                else:
                    finish(child, at, after)
        return out

    def _normal(self, chunk: str) -> str:
        if not chunk.isascii():
            chunk = composed(chunk).translate(self.lower)
        return chunk.lower()

    def encode_chunks(self, chunks: Iterable[str]) -> dict[str, bytes]:
        """Token ids, as int32 bytes, of pieces of text without white space."""
        words = self._words
        split = {c: self._with_specials(c) if "<" in c else words(c) for c in chunks}
        known = self.encode_words(set(chain.from_iterable(split.values())) - self.special.keys())
        known |= {name: array("i", [i]).tobytes() for name, i in self.special.items()}
        get = known.__getitem__
        return {c: get(parts[0]) if len(parts) == 1 else b"".join(map(get, parts)) for c, parts in split.items()}

    def _with_specials(self, chunk: str) -> list[str]:
        """Words and special tokens; no word equals a special, as the split pattern parts a special's marks from its letters."""
        parts: list[str] = []
        at = 0
        for found in self.specials.finditer(chunk) if self.specials else ():
            parts += [*self._words(chunk[at : found.start()]), found[0]]
            at = found.end()
        return parts + self._words(chunk[at:])

    def _words(self, text: str) -> list[str]:
        if text.isascii() and text.isprintable():
            return self.pieces.findall(text.lower())
        letters = self.alphabet
        return [w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()]) for w in self.pieces.findall(self._normal(text))]


@lru_cache(maxsize=4)
def load_model(file_text: str) -> BpeModel:
    return BpeModel(file_text)


@lru_cache(maxsize=4)
def token_names(file_text: str) -> dict[int, str]:
    """The string of every id, specials included."""
    spec = json.loads(file_text)
    return {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec.get("added_tokens", [])}


#: White space that the tokenizer's \s takes; the four separators U+001C-1F, which str.split() takes too, are not among it.
_GAP = regex.compile(r"\s+")
_ODD = regex.compile("[\x1c-\x1f]")


def _chunks(text: str) -> list[str]:
    return [c for c in _GAP.split(text) if c] if _ODD.search(text) else text.split()


def encode_texts(model: BpeModel, texts: list[str], store: dict[str, bytes]) -> list[bytes]:
    """The ids of each text as int32 bytes; store keeps the chunks met before."""
    split = [_chunks(t) for t in texts]
    used = set().union(*split)
    new = used - store.keys()
    if len(store) + len(new) > CACHE_CHUNKS:
        for chunk in store.keys() - used:
            del store[chunk]
    found = model.encode_chunks(new)
    store.update((c, ids) for c, ids in found.items() if len(c) <= CACHE_CHARS)
    get = store.__getitem__
    if all(len(c) <= CACHE_CHARS for c in new):
        return [b"".join(map(get, chunks)) for chunks in split]
    return [b"".join([store[c] if c in store else found[c] for c in chunks]) for chunks in split]


def encode(df: DataFrame, tokenizer_json: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and `token_ids`, the ids of every whole text as the tokenizer gives them without added specials."""
    spec = df.sparkSession.sparkContext.broadcast(tokenizer_json)
    names = [*keep, "token_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(spec.value)
        collects = gc.isenabled()
        gc.disable()  # tries are freed by reference counts; walking them for cycles takes a quarter of the time
        try:
            for batch in rows_batches(batches, BATCH_BYTES):
                texts = [b.decode("utf-8", "replace") for b in text_bytes(batch.column(batch.num_columns - 1))]
                ids = encode_texts(model, texts, model.store)
                offsets = np.zeros(len(ids) + 1, np.int64)
                np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names)
        finally:
            if collects:
                gc.enable()

    df = df.select(*keep, F.col(text_col).alias("__text"))
    return df.mapInArrow(run, T.StructType([*df.schema.fields[:-1], T.StructField("token_ids", T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, tokenizer_json: str, ids_col: str = "token_ids") -> DataFrame:
    """All columns of df and `decoded`: the tokens' own strings with one space between, specials included; null ids are none."""
    spec = df.sparkSession.sparkContext.broadcast(tokenizer_json)
    df = df.drop("decoded")
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = token_names(spec.value).__getitem__
        for batch in rows_batches(batches, BATCH_BYTES):
            texts = [" ".join(map(get, ids.values.to_numpy(zero_copy_only=False).tolist())) if ids.is_valid else "" for ids in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())]))
