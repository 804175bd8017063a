"""Quality classifier: a generalised additive model with pairwise interactions.

Features are dense measures of a text. Cyclic boosting visits one feature after another
and adds a shallow tree over its bins, shrunk, to the feature's lookup table; then the
pairs of features that explain most of what is left get two-dimensional tables in the same
way. A text's score is the logistic of a sum of table entries, looked up by bin for a whole
Arrow batch at once.

Null texts are empty; empty texts have a score too; very long texts are measured whole;
repeated rows are scored alike; an empty table gives an empty table; without labels of
both kinds the tables are zero and the score is the labels' smoothed mean. Only the id and
text columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, rows_batches
from .textbatch import TextBlock, blocks, duplicate_lines, repeated_window_words

#: Bound of the training sample.
TRAIN_ROWS = 8000
SEED = 10
BINS = 32
PAIR_BINS = 12
PAIRS = 6
ROUNDS = 120
PAIR_ROUNDS = 60
RATE = 0.15
FEATURES = ("log_words", "word_length", "symbols", "upper", "digits", "marks", "bars", "shouts", "other_bytes", "dup_lines", "repeats", "distinct", "stutter", "line_words", "last_mark", "longest_word")


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_CLASSES = [_class(b"#*$%&<>"), _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b".,;:?'\"()-"), _class(b"|"), _class(b"!"), _class(bytes(range(128, 256)))]


def features(block: TextBlock) -> np.ndarray:
    """A row of FEATURES for each text of the block."""
    starts, ends, owner = block.words()
    n = np.bincount(owner, minlength=block.n)
    some, size = np.maximum(n, 1), np.maximum(np.diff(block.offsets), 1)
    hashes = block.span_hash(starts, ends, lower=True)
    order = np.lexsort((hashes, owner))
    first = np.ones(len(order), bool)
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    lines = 1 + block.per_text(block.data == 10)
    longest = np.zeros(block.n)
    np.maximum.at(longest, owner, ends - starts)
    ending = _CLASSES[3][block.data[ends - 1]] if len(ends) else np.zeros(0, bool)
    columns = [
        np.log1p(n),
        np.bincount(owner, ends - starts, minlength=block.n) / some,
        *(block.per_text(c[block.data]) / size for c in _CLASSES),
        duplicate_lines(block, starts) / lines,
        repeated_window_words(hashes, owner, block.n) / some,
        np.bincount(owner[order][first], minlength=block.n) / some,
        np.bincount(owner[again], minlength=block.n) / some,
        n / lines,
        np.bincount(owner[ending], minlength=block.n) / some,
        longest,
    ]
    return np.stack(columns, 1).astype(np.float64)


def edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


def to_bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], 1)


def _gain(g, h):
    return g * g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best cut of a histogram of gradients: (gain, bins on the left)."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    best = int(gain.argmax())
    return float(gain[best]), best + 1


def tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A value a bin from the best-first tree with so many leaves."""
    spans = [(0, len(g))]
    while len(spans) < leaves:
        cuts = [(*_split(g[a:b], h[a:b]), a, b) for a, b in spans]
        gain, at, a, b = max(cuts, key=lambda c: c[0])
        if gain <= 1e-12:
            break
        spans.remove((a, b))
        spans += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the tree that cuts the first feature once and each side by the second."""
    best, out = -1.0, np.zeros(g.shape)
    for at in range(1, g.shape[0]):
        gain, values = 0.0, np.zeros(g.shape)
        for rows in (slice(0, at), slice(at, None)):
            gs, hs = g[rows].sum(0), h[rows].sum(0)
            _, cut = _split(gs, hs)
            for columns in (slice(0, cut), slice(cut, None)):
                s, t = gs[columns].sum(), hs[columns].sum()
                gain += _gain(s, t)
                values[rows, columns] = s / (t + 1.0)
        if gain > best:
            best, out = gain, values
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, rate: float = RATE) -> dict:
    """Bin edges, base log-odds, one table a feature and one table a chosen pair."""
    mean = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(mean / (1 - mean)))
    if len(y) == 0 or y.min() == y.max():
        none = [np.zeros(0)] * len(FEATURES)
        return {"base": base, "cuts": none, "tables": [np.zeros(1)] * len(FEATURES), "pair_cuts": none, "pairs": []}
    cuts, pair_cuts = edges(x, BINS), edges(x, PAIR_BINS)
    b, pb = to_bins(x, cuts), to_bins(x, pair_cuts)
    tables = [np.zeros(len(c) + 1) for c in cuts]
    score = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(tables):
            g, h = slopes()
            step = rate * tree(np.bincount(b[:, f], g, minlength=len(table)), np.bincount(b[:, f], h, minlength=len(table)))
            table += step
            score += step[b[:, f]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int], np.ndarray]:
        shape = (len(pair_cuts[i]) + 1, len(pair_cuts[j]) + 1)
        cell = pb[:, i] * shape[1] + pb[:, j]
        g, h = slopes()
        return np.bincount(cell, g, minlength=shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, minlength=shape[0] * shape[1]).reshape(shape), shape, cell

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda ij: -pair_tree(*grid(*ij)[:2])[0])
    pairs = [(i, j, np.zeros(grid(i, j)[2])) for i, j in ranked[:PAIRS]]
    for _ in range(pair_rounds):
        for i, j, table in pairs:
            g, h, _, cell = grid(i, j)
            step = rate * pair_tree(g, h)[1]
            table += step
            score += step.ravel()[cell]
    return {"base": base, "cuts": cuts, "tables": tables, "pair_cuts": pair_cuts, "pairs": pairs}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    b, pb = to_bins(x, model["cuts"]), to_bins(x, model["pair_cuts"])
    score = np.full(len(x), model["base"])
    for f, table in enumerate(model["tables"]):
        score += table[b[:, f]]
    for i, j, table in model["pairs"]:
        score += table[pb[:, i], pb[:, j]]
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> dict:
    """The model from the measures of at most `rows` labelled documents; those measures, 17 numbers each, come to the driver."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    sample = bounded_sample(known, "__id", rows, SEED)
    joined = df.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col(id_col) == F.col("__id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_batches(batches):
            for first, last, block in blocks(batch.column(2)):
                x = features(block)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(x.tolist(), pa.list_(pa.float64()))], ["id", "label", "x"])

    measured = joined.select(F.col("__id").alias("id"), F.col("__label").alias("label"), "text").mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, label int, x array<double>")
    table = measured.groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.label", "r.x").toArrow().sort_by("id")
    x = np.array(table["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, table["label"].to_numpy().astype(np.float64))


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_batches(batches):
            for first, last, block in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(predict(shared.value, features(block)))], [id_col, "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
