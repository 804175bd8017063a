"""Quality rules: counting rules and a hashed n-gram logistic regression.

The regression's features are hashed word uni- and bigrams and character 3- and 4-grams
(of bytes), each group a mean over the text. It is trained on a bounded sample of labelled
rows, its probabilities are calibrated on the sample's fifth that training leaves out
(Platt scaling), and texts are scored in Arrow batches against a fixed threshold.

Null texts are empty; empty texts have no words and fail the rules; very long texts are
measured whole; repeated rows are scored alike; an empty table gives an empty table; with
no labelled row of either kind every probability is 1 (the counting rules alone decide).
Only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, rows_batches
from .textbatch import TextBlock, blocks, duplicate_lines, mix, repeated_window_words

#: Bound of the training sample.
TRAIN_ROWS = 1500
SEED = 5
#: Fixed thresholds: fewest words, largest percentage of repeated words, least probability of quality.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
KEEP_FROM = 0.5
BITS = 16
GROUPS = 4
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def feature_groups(block: TextBlock, words: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each group: hashed features in text order, and the offsets of the texts in them."""
    mask = np.uint64((1 << BITS) - 1)
    data = block.data.astype(np.uint32)
    for group, n in enumerate((3, 4)):
        code = np.zeros(max(len(data) - n + 1, 0), np.uint32)
        for i in range(n):
            code = code * np.uint32(0x01000193) + data[i : len(code) + i]
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        counts = np.maximum(np.diff(block.offsets) - n + 1, 0)
        offsets = np.concatenate(([0], np.cumsum(counts)))
        keep = np.arange(offsets[-1]) + np.repeat(block.offsets[:-1] - offsets[:-1], counts)
        yield code[keep].astype(np.int32) + (group << BITS), offsets
    starts, ends, owner = words
    h = block.span_hash(starts, ends, lower=True)
    pair = mix(h[:-1] * np.uint64(3) + h[1:])[owner[:-1] == owner[1:]] if len(h) > 1 else h[:0]
    counts = np.bincount(owner, minlength=block.n)
    for group, (x, c) in enumerate(((h, counts), (pair, np.maximum(counts - 1, 0))), 2):
        yield (x & mask).astype(np.int32) + (group << BITS), np.concatenate(([0], np.cumsum(c)))


def margins(block: TextBlock, words: tuple, weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(block.n, bias)
    for index, offsets in feature_groups(block, words):
        total = np.concatenate(([0.0], np.cumsum(weights[index], dtype=np.float64)))
        out += (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)
    return out


def text_features(block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features, each one's share in its group and text, and the offsets of the texts in them."""
    size, keys, shares = GROUPS << BITS, [], []
    for index, offsets in feature_groups(block, block.words()):
        n = np.diff(offsets)
        key, count = np.unique(np.repeat(np.arange(block.n), n) * size + index, return_counts=True)
        keys.append(key)
        shares.append(count / n[key // size])
    key, share = np.concatenate(keys), np.concatenate(shares)
    order = np.argsort(key)
    return (key[order] % size).astype(np.int32), share[order].astype(np.float32), np.searchsorted(key[order], np.arange(block.n + 1) * size)


def fit(index: np.ndarray, share: np.ndarray, offsets: np.ndarray, labels: np.ndarray, rounds: int = 40, rate: float = 0.6, decay: float = 1e-4) -> tuple[np.ndarray, float, float, float]:
    """Weights, bias and the calibration's slope and intercept from text_features; every fifth row is left to the calibration."""
    if len(labels) == 0 or labels.min() == labels.max():
        return np.zeros(GROUPS << BITS, np.float32), 0.0, 0.0, 50.0
    row = np.repeat(np.arange(len(labels)), np.diff(offsets))
    learn = np.arange(len(labels)) % 5 != 4
    if len(set(labels[learn])) < 2 or len(set(labels[~learn])) < 2:
        learn[:] = True
    y = labels.astype(np.float64)
    per_class = np.where(y > 0, 0.5 / max(y[learn].sum(), 1), 0.5 / max((1 - y[learn]).sum(), 1)) * learn
    w, bias = np.zeros(GROUPS << BITS), 0.0
    moment, square, steps = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0

    def margin() -> np.ndarray:
        return bias + np.bincount(row, w[index] * share, minlength=len(y))

    for _ in range(rounds):
        wrong = per_class * (1 / (1 + np.exp(-np.clip(margin(), -30, 30))) - y)
        gradient = np.zeros(len(w) + 1)
        gradient[:-1] = decay * w / len(w) + np.bincount(index, wrong[row] * share, minlength=len(w))
        gradient[-1] = wrong.sum()
        steps += 1
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        step = rate * (moment / (1 - 0.9**steps)) / (np.sqrt(square / (1 - 0.99**steps)) + 1e-7)
        w -= step[:-1]
        bias -= step[-1]
    m = margin()
    rest = ~learn if (~learn).any() else learn
    slope, intercept = _platt(m[rest], y[rest])
    return w.astype(np.float32), float(bias), slope, intercept


def _platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic calibration of margins by Newton steps, with smoothed targets."""
    scale = max(float(np.abs(m).std()), 1e-6)
    x = np.stack((m / scale, np.ones_like(m)), 1)
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        a = a - np.clip(np.linalg.solve(hessian, x.T @ (p - t) + 1e-3 * a), -2, 2)
    return float(a[0] / scale), float(a[1])


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> tuple:
    """The model from at most `rows` labelled documents, fitted in one task over that bounded sample."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    sample = bounded_sample(known, "__id", rows, SEED)
    joined = df.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col(id_col) == F.col("__id"))

    kind = df.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_batches(batches):
            for first, last, block in blocks(batch.column(2)):
                index, share, offsets = text_features(block)
                lists = (pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (index, share))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, last - first) for c in (0, 1)), *lists], ["id", "label", "f", "s"])

    # one task gathers features, at most GROUPS << BITS a row whatever its text; repeated document rows: one each, so the bound holds
    counted = joined.select(F.col("__id").alias("id"), F.col("__label").alias("label"), "text").mapInArrow(count, f"id {kind}, label int, f array<int>, s array<float>")
    gathered = counted.groupBy("id").agg(F.min(F.struct("label", "f", "s")).alias("r")).select("id", "r.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if batches:
            table = pa.Table.from_batches(batches).sort_by("id").combine_chunks()
            f, s = (table[c].combine_chunks() for c in "fs")
            w, bias, slope, intercept = fit(f.flatten().to_numpy(), s.flatten().to_numpy(), f.offsets.to_numpy() - f.offsets[0].as_py(), table["label"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([[bias, slope, intercept]])], ["w", "rest"])

    row = gathered.repartition(1).mapInArrow(run, "w binary, rest array<double>").first()
    if row is None:
        return np.zeros(GROUPS << BITS, np.float32), 0.0, 0.0, 50.0
    return np.frombuffer(row.w, np.float32), *row.rest


def measure(df: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, probability) of every text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, slope, intercept = shared.value
        for batch in rows_batches(batches):
            for first, last, block in blocks(batch.column(1)):
                starts, ends, owner = words = block.words()
                inside = block.data & 0xC0 != 0x80
                spaces = (block.data == 32) | ((block.data >= 9) & (block.data <= 13))
                hashes = block.span_hash(starts, ends)
                columns = [
                    np.bincount(owner, minlength=block.n),
                    block.per_text(inside & ~spaces),
                    block.per_text(_SYMBOLS[block.data]),
                    duplicate_lines(block, starts),
                    repeated_window_words(hashes, owner, block.n),
                ]
                p = 1 / (1 + np.exp(-np.clip(slope * margins(block, words, weights, bias) + intercept, -50, 50)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *(pa.array(c.astype(np.int64)) for c in columns), pa.array(p)], names)

    names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "probability"]
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names[1:-1]) + ", probability double"
    return df.select(id_col, text_col).mapInArrow(run, schema)


def apply_rules(measured: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """`base_failed` and `kept`; where the counting rules fail nothing else is asked."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("probability") >= keep_from))
