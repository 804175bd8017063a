"""Language identification by segmentation-marginalised unigrams.

Every language has its own unigram probabilities over the pieces of one fixed public
vocabulary. The probability of a word is the sum over all its segmentations into pieces,
by the forward algorithm; a text's score is the sum over its words' log probabilities, and
the predicted language is the likeliest. The probabilities are learned by expectation
maximisation (forward-backward) from a bounded sample of documents of each language.

Forward values depend on the prefix only, so a batch's new words are scored in sorted
order and words that begin alike share them.

`und` with score 0 where the text is null or has no letters. Empty texts have none; very
long texts are scored whole; equal likelihoods go to the language first in code-point
order; repeated rows are scored alike; an empty table gives an empty table. Null
languages are not learned; where no language was learned every text is `und`. Only the
named columns are read, so others can't clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .affix import EndingEntries
from .common import rows_batches, text_bytes, unit_hash

#: Bound of the training sample: documents a language.
DOCS_PER_LANG = 250
#: Languages of one model; more languages are several models, whose likelihoods stand side by side.
BLOCK_LANGS = 200
ROUNDS = 3
SEED = 6
#: Probability of one character that no piece covers.
FLOOR = 1e-8
MARK = "▁"
#: Chunks between white space kept from batch to batch, those of at most so many characters.
CACHE_WORDS, CACHE_CHARS = 200_000, 80
#: Letter runs that are longer, and all whose sums fall below the least number, are summed in logarithms.
LINEAR_CHARS, LEAST = 40, 1e-250
BATCH_BYTES = 2 << 20
_LETTERS = regex.compile(r"\p{L}+")


def vocabulary_pieces(model_file: str) -> list[str]:
    """The pieces of a public vocabulary that are letters, with or without the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in pieces if p.lstrip(MARK) and _LETTERS.fullmatch(p.removeprefix(MARK)))


def word_parts(text: str) -> list[str]:
    """Lower-cased letter runs with the word mark before each."""
    return [MARK + run for run in _LETTERS.findall(text.lower())]


def _piece_shares(n: int, arcs: list[tuple[int, int, str]], prob: dict[str, float]) -> Iterator[tuple[str, float]]:
    """Each arc's piece and the arc's share in all segmentations of a word of n characters."""
    forward = [1.0] + [0.0] * n
    for i, j, piece in arcs:
        forward[j] += forward[i] * prob[piece]
    if forward[n] > LEAST:
        backward = [0.0] * n + [1.0]
        for i, j, piece in reversed(arcs):
            backward[i] += backward[j] * prob[piece]
        for i, j, piece in arcs:
            yield piece, forward[i] * prob[piece] * backward[j] / forward[n]
        return
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    logs = {piece: math.log(prob[piece]) for _, _, piece in arcs}
    none = -1e300
    before, after = [0.0] + [none] * n, [none] * n + [0.0]
    for i, j, piece in arcs:
        before[j] = add(before[j], before[i] + logs[piece])
    for i, j, piece in reversed(arcs):
        after[i] = add(after[i], after[j] + logs[piece])
    for i, j, piece in arcs:
        yield piece, math.exp(before[i] + logs[piece] + after[j] - before[n])


def learn_pieces(words: dict[str, int], pieces: list[str], rounds: int = ROUNDS) -> dict[str, float]:
    """Piece probabilities of one language by expectation maximisation over word counts."""
    known, longest = set(pieces), max(map(len, pieces), default=1)
    spans = {}
    for word in words:
        n = len(word)
        spans[word] = [(i, j, word[i:j]) for i in range(n) for j in range(i + 1, min(n, i + longest) + 1) if j == i + 1 or word[i:j] in known]
    prob: dict[str, float] = {}
    for word, count in words.items():
        for _, _, piece in spans[word]:
            prob[piece] = prob.get(piece, 0.0) + count
    total = sum(prob.values())
    prob = {p: c / total for p, c in prob.items()}
    for _ in range(rounds):
        expected: dict[str, float] = dict.fromkeys(prob, 0.0)
        for word, count in words.items():
            for piece, share in _piece_shares(len(word), spans[word], prob):
                expected[piece] += count * share
        total = sum(expected.values()) or 1.0
        prob = {p: max(c / total, 1e-12) for p, c in expected.items()}
    return prob


class LanguageModel:
    """Piece probabilities by language and the words scored so far."""

    def __init__(self, langs: list[str], table: dict[str, list[float]]):
        self.langs = langs
        self.ending = EndingEntries(table)
        self.longest = max(map(len, table), default=1) + 1
        self.floor = [FLOOR] * len(langs)
        self.words: dict[str, int] = {}
        self.scores = np.zeros((0, len(langs) + 1))

    def word_log_probs(self, words: list[str]) -> np.ndarray:
        """Natural logarithms of the sum over all segmentations, a row a word, a column a language."""
        ending, zero, floor = self.ending, [0.0] * len(self.langs), self.floor
        order = sorted(range(len(words)), key=words.__getitem__)
        out = np.zeros((len(words), len(self.langs)))
        before, forward, states = "", [[1.0] * len(self.langs)], [""]
        for k in order:
            word = words[k]
            if len(word) > LINEAR_CHARS:
                out[k] = self._in_logs(word)
                continue
            at = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                at += 1
            del forward[at + 1 :], states[at + 1 :]
            state = states[at]
            for j in range(at + 1, len(word) + 1):
                state, pieces = ending[state + word[j - 1]]
                sums = zero
                for length, p in pieces:
                    sums = [s + x * y for s, x, y in zip(sums, forward[j - length], p)]
                if not pieces or pieces[-1][0] > 1:  # no piece for the character alone
                    sums = [s + x * y for s, x, y in zip(sums, forward[j - 1], floor)]
                forward.append(sums)
                states.append(state)
            before = word
            out[k] = self._in_logs(word) if min(forward[-1]) < LEAST else [math.log(x) for x in forward[-1]]
        return out

    def _in_logs(self, word: str) -> np.ndarray:
        """The same sums in logarithms, for words of any length."""
        floor, state = math.log(FLOOR), ""
        forward = [np.zeros(len(self.langs))]  # of the last prefixes
        for c in word:
            state, pieces = self.ending[state + c]
            terms = [forward[-length] + np.log(p) for length, p in pieces]
            if not pieces or pieces[-1][0] > 1:
                terms.append(forward[-1] + floor)
            forward.append(np.logaddexp.reduce(terms))
            if len(forward) > 2 * self.longest:
                del forward[: self.longest]
        return forward[-1]

    def text_log_probs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods (a row a text) and whether the text has letters."""
        split = [t.lower().split() for t in texts]
        used = set().union(*split)
        # long chunks last: they leave the store after the batch
        new = sorted(used - self.words.keys(), key=lambda c: len(c) > CACHE_CHARS)
        if len(self.words) + len(new) > CACHE_WORDS:  # those of the current batch stay
            kept = list(used & self.words.keys())
            self.scores = self.scores[[self.words[c] for c in kept]]
            self.words = {c: i for i, c in enumerate(kept)}
        runs = [word_parts(c) for c in new]
        parts = list(dict.fromkeys(p for r in runs for p in r))
        number = {p: i for i, p in enumerate(parts)}
        logs = self.word_log_probs(parts)
        rows = np.zeros((len(new), len(self.langs) + 1))
        owner = np.repeat(np.arange(len(new)), [len(r) for r in runs])
        index = np.fromiter((number[p] for r in runs for p in r), np.int64, len(owner))
        np.add.at(rows[:, :-1], owner, logs[index])
        rows[:, -1] = np.bincount(owner, minlength=len(new))
        first = len(self.words)
        self.words.update((c, first + i) for i, c in enumerate(new))
        self.scores = np.concatenate((self.scores, rows))
        get = self.words.__getitem__
        out = np.zeros((len(texts), rows.shape[1]))
        for k, chunks in enumerate(split):
            if chunks:
                out[k] = self.scores[np.fromiter(map(get, chunks), np.int64, len(chunks))].sum(0)
        while new and len(new[-1]) > CACHE_CHARS:
            del self.words[new.pop()]
        self.scores = self.scores[: first + len(new)]
        return out[:, :-1], out[:, -1] > 0


def predict(models: list[LanguageModel], texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text over all models, and its share in the likelihoods."""
    if not models:
        return ["und"] * len(texts), np.zeros(len(texts))
    langs = [lang for m in models for lang in m.langs]
    parts = [m.text_log_probs(texts) for m in models]
    logs, lettered = np.concatenate([p[0] for p in parts], 1), parts[0][1]
    best = logs.argmax(1)
    with np.errstate(under="ignore"):
        share = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
    return [langs[b] if ok else "und" for b, ok in zip(best, lettered)], np.where(lettered, share, 0.0)


def train(df: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG, block_langs: int = BLOCK_LANGS) -> list[tuple[list[str], dict[str, list[float]]]]:
    """Languages and piece probabilities, block_langs languages a block, learned from at most docs_per_lang documents a language.

    A hash threshold by the language's row count leaves little more than the sample, a
    window over those few rows makes the bound strict. What comes to the driver is bounded by
    the vocabulary and the number of languages.
    """
    df = df.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r.lang: r.n for r in df.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    vocabulary = df.sparkSession.sparkContext.broadcast(pieces)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        words = Counter(w for t in sorted(group["text"].fillna("")) for w in word_parts(t))
        prob = learn_pieces(dict(sorted(words.items())), vocabulary.value)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "piece": list(prob), "p": list(prob.values())})

    def block(some: list[str]) -> tuple[list[str], dict[str, list[float]]]:
        rate = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 1.2 * docs_per_lang / counts[k]))) for k in some])
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "text"))
        sample = df.withColumn("h", unit_hash(F.col("id"), SEED)).where(F.col("lang").isin(some) & (F.col("h") < rate)).withColumn("r", rank).where(F.col("r") <= docs_per_lang)
        learned = sample.select("lang", "text").groupBy("lang").applyInPandas(fit, "lang string, piece string, p double").toArrow()
        table: dict[str, list[float]] = {}
        place = {k: i for i, k in enumerate(some)}
        for lang, piece, p in zip(*(learned.column(c).to_pylist() for c in ("lang", "piece", "p"))):
            table.setdefault(piece, [1e-9 if len(piece) > 1 else FLOOR] * len(some))[place[lang]] = p
        return some, table

    return [block(langs[at : at + block_langs]) for at in range(0, len(langs), block_langs)]


def classify(df: DataFrame, models: list[tuple[list[str], dict[str, list[float]]]], text_col: str = "text") -> DataFrame:
    """All rows and columns of df with `lang_pred` and `score`; columns of these names are replaced."""
    df = df.drop("lang_pred", "score")
    shared = df.sparkSession.sparkContext.broadcast(models)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [LanguageModel(*m) for m in shared.value]
        for batch in rows_batches(batches, BATCH_BYTES):
            langs, scores = predict(scorers, [b.decode("utf-8", "replace") for b in text_bytes(batch.column(at))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.mapInArrow(run, schema)
