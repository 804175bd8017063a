"""Source divergence audit: how the term rates of each source differ from its language's other sources, exactly.

A term row lists a term's sources with its count in each, in source order, without zeros. The
value of two sources is a sum over all terms of f of their two rates. With both counts 0 every
term gives the same, and a term that only one of the two has depends on that one's count
alone; what is left is a correction for terms that both have. For these the distinct term
rows, with the number of terms that have each, form a frequent-pattern tree: rows with a
common beginning share the path, and each node meets each of its ancestors once, with the
number of terms below it. Sorted rows are the tree, depth first: a task needs only the path
it is on. A path that two tasks share gives each of them its part of the number.

Null text, language and source are empty; documents without terms have groups; very long
texts are read whole; repeated rows count each; an empty table gives an empty table. Only the
three columns are read, so others can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_bytes

#: Letters A-Z, and what isn't ASCII; in UTF-8 all bytes of the latter are above 0x7F.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Entries, and bytes of terms, that a task gathers before it gives them on.
GATHERED, GATHERED_BYTES = 300_000, 32 << 20
#: Pair sums that a task of the tree holds.
HELD_PAIRS = 1 << 21
MIN_DOCUMENTS, TOP_TERMS = 10, 10
RATE = 1_000_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, docs, n) of what parts of the table hold: sums over equal keys are the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, documents) in gathered.items():
                columns = [pa.array(n.keys(), pa.binary()).cast(pa.string()), pa.array([documents[t] for t in n], pa.int64()), pa.array(n.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array([source] * len(n)), *columns], ["lang", "source", "term", "docs", "n"])
            gathered.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
                terms = _TERM.findall(text.translate(_LOWER))
                if not terms:
                    continue
                n, documents = gathered.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(terms)
                own = set(terms)
                documents.update(own)
                size += (len(n) - before) * (GATHERED_BYTES // GATHERED) + sum(len(t) for t in own if len(t) > 100)
                if size > GATHERED_BYTES:
                    yield from given()
                    size = 0
        yield from given()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, docs long, n long")


def term_rows(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, term, n, items): the terms in at least so many documents of their language, with count and source of each occurrence.

    One shuffle, by language and term; a row has an item a source.
    """
    parts = term_counts(docs).repartition("lang", "term")
    groups = parts.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    items = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("items")
    return groups.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), items).where(F.col("docs") >= min_documents).drop("docs")


def _rate(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(RATE * (n + 2) / (total + 2 * terms)), in decimals: the product may leave the longs."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", whole(n + 2) * F.lit(RATE).cast("decimal(10,0)"), whole(total + 2 * terms)) + 1


def _gap(p: Column, q: Column) -> Column:
    """f: floor((p - q)^2 / (p + q)); rates are at most RATE + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def pair_corrections(patterns: DataFrame) -> DataFrame:
    """(lang, source, other, value), of patterns (lang, items of source, p, p0 in source order, terms): sums of what both sources' counts change together."""
    dealt = patterns.repartitionByRange("lang", "items").sortWithinPartitions("lang", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang: str | None = None
        path: list[tuple[str, int, int]] = []
        terms: list[int] = []
        p, p0 = np.zeros(64, np.int64), np.zeros(64, np.int64)
        at: dict[str, int] = {}  # sources by number
        rows: np.ndarray = np.zeros(64, np.int64)
        sums: dict[int, np.ndarray] = {}  # of a source, by the other's number
        held = 0

        def leave(depth: int) -> None:
            """The nodes deeper than `depth`, deepest first, meet their ancestors; their terms are the parents' too."""
            nonlocal held
            while len(path) > depth:
                d = len(path) - 1
                path.pop()
                n = terms.pop()
                if not d:
                    break
                terms[-1] += n
                both = _gaps(p[:d], p[d]) - _gaps(p[:d], p0[d]) - _gaps(p0[:d], p[d]) + _gaps(p0[:d], p0[d])
                line = sums.get(rows[d])
                if line is None or len(line) < len(at):
                    grown = np.zeros(2 * len(at), np.int64)
                    held += len(grown)
                    if line is not None:
                        grown[: len(line)] = line
                        held -= len(line)
                    line = sums[rows[d]] = grown
                line[rows[:d]] += n * both

        def given() -> Iterator[pa.RecordBatch]:
            nonlocal held
            names = np.array(list(at), object)
            for source, line in sums.items():
                other = np.flatnonzero(line)
                columns = [[lang] * len(other), [names[source]] * len(other), list(names[other])]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns], pa.array(line[other])], ["lang", "source", "other", "value"])
            sums.clear()
            held = 0

        for batch in batches:
            for own, items, n in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                items = [(x["source"], x["p"], x["p0"]) for x in items]
                if own != lang:
                    leave(0)
                    yield from given()
                    lang = own
                    at.clear()
                same = 0
                while same < min(len(path), len(items)) and path[same] == items[same]:
                    same += 1
                leave(same)
                if len(items) > len(p):
                    p, p0, rows = (np.concatenate((x, np.zeros(2 * len(items), np.int64))) for x in (p, p0, rows))
                for d in range(same, len(items)):
                    path.append(items[d])
                    terms.append(0)
                    p[d], p0[d], rows[d] = items[d][1], items[d][2], at.setdefault(items[d][0], len(at))
                terms[-1] += n
                if held > HELD_PAIRS:
                    yield from given()
        leave(0)
        yield from given()

    return dealt.select("lang", "items", "terms").mapInArrow(run, "lang string, source string, other string, value long")


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): of each group its language's other sources by `pair` value, and its most over-represented terms by `term` value."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    docs = docs.select(blank("lang"), blank("source"), blank("text"))
    rows = materialize(term_rows(docs, min_documents), "terms")
    langs = rows.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    item = rows.select("lang", "term", F.col("n").alias("all_n"), F.inline("items"))
    sizes = item.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["source_n", "v", "lang_n"])
    groups = groups.withColumn("p0", F.when(F.col("v") > 0, _rate(F.lit(0), F.col("source_n"), F.col("v"))))
    groups = materialize(groups, "groups")

    rated = item.join(groups, ["lang", "source"]).withColumn("p", _rate(F.col("n"), F.col("source_n"), F.col("v")))
    rated = materialize(rated.select("lang", "source", "term", "p", "p0", _rate(F.col("all_n"), F.col("lang_n"), F.col("v")).alias("q")), "rates")
    terms = rated.where("p > q").select("lang", "source", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    terms = ranked(terms).where(F.col("rank") <= top_terms)

    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0"), "v")
    two = groups.drop("v").join(others, "lang").where("source <> other")
    base = two.select("lang", "source", "other", F.coalesce(F.col("v") * _gap(F.col("p0"), F.col("other_p0")), F.lit(0)).alias("value"))
    # what one source's count changes beside a source without the term: by distinct rate, not by term
    single = rated.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms"))
    single = single.join(others.drop("v"), "lang").where("source <> other")
    single = single.select("lang", "source", "other", (F.col("terms") * (_gap(F.col("p"), F.col("other_p0")) - _gap(F.col("p0"), F.col("other_p0")))).alias("value"))
    patterns = rated.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "p0"))).alias("items"))
    patterns = patterns.where(F.size("items") > 1).groupBy("lang", "items").agg(F.count("*").alias("terms"))
    changes = single.unionByName(pair_corrections(patterns)).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    mirrored = changes.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value")
    pairs = base.unionByName(changes).unionByName(mirrored).groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(ranked(pairs), "pair").unionByName(columns(terms, "term"))
