"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key -ln(u) / w, u from a hash of its id and text and w
its quality weight; small keys go first. A source's token budget pays for complete epochs
over all of it; the rest pays for documents in key order up to the prefix sum nearest to
the budget. Keys fall into bins that keep their order, so a source is never sorted in one
task: bin sums find the one bin where the budget ends, that bin is cut into BINS again until
CUT_ROWS rows are left at most, and only these are sorted. Bins are steps of the key's
logarithm: whatever the weights, a step of 1 / STEPS holds no more than ln 2 / (e * STEPS),
a thousandth, of a source's documents on average. Texts are counted once; draws are written
to the shared folder.

Null texts have size 0 and take nothing; null sources form the last source; empty texts,
ties (by key, then id, then a hash of the text) and repeated rows are documents like any
other, rows alike in id and text draw one key and, where the budget ends among them, are
sorted in one task; reruns agree however the rows come; an empty
table gives an empty table; other columns pass through, those named like a result are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Fixed values of the mix: weights by source order, share of all sizes, most epochs.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix-1"
#: Bins: steps of a doubling of the key, bins that a cutting bin is cut into, rows that one task sorts, and how often a double's digits allow a cut.
STEPS = 256
BINS = 1024
CUT_ROWS = 4096
MOST_CUTS = 3


def word_count(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text_col: str = "text", size_col: str = "size") -> Column:
    """1 where words have 3 to 9 characters on average, white space included, else a quarter."""
    mean = F.length(F.col(text_col)) / F.greatest(F.col(size_col), F.lit(1))
    return F.when(mean.between(3, 9), 1.0).otherwise(0.25)


def uniform(id_col: str, text_col: str, seed: str) -> Column:
    """In (0, 1), decided by id, text and seed: 52 bits of an MD5."""
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    whole = F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text)
    digits = F.substring(F.md5(whole.cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))


def source_targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) to these plus `target`: shares by weight, stopped at twice the size, the excess reshared.

    Sorted by the level at which each source stops, what is left after the stopped sources
    shared by the weights that remain rises while sources stop and falls after: its maximum
    is the common level. One pass over one row a source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    cases = F.element_at(F.array(*map(F.lit, map(float, WEIGHTS))), (rank - 1) % len(WEIGHTS) + 1)
    s = sources.withColumn("__w", cases).withColumn("__cap", MOST_EPOCHS * F.col("source_size").cast("double"))
    s = s.withColumn("__stop", F.col("__cap") / F.col("__w"))
    order = Window.orderBy("__stop", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("__all", F.sum("source_size").over(everything) * F.lit(SHARE))
    s = s.withColumn("__level", (F.col("__all") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(after))
    s = s.withColumn("__common", F.max("__level").over(everything))
    target = F.least(F.col("__cap"), F.coalesce(F.col("__common"), F.lit(0.0)) * F.col("__w"))
    return s.select("source", "source_size", target.alias("target"))


def bin_at(level: int) -> Column:
    """Number of a key's bin after `level` cuts; bins keep the keys' order, and one's parts lie in it."""
    return F.floor(F.col("__step") * F.lit(float(BINS**level))).cast("long")


def _bins(draw: DataFrame, level: int) -> DataFrame:
    return draw.groupBy(F.col("__from").alias("source"), bin_at(level).alias("__bin")).agg(F.sum("size").alias("__bin_size"), F.count("*").alias("__bin_rows"))


def _cut(bins: DataFrame, budgets: DataFrame) -> DataFrame:
    """budgets (source, `__left`, `__paid` before these bins, others) with the bin where `__left` ends, what is paid before it and its rows; beyond all bins where it pays for everything."""
    run = Window.partitionBy("source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("__run", F.coalesce(F.sum("__bin_size").over(run), F.lit(0)))
    b = budgets.alias("b")
    bins = b.join(bins.alias("n"), F.col("b.source").eqNullSafe(F.col("n.source")), "left")
    before = F.col("b.__paid") + F.col("n.__run")
    ends = (before <= F.col("b.__left")) & (before + F.col("n.__bin_size") > F.col("b.__left"))
    held = [c for c in budgets.columns if c not in ("source", "__paid")]
    return bins.groupBy(F.col("b.source").alias("source")).agg(
        F.coalesce(F.max(F.when(ends, F.col("n.__bin"))), F.lit((1 << 63) - 1)).alias("__cut"),
        F.coalesce(F.max(F.when(ends, before)), F.max("b.__paid")).alias("__paid"),
        F.coalesce(F.max(F.when(ends, F.col("n.__bin_rows"))), F.lit(0)).alias("__cut_rows"),
        *[F.first(f"b.{c}").alias(c) for c in held],
    )


def cuts(draw: DataFrame, cut_rows: int = CUT_ROWS) -> tuple[DataFrame, int]:
    """Of draw (`__from`, `__step`, `size`) one row a source: size, target, epochs, budget left, the bin where it ends, what is paid before; and how often bins were cut."""
    bins = materialize(_bins(draw, 0), "bins")
    sources = source_targets(bins.groupBy("source").agg(F.sum("__bin_size").alias("source_size")))
    sources = sources.withColumn("__epochs", F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))))
    sources = sources.withColumn("__left", F.col("target") - F.col("__epochs") * F.col("source_size"))
    found, level = materialize(_cut(bins, sources.withColumn("__paid", F.lit(0).cast("long"))), "cuts"), 0
    while level < MOST_CUTS and not found.where(F.col("__cut_rows") > cut_rows).isEmpty():
        # all sources go on together, so that one number of a bin says where all of them end
        at = found.select(F.col("source").alias("__of"), F.col("__cut").alias("__at"))
        inside = draw.join(at, F.col("__from").eqNullSafe(F.col("__of")) & (bin_at(level) == F.col("__at")))
        level += 1
        paid = found.drop("__cut_rows").withColumnRenamed("__cut", "__whole")
        deeper = _cut(_bins(inside, level), paid)
        # a source without a cutting bin keeps the end beyond all bins
        found = materialize(deeper.drop("__whole"), "cuts")
    return found.drop("__cut_rows"), level


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, seed: str = SEED, columns: tuple[str, ...] | None = None, cut_rows: int = CUT_ROWS) -> DataFrame:
    """All rows of df, its listed columns (all) with `size`, `source_size`, `target` and `copies`, how often the mix takes the document.

    `weight` is a column of df above 0, such as a learned quality score; a weight that is null, not a number or below 1e-6 counts as 1e-6.
    """
    df = df.drop("size", "source_size", "target", "copies")
    kept = [F.col(f"`{c}`") for c in (df.columns if columns is None else columns)]
    w = quality_weight(text_col, "__size") if weight is None else F.greatest(F.coalesce(F.nanvl(weight.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1e-6))
    draw = df.withColumn("__size", word_count(text_col)).withColumn("__key", -F.log(uniform(id_col, text_col, seed)) / w)
    draw = draw.select(*kept, F.col(f"`{id_col}`").alias("__id"), F.col(f"`{source_col}`").alias("__from"), F.xxhash64(text_col).alias("__h"), F.col("__size").alias("size"), "__key", (F.log2("__key") * F.lit(float(STEPS))).alias("__step"))
    draw = materialize(draw, "draws")
    cut, level = cuts(draw, cut_rows)
    # one row a source
    joined = draw.join(cut.withColumnRenamed("source", "__source"), F.col("__from").eqNullSafe(F.col("__source")))
    # only the rows of the cutting bins are sorted
    at_cut = bin_at(level) == F.col("__cut")
    line = Window.partitionBy("__source").orderBy("__key", "__id", "__h").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__paid") + F.coalesce(F.sum("size").over(line), F.lit(0))
    sorted_rows = joined.where(at_cut).withColumn("__chosen", before + F.col("size") / 2 <= F.col("__left"))
    told = joined.where(~at_cut).withColumn("__chosen", bin_at(level) < F.col("__cut")).unionByName(sorted_rows)
    copies = F.least(F.col("__epochs") + F.when(F.col("__chosen"), 1).otherwise(0), F.lit(MOST_EPOCHS)).cast("int")
    return told.select(*kept, "size", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"))


def take(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("__copy", "copies")
