"""Ingest with time-windowed duplicate suppression, upsert and deletion by id.

Rows of one type, amount, party (any case) and channel no more than a window apart refuse each
other; the first in order is taken and refused rows refuse nothing. Two rows of one bucket of
the window's width always refuse each other, so of the rows there already each bucket's first
and last time says all. The rest falls into islands, runs without a longer gap. Of an island
no longer than the window the first row in order is taken. A longer one goes through one task
in order; a very long one whose order is that of time, forwards or backwards, is cut into
segments, in which each row has at most one next row, and the segments' ways through are
joined by doubling.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import DAY_MS
from ..sources.scratch import scratch
from .findings import KEY, with_key

WINDOW_MS = 600_000
#: Rows of an island that one task takes, if it can be cut.
LONG_ISLAND = 100_000
#: Parts that keys are hashed into, for each LONG_ISLAND rows.
PARTS_A_LONG_ISLAND = 16
#: Windows in a segment.
SEGMENT_WINDOWS = 144


def _bucket(ms: Column, within_ms: int) -> Column:
    return F.floor(ms / max(within_ms, 1)).cast("long")


def _same(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> list[Column]:
    return [a[c].eqNullSafe(b[c]) for c in columns]


def _refused(rows: DataFrame, old: DataFrame, within_ms: int) -> DataFrame:
    """The rows with `__refused`, whether one of `old` does. One row a key and bucket says whether the bucket, or an end of its neighbours, is taken."""
    spans = old.where("__ms IS NOT NULL").groupBy(*KEY, _bucket(F.col("__ms"), within_ms).alias("__at")).agg(F.min("__ms").alias("lo"), F.max("__ms").alias("hi"))
    sides = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), (F.col("__at") + d).alias("b")) for d in (-1, 0, 1)])).alias("side")
    on = lambda d, c: F.max(F.when(F.col("side.d") == d, F.col(c)))
    near = spans.select(*KEY, sides, "lo", "hi").groupBy(*KEY, F.col("side.b").alias("__near")).agg(on(0, "lo").alias("__own"), on(1, "hi").alias("__before"), on(-1, "lo").alias("__after"))
    rows = rows.withColumn("__at", _bucket(F.col("__ms"), within_ms))
    joined = rows.join(near, [*_same(rows, near, KEY), rows["__at"] == near["__near"]], "left")
    clash = F.col("__own").isNotNull() | (F.col("__ms") - F.col("__before") <= within_ms) | (F.col("__after") - F.col("__ms") <= within_ms)
    return joined.select(rows["*"], F.coalesce(clash, F.lit(False)).alias("__refused")).drop("__at")


def _islands(rows: DataFrame, within_ms: int) -> DataFrame:
    """`__island`, the time at which the row's run of rows without a longer gap began, among its key.

    The gap before a row is one to a row of its bucket or the one before. A running maximum of
    run starts in two levels, inside days and over days, so that one key is many tasks.
    """
    own = _bucket(F.col("__ms"), within_ms)
    dealt = rows.withColumn("__bucket", F.explode(F.array(own, own + 1)))
    line = Window.partitionBy(*KEY, "__bucket").orderBy("__ms")
    gap = F.col("__ms") - F.lag("__ms").over(line)
    rows = dealt.withColumn("__start", F.when(F.coalesce(gap > within_ms, F.lit(True)), F.col("__ms"))).where(own == F.col("__bucket")).drop("__bucket")
    rows = rows.withColumn("__day", F.floor(F.col("__ms") / DAY_MS))
    days = rows.groupBy(*KEY, "__day").agg(F.max("__start").alias("__day_start"))
    upto = Window.partitionBy(*KEY).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("__carried", F.max("__day_start").over(upto)).drop("__day_start")
    rows = rows.join(days, _same(rows, days, (*KEY, "__day"))).select(rows["*"], days["__carried"])
    inside = Window.partitionBy(*KEY, "__day").orderBy("__ms").rangeBetween(Window.unboundedPreceding, 0)
    island = F.coalesce(F.max("__start").over(inside), F.col("__carried"))
    return rows.withColumn("__island", island).drop("__start", "__day", "__carried")


def accepted(batches: Iterator[pa.RecordBatch], within_ms: int) -> Iterator[pa.RecordBatch]:
    """`__row` of the rows that the greedy pass accepts; rows come island by island, in order.

    Of an island one accepted time of each window-wide bucket is held: a row meets three
    buckets, however long the island.
    """
    width, island, times = max(within_ms, 1), None, {}
    for batch in batches:
        taken = []
        for *group, ms in zip(*[batch.column(c).to_pylist() for c in (*KEY, "__island", "__ms")]):
            if group != island:
                island, times = group, {}
            at = ms // width
            clash = at in times or ms - times.get(at - 1, ms - within_ms - 1) <= within_ms or times.get(at + 1, ms + within_ms + 1) - ms <= within_ms
            if not clash:
                times[at] = ms
            taken.append(not clash)
        yield batch.select(["__row"]).filter(pa.array(taken, pa.bool_()))


def _in_order(islands: DataFrame, within_ms: int) -> DataFrame:
    """`__row` of what is accepted; islands are dealt out and each goes through a task in order."""
    dealt = islands.repartition(*KEY, "__island").sortWithinPartitions(*KEY, "__island", "__seq")
    plain = dealt.select(*KEY, "__island", "__ms", F.col("__seq.row").alias("__row"))
    return plain.mapInArrow(lambda it: accepted(it, within_ms), "__row long")


def _long_ordered(islands: DataFrame, within_ms: int, long_island: int) -> DataFrame:
    """(key, `__island`, `__sign`) of islands of over long_island rows that come in the order of time (1) or against it (-1)."""
    ids = [*KEY, "__island"]
    segment = F.floor(F.col("__ms") / _segment_ms(within_ms))
    # a time has one row here
    before = F.lag("__seq").over(Window.partitionBy(*ids, "__segment").orderBy("__ms"))
    rows = islands.withColumn("__segment", segment)
    rows = rows.withColumn("__up", F.coalesce(before <= F.col("__seq"), F.lit(True))).withColumn("__down", F.coalesce(before >= F.col("__seq"), F.lit(True)))
    segments = rows.groupBy(*ids, "__segment").agg(F.count("*").alias("n"), F.min("__seq").alias("lo"), F.max("__seq").alias("hi"), F.bool_and("__up").alias("up"), F.bool_and("__down").alias("down"))
    order = Window.partitionBy(*ids).orderBy("__segment")
    up = F.col("up") & F.coalesce(F.lag("hi").over(order) <= F.col("lo"), F.lit(True))
    down = F.col("down") & F.coalesce(F.lag("lo").over(order) >= F.col("hi"), F.lit(True))
    found = segments.withColumn("up", up).withColumn("down", down).groupBy(*ids).agg(F.sum("n").alias("n"), F.bool_and("up").alias("up"), F.bool_and("down").alias("down"))
    return found.where((F.col("n") > long_island) & (F.col("up") | F.col("down"))).select(*ids, F.when(F.col("up"), 1).otherwise(-1).alias("__sign"))


def _segment_ms(within_ms: int) -> int:
    return max(within_ms, 1) * SEGMENT_WINDOWS


def _way(times: np.ndarray, within_ms: int) -> np.ndarray:
    """Of each sorted time the place of the first time beyond the window; their number where there is none."""
    return np.searchsorted(times, times + within_ms, "right")


def _through_segments(rows: DataFrame, within_ms: int) -> DataFrame:
    """(key, `__island`, `__t`) of the accepted times of islands in the order of `__t`.

    A segment's rows, with those of the next one in reach, say where a way that enters it
    leaves it. Ways of 1, 2, 4... segments are joined until none is left; going back from the
    longest, all entries that the island's first row leads to are marked.
    """
    ids, length = [*KEY, "__island"], _segment_ms(within_ms)
    nodes = rows.select(*ids, "__t").distinct().withColumn("__segment", F.floor(F.col("__t") / length).cast("long"))
    early = F.col("__t") - F.col("__segment") * length <= 2 * within_ms
    both = F.when(early, F.array("__segment", F.col("__segment") - 1)).otherwise(F.array("__segment"))
    dealt = nodes.select(*ids, "__t", F.explode(both).alias("__segment"))
    key_fields = [rows.schema[c] for c in ids]
    edge = T.StructType([*key_fields, T.StructField("__from", T.LongType()), T.StructField("__to", T.LongType())])

    def leave(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(frame["__t"].to_numpy())
        first, end = int(keys[-1]) * length, (int(keys[-1]) + 1) * length
        own = int(np.searchsorted(times, end))
        to = np.append(_way(times, within_ms), len(times))
        to[own:] = np.arange(own, len(to))
        while (to[to] != to).any():
            to = to[to]
        start = np.flatnonzero(times[:own] - first <= 2 * within_ms)
        start = start[to[start] < len(times)]
        return pd.DataFrame({**dict.fromkeys(ids), "__from": times[start], "__to": times[to[start]]}).assign(**dict(zip(ids, keys[:-1]))) if len(start) else pd.DataFrame(columns=edge.names)

    ways = [scratch(dealt.groupBy(*ids, "__segment").applyInPandas(leave, edge), "ways")]
    # an island begins anywhere in its first segment: its first row is followed from there
    while not ways[-1].isEmpty():
        a, b = ways[-1], ways[-1].select(*[F.col(c).alias(f"b_{c}") for c in ids], F.col("__from").alias("b_from"), F.col("__to").alias("b_to"))
        joined = a.join(b, [*[a[c].eqNullSafe(b[f"b_{c}"]) for c in ids], a["__to"] == b["b_from"]])
        ways.append(scratch(joined.select(*ids, "__from", F.col("b_to").alias("__to")), "ways"))
    first = nodes.groupBy(*ids).agg(F.min("__t").alias("__t"))
    begin = first.withColumn("__segment", F.floor(F.col("__t") / length).cast("long"))
    reached = scratch(_leave_first(dealt, begin, ids, within_ms, length, edge), "reached").select(*ids, F.col("__to").alias("__t"))
    for way in reversed(ways[:-1]):
        on = reached.select(*[F.col(c).alias(f"r_{c}") for c in ids], F.col("__t").alias("r_t"))
        further = way.join(on, [*[way[c].eqNullSafe(on[f"r_{c}"]) for c in ids], way["__from"] == on["r_t"]], "left_semi").select(*ids, F.col("__to").alias("__t"))
        reached = scratch(reached.unionByName(further).distinct(), "reached")
    starts = reached.unionByName(first).withColumn("__segment", F.floor(F.col("__t") / length).cast("long")).withColumn("__enters", F.lit(True))
    inside = nodes.withColumn("__enters", F.lit(False)).unionByName(starts)
    out = T.StructType([*key_fields, T.StructField("__t", T.LongType())])

    def walk(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(frame.loc[~frame["__enters"], "__t"].to_numpy())
        to, taken = _way(times, within_ms), []
        at = int(np.searchsorted(times, frame.loc[frame["__enters"], "__t"].min())) if frame["__enters"].any() else len(times)
        while at < len(times):
            taken.append(times[at])
            at = to[at]
        return pd.DataFrame({**dict.fromkeys(ids), "__t": taken}).assign(**dict(zip(ids, keys[:-1]))) if taken else pd.DataFrame(columns=out.names)

    return inside.groupBy(*ids, "__segment").applyInPandas(walk, out)


def _leave_first(dealt: DataFrame, begin: DataFrame, ids: list[str], within_ms: int, length: int, edge: T.StructType) -> DataFrame:
    """Where the way from each island's first row leaves its segment."""
    b = begin.select(*[F.col(c).alias(f"b_{c}") for c in ids], F.col("__segment").alias("b_segment"))
    rows = dealt.join(b, [*[dealt[c].eqNullSafe(b[f"b_{c}"]) for c in ids], dealt["__segment"] == b["b_segment"]], "left_semi")

    def leave(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(frame["__t"].to_numpy())
        own = int(np.searchsorted(times, (int(keys[-1]) + 1) * length))
        to, at = _way(times, within_ms), 0
        while at < own:
            at = int(to[at])
        return pd.DataFrame({**dict.fromkeys(ids), "__from": [times[0]], "__to": [times[at]]}).assign(**dict(zip(ids, keys[:-1]))) if at < len(times) else pd.DataFrame(columns=edge.names)

    return rows.groupBy(*ids, "__segment").applyInPandas(leave, edge)


def dedupe(inputs: DataFrame, existing: DataFrame | None = None, within_ms: int = WINDOW_MS, order: str | Sequence[str] = "seq", long_island: int = LONG_ISLAND) -> DataFrame:
    """Inputs with `kept`, in the order of the column or columns `order`.

    A row is refused when an accepted or existing row of its type, amount, party (any case)
    and channel lies at most within_ms away; refused rows refuse nothing. Rows without a
    valid date are accepted. Rows of one order value come in the order of their content, then
    of their place; those without a value come last. Every row comes back once.
    """
    return decide(numbered(inputs), existing, within_ms, order, long_island)


def numbered(inputs: DataFrame) -> DataFrame:
    """The inputs, written once, with their key, time and a number of their own."""
    columns = [F.col(f"`{c}`") for c in inputs.columns if c != "kept"]
    return scratch(with_key(inputs.select(*columns)).withColumn("__row", F.monotonically_increasing_id()), "inputs")


def decide(rows: DataFrame, existing: DataFrame | None = None, within_ms: int = WINDOW_MS, order: str | Sequence[str] = "seq", long_island: int = LONG_ISLAND) -> DataFrame:
    """dedupe for numbered() rows; written.

    Keys are hashed into parts. Rows of a part of at most long_island go by key through one
    shuffle, and only islands longer than the window are read again. A fuller part, which may
    hold one key of any number of rows, is cut by islands.
    """
    names = [c for c in rows.columns if c not in ("__party", "__ms", "__row")]
    columns = [F.col(f"`{c}`") for c in names]
    orders = [order] if isinstance(order, str) else list(order)
    values = [x.alias(f"{k}{i}") for i, c in enumerate(orders) for k, x in (("null", F.col(f"`{c}`").isNull()), ("value", F.col(f"`{c}`")))]
    content = F.xxhash64(*[F.col(f"`{c}`") for c in names if c not in ("id", "createdAt", *orders)])
    turn = [*values, content.alias("content"), F.col("__row").alias("row")]
    number, part, full = rows.count(), None, None
    if number > long_island:
        part = F.pmod(F.xxhash64(*KEY), F.lit(PARTS_A_LONG_ISLAND * number // long_island))
        full = scratch(rows.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).where(F.col("n") > long_island).select("__part"), "full")
        full = None if full.isEmpty() else full
    free = rows.withColumn("__refused", F.lit(False)) if existing is None else _refused(rows, with_key(existing), within_ms)
    few = free if full is None else free.join(F.broadcast(full), part == full["__part"], "left_anti")
    marked = scratch(_by_key(few, turn, within_ms), "marked")
    open_ = marked.where("__kept IS NULL")
    out = marked.where("__kept IS NOT NULL").select(*columns, F.col("__kept").alias("kept"))
    if full is None and open_.isEmpty():
        return out
    taken = _in_order(open_.withColumn("__seq", F.struct(*turn)), within_ms)
    out = out.unionByName(_with_taken(open_, taken, columns))
    if full is not None:
        many = scratch(free.join(F.broadcast(full), part == full["__part"], "left_semi"), "many")
        # of rows of one key and time only the first can be accepted
        nodes = many.where("__ms IS NOT NULL AND NOT __refused").withColumn("__seq", F.struct(*turn)).groupBy(*KEY, "__ms").agg(F.min("__seq").alias("__seq"))
        out = out.unionByName(_with_taken(many, _taken(_islands(nodes, within_ms), many.count(), within_ms, long_island), columns))
    return scratch(out, "decided")


def _with_taken(rows: DataFrame, taken: DataFrame, columns: list[Column]) -> DataFrame:
    found = rows.join(taken.withColumn("__taken", F.lit(True)), "__row", "left")
    return found.select(*columns, (F.coalesce("__taken", F.lit(False)) | F.col("__ms").isNull()).alias("kept"))


def _by_key(rows: DataFrame, turn: list[Column], within_ms: int) -> DataFrame:
    """Rows with `__island` and `__kept`, which is null in islands longer than the window. A key's rows are one task's."""
    apart = F.col("__ms").isNull() | F.col("__refused")
    # sorting compares the hash, a number, where the key's first column is a word that many rows share
    keys = ["__hash", *KEY, "__apart"]
    line = Window.partitionBy(*keys).orderBy("__ms")
    start = F.when(F.coalesce(F.col("__ms") - F.lag("__ms").over(line) > within_ms, F.lit(True)), F.col("__ms"))
    rows = rows.withColumn("__hash", F.xxhash64(*KEY)).withColumn("__apart", apart).withColumn("__start", start)
    rows = rows.withColumn("__island", F.max("__start").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")
    inside = Window.partitionBy(*keys, "__island").orderBy(*turn)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("__first", F.row_number().over(inside) == 1).withColumn("__last", F.max("__ms").over(whole))
    kept = F.when(F.col("__apart"), F.col("__ms").isNull()).when(F.col("__last") - F.col("__island") <= within_ms, F.col("__first"))
    return rows.withColumn("__kept", kept).drop("__hash", "__apart", "__first", "__last")


def _taken(islands: DataFrame, most: int, within_ms: int, long_island: int) -> DataFrame:
    """`__row` of all that is accepted; there are `most` rows at most."""
    if most <= long_island:
        return _in_order(islands, within_ms)
    islands, ids = scratch(islands, "islands"), [*KEY, "__island"]
    long = scratch(_long_ordered(islands, within_ms, long_island), "long")
    if long.isEmpty():
        return _in_order(islands, within_ms)
    short = islands.join(long, _same(islands, long, ids), "left_anti")
    cut = islands.join(long, _same(islands, long, ids)).select(islands["*"], (F.col("__ms") * F.col("__sign")).alias("__t"))
    times = _through_segments(cut, within_ms)
    found = cut.join(times, _same(cut, times, [*ids, "__t"])).select(cut["__seq.row"].alias("__row"))
    return _in_order(short, within_ms).unionByName(found)


def ingest_counts(marked: DataFrame) -> DataFrame:
    return marked.agg(F.count_if("kept").alias("inserted"), F.count_if(~F.col("kept")).alias("skipped"))


def last_by_id(rows: DataFrame, order: str) -> DataFrame:
    """Of rows with one id the last in `order`; rows without an id stay all."""
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(order)))
    return rows.where("id IS NOT NULL").withColumn("__n", last).where("__n = 1").drop("__n", order).unionByName(rows.where("id IS NULL").drop(order))


def upsert(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Old rows with new ones over them by id; of new rows with one id the last in `order` holds, those without an id are rows of their own."""
    latest = last_by_id(new, order)
    return old.join(latest, "id", "left_anti").unionByName(latest, allowMissingColumns=True)


def delete(old: DataFrame, ids: DataFrame) -> DataFrame:
    return old.join(ids, "id", "left_anti")
