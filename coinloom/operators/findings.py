"""Rule-based findings over transactions.

Rules about neighbours in time need only neighbours closer than a limit, so rows are dealt
into time buckets of that length, each row also into the next bucket: no key and no
"all outflows" ever becomes one task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import DAY_MS, iso_millis, utc_day
from .listing import open_credit

#: Limits of the rules, amounts in santim.
DUPLICATE_MS = 600_000
PROBE_MS = 1_800_000
OUTFLOW_DAYS, OUTFLOW_TIMES = 30, 3
AIRTIME_TIMES, AIRTIME_FLOOR, AIRTIME_ROWS = 3, 5000, 4
CREDIT_DAYS, CREDIT_HIGH_DAYS = 30, 60
PROBE_MOST, PROBE_UNIT, PROBE_TIMES = 10_000, 100_000, 20
#: Titles and reasons of the findings; the columns of a transaction and the age stand in braces.
DUPLICATE_TITLE = "Possible duplicate transaction"
DUPLICATE_REASON = 'Same {type} of the same amount to "{party}" via {channel} within 10 minutes.'
OUTFLOW_TITLE = "Unusually large outflow"
OUTFLOW_REASON = "More than 3× your 30-day median outflow."
AIRTIME_TITLE = "Airtime spike on {day}"
AIRTIME_REASON = "Airtime that day is more than 3× your daily average."
CREDIT_TITLE = "Open credit {age}d old"
CREDIT_REASON = 'Credit to "{party}" hasn\'t been marked settled.'
PROBE_TITLE = "Small test transfer before a large one"
PROBE_REASON = 'A tiny round transfer to "{party}" was followed by a much larger one within 30 minutes.'

KEY = ("type", "amountSantim", "__party", "channel")


def with_key(txns: DataFrame) -> DataFrame:
    return txns.withColumn("__party", F.lower("party")).withColumn("__ms", iso_millis("date"))


def with_previous(rows: DataFrame, keys: tuple[str, ...], reach_ms: int, columns: tuple[str, ...]) -> DataFrame:
    """Each row with `prev_<column>` of the row before it in time among its keys, where that is at most reach_ms away."""
    own = F.floor(F.col("__ms") / reach_ms)
    dealt = rows.where("__ms is not null").withColumn("__own", own).withColumn("__bucket", F.explode(F.array(own, own + 1)))
    line = Window.partitionBy(*keys, "__bucket").orderBy("__ms", "id")
    before = [F.lag(c).over(line).alias(f"prev_{c}") for c in (*columns, "__ms")]
    found = dealt.select("*", *before).where(F.col("__own") == F.col("__bucket"))
    return found.where(F.col("__ms") - F.col("prev___ms") <= reach_ms)


def _filled(text: str, **values: Column) -> Column:
    """The text with columns in the place of names in braces."""
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*[values.get(p, F.col(p)) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def _finding(id_: Column, severity, kind: str, title, reason, ids: Column) -> list[Column]:
    text = lambda x: _filled(x) if isinstance(x, str) else x
    return [id_.alias("id"), text(severity).alias("severity"), F.lit(kind).alias("kind"), text(title).alias("title"), text(reason).alias("reason"), ids.alias("txnIds")]


def duplicates(txns: DataFrame, within_ms: int = DUPLICATE_MS, also: tuple[str, ...] = ()) -> DataFrame:
    """Consecutive rows of one type, amount, party and channel at most within_ms apart; `also` names columns of the later row to keep."""
    pairs = with_previous(with_key(txns), KEY, within_ms, ("id",))
    ids = F.array("prev_id", "id")
    return pairs.select(*_finding(F.concat(F.lit("dup:"), "prev_id", F.lit(":"), "id"), "medium", "duplicate", DUPLICATE_TITLE, DUPLICATE_REASON, ids), *also)


def exact_median(values: DataFrame, column: str, width: int = 65_536) -> DataFrame:
    """One row with `median` (0 without values): counts a value, then a prefix sum over ranges of values, then inside the middle range."""
    counts = values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("v") / width))
    parts = counts.groupBy("part").agg(F.sum("n").alias("part_n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", "part_n", F.coalesce(F.sum("part_n").over(upto), F.lit(0)).alias("before"), F.sum("part_n").over(Window.partitionBy()).alias("total"))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    middle = parts.where((F.col("before") < high) & (F.col("before") + F.col("part_n") >= low))
    inside = Window.partitionBy("part").orderBy("v")
    ranked = counts.join(middle, "part").withColumn("last", F.col("before") + F.sum("n").over(inside)).withColumn("first", F.col("last") - F.col("n") + 1)
    at = lambda rank: F.max(F.when((F.col("first") <= rank) & (F.col("last") >= rank), F.col("v")))
    return ranked.agg(F.coalesce((at(low) + at(high)) / 2, F.lit(0.0)).cast("double").alias("median"))


def large_outflows(txns: DataFrame, as_of_ms: int, days: int = OUTFLOW_DAYS, times: int = OUTFLOW_TIMES) -> DataFrame:
    """Recent outflows above so many times their median; rows of the future are recent."""
    recent = txns.where((F.col("type") == "out") & (F.lit(as_of_ms) - iso_millis("date") < days * DAY_MS))
    middle = exact_median(recent, "amountSantim")  # one row
    hits = recent.join(F.broadcast(middle), (F.col("median") > 0) & (F.col("amountSantim") > F.col("median") * times))
    return hits.select(*_finding(F.concat(F.lit("large:"), "id"), "high", "large_outflow", OUTFLOW_TITLE, OUTFLOW_REASON, F.array("id")))


def airtime_days(txns: DataFrame) -> DataFrame:
    """(day, total, n) of every UTC day with airtime."""
    airtime = txns.where(F.col("type") == "airtime").withColumn("day", utc_day("date"))
    return airtime.groupBy("day").agg(F.sum("amountSantim").alias("total"), F.count("*").alias("n"))


def spike_days(days: DataFrame, times: int = AIRTIME_TIMES, floor_santim: int = AIRTIME_FLOOR, min_rows: int = AIRTIME_ROWS) -> DataFrame:
    """Of (day, total, n) the days above so many times the average."""
    overall = days.agg((F.sum("total") / F.count("*")).alias("average"), F.sum("n").alias("rows"))  # one row
    return days.join(F.broadcast(overall), (F.col("rows") >= min_rows) & (F.col("total") > F.col("average") * times) & (F.col("total") > floor_santim))


def airtime_spikes(txns: DataFrame, times: int = AIRTIME_TIMES, floor_santim: int = AIRTIME_FLOOR, min_rows: int = AIRTIME_ROWS, days: DataFrame | None = None) -> DataFrame:
    """Days whose airtime is above so many times the average over days with airtime. With spike_days' result as `days`, txns needs only the rows of these."""
    airtime = txns.where(F.col("type") == "airtime").withColumn("day", utc_day("date"))
    spikes = spike_days(airtime_days(txns), times, floor_santim, min_rows) if days is None else days
    members = airtime.join(spikes.select("day"), "day").groupBy("day").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return members.select(*_finding(F.concat(F.lit("airspike:"), "day"), "medium", "airtime_spike", AIRTIME_TITLE, AIRTIME_REASON, F.col("ids")))


def aging_credits(txns: DataFrame, as_of_ms: int) -> DataFrame:
    """Open credit older than 30 days, high above 60."""
    age = F.lit(as_of_ms) - iso_millis("date")
    old = txns.where(open_credit() & (age > CREDIT_DAYS * DAY_MS))
    title = _filled(CREDIT_TITLE, age=F.floor(age / DAY_MS).cast("string"))
    return old.select(*_finding(F.concat(F.lit("aging:"), "id"), F.when(age > CREDIT_HIGH_DAYS * DAY_MS, "high").otherwise("medium"), "aging_credit", title, CREDIT_REASON, F.array("id")))


def probes(txns: DataFrame, round_unit_santim: int = PROBE_UNIT, also: tuple[str, ...] = ()) -> DataFrame:
    """A small round outflow directly before one over 20 times as large to the same party, within 30 minutes; `also` as in duplicates.

    With the default unit only a zero amount is both small and round; pass 10_000 for round hundreds of birr.
    """
    pairs = with_previous(with_key(txns.where(F.col("type") == "out")), (), PROBE_MS, ("id", "party", "amountSantim"))
    small, large = F.col("prev_amountSantim"), F.col("amountSantim")
    hits = pairs.where((F.col("__ms") - F.col("prev___ms") < PROBE_MS) & (F.col("prev_party") == F.col("party")) & (small <= PROBE_MOST) & (small % round_unit_santim == 0) & (large > small * PROBE_TIMES))
    return hits.select(*_finding(F.concat(F.lit("test:"), "prev_id", F.lit(":"), "id"), "low", "test_before_large", PROBE_TITLE, PROBE_REASON, F.array("prev_id", "id")), *also)


def all_findings(txns: DataFrame, as_of_ms: int) -> DataFrame:
    """The five rules, their ids distinct by prefix."""
    parts = (duplicates(txns), large_outflows(txns, as_of_ms), airtime_spikes(txns), aging_credits(txns, as_of_ms), probes(txns))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def active(findings: DataFrame, ignored: DataFrame) -> DataFrame:
    return findings.join(ignored, "id", "left_anti")


def dismissed(findings: DataFrame, ignored: DataFrame) -> DataFrame:
    return findings.join(ignored, "id", "left_semi")


def members(findings: DataFrame, txns: DataFrame) -> DataFrame:
    """(finding_id, position, transaction columns) of every listed transaction that exists."""
    listed = findings.select(F.col("id").alias("finding_id"), F.posexplode("txnIds").alias("position", "id"))
    return listed.join(txns, "id")


def ignore(ignored: DataFrame, ids: DataFrame) -> DataFrame:
    return ignored.select("id").union(ids.select("id")).distinct()


def restore(ignored: DataFrame, ids: DataFrame) -> DataFrame:
    return ignored.join(ids, "id", "left_anti")
