"""Findings of a ledger that follow its commits instead of reading it again."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import DAY_MS, iso_millis, local_day, utc_day
from ..operators import findings as rules
from ..operators import listing
from ..schema import FINDING, TRANSACTION
from ..sources.log import Change, Snapshot
from ..sources.scratch import scratch
from ..sources.store import Ledger
from .views import SOURCE, Follower, LedgerTotals

#: A finding about neighbours with the time of its later row.
PAIR = T.StructType([*FINDING.fields, T.StructField("laterMs", T.LongType())])
AIRTIME_CELL = T.StructType([T.StructField(c, t) for c, t in (("id", T.StringType()), ("label", T.StringType()), ("day", T.DateType()), ("amountSantim", T.LongType()), ("n", T.LongType()), ("date", T.StringType()))])
#: Buckets of time as long as the longest reach of a rule about neighbours.
REACH_MS = max(rules.DUPLICATE_MS, rules.PROBE_MS)


def _bucket(ms: str) -> Column:
    return F.floor(F.col(ms) / REACH_MS)


class NeighbourFindings(Follower):
    """Duplicates and probes. A row that came or went changes findings of its own time bucket and the next only: those are made anew from the files that hold these buckets and the one before."""

    def __init__(self, ledger: Ledger, path: str, round_unit_santim: int = rules.PROBE_UNIT):
        super().__init__(ledger, path)
        self.unit = round_unit_santim

    def _found(self, txns: DataFrame) -> DataFrame:
        found = rules.duplicates(txns, also=("__ms",)).unionByName(rules.probes(txns, self.unit, also=("__ms",)))
        return found.withColumnRenamed("__ms", "laterMs")

    def _write(self, found: DataFrame):
        # written first: a write by ranges of time looks at its rows twice
        return self._log.write(scratch(found, "pairs"), PAIR, F.col("laterMs"))

    def _change(self, seen: int, now: Snapshot) -> Change:
        batch = (SOURCE, now.version)
        if self._source.replaced(seen, now.version):
            return Change(self._write(self._found(self._source.read(now, TRANSACTION))), replaces=True, batch=batch)
        changed, lists = self._source.read(self._came(seen, now), TRANSACTION), self._lists(seen, now)
        if lists:
            changed = changed.unionByName(self._lost(seen, lists))
        timed = changed.select(iso_millis("date").alias("__ms")).where("__ms IS NOT NULL")
        touched = scratch(timed.select(F.explode(F.array(_bucket("__ms"), _bucket("__ms") + 1)).alias("__bucket")).distinct(), "touched")
        near = touched.select(F.explode(F.array("__bucket", F.col("__bucket") - 1)).alias("__bucket")).distinct()
        days = near.select(F.date_from_unix_date(F.floor(F.col("__bucket") * REACH_MS / DAY_MS).cast("int")).alias("day"))
        rows = self._source.read(self._holding(now, days), TRANSACTION).withColumn("__ms", iso_millis("date"))
        rows = rows.withColumn("__bucket", _bucket("__ms")).join(near, "__bucket", "left_semi").drop("__bucket", "__ms")
        in_touched = lambda found: found.withColumn("__bucket", _bucket("laterMs")).join(touched, "__bucket", "left_semi").drop("__bucket")
        mine, made = self._log.snapshot(), self._write(in_touched(self._found(rows)))
        others = self._log.read(mine, PAIR).select(_bucket("laterMs").alias("__bucket")).join(touched, "__bucket", "left_anti")
        if others.isEmpty():  # no finding stays: these take the place of all, without a list of ids for every reader to join
            return Change(made, replaces=True, batch=batch)
        gone = in_touched(self._log.read(self._holding(mine, days), PAIR))
        return Change(made, (self._log.write_ids(gone),), batch=batch)

    def findings(self) -> DataFrame:
        return self._log.read(self._log.snapshot(), PAIR).drop("laterMs")


class OpenCredits(Follower):
    """The rows of open credit."""

    def _change(self, seen: int, now: Snapshot) -> Change:
        replaces = self._source.replaced(seen, now.version)
        rows = self._source.read(now if replaces else self._came(seen, now), TRANSACTION).where(listing.open_credit())
        lists = () if replaces else self._lists(seen, now)
        gone = (self._log.write_ids(self._log.read(self._log.snapshot(), TRANSACTION).join(self._source.ids(lists), "id", "left_semi")),) if lists else ()
        return Change(self._log.write(rows, TRANSACTION, iso_millis("date")), gone, replaces, (SOURCE, now.version))

    def rows(self) -> DataFrame:
        return self._log.read(self._log.snapshot(), TRANSACTION)


class AirtimeDays(LedgerTotals):
    """Airtime by day as the rule names it, and by the UTC day of its time."""

    schema = AIRTIME_CELL

    def __init__(self, ledger: Ledger, path: str):
        super().__init__(ledger, path, "UTC")

    def _key(self) -> dict[str, Column]:
        return {"label": utc_day("date"), "day": local_day(iso_millis("date"), self.tz)}

    def _cells(self, txns: DataFrame) -> DataFrame:
        return super()._cells(txns.where(F.col("type") == "airtime"))

    def spikes(self) -> DataFrame:
        """(label, UTC day) of days that stand out, and their totals."""
        days = self.cells().groupBy(F.col("label").alias("day")).agg(F.sum("amountSantim").alias("total"), F.sum("n").alias("n"))
        spikes = rules.spike_days(days).select("day")
        return self.cells().select(F.col("label"), "day").distinct().join(spikes.withColumnRenamed("day", "label"), "label", "left_semi")


class LedgerFindings:
    """The five rules over a ledger as of its commits and any moment, late, updated and deleted rows included.

    Neighbour findings, open credits and airtime by day are kept as tables under the path and
    follow the commits. What depends on the moment is made when asked for: ageing credits
    from the open ones, so that a finding comes with time alone; large outflows from the
    ledger's files of the last days; the rows of a spike from the files of its day.
    """

    def __init__(self, ledger: Ledger, path: str, round_unit_santim: int = rules.PROBE_UNIT):
        self.ledger = ledger
        self._pairs = NeighbourFindings(ledger, f"{path}/neighbours", round_unit_santim)
        self._credits = OpenCredits(ledger, f"{path}/credits")
        self._airtime = AirtimeDays(ledger, f"{path}/airtime")

    def version(self) -> int:
        """The ledger's commit that all tables stand for."""
        return min(part.version() for part in (self._pairs, self._credits, self._airtime))

    def refresh(self) -> int:
        """The tables follow side by side; rows that went are looked up once for all."""
        now, parts = self.ledger.log.snapshot(), (self._pairs, self._credits, self._airtime)
        seen = self.version()
        lists = self._pairs._lists(seen, now)
        if lists and not self.ledger.log.replaced(seen, now.version):
            lost = scratch(self._pairs._lost(seen, lists), "lost")
            for part in parts:
                part._known_lost = (seen, lists, lost)
        try:
            with ThreadPoolExecutor(len(parts)) as pool:
                list(pool.map(lambda part: part.refresh(now), parts))
        finally:
            for part in parts:
                part._known_lost = None
        return self.version()

    def _snapshot(self) -> Snapshot:
        now, version = self.ledger.log.snapshot(), self.version()
        return now if now.version == version else self.ledger.log.at(version)

    def findings(self, as_of_ms: int) -> DataFrame:
        """As all_findings gives them for the ledger's rows at version()."""
        log, now = self.ledger.log, self._snapshot()
        recent = log.read(now.within([(as_of_ms - rules.OUTFLOW_DAYS * DAY_MS + 1, (1 << 63) - 1)]), TRANSACTION)
        spikes = scratch(self._airtime.spikes(), "spikes")
        days = log.read(self._airtime._holding(now, spikes), TRANSACTION)
        parts = (
            self._pairs.findings(),
            rules.large_outflows(recent, as_of_ms),
            rules.airtime_spikes(days, days=spikes.select(F.col("label").alias("day")).distinct()),
            rules.aging_credits(self._credits.rows(), as_of_ms),
        )
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
