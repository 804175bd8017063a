"""Totals and rollups of a ledger that follow its commits instead of reading it again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import DAY_MS, iso_millis, local_day
from ..operators import listing
from ..schema import TRANSACTION
from ..sources.log import Change, Snapshot, TableLog
from ..sources.scratch import scratch
from ..sources.store import MOST_DAYS, Ledger

#: A cell has the columns that the listings read of a transaction: amountSantim is a sum, date the last one.
CELL = T.StructType([T.StructField(c, t) for c, t in (("id", T.StringType()), ("party", T.StringType()), ("type", T.StringType()), ("settled", T.BooleanType()), ("day", T.DateType()), ("amountSantim", T.LongType()), ("n", T.LongType()), ("date", T.StringType()))])
SOURCE = "transactions"


def _n() -> Column:
    """Rows that the cells stand for."""
    return F.coalesce(F.sum("n"), F.lit(0))


class Follower:
    """A table under a path of its own that refresh() brings to a commit of the ledger.

    The ledger's commit that the table stands for is part of the table's own, so a refresh
    that failed or ran twice changes nothing.
    """

    def __init__(self, ledger: Ledger, path: str):
        self.ledger = ledger
        self._log, self._source = TableLog(ledger.spark, path), ledger.log
        self._known_lost: tuple[int, tuple[str, ...], DataFrame] | None = None

    def version(self) -> int:
        """The ledger's commit that the table stands for."""
        return dict(self._log.snapshot().batches).get(SOURCE, 0)

    def refresh(self, now: Snapshot | None = None) -> int:
        """Follow to `now` (the ledger's newest commit); the commit that the table stands for then."""
        now = self._source.snapshot() if now is None else now
        while True:
            mine = self._log.snapshot()
            seen = dict(mine.batches).get(SOURCE, 0)
            if seen >= now.version:
                return seen
            if self._log.put(mine.version + 1, self._change(seen, now)):
                return now.version

    def _change(self, seen: int, now: Snapshot) -> Change:
        """What brings the table from one commit of the ledger to another."""
        raise NotImplementedError

    def _came(self, seen: int, now: Snapshot) -> Snapshot:
        """The files that came."""
        return now._replace(files=tuple(f for f in now.files if f.version > seen))

    def _lists(self, seen: int, now: Snapshot) -> tuple[str, ...]:
        """The lists of ids that went."""
        return tuple(path for path, version in now.gone if version > seen)

    def _lost(self, seen: int, lists: tuple[str, ...]) -> DataFrame:
        """The rows that these lists took."""
        if self._known_lost and self._known_lost[:2] == (seen, lists):
            return self._known_lost[2]
        old = self._source.read(self._source.at(seen), TRANSACTION)
        return old.join(self._source.ids(lists), "id", "left_semi")

    def _holding(self, now: Snapshot, days: DataFrame) -> Snapshot:
        """The files that may hold rows of these days (`day`, a date in some zone: it begins at most a day off UTC's)."""
        found = [r.day for r in days.select(F.unix_date("day").alias("day")).distinct().limit(MOST_DAYS + 1).collect()]
        if len(found) > MOST_DAYS or None in found:
            return now
        return now.within([((d - 1) * DAY_MS, (d + 2) * DAY_MS) for d in found])


class LedgerTotals(Follower):
    """Counts and sums of a ledger by party, type, openness and calendar day in zone tz, under a path of their own.

    refresh() adds what the ledger's newer commits changed. Rows that came add partial sums, and
    only their files are read. Cells that lost a row (an update or a deletion) are made anew
    from the files that hold their days; rows without a valid date may be in any file. A
    replacement of all rows (clear, compact) makes all cells anew.

    Rows of any columns may be null: parties are named as the rollup does, null types and days
    have cells of their own, null amounts count but add nothing. An empty ledger has no cells.
    """

    schema = CELL

    def __init__(self, ledger: Ledger, path: str, tz: str = "Africa/Addis_Ababa"):
        super().__init__(ledger, path)
        self.tz = tz

    def _change(self, seen: int, now: Snapshot) -> Change:
        batch = (SOURCE, now.version)
        if self._source.replaced(seen, now.version):
            return Change(self._write(self._cells(self._source.read(now, TRANSACTION))), replaces=True, batch=batch)
        new, lists = self._came(seen, now), self._lists(seen, now)
        came = self._cells(self._source.read(new, TRANSACTION))
        if not lists:
            return Change(self._write(came) if new.files else (), batch=batch)
        lost = scratch(self._cells(self._lost(seen, lists)).select("id", "day"), "lost")
        again = self._cells(self._source.read(self._holding(now, lost), TRANSACTION)).join(lost, "id", "left_semi")
        return Change(self._write(came.join(lost, "id", "left_anti").unionByName(again)), (self._log.write_ids(lost),), batch=batch)

    def _key(self) -> dict[str, Column]:
        settled = (F.col("type") == "credit") & ~listing.open_credit()
        return {"party": listing.party_name(), "type": F.col("type"), "settled": settled, "day": local_day(iso_millis("date"), self.tz)}

    def _cells(self, txns: DataFrame) -> DataFrame:
        key = self._key()
        cells = txns.groupBy(*[c.alias(n) for n, c in key.items()]).agg(F.sum("amountSantim").alias("amountSantim"), F.count("*").alias("n"), F.max("date").alias("date"))
        return cells.withColumn("id", F.sha2(F.to_json(F.struct(*key)), 256))

    def _write(self, cells: DataFrame):
        return self._log.write(scratch(cells, "cells"), self.schema, F.unix_date("day").cast("long") * DAY_MS)

    def cells(self) -> DataFrame:
        """Partial sums; a cell may have several."""
        return self._log.read(self._log.snapshot(), self.schema)

    def compact(self) -> None:
        """One row a cell, in files of one commit."""
        done = False
        while not done:
            mine = self._log.snapshot()
            whole = self._log.read(mine, self.schema).groupBy("id", *self._key()).agg(F.sum("amountSantim").alias("amountSantim"), F.sum("n").alias("n"), F.max("date").alias("date"))
            done = self._log.put(mine.version + 1, Change(self._write(whole), replaces=True))

    def party_rollup(self) -> DataFrame:
        return listing.party_rollup(self.cells(), _n())

    def party_ranking(self) -> DataFrame:
        return listing.party_ranking(self.cells(), _n())

    def history_totals(self, type_: str = "all") -> DataFrame:
        return listing.history_totals(listing.history(self.cells(), type_=type_), _n())

    def export_totals(self) -> DataFrame:
        return listing.export_totals(self.cells(), _n())

    def tiles(self, as_of_ms: int) -> DataFrame:
        return listing.tiles(self.cells(), as_of_ms, self.tz, F.col("day"))
