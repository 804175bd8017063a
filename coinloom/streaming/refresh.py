"""Keeping a ledger current from a stream of transactions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Ledger
from .findings import LedgerFindings
from .views import LedgerTotals


def ingest_stream(stream: DataFrame, ledger: Ledger, checkpoint: str, refreshed: Callable[[DataFrame], None] | None = None, order: str = "seq", totals: Iterable[LedgerTotals | LedgerFindings] = (), **trigger) -> StreamingQuery:
    """Each micro-batch goes through the ledger's duplicate suppression; then `totals` (and findings) follow it and `refreshed` gets the new snapshot.

    The batch's number is part of its commit, under the name of the checkpoint, so a batch that
    is run again after a failure inserts nothing, whatever its rows. Only the ledger's files
    that may hold rows in reach of the batch are read.
    """

    def apply(batch: DataFrame, number: int) -> None:
        ledger.add_deduped(batch, order, batch=(checkpoint, number))
        for view in totals:
            view.refresh()
        if refreshed:
            refreshed(ledger.transactions().orderBy(F.desc("date"), "id"))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
