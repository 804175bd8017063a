"""Duplicate suppression with keyed state, for streams that aren't written to a ledger batch by batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalar import DAY_MS
from ..operators.findings import KEY, with_key
from ..operators.ingest import WINDOW_MS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEEP_MS = 7 * DAY_MS


class _Windows(StatefulProcessor):
    """Of one key: the accepted time of each window-wide bucket, one at most, and the newest time met."""

    def __init__(self, within_ms: int, keep_ms: int, columns: list[str]):
        self.within, self.keep, self.columns = within_ms, keep_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        number = lambda name: T.StructType([T.StructField(name, T.LongType())])
        self.taken = handle.getMapState("taken", number("bucket"), number("ms"))
        self.newest = handle.getValueState("newest", number("ms"))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # by place: made columns come without their names
        frame = pd.concat([f.set_axis([*self.columns, "__party", "__ms", "__seq"], axis=1) for f in rows], ignore_index=True).sort_values("__seq", kind="stable")
        width = max(self.within, 1)
        times = {k[0]: v[0] for k, v in self.taken.iterator()}
        before = dict(times)
        kept = []
        for ms in frame["__ms"]:
            if pd.isna(ms):
                kept.append(True)
                continue
            ms = int(ms)
            at = ms // width
            clash = at in times or ms - times.get(at - 1, ms - self.within - 1) <= self.within or times.get(at + 1, ms + self.within + 1) - ms <= self.within
            kept.append(not clash)
            if not clash:
                times[at] = ms
        met = frame["__ms"].max()
        if not pd.isna(met):
            newest = max(int(met), self.newest.get()[0] if self.newest.exists() else int(met))
            self.newest.update((newest,))
            old = {at for at, ms in times.items() if ms < newest - self.keep}
            for at in old & before.keys():
                self.taken.removeKey((at,))
            for at in times.keys() - before.keys() - old:
                self.taken.updateValue((at,), (times[at],))
        yield frame[self.columns].assign(kept=np.array(kept, bool))

    def close(self) -> None:
        pass


def dedupe_stream(stream: DataFrame, within_ms: int = WINDOW_MS, keep_ms: int = KEEP_MS, order: str = "seq") -> DataFrame:
    """The stream's rows with `kept`, as the batch dedupe marks them: micro-batches one after another, in each the order of `order`, no value last.

    A key's state holds an accepted time a window, of the last keep_ms up to the newest time
    that the key has met. Results equal the batch's as long as no row comes more than
    keep_ms - within_ms behind a row of its key. Rows without a valid date are kept. A micro-batch's rows of
    one key are in memory at once. The session's state store must be RocksDB.
    """
    if stream.sparkSession.conf.get(PROVIDER, "") != ROCKSDB:
        raise ValueError(f"{PROVIDER} must be {ROCKSDB}")
    names = [c for c in stream.columns if c != "kept"]
    rows = with_key(stream.select(*[F.col(f"`{c}`") for c in names])).withColumn("__seq", F.coalesce(F.col(order).cast("long"), F.lit((1 << 63) - 1)))
    schema = T.StructType([*[stream.schema[c] for c in names], T.StructField("kept", T.BooleanType())])
    windows = _Windows(within_ms, keep_ms, names)
    return rows.groupBy(*KEY).transformWithStateInPandas(statefulProcessor=windows, outputStructType=schema, outputMode="Append", timeMode="None")
