"""The end of a watch as a stream: one state per watch, which goes on from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "watch long, at long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class WatchEnd(StatefulProcessor):
    """Counts idle polls in a row; ``needed`` of them, or one unreadable poll, end a watch, which is told once.

    With ``silence`` (milliseconds) a watch that hears nothing for so long ends at its last poll.
    """

    def __init__(self, needed: int, silence: int | None):
        self.needed, self.silence = needed, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("watch", "run int, last long, ended boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        run, last, ended = self.state.get() if self.state.exists() else (0, None, False)
        if ended:
            return
        polls = pd.concat(list(rows)).sort_values("at")
        for at, busy, pending in zip(polls["at"], polls["busy"], polls["pending"]):
            last = int(at)
            lost = pd.isna(busy) and pd.isna(pending)
            quiet = not pd.isna(busy) and not busy and (pd.isna(pending) or pending == 0)
            run = run + 1 if quiet else 0
            if lost or run >= self.needed:
                ended = True
                break
        self.state.update((run, last, ended))
        if self.silence is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if not ended:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence)
        if ended:
            yield pd.DataFrame({"watch": [key[0]], "at": [last]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        run, last, ended = self.state.get()
        if not ended:
            self.state.update((run, last, True))
            yield pd.DataFrame({"watch": [key[0]], "at": [last]})

    def close(self) -> None:
        pass


def watch_ends(polls: DataFrame, needed: int = 2, silence: int | None = None) -> DataFrame:
    """watch, at: the poll that ended each watch, of a stream of (watch, at, busy, pending).

    Polls of one batch are taken in the order of ``at``; batches follow one another. The rule is that of ``sync.idle``.
    With ``silence`` the stream looks at its clock as long as it runs, so ``availableNow`` is for streams without it.
    """
    mode = "None" if silence is None else "ProcessingTime"
    polls.sparkSession.conf.set(_PROVIDER, _ROCKSDB)
    return polls.groupBy("watch").transformWithStateInPandas(WatchEnd(needed, silence), SCHEMA, "Append", mode)
