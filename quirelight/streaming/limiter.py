"""Rate limiter and failure guard as keyed state of a stream.

Calls arrive with their service and outcome; each gets the start of its slot, and the run of failures it ends.  The state
is one value a service in the state store, so all tasks, passes and restarts share it: the next slot is carried over
batches, and the checkpoint over restarts.  Within a batch calls are taken in order of time; a batch's slots are those of
the closed form, ``at_i = i * gap + max over j <= i of (now_j - j * gap)``, started from the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SLOTS = "service string, order long, now long, at long, streak long, tripped boolean"


class Slots(StatefulProcessor):
    """(service, order, now, failed) -> (service, order, now, at, streak, tripped); times in microseconds.

    Idle time is not banked, so the state of a service that was silent says no more than that its next slot is free.
    """

    def __init__(self, gap: int, limit: int) -> None:
        self.gap, self.limit = gap, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("slot", "next long, streak long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["now", "order"], kind="stable")
        free, streak = self.state.get() if self.state.exists() else (None, 0)
        now, failed = calls["now"].to_numpy(np.int64), calls["failed"].to_numpy(bool)
        place = np.arange(len(now), dtype=np.int64)
        ready = now - place * self.gap
        if free is not None:
            ready[0] = max(ready[0], free)
        at = place * self.gap + np.maximum.accumulate(ready)
        # a run of failures counts from the last success, or goes on from the state
        last = np.maximum.accumulate(np.where(~failed, place, -1))
        run = np.where(failed, place - last, 0) + np.where(failed & (last < 0), streak, 0)
        self.state.update((int(at[-1] + self.gap), int(run[-1])))
        yield pd.DataFrame({"service": key[0], "order": calls["order"].to_numpy(), "now": now, "at": at, "streak": run, "tripped": (run >= self.limit) & (self.limit > 0)})

    def close(self) -> None:
        pass


def slots(calls: DataFrame, gap: int, limit: int = 6) -> DataFrame:
    """The slots of a stream of ``calls`` (service, order, now, failed), as a stream."""
    given = calls.select("service", "order", "now", "failed").groupBy("service")
    return given.transformWithStateInPandas(Slots(gap, limit), SLOTS, "append", "none")
