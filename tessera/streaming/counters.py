"""Counts that come with the work: metrics observed on the rows of a batch or
a stream while they pass to their sink, so that no second read is needed."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming.listener import StreamingQueryListener


class Totals(StreamingQueryListener):
    """Sums of an observed metric over the micro-batches of one query.

    ``batches`` has the counts of each micro-batch of this run.  A replayed
    micro-batch replaces its earlier counts."""

    def __init__(self, name: str):
        self.name, self.batches = name, {}
        self._ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None and event.progress.numInputRows:
            self.batches[event.progress.batchId] = row.asDict()

    def onQueryTerminated(self, event) -> None:
        self._ended.set()

    def wait(self, seconds: float = 60) -> dict:
        """The sums, when the query has ended and all its events are in."""
        if not self._ended.wait(seconds):
            raise TimeoutError(f"no end of the query within {seconds} s")
        out: dict = {}
        for counts in self.batches.values():
            for k, v in counts.items():
                out[k] = out.get(k, 0) + (v or 0)
        return out


def observed_write(df: DataFrame, write, **counts: Column) -> dict:
    """Run ``write(df)`` once and return the values of the aggregates
    ``counts`` over the rows that it wrote."""
    seen = Observation()
    write(df.observe(seen, *[c.alias(k) for k, c in counts.items()]))
    return seen.get
