"""Progress: events of long matches, and counters that a running stream reports by itself."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Fixed value: fixes between two events of a match.
EVERY = 128
OUTCOMES = ("accepted", "rejected", "gap", "split")


def events(fixes: DataFrame, by: str = "trip_id", order: str = "seq") -> DataFrame:
    """(by, order) -> by, done, total: an event at every EVERY-th fix and at the last one of each trip."""
    w = W.partitionBy(by)
    rows = fixes.select(by, F.row_number().over(w.orderBy(order)).cast("long").alias("done"), F.count("*").over(w).alias("total"))
    return rows.where((F.col("done") % EVERY == 0) | (F.col("done") == F.col("total")))


def observed(outcomes: DataFrame, name: str = "ingest") -> DataFrame:
    """The same rows; whoever runs them reports how many had which outcome, without another pass."""
    return outcomes.observe(name, *(F.count_if(F.col("outcome") == k).alias(k) for k in OUTCOMES), F.count("*").alias("n"))


class Progress(StreamingQueryListener):
    """Sums what the batches of observed streams report: spark.streams.addListener(Progress())."""

    def __init__(self, name: str = "ingest"):
        self.name, self.totals, self.batches = name, Counter(), []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            counts = row.asDict()
            self.totals.update(counts)
            self.batches.append((event.progress.batchId, counts["n"]))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
