"""Counts that a stream observes on its way, by epoch."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql.streaming import StreamingQueryListener

EPOCHS_KEPT = 1_000


class EpochCounts(StreamingQueryListener):
    """Keeps the observed metrics of the newest epochs: ``counts[query name or id, epoch][observation]``.

    Add it with ``spark.streams.addListener`` before the query starts. The counts are figures
    for watching a job: a task that is repeated in a stage before a shuffle counts again.
    Durable counts of committed rows are ``epochs.epoch_counts``.
    """

    def __init__(self, keep: int = EPOCHS_KEPT) -> None:
        self.keep = keep
        self.counts: OrderedDict[tuple[str, int], dict[str, dict]] = OrderedDict()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        observed = {name: row.asDict() for name, row in progress.observedMetrics.items()}
        if observed:
            self.counts[progress.name or str(progress.id), progress.batchId] = observed
        while len(self.counts) > self.keep:
            self.counts.popitem(last=False)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
