"""Progress as observed metrics: totals that a running plan counts as rows pass, with no job of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def counted(files: DataFrame, name: str = "files") -> tuple[DataFrame, Observation]:
    """``files`` and what will hold its rows and bytes once an action has run over it."""
    seen = Observation(name)
    return files.observe(seen, F.count("*").alias("files"), F.coalesce(F.sum("orig_size"), F.lit(0)).alias("bytes")), seen


class ProgressListener(StreamingQueryListener):
    """Calls back with (batch, metrics) after each micro-batch of a stream."""

    def __init__(self, callback: Callable[[int, dict], None]):
        self.callback = callback

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        metrics = {k: v.asDict() for k, v in (event.progress.observedMetrics or {}).items()}
        self.callback(event.progress.batchId, metrics)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
