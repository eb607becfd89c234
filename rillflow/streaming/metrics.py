"""Progress of streaming queries as metric lines."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Metrics(StreamingQueryListener):
    """Keeps input counts per query and hands every progress report to ``emit``."""

    def __init__(self, emit=None):
        self.input_counts: dict[str, int] = {}
        self.emit = emit or (lambda m: print(json.dumps(m), file=sys.stderr))

    def onQueryStarted(self, event):
        self.input_counts.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event):
        p = event.progress
        name = p.name or str(p.id)
        self.input_counts[name] = self.input_counts.get(name, 0) + p.numInputRows
        self.emit({"query": name, "batch": p.batchId, "inputEventCount": p.numInputRows, "rowsPerSecond": p.processedRowsPerSecond})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def log_metrics(spark: SparkSession, emit=None) -> Metrics:
    m = Metrics(emit)
    spark.streams.addListener(m)
    return m
