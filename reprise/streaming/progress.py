"""Progress of a maintained clone store, as begin, report and end notices."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

Notice = Callable[[str, str], None]


class ProgressListener(StreamingQueryListener):
    """Calls notice(kind, text): `begin` when a query starts, `report` after each batch, `end` when it stops."""

    def __init__(self, notice: Notice):
        self.notice = notice

    def onQueryStarted(self, event) -> None:
        self.notice("begin", event.name or str(event.id))

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        self.notice("report", f"batch {p['batchId']}: {p['numInputRows']} events")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.notice("end", event.exception or "")


def listen(spark: SparkSession, notice: Notice) -> ProgressListener:
    listener = ProgressListener(notice)
    spark.streams.addListener(listener)
    return listener
