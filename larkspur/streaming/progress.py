"""Progress of stages, the registry of jobs, and events as lines."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: How long a finished job is kept, and how many jobs are.
TTL_HOURS, MAX_JOBS = 1, 200


class Progress:
    """Calls back with a stage's name and the share of stages that are done; remembers how long each took."""

    def __init__(self, stages: list[str], callback: Callable[[str, float], None] | None = None):
        self.stages, self.callback = stages, callback
        self.seconds: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        self._tell(name)
        start = time.monotonic()
        try:
            yield
        finally:
            self.seconds[name] = time.monotonic() - start
        self._tell(name)

    def _tell(self, name: str) -> None:
        if self.callback:
            self.callback(name, len(self.seconds) / max(len(self.stages), 1))


class StreamProgress(StreamingQueryListener):
    """Passes on how many rows each micro-batch of a stream had."""

    def __init__(self, callback: Callable[[str, int], None]):
        self.callback = callback

    def onQueryStarted(self, event) -> None:
        self.callback("started", 0)

    def onQueryProgress(self, event) -> None:
        self.callback("progress", int(event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.callback("ended", 0)


def live_jobs(jobs: DataFrame, now: Column, hours: int = TTL_HOURS, most: int = MAX_JOBS) -> DataFrame:
    """Jobs that run, or have ended within the time to live; the `most` newest. jobs: job_id, created_at, finished_at."""
    kept = jobs.where(F.col("finished_at").isNull() | (F.col("finished_at") >= now - F.expr(f"INTERVAL {hours} HOURS")))
    return kept.orderBy(F.col("created_at").desc(), "job_id").limit(most)


def lines(events: DataFrame, key: str, order: str) -> DataFrame:
    """key, lines: the events of each key as JSON lines, in order."""
    rest = [c for c in events.columns if c not in (key, order)]
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.to_json(F.struct(*rest)).alias("line"))))
    return events.groupBy(key).agg(F.array_join(F.transform(pairs, lambda p: p["line"]), "\n").alias("lines"))
