"""Lifecycle of streaming pipelines, and metrics of their progress."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

STOPPED, STARTING, STARTED = "STOPPED", "STARTING", "STARTED"


class Pipeline:
    """Starts one streaming query at a time; starting twice raises, a failed start leaves it stopped."""

    def __init__(self, start: Callable[[], Any]):
        self._start, self._query, self._lock, self._starting = start, None, threading.Lock(), False

    def start(self) -> Any:
        with self._lock:
            if self._starting or self._query is not None:
                raise RuntimeError("already started")
            self._starting = True
        try:
            self._query = self._start()
        finally:
            self._starting = False
        return self._query

    def stop(self) -> None:
        query, self._query = self._query, None
        if query is not None:
            query.stop()

    @property
    def state(self) -> str:
        if self._starting:
            return STARTING
        return STARTED if self._query is not None and self._query.isActive else STOPPED


class MetricRegistry:
    """Gauges by name and tags. Registering again replaces; only the current owner may take a gauge back; an absent one is the default."""

    def __init__(self):
        self._gauges: dict[tuple, tuple[object, Callable[[], float]]] = {}

    @staticmethod
    def key(name: str, **tags: str) -> tuple:
        return name, tuple(sorted(tags.items()))

    def register(self, key: tuple, owner: object, value: Callable[[], float]) -> None:
        self._gauges[key] = (owner, value)

    def unregister(self, key: tuple, owner: object) -> bool:
        if key in self._gauges and self._gauges[key][0] is owner:
            del self._gauges[key]
            return True
        return False

    def value(self, key: tuple, default: float = float("nan")) -> float:
        return self._gauges[key][1]() if key in self._gauges else default


SUBSCRIBED, CANCELED, ERRORED, COMPLETED = "SUBSCRIBED", "CANCELED", "ERRORED", "COMPLETED"


class Listener:
    """Is told of a stream's states, with what is known of them, and of each batch."""

    def state_changed(self, state: str, about: Any) -> None:
        pass

    def next(self, progress: Any) -> None:
        pass


class LoggingListener(Listener):
    """Logs batches and errors, each at its level (None: not at all)."""

    def __init__(self, logger: logging.Logger, next_level: int | None = logging.INFO, error_level: int | None = logging.ERROR):
        self.logger, self.next_level, self.error_level = logger, next_level, error_level

    def state_changed(self, state: str, about: Any) -> None:
        if state == ERRORED and self.error_level is not None:
            self.logger.log(self.error_level, "%s: %s", state, about)

    def next(self, progress: Any) -> None:
        if self.next_level is not None:
            self.logger.log(self.next_level, "batch %s: %s rows", progress.batchId, progress.numInputRows)


class MetricsListener(Listener):
    """<name>.items and <name>.errors count what `observed` reports under the name, and failures; <name>.subscribers how many queries run."""

    def __init__(self, registry: MetricRegistry, name: str, **tags: str):
        self.name, self.counts = name, {"items": 0, "errors": 0, "subscribers": 0}
        for n in self.counts:
            registry.register(registry.key(f"{name}.{n}", **tags), self, lambda n=n: float(self.counts[n]))

    def state_changed(self, state: str, about: Any) -> None:
        self.counts["subscribers"] += 1 if state == SUBSCRIBED else -1
        self.counts["errors"] += state == ERRORED

    def next(self, progress: Any) -> None:
        seen = progress.observedMetrics.get(self.name)
        if seen is not None:
            self.counts["items"] += seen["items"]
            self.counts["errors"] += seen["errors"]


def progress_metrics(progress: Any, names: list[str] = (), whitelist: bool = False) -> list[tuple[str, str, dict[str, str], float]]:
    """(group, name, tags, value) of each number that a query's sources report; a list of names leaves them out, or lets only them
    in. What is no number is NaN."""
    out = []
    for source in progress.sources:
        for name, value in (source.metrics or {}).items():
            if whitelist == (name in names):
                try:
                    number = float(value)
                except ValueError:
                    number = float("nan")
                out.append(("source", name, {"description": source.description, "query": progress.name or ""}, number))
    return out


class Listening(StreamingQueryListener):
    """Tells listeners of one named query. Stopping it by `cancel` is CANCELED, its own end COMPLETED."""

    def __init__(self, name: str, listeners: list[Listener]):
        self.name, self.listeners, self._run, self._canceled = name, listeners, None, False

    def attach(self, spark: SparkSession) -> Listening:
        if self.listeners:
            spark.streams.addListener(self)
        return self

    def cancel(self, query: Any) -> None:
        self._canceled = True
        query.stop()

    def _tell(self, state: str, about: Any) -> None:
        for x in self.listeners:
            x.state_changed(state, about)

    def onQueryStarted(self, event: Any) -> None:
        if event.name == self.name:
            self._run, self._canceled = event.runId, False
            self._tell(SUBSCRIBED, SUBSCRIBED)

    def onQueryProgress(self, event: Any) -> None:
        if event.progress.runId == self._run:
            for x in self.listeners:
                x.next(event.progress)

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        if event.runId == self._run:
            state = ERRORED if event.exception else CANCELED if self._canceled else COMPLETED
            self._tell(state, event.exception or state)


def outcome_counts(failed: Column) -> tuple[Column, Column]:
    """The aggregates `items`, of what did not fail, and `errors`."""
    return F.count_if(~failed).alias("items"), F.count_if(failed).alias("errors")


def observed(df: DataFrame, name: str, error: str = "error") -> DataFrame:
    """df with counts of all its items and of those with an error reported as the observation `name`."""
    bad = F.col(error).isNotNull() if error in df.columns else F.lit(False)
    return df.observe(name, F.count(F.lit(1)).alias("items"), outcome_counts(bad)[1])
