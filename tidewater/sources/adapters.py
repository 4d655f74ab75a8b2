"""What consumes a stream's batches: adapters for foreachBatch, and sinks that log."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Consumer = Callable[[DataFrame, int], Any]
log = logging.getLogger(__name__)


def each_row(consume: Callable[[Any], None]) -> Consumer:
    """A consumer of rows as one of batches; rows come one partition after another, never all at once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        for row in batch.toLocalIterator():
            consume(row)

    return run


def consuming(consume: Consumer, nacked: Consumer) -> Consumer:
    """A batch that fails is handed on, negatively acknowledged, with its `error`; the stream goes on."""

    def run(batch: DataFrame, batch_id: int) -> None:
        try:
            consume(batch, batch_id)
        except Exception as e:  # noqa: BLE001
            nacked(batch.withColumn("error", F.lit(f"{type(e).__name__}: {e}")), batch_id)

    return run


def ack_on_terminate(consume: Consumer) -> Consumer:
    """Every batch counts as done when its consumer ends, however it ends: at most once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        try:
            consume(batch, batch_id)
        except Exception as e:  # noqa: BLE001
            log.error("Consumer failed; batch %s is done with", batch_id, exc_info=e)

    return run


def sending(make_sender: Callable[[], Callable[[DataFrame], Any]]) -> Callable[[DataFrame], Any]:
    """A consumer that makes its sender at first use and then keeps it."""
    lock, kept = threading.Lock(), []

    def run(batch: DataFrame, *_: Any) -> Any:
        with lock:
            if not kept:
                kept.append(make_sender())
        return kept[0](batch)

    return run


def sending_per_thread(make_sender: Callable[[], Callable[[DataFrame], Any]]) -> Callable[[DataFrame], Any]:
    """As sending, but a sender for each thread that uses it; senders are never let go."""
    local = threading.local()

    def run(batch: DataFrame, *_: Any) -> Any:
        if not hasattr(local, "send"):
            local.send = make_sender()
        return local.send(batch)

    return run


def synchronous(start: Callable[[], Any], timeout: timedelta | None = None) -> None:
    """Runs a query to its end; its error is raised here, and TimeoutError if it takes longer."""
    query = start()
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout.total_seconds()):
        query.stop()
        raise TimeoutError(f"not done after {timeout}")


def failures(results: DataFrame, error: str = "error") -> DataFrame:
    return results.where(F.col(error).isNotNull())


def logging_results(logger: logging.Logger = log, error: str = "error") -> Consumer:
    """Logs results that have an error; the others are done with."""

    def run(batch: DataFrame, batch_id: int) -> None:
        for r in failures(batch, error).toLocalIterator():
            logger.warning("Result has an error: %s", r)

    return run


def logging_outcomes(logger: logging.Logger = log, status: str = "status") -> Consumer:
    """Logs what became of each row."""

    def run(batch: DataFrame, batch_id: int) -> None:
        for r in batch.toLocalIterator():
            logger.log(logging.WARNING if r[status] == "NACKED" else logging.INFO, "%s: %s", r[status], r)

    return run
