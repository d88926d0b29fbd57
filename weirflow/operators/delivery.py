"""Delivery guarantees: record ids, deduplication and sink policies."""

from __future__ import annotations

import time
from collections.abc import Callable
from enum import Enum

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import DeliveryError


class DeliveryMode(Enum):
    AT_LEAST_ONCE = "at_least_once"
    AT_MOST_ONCE = "at_most_once"
    EXACTLY_ONCE = "exactly_once"


def record_id(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of the record: of a single string as it is, else of its JSON with sorted names."""
    names = sorted(columns or df.columns)
    if len(names) == 1 and df.schema[names[0]].dataType.typeName() == "string":
        return F.sha2(F.col(names[0]).cast("binary"), 256)
    return F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).cast("binary"), 256)


def deduplicated(df: DataFrame, columns: list[str] | None = None, time_field: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """One of each record, by all columns or some.

    A stream keeps ids as long as the watermark on ``time_field`` allows copies to
    come; without one it keeps them for good.
    """
    if df.isStreaming and time_field:
        return df.withWatermark(time_field, delay).dropDuplicatesWithinWatermark(columns or [c for c in df.columns if c != time_field])
    return df.dropDuplicates(columns) if columns else df.distinct()


def delivered(write: Callable[[DataFrame], None], mode: DeliveryMode, max_retries: int = 3, pause: float = 0.01, done: Callable[[int], bool] | None = None, mark: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes by a guarantee.

    At most once: a batch whose write fails is given up. At least once: it is
    written again, ``max_retries`` times, then the query fails. Exactly once: a
    batch number that ``done`` knows is skipped, so that a restarted query does
    not write a batch twice; ``mark`` notes it.
    """

    def run(part: DataFrame, batch: int) -> None:
        if mode is DeliveryMode.AT_MOST_ONCE:
            try:
                write(part)
            except Exception:
                return
        elif mode is DeliveryMode.EXACTLY_ONCE:
            if done is not None and done(batch):
                return
            write(part)
            if mark is not None:
                mark(batch)
        else:
            for attempt in range(max_retries + 1):
                try:
                    return write(part)
                except Exception as e:
                    if attempt == max_retries:
                        raise DeliveryError(f"batch {batch} failed {max_retries + 1} times") from e
                    time.sleep(pause * (attempt + 1))

    return run
