"""Watermark strategies, a tracker for single values, and the split of late rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F, types as T

from ..errors import WatermarkError
from ..plans.files import Folder, StateFile
from ..plans.prefix import running_max


@dataclass(frozen=True)
class Watermark:
    timestamp: float


@dataclass(frozen=True)
class WatermarkStrategy:
    """How far event time may run behind the largest time seen; ``lateness`` in seconds, None for no watermark."""

    lateness: float | None = 0.0
    time_field: str | None = None
    idle_timeout: float | None = None

    @classmethod
    def monotonous(cls, time_field: str | None = None) -> WatermarkStrategy:
        return cls(0.0, time_field)

    @classmethod
    def bounded_out_of_orderness(cls, lateness: float, time_field: str | None = None) -> WatermarkStrategy:
        return cls(float(lateness), time_field)

    @classmethod
    def no_watermarks(cls) -> WatermarkStrategy:
        return cls(None)

    def on(self, time_field: str) -> WatermarkStrategy:
        return replace(self, time_field=time_field)

    def apply(self, df: DataFrame) -> DataFrame:
        """The watermark on a stream; a batch has all its rows and stays as it is."""
        if self.lateness is None or not df.isStreaming:
            return df
        if self.time_field is None or self.time_field not in df.columns:
            raise WatermarkError(f"no event-time column {self.time_field!r}")
        if isinstance(df.schema[self.time_field].dataType, T.TimestampNTZType):
            df = df.withColumn(self.time_field, F.col(self.time_field).cast("timestamp"))
        return df.withWatermark(self.time_field, f"{round(self.lateness * 1000)} milliseconds")


class WatermarkTracker:
    """The watermark over single event times in seconds."""

    def __init__(self, strategy: WatermarkStrategy | None = None, strict: bool = False):
        """``strict``: late is below the watermark; else, for bounded ones, below it by the bound once more."""
        self.strategy = strategy or WatermarkStrategy.monotonous()
        self.strict = strict
        self.largest: float | None = None

    def on_event(self, timestamp: float) -> Watermark:
        self.largest = timestamp if self.largest is None else max(self.largest, timestamp)
        return Watermark(self.current_watermark())

    def current_watermark(self) -> float:
        return float("-inf") if self.largest is None else self.largest - (self.strategy.lateness or 0.0)

    def is_late(self, timestamp: float) -> bool:
        return timestamp < self.current_watermark() - (0.0 if self.strict else (self.strategy.lateness or 0.0))


def late_split(df: DataFrame, order: str, time_field: str, delay: str) -> DataFrame:
    """A batch replayed in the order of arrival: ``watermark`` at each row, and ``is_late``.

    The watermark is the largest time of this and all earlier rows, less
    ``delay``; a row that moves it is never late. Values of ``order`` must be distinct.
    """
    later = df.withColumn("__t", F.col(time_field))
    seen = running_max(later, [order], "__t", "__seen")
    watermark = F.col("__seen") - F.expr(f"interval {delay}")
    return seen.withColumn("watermark", watermark).withColumn("is_late", F.col("__t") < F.col("watermark")).drop("__t", "__seen")


class LateRouter:
    """A ``foreachBatch`` function that sends late rows of a stream aside instead of dropping them.

    A micro-batch's rows are late when they lie below the watermark that the
    batches before it left: their largest time less ``delay`` seconds. ``note``
    names a folder, on a file system that a restarted driver reaches, too, which
    keeps that time over restarts.
    """

    def __init__(self, time_field: str, delay: float, on_time: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None] | None = None, note: str | None = None):
        self.time_field, self.delay, self.on_time, self.late, self.note = time_field, delay, on_time, late, note
        self.largest: float | None = None
        self.records_late = 0
        self._state: StateFile | None = None

    def __call__(self, part: DataFrame, batch: int) -> None:
        if self.note and self._state is None:
            self._state = StateFile(Folder(part.sparkSession, self.note))
            self.largest = self._state.load().get("largest", self.largest)
        time = F.col(self.time_field).cast("timestamp").cast("double")
        part.persist()
        try:
            top, n_late = part.agg(F.max(time), F.count_if(time < F.lit(self._watermark()))).first()
            self.on_time(part.where(~(time < F.lit(self._watermark())) | time.isNull()), batch)
            if n_late:
                self.records_late += n_late
                if self.late is not None:
                    self.late(part.where(time < F.lit(self._watermark())), batch)
        finally:
            part.unpersist()
        if top is not None and (self.largest is None or top > self.largest):
            self.largest = top
            if self._state is not None:
                self._state.save({"largest": top})

    def _watermark(self) -> float:
        return float("-inf") if self.largest is None else self.largest - self.delay
