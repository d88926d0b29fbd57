"""Event-time windows as grouping columns."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import PipelineError


class WindowKind(Enum):
    TUMBLING = "tumbling"
    SLIDING = "sliding"
    SESSION = "session"
    OVER = "over"
    GLOBAL = "global"


def _span(x: float | str) -> str:
    """Spark's interval text of a length in seconds, or such text as it is."""
    return x if isinstance(x, str) else f"{round(x * 1_000_000)} microseconds"


@dataclass(frozen=True)
class WindowType:
    """Lengths are seconds or interval texts such as ``7 days``."""

    kind: WindowKind
    size: float | str | None = None
    slide: float | str | None = None
    gap: float | str | None = None
    time_field: str | None = None
    allowed_lateness: float = 0.0

    @classmethod
    def tumbling(cls, size: float | str, time_field: str | None = None, allowed_lateness: float = 0.0) -> WindowType:
        return cls(WindowKind.TUMBLING, size=size, time_field=time_field, allowed_lateness=allowed_lateness)

    @classmethod
    def sliding(cls, size: float | str, slide: float | str, time_field: str | None = None, allowed_lateness: float = 0.0) -> WindowType:
        return cls(WindowKind.SLIDING, size=size, slide=slide, time_field=time_field, allowed_lateness=allowed_lateness)

    @classmethod
    def session(cls, gap: float | str, time_field: str | None = None) -> WindowType:
        return cls(WindowKind.SESSION, gap=gap, time_field=time_field)

    @classmethod
    def over(cls, time_field: str | None = None) -> WindowType:
        return cls(WindowKind.OVER, time_field=time_field)

    @classmethod
    def global_window(cls) -> WindowType:
        return cls(WindowKind.GLOBAL)

    @property
    def timed(self) -> bool:
        """Whether rows fall into windows by time; without a time field all are one window."""
        return self.time_field is not None and self.kind in (WindowKind.TUMBLING, WindowKind.SLIDING, WindowKind.SESSION)

    def column(self, df: DataFrame) -> Column:
        """The grouping column ``window``, a struct of start and end. Null times fall into no window."""
        if self.time_field not in df.columns:
            raise PipelineError(f"no column {self.time_field!r} to window by")
        time = event_time(df, self.time_field)
        if self.kind is WindowKind.SESSION:
            return F.session_window(time, _span(self.gap)).alias("window")
        return F.window(time, _span(self.size), _span(self.slide) if self.kind is WindowKind.SLIDING else None).alias("window")


def event_time(df: DataFrame, name: str) -> Column:
    """A time column as it is, a number as seconds since 1970."""
    return F.timestamp_seconds(F.col(name)) if isinstance(df.schema[name].dataType, T.NumericType) else F.col(name)
