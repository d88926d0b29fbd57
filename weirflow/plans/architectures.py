"""Lambda, kappa and adaptive runs of one pipeline function.

A pipeline function takes a frame and returns one, so the same function serves a
batch, a stream, a replayed log and any level of the adaptive mode.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import PipelineError
from ..operators.eventlog import EventLog
from ..operators.serving import Merge, MergeView, ServingView
from ..streaming.viscosity import GranularityLevel, GranularityPolicy, Viscosity, ViscosityController, ViscosityPolicy
from .prefix import numbered

PipelineFn = Callable[[DataFrame], DataFrame]


class LambdaFlow:
    """A batch layer over the history, a speed layer over what is new, and a view that merges both."""

    def __init__(self, batch_layer: PipelineFn | None = None, speed_layer: PipelineFn | None = None, keys: list[str] | None = None, merge: Merge = MergeView.latest, value: str = "value"):
        self.batch_layer, self.speed_layer = batch_layer, speed_layer
        self.view = ServingView(keys or ["key"], merge, value)
        self._on_speed: Callable[[DataFrame], None] | None = None
        self.interval: float | None = None

    def on_speed_result(self, f: Callable[[DataFrame], None]) -> LambdaFlow:
        self._on_speed = f
        return self

    def batch_interval(self, seconds: float) -> LambdaFlow:
        """How often a caller means to run the batch layer."""
        self.interval = seconds
        return self

    def execute_batch_only(self, history: DataFrame) -> ServingView:
        if self.batch_layer is None:
            raise PipelineError("there is no batch layer")
        self.view.update_batch(self.batch_layer(history))
        return self.view

    def execute(self, history: DataFrame, new: DataFrame, checkpoint: str | None = None) -> ServingView:
        """Both layers; of a stream, all that is there now."""
        if self.batch_layer is not None:
            self.execute_batch_only(history)
        if self.speed_layer is not None:
            got = self.speed_layer(new)
            if got.isStreaming:
                name = f"speed_{id(self)}"
                writer = got.writeStream.format("memory").queryName(name).outputMode("complete")
                writer.trigger(availableNow=True).start().awaitTermination()
                got = new.sparkSession.table(name)
            if self._on_speed:
                self._on_speed(got)
            self.view.update_speed(got)
        return self.view

    def query(self, *key: Any) -> Any:
        return self.view.query(*key)

    def query_all(self) -> dict:
        return self.view.query_all()


class KappaFlow:
    """One pipeline; all input goes through a log, from which any range can be replayed."""

    def __init__(self, spark: SparkSession, stream_fn: PipelineFn, event_log_path: str | None = None, order: list[str] | None = None, keys: list[str] | None = None):
        self.spark, self.stream_fn, self.order = spark, stream_fn, order
        self.log = EventLog(spark, event_log_path) if event_log_path else None
        self.view = ServingView(keys) if keys else None

    def _need_log(self) -> EventLog:
        if self.log is None:
            raise PipelineError("there is no event log")
        return self.log

    def append_to_log(self, record: dict) -> int:
        return self._need_log().append(record)

    def replay(self, offset: int = 0, limit: int | None = None) -> DataFrame:
        return self._need_log().read(offset, limit)

    def replay_to_stream(self, offset: int = 0, limit: int | None = None, transform: PipelineFn | None = None) -> DataFrame:
        """The pipeline's output on a range of the log."""
        out = self.stream_fn(self.replay(offset, limit))
        return transform(out) if transform else out

    def execute(self, df: DataFrame, checkpoint: str | None = None) -> DataFrame | StreamingQuery:
        """Log the input, then run the pipeline: on a batch at once; a stream's micro-batches are logged, each exactly once over restarts from ``checkpoint``."""
        if not df.isStreaming:
            if self.log is not None:
                self.log.append_frame(df, self.order or [df.columns[0]])
            out = self.stream_fn(df)
            if self.view is not None:
                self.view.update_speed(out)
            return out
        log, order = self._need_log(), self.order or [df.columns[0]]

        def write(part: DataFrame, batch: int) -> None:
            # the log keeps the number of the stream's last batch: one that a restarted query brings again is not appended twice
            log.append_frame(part, order, (checkpoint or "stream", batch))

        writer = df.writeStream.foreachBatch(write)
        if checkpoint:
            writer = writer.option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()


class AdaptiveFlow:
    """A pipeline whose micro-batches grow and shrink with the load.

    A stream's trigger can't change while it runs: a new level stops the query
    and starts it on the same checkpoint, where state and offsets go on.
    """

    def __init__(
        self, stream_fn: PipelineFn, controller: ViscosityController | None = None, viscosity: Viscosity | None = None, policy: ViscosityPolicy | GranularityPolicy | None = None,
        initial_granularity: GranularityLevel | None = None, initial_viscosity: Viscosity | None = None, min_viscosity: Viscosity | GranularityLevel = Viscosity.VOLATILE, max_viscosity: Viscosity | GranularityLevel = Viscosity.FROZEN,
    ):
        first = viscosity or initial_viscosity or initial_granularity or Viscosity.HONEYED
        self.stream_fn = stream_fn
        self.controller = controller or ViscosityController(first, policy or ViscosityPolicy.BALANCED, min_viscosity, max_viscosity, adjust_interval=0.0)

    def set_viscosity(self, level: Any) -> AdaptiveFlow:
        self.controller.set_viscosity(level)
        return self

    set_granularity = set_viscosity

    def set_policy(self, policy: ViscosityPolicy | GranularityPolicy) -> AdaptiveFlow:
        self.controller.policy = policy.to_viscosity() if isinstance(policy, GranularityPolicy) else policy
        return self

    def on_change(self, f: Callable[[Viscosity, Viscosity], None]) -> AdaptiveFlow:
        self.controller.on_change = f
        return self

    def thaw(self) -> AdaptiveFlow:
        self.controller.thaw()
        return self

    def freeze(self) -> AdaptiveFlow:
        self.controller.freeze()
        return self

    flow_freely, flow_as_batch = thaw, freeze

    @property
    def viscosity_metrics(self) -> dict[str, float]:
        return self.controller.metrics.snapshot()

    def execute(self, df: DataFrame) -> DataFrame:
        """On a bounded frame the answer does not depend on the level: the pipeline runs once."""
        return self.stream_fn(df)

    def execute_at_viscosity(self, df: DataFrame, level: Any) -> DataFrame:
        self.controller.set_viscosity(level)
        return self.execute(df)

    execute_at_granularity = execute_at_viscosity

    def execute_batch_like(self, df: DataFrame) -> DataFrame:
        return self.execute_at_viscosity(df, Viscosity.FROZEN)

    def execute_stream_like(self, df: DataFrame) -> DataFrame:
        return self.execute_at_viscosity(df, Viscosity.VOLATILE)

    def run_stream(self, df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", rounds: int = 10, seconds: float = 1.0) -> list[Viscosity]:
        """Run a stream for ``rounds`` looks at its progress, each after ``seconds``; returns the levels it ran at."""
        levels = []
        query = None
        try:
            for _ in range(rounds):
                level = self.controller.level
                if query is None or level is not levels[-1]:
                    if query is not None:
                        query.stop()
                    query = self.stream_fn(df).writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**level.trigger()).start()
                levels.append(level)
                query.awaitTermination(seconds)
                if query.exception() is not None:
                    raise query.exception()
                if query.lastProgress:
                    self.controller.update_from_progress(query.lastProgress)
                    self.controller.adjust()
                if not query.isActive:
                    query = None
                    if level is Viscosity.FROZEN:
                        break
        finally:
            if query is not None:
                query.stop()
        return levels

    def explain(self) -> str:
        return self.controller.explain()


def per_chunk(df: DataFrame, order: list[str], size: int, *aggregates: Any) -> DataFrame:
    """Aggregates for each chunk of ``size`` rows in an order, as a run at one level would emit them: (chunk, ...)."""
    rows = numbered(df, order, "__at")
    return rows.groupBy(F.floor(F.col("__at") / size).alias("chunk")).agg(*aggregates)
