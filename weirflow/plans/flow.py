"""Flows: named sources, pipelines on them and sinks, run as a batch or as streams."""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..errors import PipelineError
from ..operators.delivery import DeliveryMode
from ..operators.pipeline import Pipeline
from ..sources.readers import CollectionSource, DatagenSource, FileSource, GeneratorSource, KafkaSource, SocketSource, Source
from ..sources.sinks import CollectSink, Sink


class RuntimeMode(Enum):
    BATCH = "batch"
    STREAMING = "streaming"


class ArchitectureMode(Enum):
    SIMPLE = "simple"
    LAMBDA = "lambda"
    KAPPA = "kappa"
    ADAPTIVE = "adaptive"


#: Settings of ``Flow.configure`` and the Spark settings they stand for.
CONFIGURED = {
    "concurrency": "spark.sql.shuffle.partitions",
    "checkpoint_dir": "spark.sql.streaming.checkpointLocation",
}


class Flow:
    """Sources give pipelines; ``sink`` names what is written where; ``execute`` runs it all."""

    def __init__(self, name: str = "flow", mode: RuntimeMode = RuntimeMode.BATCH, parallelism: int | None = None, delivery_mode: DeliveryMode = DeliveryMode.AT_LEAST_ONCE, max_retries: int = 3, spark: SparkSession | None = None):
        self.name, self.mode, self.delivery_mode, self.max_retries = name, mode, delivery_mode, max_retries
        self.spark = spark or SparkSession.builder.appName(name).getOrCreate()
        self.config: dict[str, Any] = {}
        self._sinks: list[tuple[str, Pipeline | DataFrame, Sink]] = []
        self.sources: list[Source] = []
        if parallelism:
            self.set_parallelism(parallelism)

    def set_parallelism(self, n: int) -> Flow:
        return self.configure("concurrency", n)

    def set_checkpoint(self, folder: str, interval: float | None = None) -> Flow:
        self.config["checkpoint_interval"] = interval
        return self.configure("checkpoint_dir", folder)

    def configure(self, key: str, value: Any) -> Flow:
        self.config[key] = value
        if key.startswith("spark.") or key in CONFIGURED:
            self.spark.conf.set(CONFIGURED.get(key, key), value)
        return self

    def from_source(self, source: Source, schema: Any = None) -> Pipeline:
        if schema is not None:
            source.schema = schema
        self.sources.append(source)
        df = source.stream(self.spark) if self.mode is RuntimeMode.STREAMING and not isinstance(source, (CollectionSource, GeneratorSource)) else source.batch(self.spark)
        made = Pipeline(df, delivery=self.delivery_mode, max_retries=self.max_retries)
        return made.exactly_once() if self.delivery_mode is DeliveryMode.EXACTLY_ONCE else made

    def from_frame(self, df: DataFrame) -> Pipeline:
        return Pipeline(df, delivery=self.delivery_mode, max_retries=self.max_retries)

    def from_collection(self, data: list, schema: Any = None) -> Pipeline:
        return self.from_source(CollectionSource(data, schema))

    def from_generator(self, make: Callable, max_items: int | None = None, schema: Any = None) -> Pipeline:
        return self.from_source(GeneratorSource(make, max_items, schema))

    def from_file(self, path: str, fmt: str = "text", schema: Any = None, **options: Any) -> Pipeline:
        return self.from_source(FileSource(path, fmt, schema, **options))

    def from_kafka(self, topic: str, bootstrap_servers: str = "localhost:9092", group_id: str | None = None, schema: Any = None, start_from: str = "latest") -> Pipeline:
        return self.from_source(KafkaSource(topic, bootstrap_servers, group_id, schema, start_from))

    def from_datagen(self, rows_per_second: int = 100, fields: dict | None = None, max_records: int = 100) -> Pipeline:
        return self.from_source(DatagenSource(rows_per_second, fields, max_records))

    def from_socket(self, host: str = "localhost", port: int = 9999, delimiter: str = "\n", encoding: str = "utf-8") -> Pipeline:
        return self.from_source(SocketSource(host, port, delimiter, encoding))

    def sink(self, result: Pipeline | DataFrame, sink: Sink | None = None, name: str | None = None) -> Sink:
        """Write a result when the flow runs; without a sink, collect it."""
        sink = sink or CollectSink()
        self._sinks.append((name or f"sink_{len(self._sinks)}", result, sink))
        return sink

    def execute(self, timeout: float | None = None, **how: Any) -> dict[str, Any]:
        """By sink name: a batch's collected records (None for other sinks), or a stream's query. Each sink has its own query."""
        if not self._sinks:
            raise PipelineError(f"flow {self.name!r} has no sink")
        out: dict[str, Any] = {}
        for name, result, sink in self._sinks:
            df = result.df if isinstance(result, Pipeline) else result
            if df.isStreaming:
                out[name] = sink.start(df, **how)
                if timeout is not None:
                    out[name].awaitTermination(timeout)
            else:
                sink.write(df)
                out[name] = sink.results if isinstance(sink, CollectSink) else None
        return out

    # the same pipeline function in another architecture

    def as_lambda(self, layer: Callable[[DataFrame], DataFrame], keys: list[str], merge: Callable | None = None, value: str = "value") -> Any:
        from ..operators.serving import MergeView
        from .architectures import LambdaFlow

        return LambdaFlow(layer, layer, keys, merge or MergeView.latest, value)

    def as_kappa(self, pipeline: Callable[[DataFrame], DataFrame], event_log_path: str | None = None, order: list[str] | None = None, keys: list[str] | None = None) -> Any:
        from .architectures import KappaFlow

        return KappaFlow(self.spark, pipeline, event_log_path, order, keys)

    def as_adaptive(self, pipeline: Callable[[DataFrame], DataFrame], **how: Any) -> Any:
        from .architectures import AdaptiveFlow

        return AdaptiveFlow(pipeline, **how)

    def in_architecture(self, architecture: ArchitectureMode, pipeline: Callable[[DataFrame], DataFrame], **how: Any) -> Any:
        """This flow, or the pipeline in one of the others."""
        return {ArchitectureMode.SIMPLE: lambda _, **__: self, ArchitectureMode.LAMBDA: self.as_lambda, ArchitectureMode.KAPPA: self.as_kappa, ArchitectureMode.ADAPTIVE: self.as_adaptive}[architecture](pipeline, **how)

    def explain(self) -> str:
        """Each sink's physical plan."""
        plans = [f"== {n} ==\n{(r if isinstance(r, Pipeline) else Pipeline(r)).explain()}" for n, r, _ in self._sinks]
        return f"{self.name} ({self.mode.value}, {self.delivery_mode.value})\n" + "\n".join(plans)


def quick_flow(name: str = "quick", **how: Any) -> Flow:
    return Flow(name, **how)


def stop_all(queries: dict[str, Any]) -> None:
    for q in queries.values():
        if isinstance(q, StreamingQuery):
            q.stop()
