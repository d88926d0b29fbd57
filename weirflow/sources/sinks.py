"""Sinks: each writes a batch frame or starts a streaming query."""

from __future__ import annotations

import json
import socket
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import ConnectorError


class SinkKind(Enum):
    PRINT = "print"
    FILE = "file"
    KAFKA = "kafka"
    CALLBACK = "callback"
    COLLECT = "collect"
    SOCKET = "socket"


def record(row: Any) -> Any:
    """A dict, or the bare value of a single column ``value``."""
    d = row.asDict(recursive=True)
    return d["value"] if list(d) == ["value"] else d


class Sink:
    kind: SinkKind

    def write(self, df: DataFrame) -> None:
        raise NotImplementedError

    def start(self, df: DataFrame, mode: str = "append", checkpoint: str | None = None, trigger: dict | None = None) -> StreamingQuery:
        """Every micro-batch by ``write``; a retried batch is written again."""
        writer = df.writeStream.outputMode(mode).foreachBatch(lambda part, _: self.write(part))
        return _started(writer, checkpoint, trigger)


def _started(writer: Any, checkpoint: str | None, trigger: dict | None) -> StreamingQuery:
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


@dataclass
class PrintSink(Sink):
    rows: int = 20
    kind = SinkKind.PRINT

    def write(self, df: DataFrame) -> None:
        df.show(self.rows, truncate=False)


@dataclass
class CollectSink(Sink):
    """Results as records on the driver, for results that fit it."""

    results: list = field(default_factory=list)
    kind = SinkKind.COLLECT

    def write(self, df: DataFrame) -> None:
        self.results.extend(record(r) for r in df.toLocalIterator())


@dataclass
class CallbackSink(Sink):
    """A Python function for each record, on the executors or (``local``) the driver."""

    func: Callable[[Any], Any]
    local: bool = True
    kind = SinkKind.CALLBACK

    def write(self, df: DataFrame) -> None:
        if self.local:
            for r in df.toLocalIterator():
                self.func(record(r))
        else:
            f = self.func
            df.foreach(lambda r: f(record(r)))


@dataclass
class FileSink(Sink):
    """json, csv, parquet, orc or text files: batches overwrite, streams append."""

    path: str
    fmt: str = "json"
    partition_by: tuple[str, ...] = ()
    kind = SinkKind.FILE

    def _options(self) -> dict:
        if self.fmt not in ("json", "csv", "parquet", "orc", "text"):
            raise ConnectorError(f"file format {self.fmt!r} is not known")
        return {"header": True} if self.fmt == "csv" else {}

    def write(self, df: DataFrame) -> None:
        df.write.format(self.fmt).options(**self._options()).partitionBy(*self.partition_by).mode("overwrite").save(self.path)

    def start(self, df: DataFrame, mode: str = "append", checkpoint: str | None = None, trigger: dict | None = None) -> StreamingQuery:
        """Spark's file sink: each micro-batch lands once, also after a restart."""
        writer = df.writeStream.format(self.fmt).options(**self._options()).partitionBy(*self.partition_by).outputMode(mode).option("path", self.path)
        return _started(writer, checkpoint or f"{self.path}/_checkpoint", trigger)


@dataclass
class KafkaSink(Sink):
    """Rows as JSON values under a key column. Needs Spark's Kafka package, or another of its shape named by ``fmt``."""

    topic: str
    bootstrap_servers: str = "localhost:9092"
    key: str | None = None
    fmt: str = "kafka"
    kind = SinkKind.KAFKA

    def shape(self, df: DataFrame) -> DataFrame:
        value = F.col("value").cast("string") if df.columns == ["value"] else F.to_json(F.struct("*"))
        return df.select((F.col(self.key).cast("string") if self.key else F.lit(None).cast("string")).alias("key"), value.alias("value"))

    def _to(self, writer: Any) -> Any:
        return writer.format(self.fmt).option("kafka.bootstrap.servers", self.bootstrap_servers).option("topic", self.topic)

    def write(self, df: DataFrame) -> None:
        self._to(self.shape(df).write).mode("append").save()

    def start(self, df: DataFrame, mode: str = "append", checkpoint: str | None = None, trigger: dict | None = None) -> StreamingQuery:
        return _started(self._to(self.shape(df).writeStream.outputMode(mode)), checkpoint, trigger)


@dataclass
class SocketSink(Sink):
    """One line of JSON a record, over one connection a partition."""

    host: str = "localhost"
    port: int = 9999
    kind = SinkKind.SOCKET

    def write(self, df: DataFrame) -> None:
        host, port = self.host, self.port

        def send(rows: Any) -> None:
            link = None
            for r in rows:
                link = link or socket.create_connection((host, port), timeout=10)
                link.sendall((json.dumps(record(r), default=str) + "\n").encode())
            if link:
                link.close()

        df.foreachPartition(send)
