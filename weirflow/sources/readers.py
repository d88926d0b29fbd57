"""Sources: each gives a batch frame, and a stream where Spark can."""

from __future__ import annotations

import itertools
import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..errors import ConnectorError, PipelineError
from ..types import FieldType, Schema, as_struct


class SourceKind(Enum):
    COLLECTION = "collection"
    GENERATOR = "generator"
    FILE = "file"
    KAFKA = "kafka"
    DATAGEN = "datagen"
    SOCKET = "socket"


class Source:
    kind: SourceKind

    def batch(self, spark: SparkSession) -> DataFrame:
        raise ConnectorError(f"{type(self).__name__} has no batch form")

    def stream(self, spark: SparkSession) -> DataFrame:
        raise ConnectorError(f"{type(self).__name__} has no streaming form")


def _frame(spark: SparkSession, data: list, schema: Any) -> DataFrame:
    schema = as_struct(schema)
    if not data:
        return spark.createDataFrame([], schema or "value string")
    first = data[0]
    if isinstance(first, dict):
        if schema is None:
            names = list(dict.fromkeys(k for r in data for k in r))
            return spark.createDataFrame([{n: r.get(n) for n in names} for r in data])
        names = schema.fieldNames() if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).columns
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in data], schema)
    if isinstance(first, (tuple, list)):
        return spark.createDataFrame([tuple(r) for r in data], schema)
    return spark.createDataFrame([(r,) for r in data], schema or ["value"])


@dataclass
class CollectionSource(Source):
    """Rows held by the driver: dicts, tuples or bare values (column ``value``)."""

    data: list
    schema: Schema | T.StructType | str | None = None
    kind = SourceKind.COLLECTION

    def batch(self, spark: SparkSession) -> DataFrame:
        return _frame(spark, list(self.data), self.schema)


@dataclass
class GeneratorSource(Source):
    """What ``make()`` yields, up to ``max_items``."""

    make: Callable[[], Iterable]
    max_items: int | None = None
    schema: Schema | T.StructType | str | None = None
    kind = SourceKind.GENERATOR

    def batch(self, spark: SparkSession) -> DataFrame:
        return _frame(spark, list(itertools.islice(self.make(), self.max_items)), self.schema)


@dataclass
class FileSource(Source):
    """text (column ``value``), csv with a header, json (lines, or one document with ``multi_line``), parquet or orc."""

    path: str
    fmt: str = "text"
    schema: Schema | T.StructType | str | None = None
    multi_line: bool = False
    options: dict = field(default_factory=dict)
    kind = SourceKind.FILE

    def _reader(self, reader: Any) -> Any:
        if self.fmt not in ("text", "csv", "json", "parquet", "orc"):
            raise ConnectorError(f"file format {self.fmt!r} is not known")
        reader = reader.format(self.fmt).options(**self.options)
        if self.fmt == "csv":
            reader = reader.option("header", True)
        if self.fmt == "json" and self.multi_line:
            reader = reader.option("multiLine", True)
        if self.schema is not None and self.fmt != "text":
            reader = reader.schema(as_struct(self.schema))
        return reader

    def batch(self, spark: SparkSession) -> DataFrame:
        path = self.path.removeprefix("file://")
        if "://" not in path and "*" not in path and not os.path.exists(path):
            raise PipelineError(f"no such file: {self.path}")
        return self._reader(spark.read).load(self.path)

    def stream(self, spark: SparkSession) -> DataFrame:
        """New files of a folder as they come; csv, json, parquet and orc need a schema."""
        if self.schema is None and self.fmt != "text":
            raise PipelineError("a stream of files needs a schema")
        return self._reader(spark.readStream).load(self.path)


def from_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@dataclass
class KafkaSource(Source):
    """Values of a topic as text, with key, topic, partition, offset and timestamp. Needs Spark's Kafka package, or another of its shape named by ``fmt``."""

    topic: str
    bootstrap_servers: str = "localhost:9092"
    group_id: str | None = None
    schema: Schema | T.StructType | str | None = None
    start_from: str = "latest"
    fmt: str = "kafka"
    kind = SourceKind.KAFKA

    def options(self, streaming: bool) -> dict[str, str]:
        out = {"kafka.bootstrap.servers": self.bootstrap_servers, "subscribe": self.topic, "startingOffsets": self.start_from if streaming else "earliest"}
        return out | ({"kafka.group.id": self.group_id} if self.group_id else {})

    def _shape(self, df: DataFrame) -> DataFrame:
        out = df.select(F.col("value").cast("string").alias("value"), F.col("key").cast("string").alias("key"), "topic", "partition", "offset", "timestamp")
        if self.schema is None:
            return out
        kind = as_struct(self.schema)
        return out.select(F.from_json("value", kind).alias("r"), "key", "offset", "timestamp").select("r.*", "key", "offset", "timestamp")

    def batch(self, spark: SparkSession) -> DataFrame:
        return self._shape(spark.read.format(self.fmt).options(**self.options(False)).load())

    def stream(self, spark: SparkSession) -> DataFrame:
        return self._shape(spark.readStream.format(self.fmt).options(**self.options(True)).load())


@dataclass
class DatagenSource(Source):
    """Made-up rows: ``id`` and a column for each of ``fields``, the same for the same seed."""

    rows_per_second: int = 100
    fields: dict[str, FieldType] | None = None
    max_records: int = 100
    seed: int = 42
    kind = SourceKind.DATAGEN

    def _columns(self, df: DataFrame) -> DataFrame:
        for k, (name, kind) in enumerate((self.fields or {"value": FieldType.DOUBLE}).items()):
            unit = F.pmod(F.xxhash64("id", F.lit(self.seed + k)), F.lit(1_000_000)) / 1_000_000.0  # of the id, so any partitioning gives the same
            made = {
                FieldType.INTEGER: F.floor(unit * 1001).cast("int"), FieldType.LONG: F.floor(unit * 1001).cast("long"), FieldType.FLOAT: F.round(unit * 1000, 2).cast("float"), FieldType.DOUBLE: F.round(unit * 1000, 2),
                FieldType.STRING: F.concat(F.lit("value_"), F.col("id").cast("string")), FieldType.BOOLEAN: unit < 0.5,
            }.get(kind, F.round(unit * 100, 2))
            df = df.withColumn(name, made)
        return df

    def batch(self, spark: SparkSession) -> DataFrame:
        return self._columns(spark.range(self.max_records))

    def stream(self, spark: SparkSession) -> DataFrame:
        rate = spark.readStream.format("rate").option("rowsPerSecond", self.rows_per_second).load()
        return self._columns(rate.select(F.col("value").alias("id"), "timestamp"))


class _DelimitedSocketReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self.at, self.rest, self.link = 0, b"", None

    def initialOffset(self) -> dict:
        return {"at": 0}

    def read(self, start: dict) -> tuple[Iterable[tuple], dict]:
        import socket

        if self.link is None:
            self.link = socket.create_connection((self.options["host"], int(self.options["port"])), timeout=5)
            self.link.settimeout(0.1)
        cut, encoding = self.options.get("delimiter", "\n").encode(), self.options.get("encoding", "utf-8")
        try:
            while len(self.rest) < 1 << 20 and (got := self.link.recv(65536)):
                self.rest += got
        except TimeoutError:
            pass
        *whole, self.rest = self.rest.split(cut)
        rows = [(x.decode(encoding),) for x in whole if x]
        self.at = start["at"] + len(rows)
        return iter(rows), {"at": self.at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterable[tuple]:
        raise ConnectorError("a socket can't be read again")  # like Spark's own socket source


class DelimitedSocket(DataSource):
    """Text from a socket cut at any delimiter; Spark's own source knows line ends only."""

    @classmethod
    def name(cls) -> str:
        return "weirflow_socket"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:
        return _DelimitedSocketReader(dict(self.options))


@dataclass
class SocketSource(Source):
    host: str = "localhost"
    port: int = 9999
    delimiter: str = "\n"
    encoding: str = "utf-8"
    kind = SourceKind.SOCKET

    def stream(self, spark: SparkSession) -> DataFrame:
        if self.delimiter == "\n" and self.encoding == "utf-8":
            return spark.readStream.format("socket").option("host", self.host).option("port", self.port).load().where("value <> ''")
        spark.dataSource.register(DelimitedSocket)
        options = {"host": self.host, "port": self.port, "delimiter": self.delimiter, "encoding": self.encoding}
        return spark.readStream.format(DelimitedSocket.name()).options(**options).load()
