from .readers import (
    CollectionSource, DatagenSource, FileSource, GeneratorSource, KafkaSource, SocketSource, Source, SourceKind, from_parquet,
)
from .sinks import CallbackSink, CollectSink, FileSink, KafkaSink, PrintSink, Sink, SinkKind, SocketSink

__all__ = [
    "CallbackSink", "CollectSink", "CollectionSource", "DatagenSource", "FileSink", "FileSource", "GeneratorSource", "KafkaSink", "KafkaSource", "PrintSink", "Sink", "SinkKind", "SocketSink", "SocketSource", "Source", "SourceKind", "from_parquet",
]
