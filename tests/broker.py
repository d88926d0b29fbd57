"""A broker in a folder, with the shape of Spark's Kafka source and sink: one file a message, named by its offset."""

import json
import os
import uuid
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage


def _messages(options):
    folder = f"{options['kafka.bootstrap.servers']}/{options['subscribe']}"
    names = sorted(os.listdir(folder), key=lambda n: os.stat(f"{folder}/{n}").st_mtime_ns) if os.path.isdir(folder) else []
    for offset, name in enumerate(names):
        with open(f"{folder}/{name}") as f:
            key, value = json.load(f)
        yield (None if key is None else key.encode(), value.encode(), options["subscribe"], 0, offset, datetime(2024, 1, 1, tzinfo=timezone.utc))


class Span(InputPartition):
    def __init__(self, start, end):
        self.start, self.end = start, end


class Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def read(self, partition):
        assert self.options["startingoffsets"] == "earliest"
        yield from _messages(self.options)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.options = options

    def initialOffset(self):
        return {"at": 0 if self.options["startingoffsets"] == "earliest" else len(list(_messages(self.options)))}

    def latestOffset(self):
        return {"at": len(list(_messages(self.options)))}

    def partitions(self, start, end):
        return [Span(start["at"], end["at"])]

    def read(self, partition):
        yield from list(_messages(self.options))[partition.start : partition.end]


def _send(options, rows):
    folder = f"{options['kafka.bootstrap.servers']}/{options['topic']}"
    os.makedirs(folder, exist_ok=True)
    for r in rows:
        name = uuid.uuid4().hex
        with open(f"{folder}/.{name}", "w") as f:
            json.dump([r["key"], r["value"]], f)
        os.rename(f"{folder}/.{name}", f"{folder}/{name}")
    return WriterCommitMessage()


class Writer(DataSourceWriter):
    def __init__(self, options):
        self.options = options

    def write(self, rows):
        return _send(self.options, rows)


class StreamWriter(DataSourceStreamWriter):
    def __init__(self, options):
        self.options = options

    def write(self, rows):
        return _send(self.options, rows)

    def commit(self, messages, batchId):
        pass

    def abort(self, messages, batchId):
        pass


class FolderBroker(DataSource):
    @classmethod
    def name(cls):
        return "folder_broker"

    def schema(self):
        return "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"

    def reader(self, schema):
        return Reader(dict(self.options))

    def streamReader(self, schema):
        return StreamReader(dict(self.options))

    def writer(self, schema, overwrite):
        return Writer(dict(self.options))

    def streamWriter(self, schema, overwrite):
        return StreamWriter(dict(self.options))
