"""Small files in folders of any file system that Spark reaches."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Folder:
    """A folder by Hadoop's file system calls, made by the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._kind = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._kind(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str = "") -> Any:
        return self._kind(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """What a subfolder holds; nothing if it isn't there."""
        where = self._at(name)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def has(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        """A new file, seen under its name once it is whole."""
        part = f"_part-{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(part), True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        self.move(part, name)

    def move(self, name: str, to: str) -> None:
        where = self._at(to)
        self._fs.mkdirs(where.getParent())
        if not self._fs.rename(self._at(name), where):
            raise OSError(f"{self.path}/{name} can't become {to}")

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)


class StateFile:
    """A dict kept in numbered files, of which the last whole one counts: a crash leaves the one before."""

    def __init__(self, folder: Folder, name: str = "_state"):
        self.folder, self.name = folder, name

    def _numbers(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self.folder.names(self.name) if n.endswith(".json") and n[0].isdigit())

    def load(self) -> dict:
        numbers = self._numbers()
        return json.loads(self.folder.read(f"{self.name}/{numbers[-1]}.json")) if numbers else {}

    def save(self, state: dict) -> None:
        numbers = self._numbers()
        self.folder.write(f"{self.name}/{(numbers[-1] if numbers else 0) + 1}.json", json.dumps(state).encode())
        for old in numbers[:-1]:
            self.folder.delete(f"{self.name}/{old}.json")
