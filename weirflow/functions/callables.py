"""Opaque Python functions on frames, in Arrow batches.

Records are dicts, or bare values where a frame has the one column ``value``.
These run where no column expression can say the same; they need the schema of
what they return.
"""

from __future__ import annotations

import os
import tempfile
import time
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce as fold
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

BATCH = 4096
HELD = 100_000  # keys in a partition's memory
KEPT = 1 << 24  # bytes of a group in a task's memory


def struct_of(schema: T.StructType | str) -> T.StructType:
    """A StructType of a StructType, a DDL string of columns, or a type's name for a bare ``value``."""
    if isinstance(schema, T.StructType):
        return schema
    parsed = T._parse_datatype_string(schema)
    return parsed if isinstance(parsed, T.StructType) else T.StructType([T.StructField("value", parsed)])


def _records(batch: pa.RecordBatch) -> list:
    if batch.schema.names == ["value"]:
        return batch.column(0).to_pylist()
    return batch.to_pylist()


def _batch(records: list, schema: pa.Schema) -> pa.RecordBatch:
    names = schema.names

    def row(r: Any) -> dict:
        if isinstance(r, dict):
            return {n: r.get(n) for n in names}
        if names == ["value"]:
            return {"value": r}
        return dict(zip(names, r))  # tuples by position

    return pa.RecordBatch.from_pylist([row(r) for r in records], schema=schema)


def guarded(f: Callable[[Any], list], on_error: str, retries: int) -> Callable[[list], list[list]]:
    """``f`` on each of many records, with a failing one raised, skipped, or tried again up to ``retries`` times and then raised.

    Records that fail are tried again together, after one pause, so the time spent
    waiting does not grow with their number.
    """

    def run(records: list) -> list[list]:
        made: list[list] = [[] for _ in records]
        left: Iterable[int] = range(len(records))
        for attempt in range(retries + 1):
            failed = []
            for k in left:
                try:
                    made[k] = f(records[k])
                except Exception:
                    if on_error == "raise" or on_error == "retry" and attempt == retries:
                        raise
                    failed.append(k)
            if not failed or on_error == "skip":
                break
            left = failed
            time.sleep(0.01 * (attempt + 1))
        return made

    return run


def each_row(df: DataFrame, f: Callable[[Any], list], schema: T.StructType | str, on_error: str = "raise", retries: int = 0) -> DataFrame:
    """Every record's results, none or more, in order."""
    out = struct_of(schema)
    arrow, run = to_arrow_schema(out), guarded(f, on_error, retries)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                made = [x for results in run(_records(batch.slice(at, BATCH))) for x in results]
                if made:
                    yield _batch(made, arrow)

    return df.mapInArrow(apply, out)


class Records(Sequence):
    """A group's records as a sequence that may be read any number of times.

    They are kept as Arrow batches, those of a group beyond ``kept`` bytes in a file
    of the task without a name; records are made while they are read, at most
    ``BATCH`` at a time. A function that keeps none of them has no part of a group
    in memory that grows with it; ``list(records)`` makes them all.
    """

    def __init__(self, batches: Iterable[pa.RecordBatch], without: Iterable[str] = (), kept: int = KEPT):
        self._ends, self._parts, self._stored, self._last = [], [], None, (-1, [])
        self._bare, size, n, writer, without = False, 0, 0, None, set(without)
        for batch in batches:
            self._bare = batch.schema.names == ["value"]
            batch = batch.select([c for c in batch.schema.names if c not in without]) if without else batch
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                n, size = n + part.num_rows, size + part.nbytes
                self._ends.append(n)
                self._parts.append(part)
                if writer is None and size > kept:
                    held = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
                    writer = pa.ipc.new_file(held, part.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
                if writer is not None:
                    for x in self._parts:
                        writer.write_batch(x)
                    self._parts = []
        if writer is not None:
            writer.close()
            self._stored = pa.ipc.open_file(held)

    def _part(self, k: int) -> list:
        if self._last[0] != k:
            part = self._stored.get_batch(k) if self._stored else self._parts[k]
            self._last = (k, part.column(0).to_pylist() if self._bare else part.to_pylist())
        return self._last[1]

    def __len__(self) -> int:
        return self._ends[-1] if self._ends else 0

    def __iter__(self) -> Iterator:
        for k in range(len(self._ends)):
            yield from self._part(k)

    def __getitem__(self, at: int | slice) -> Any:
        if isinstance(at, slice):
            return [self[i] for i in range(*at.indices(len(self)))]
        i = at + len(self) if at < 0 else at
        if not 0 <= i < len(self):
            raise IndexError(at)
        k = bisect_right(self._ends, i)
        return self._part(k)[i - (self._ends[k - 1] if k else 0)]

    def __eq__(self, other: Any) -> bool:
        return isinstance(other, (Records, list)) and len(self) == len(other) and all(a == b for a, b in zip(self, other))


def per_group(df: DataFrame, keys: list[str], f: Callable[[tuple, Sequence], Iterable], schema: T.StructType | str, without: Iterable[str] = ()) -> DataFrame:
    """``f(key values, records of the group)`` gives the group's results; records come as ``Records``, less the columns ``without``.

    A group goes through one task, but not into its memory.
    """
    out = struct_of(schema)
    arrow, without = to_arrow_schema(out), tuple(without)

    def apply(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = iter(f(tuple(k.as_py() for k in key), Records(batches, without)))
        while part := list(islice(made, BATCH)):
            yield _batch(part, arrow)

    return df.groupBy(*keys).applyInArrow(apply, out)


def fold_groups(df: DataFrame, keys: list[str], f: Callable[[Any, Any], Any], column: str, order: str | None = None, associative: bool = False) -> DataFrame:
    """Left fold of a column within each group: (keys, value).

    In the order of ``order`` where given; a group must then fit the memory of one
    task. Without it the group goes through one task if ``f`` is not ``associative``.
    Associative folds run in partitions before the shuffle, so a hot key arrives as
    one value a partition.
    """
    out = T.StructType([*[df.schema[k] for k in keys], T.StructField("value", df.schema[column].dataType)])
    arrow = to_arrow_schema(out)

    def run(key: tuple, records: Sequence) -> list:
        rows = sorted(records, key=lambda r: r[order]) if order else records
        return [(*key, fold(f, (r[column] for r in rows)))]

    if order or not associative:
        return per_group(df, keys, run, out)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Any] = {}
        for batch in batches:
            for *key, value in zip(*(c.to_pylist() for c in batch.columns)):
                key = tuple(key)
                held[key] = f(held[key], value) if key in held else value
            if len(held) > HELD:
                yield _batch([(*k, v) for k, v in held.items()], arrow)
                held = {}
        if held:
            yield _batch([(*k, v) for k, v in held.items()], arrow)

    def merge(key: tuple, records: Sequence) -> list:
        return [(*key, fold(f, (r["value"] for r in records)))]

    return per_group(df.select(*keys, df[column].alias("value")).mapInArrow(partial, out), keys, merge, out)


def fold_global(df: DataFrame, f: Callable[[Any, Any], Any], column: str, fan_in: int = 1024) -> DataFrame:
    """Fold of an associative function over a column. Empty gives no row.

    Every partition is folded where it lies to one value; values of ``fan_in``
    neighbouring partitions meet in a task, and then one value of each of these.
    """
    out = T.StructType([T.StructField("at", T.LongType()), T.StructField("value", df.schema[column].dataType)])
    arrow = to_arrow_schema(out)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of ``at`` to one value for each ``fan_in`` of them."""
        group, held = None, None
        for batch in batches:
            for at, value in zip(batch.column("at").to_pylist(), batch.column("value").to_pylist()):
                if at // fan_in != group:
                    if group is not None:
                        yield _batch([(group, held)], arrow)
                    group, held = at // fan_in, value
                else:
                    held = f(held, value)
        if group is not None:
            yield _batch([(group, held)], arrow)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            held = [fold(f, held + batch.column(0).to_pylist())] if batch.num_rows else held
        if held:
            yield _batch([(TaskContext.get().partitionId(), held[0])], arrow)

    values = df.select(df[column].alias("value")).mapInArrow(first, out)
    met = values.withColumn("group", F.floor(F.col("at") / fan_in)).repartition("group").sortWithinPartitions("at").drop("group").mapInArrow(apply, out)
    return met.repartition(1).sortWithinPartitions("at").withColumn("at", F.lit(0).cast("long")).mapInArrow(apply, out).select("value")
