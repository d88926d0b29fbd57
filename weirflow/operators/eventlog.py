"""An append-only event log in segments, addressed by offset.

A log is a folder. ``live`` holds Parquet files by segment, with one column
``offset`` beside the payload's; segments of less than a million rows share a folder,
named by its first, so that files grow in number with the rows and not with the
segments. A row's segment comes from its offset. ``compacted-*`` holds what a
compaction made of the rows below its checkpoint. ``_state`` says what counts: the next offset, the columns, from
where on live rows hold, the compacted folder, and the last batch of each stream.
Writing it is the one moment at which an append or a compaction happens: an append's
files wait in a hidden folder until then and are moved to their segments after it, or
by whoever opens the log next. A crash before it leaves the log as it was.

Offsets of an append are the log's next ones, in the order asked for, and are never
given twice. One writer appends at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import PipelineError
from ..plans.files import Folder, StateFile
from ..plans.prefix import numbered
from ..sources.readers import CollectionSource

LIVE = "live"
FOLDER_ROWS = 1_000_000  # that a folder's segments have together, if one has fewer


class EventLog:
    def __init__(self, spark: SparkSession, path: str, segment_size: int = 100_000):
        self.spark, self.path, self.segment_size = spark, path.rstrip("/"), segment_size
        self.span = max(1, FOLDER_ROWS // segment_size)  # segments a folder
        self.folder = Folder(spark, self.path)
        self._file = StateFile(self.folder)

    # state

    def _state(self) -> dict:
        """What counts, after finishing an append that was committed but whose files were not all moved."""
        state = {"next": 0, "floor": 0, "from": 0, "compacted": None, "schema": None, "staged": None, "batches": {}} | self._file.load()
        if state["staged"] and self.folder.has(state["staged"]):
            self._settle(state["staged"])
        return state

    def _settle(self, staged: str) -> None:
        for segment in self.folder.names(staged):
            if segment.startswith("segment="):
                for name in self.folder.names(f"{staged}/{segment}"):
                    if name.endswith(".parquet"):
                        self.folder.move(f"{staged}/{segment}/{name}", f"{LIVE}/{segment}/{name}")
        self.folder.delete(staged)

    def _folders(self) -> list[int]:
        """The first segment of each folder."""
        return sorted(int(n.removeprefix("segment=")) for n in self.folder.names(LIVE) if n.startswith("segment="))

    def _drop(self, state: dict, below: int) -> None:
        """Delete the folders all of whose rows are below an offset."""
        for first in self._folders():
            if min((first // self.span + 1) * self.span * self.segment_size, state["next"]) <= below:
                self.folder.delete(f"{LIVE}/segment={first}")

    def _between(self, low: int, high: int) -> int:
        """How many segments have rows from one offset up to another; live offsets have no gaps."""
        return (high - 1) // self.segment_size - low // self.segment_size + 1 if high > low else 0

    def exists(self) -> bool:
        return self._state()["schema"] is not None

    @property
    def offset(self) -> int:
        """The next offset, from the state alone."""
        return self._state()["next"]

    @property
    def segment_count(self) -> int:
        """Segments with rows: those of live ones, and all that a compaction put together as one."""
        state = self._state()
        return self._between(max(state["floor"], state["from"]), state["next"]) + (state["compacted"] is not None)

    # appends

    def append(self, record: dict) -> int:
        return self.append_batch([record])[0]

    def append_batch(self, records: list[dict]) -> list[int]:
        """Offsets of records held by the driver, in their order; written without a Spark job."""
        if not records:
            return []
        rows = [r if isinstance(r, dict) else {"value": r} for r in records]
        state = self._state()
        start, size = state["next"], self.span * self.segment_size
        table = None
        if state["schema"]:
            known = {f.name: f for f in T.StructType.fromJson(state["schema"])}
            names = dict.fromkeys(n for r in rows for n in r)
            if known.keys() >= names.keys():
                schema = T.StructType([known[n] for n in names])
                try:
                    table = self._table(rows, schema, start)
                except (pa.ArrowInvalid, pa.ArrowTypeError):  # of another type than before
                    pass
        if table is None:
            schema = CollectionSource(rows).batch(self.spark).schema
            self._check(state, schema)
            table = self._table(rows, schema, start)
        staged = f"_staged-{uuid.uuid4().hex}"
        for at in range(start // size, (start + len(rows) - 1) // size + 1):
            low, high = max(start, at * size), min(start + len(rows), (at + 1) * size)
            held = pa.BufferOutputStream()
            pq.write_table(table.slice(low - start, high - low), held)
            self.folder.write(f"{staged}/segment={at * self.span}/part-{uuid.uuid4().hex}.parquet", held.getvalue().to_pybytes())
        self._commit(state, staged, len(rows), schema)
        return list(range(start, start + len(rows)))

    @staticmethod
    def _check(state: dict, schema: T.StructType) -> None:
        known = {f.name: f.dataType for f in T.StructType.fromJson(state["schema"])} if state["schema"] else {}
        for f in schema:
            if f.name in known and known[f.name] != f.dataType and not isinstance(f.dataType, T.NullType):
                raise PipelineError(f"column {f.name!r} of the log is {known[f.name].simpleString()}, not {f.dataType.simpleString()}")

    @staticmethod
    def _table(rows: list[dict], schema: T.StructType, start: int) -> pa.Table:
        columns = {f.name: [r.get(f.name) for r in rows] for f in schema}
        for f in schema:
            if isinstance(f.dataType, T.MapType):
                columns[f.name] = [None if v is None else list(v.items()) for v in columns[f.name]]
        columns["offset"] = range(start, start + len(rows))
        return pa.Table.from_pydict(columns, to_arrow_schema(T.StructType([*schema.fields, T.StructField("offset", T.LongType())])))

    def append_frame(self, df: DataFrame, order: list[str], batch: tuple[str, int] | None = None) -> tuple[int, int]:
        """Append a frame in an order, numbered without one task holding it; returns its range of offsets.

        ``batch`` names a stream and the number of its batch: one that the log
        already has, as a restarted query may bring it again, is not appended.
        """
        state = self._state()
        start = state["next"]
        if batch and state["batches"].get(batch[0], -1) >= batch[1]:
            return start, start
        self._check(state, df.schema)
        n = df.count()
        staged = f"_staged-{uuid.uuid4().hex}"
        if n:
            rows = numbered(df, order, "offset", start).withColumn("offset", F.col("offset").cast("long"))
            first = F.floor(F.col("offset") / (self.span * self.segment_size)) * self.span
            rows.withColumn("segment", first.cast("long")).sortWithinPartitions("segment", "offset").write.partitionBy("segment").parquet(f"{self.path}/{staged}")
        self._commit(state, staged, n, df.schema, batch)
        return start, start + n

    def _with_segment(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("segment", F.floor(F.col("offset") / self.segment_size).cast("long"))

    def _commit(self, state: dict, staged: str, n: int, schema: T.StructType, batch: tuple[str, int] | None = None) -> None:
        known = T.StructType.fromJson(state["schema"]) if state["schema"] else T.StructType()
        fields = [*known.fields, *(T.StructField(f.name, f.dataType) for f in schema if f.name not in known.names and f.name != "offset")]
        done = state["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._file.save(state | {"next": state["next"] + n, "schema": T.StructType(fields).jsonValue(), "staged": staged, "batches": done})
        if self.folder.has(staged):
            self._settle(staged)

    # reads

    def frame(self) -> DataFrame:
        """All rows, with offset and segment; the columns come from the state, no file is opened for them."""
        return self._rows()

    def _rows(self, low: int = 0, high: int | None = None) -> DataFrame:
        """Rows with offsets from ``low`` up to ``high``; folders without any are not read, nor pages of files."""
        state = self._state()
        if state["schema"] is None:
            raise PipelineError(f"no event log at {self.path}")
        schema = T.StructType([*T.StructType.fromJson(state["schema"]).fields, T.StructField("offset", T.LongType())])
        read = self.spark.read
        parts = []
        if self._folders():
            start = max(low, state["floor"], state["from"])
            live = read.schema(T.StructType([*schema.fields, T.StructField("segment", T.LongType())])).parquet(f"{self.path}/{LIVE}")
            if start > 0:
                live = live.where((F.col("segment") >= start // self.segment_size // self.span * self.span) & (F.col("offset") >= start))
            if high is not None:
                live = live.where((F.col("segment") <= (high - 1) // self.segment_size) & (F.col("offset") < high))
            parts.append(live.drop("segment"))
        if state["compacted"] is not None:
            old, start = read.schema(schema).parquet(f"{self.path}/{state['compacted']}"), max(low, state["floor"])
            old = old.where(F.col("offset") >= start) if start > 0 else old
            parts.append(old.where(F.col("offset") < high) if high is not None else old)
        rows = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0] if parts else self.spark.createDataFrame([], schema)
        return self._with_segment(rows)

    def read(self, offset: int = 0, limit: int | None = None) -> DataFrame:
        """Rows from an offset on, in order; whole segments before it are not read."""
        rows = self._rows(offset).orderBy("offset")
        return (rows.limit(limit) if limit is not None else rows).drop("segment")

    def read_segment(self, index: int) -> DataFrame:
        return self._rows(index * self.segment_size, (index + 1) * self.segment_size).orderBy("offset").drop("segment")

    # upkeep

    def truncate(self, before_offset: int) -> int:
        """Give up whole segments below an offset; returns how many had rows. Folders are deleted once none of their rows holds."""
        state = self._state()
        bound = min(before_offset // self.segment_size * self.segment_size, state["next"])  # offsets still to come are not below it
        floor = max(state["floor"], bound)
        had = self._between(max(state["floor"], state["from"]), bound)
        old = state["compacted"]
        if old is not None:
            had += self._rows(high=min(floor, state["from"])).select("segment").distinct().count()
        gone = old is not None and floor >= state["from"]
        self._file.save(state | {"floor": floor, "compacted": None if gone else old})
        self._drop(state, floor)
        if gone:
            self.folder.delete(old)
        return had

    def compact(self, merge: Callable[[DataFrame], DataFrame], checkpoint_offset: int) -> None:
        """Replace all rows below an offset by ``merge`` of them, which must keep a column ``offset``; rows from it on are not touched."""
        state = self._state()
        new = f"compacted-{uuid.uuid4().hex}"
        merged = merge(self.frame().where(F.col("offset") < checkpoint_offset).drop("segment"))
        merged.withColumn("offset", F.col("offset").cast("long")).hint("rebalance").write.parquet(f"{self.path}/{new}")
        self._file.save(state | {"from": max(checkpoint_offset, state["from"]), "compacted": new})
        self._drop(state, checkpoint_offset)  # what no longer counts
        if state["compacted"]:
            self.folder.delete(state["compacted"])


def latest_by_key(*keys: str) -> Callable[[DataFrame], DataFrame]:
    """A merge that keeps each key's row with the largest offset."""

    def merge(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "offset").alias("last"))
        return last.select(*keys, "last.*")

    return merge
