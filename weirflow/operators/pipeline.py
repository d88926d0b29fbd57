"""Immutable pipelines over frames: the same verbs for bounded and unbounded data.

A verb returns a new pipeline and leaves its own alone, so any number of branches
may start from one. Verbs take column expressions (or SQL text) first, which stay
in the optimiser's sight; a Python callable needs the schema of its results and
runs in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..errors import PipelineError
from ..functions.callables import each_row, fold_global, fold_groups, per_group
from ..functions.expressions import aggregate, plain
from ..sources.sinks import CallbackSink, CollectSink, PrintSink, Sink, record
from ..streaming.watermarks import WatermarkStrategy
from ..types import Schema
from .delivery import DeliveryMode, deduplicated
from .windows import WindowKind, WindowType

Expr = Column | str


def _col(x: Expr) -> Column:
    return F.expr(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Pipeline:
    """``df`` and what the next grouping verb will use: keys, an order, a guarantee."""

    df: DataFrame
    keys: tuple[str, ...] = ()
    delivery: DeliveryMode = DeliveryMode.AT_LEAST_ONCE
    max_retries: int = 3

    def _with(self, df: DataFrame) -> Pipeline:
        return replace(self, df=df)

    def _apply(self, f: Callable[[Any], list], schema: T.StructType | str | None, verb: str) -> Pipeline:
        if schema is None:
            raise PipelineError(f"{verb} with a Python function needs the schema of its results")
        on_error = {DeliveryMode.AT_MOST_ONCE: "skip", DeliveryMode.AT_LEAST_ONCE: "retry", DeliveryMode.EXACTLY_ONCE: "raise"}[self.delivery]
        return self._with(each_row(self.df, f, schema, on_error, self.max_retries))

    # rows

    def map(self, f: Expr | dict[str, Expr] | list[Expr] | Callable, schema: T.StructType | str | None = None) -> Pipeline:
        """One record to one: named expressions, a list of them, one as ``value``, or a function."""
        if isinstance(f, dict):
            return self._with(self.df.select(*[_col(e).alias(n) for n, e in f.items()]))
        if isinstance(f, list):
            return self._with(self.df.select(*[_col(e) for e in f]))
        if isinstance(f, (str, Column)):
            return self._with(self.df.select(_col(f).alias("value")))
        return self._apply(lambda r: [f(r)], schema, "map")

    def flat_map(self, f: Expr | Callable, schema: T.StructType | str | None = None) -> Pipeline:
        """One record to any number: an array expression, exploded to ``value``, or a function."""
        if isinstance(f, (str, Column)):
            return self._with(self.df.select(F.explode(_col(f)).alias("value")))
        return self._apply(lambda r: list(f(r)), schema, "flat_map")

    def filter(self, f: Expr | Callable) -> Pipeline:
        """Records for which a condition is true."""
        if isinstance(f, (str, Column)):
            return self._with(self.df.where(_col(f)))
        return self._apply(lambda r: [r] if f(r) else [], self.df.schema, "filter")

    def process(self, f: Any, schema: T.StructType | str | None = None) -> Pipeline:
        """A function, of whose results None is dropped and a list or tuple spread, or an object with ``process``, whose lists are results."""
        if hasattr(f, "process"):
            made = f() if isinstance(f, type) else f
            return self._apply(lambda r: [x for x in [made.process(r)] if x is not None], schema, "process")

        def run(r: Any) -> list:
            got = f(r)
            return [] if got is None else list(got) if isinstance(got, (list, tuple)) else [got]

        return self._apply(run, schema, "process")

    def select(self, *columns: Expr) -> Pipeline:
        """Columns by name or expression; a name that isn't there is null."""
        return self._with(self.df.select(*[F.lit(None).cast("string").alias(c) if isinstance(c, str) and c.isidentifier() and c not in self.df.columns else (F.col(c) if isinstance(c, str) and c in self.df.columns else _col(c)) for c in columns]))

    def where(self, condition: Expr | Callable) -> Pipeline:
        return self.filter(condition)

    def with_schema(self, schema: Schema) -> Pipeline:
        return self._with(schema.enforce(self.df))

    def to_table(self, schema: Schema | None) -> Pipeline:
        """The table verbs (select, where, group_by, order_by, limit) on a declared schema."""
        if schema is None:
            raise PipelineError("a table needs a schema")
        return self.with_schema(schema)

    # time

    def assign_timestamps(self, time: Expr, strategy: WatermarkStrategy | None = None, name: str = "event_time") -> Pipeline:
        """``name`` from an expression, with the watermark of ``strategy`` on a stream."""
        out = self.df.withColumn(name, _col(time))
        return self._with((strategy or WatermarkStrategy.monotonous()).on(name).apply(out))

    def watermark(self, strategy: WatermarkStrategy) -> Pipeline:
        return self._with(strategy.apply(self.df))

    # groups

    def key_by(self, *keys: str, **named: Expr) -> Pipeline:
        """Later aggregates are for each value of columns, or of named expressions."""
        df = self.df.withColumns({n: _col(e) for n, e in named.items()}) if named else self.df
        return replace(self, df=df, keys=(*keys, *named))

    def group_by(self, *keys: str) -> Pipeline:
        return self.key_by(*keys)

    def groups(self, *order: str) -> DataFrame:
        """Keys and ``records``, the group's other columns as structs, in an order where given. For groups that fit a row."""
        rest = [c for c in self.df.columns if c not in self.keys]
        kept = F.struct(*order, *[c for c in rest if c not in order])
        gathered = F.collect_list(kept)
        return self.df.groupBy(*self.keys).agg((F.sort_array(gathered) if order else gathered).alias("records"))

    def _agg(self, *columns: Column) -> DataFrame:
        if self.keys:
            return self.df.groupBy(*self.keys).agg(*columns)
        # no rows in, no row out, except for a count
        return self.df.agg(*columns, F.count("*").alias("__n")).where("__n > 0").drop("__n")

    def count(self) -> DataFrame:
        return self.df.groupBy(*self.keys).agg(aggregate("count")) if self.keys else self.df.agg(aggregate("count"))

    def sum(self, column: Expr = "value") -> DataFrame:
        return self._agg(aggregate("sum", _col(column)))

    def min(self, column: Expr = "value") -> DataFrame:
        return self._agg(aggregate("min", _col(column)))

    def max(self, column: Expr = "value") -> DataFrame:
        return self._agg(aggregate("max", _col(column)))

    def avg(self, column: Expr = "value") -> DataFrame:
        return self._agg(aggregate("avg", _col(column)))

    def reduce(self, f: Column | Callable, column: str = "value", order: str | None = None, associative: bool = False) -> DataFrame:
        """An aggregate expression, or a fold of a column: within each key in the order of ``order``, or in partitions first if ``f`` is ``associative``; without keys it must be."""
        if isinstance(f, Column):
            return self._agg(f.alias("value"))
        return fold_groups(self.df, list(self.keys), f, column, order, associative) if self.keys else fold_global(self.df, f, column)

    def aggregate(self, **named: Column) -> DataFrame:
        return self._agg(*[e.alias(n) for n, e in named.items()])

    def process_groups(self, f: Callable[[tuple, Sequence], Iterable], schema: T.StructType | str) -> DataFrame:
        """``f(key values, records)`` for each key; records as in a window's ``apply``."""
        return per_group(self.df, list(self.keys), f, schema)

    def process_keyed(self, function: Any, schema: T.StructType | str, mode: str = "update", time_mode: str = "none") -> DataFrame:
        """A ``KeyedProcessFunction`` with state and timers for each key, on batch or stream."""
        from ..streaming.state import run_keyed

        return run_keyed(self.df, list(self.keys), function, schema, mode, time_mode)

    def window(self, window: WindowType) -> WindowedPipeline:
        return WindowedPipeline(self, window)

    # order, guarantees, results

    def order_by(self, *keys: str) -> Pipeline:
        return self._with(self.df.orderBy(*[F.asc_nulls_first(k) for k in keys]))

    def limit(self, n: int) -> Pipeline:
        """The first n rows; with an order before it, the n first of it without a full sort."""
        if n < 0:
            raise PipelineError("limit needs 0 or more")
        return self._with(self.df.limit(n))

    def exactly_once(self, *columns: str, time_field: str | None = None, delay: str = "10 minutes") -> Pipeline:
        """One of each record, once, at the source; later verbs see no copies and make none."""
        return replace(self, df=deduplicated(self.df, list(columns) or None, time_field, delay), delivery=DeliveryMode.EXACTLY_ONCE)

    def with_delivery(self, mode: DeliveryMode, max_retries: int = 3) -> Pipeline:
        return replace(self, delivery=mode, max_retries=max_retries)

    def sink_to(self, sink: Sink, **how: Any) -> Any:
        """Write a batch; start a query on a stream."""
        return sink.start(self.df, **how) if self.df.isStreaming else sink.write(self.df)

    def insert_into(self, sink: Sink, **how: Any) -> Any:
        return self.sink_to(sink, **how)

    def print(self, rows: int = 20) -> Any:
        return self.sink_to(PrintSink(rows))

    def for_each(self, f: Callable[[Any], Any]) -> Any:
        return self.sink_to(CallbackSink(f))

    def collect(self) -> list:
        """Records on the driver: keyed ones as (key, [records]), for results that fit it."""
        if self.df.isStreaming:
            held = CollectSink()
            self.sink_to(held).awaitTermination()
            return held.results
        if self.keys:
            return [(tuple(r[k] for k in self.keys) if len(self.keys) > 1 else r[self.keys[0]], [record(x) for x in r["records"]]) for r in self.groups().toLocalIterator()]
        return [record(r) for r in self.df.toLocalIterator()]

    def explain(self) -> str:
        """The formatted physical plan."""
        return self.df._sc._jvm.PythonSQLUtils.explainString(self.df._jdf.queryExecution(), "formatted")


@dataclass(frozen=True)
class WindowedPipeline:
    """Aggregates for each window, and key if there are any: keys, window_start, window_end, value.

    Windows without a time field, ``global`` and ``over`` are one window over all
    rows, without bounds; no rows then give no result, except a count of 0 for
    ``global`` and ``over``.
    """

    source: Pipeline
    spec: WindowType

    def _agg(self, *columns: Column) -> DataFrame:
        df, keys = self.source.df, self.source.keys
        if not self.spec.timed:
            return self.source._agg(*columns)
        if self.spec.kind is WindowKind.SESSION and not keys and not df.isStreaming:
            return self._sessions().groupBy("window_start", "window_end").agg(*columns)  # ranges of time instead of one task
        out = df.groupBy(*keys, self.spec.column(df)).agg(*columns)
        names = [c for c in out.columns if c not in (*keys, "window")]
        return out.select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *names)

    def count(self) -> DataFrame:
        if not self.spec.timed and self.spec.kind in (WindowKind.GLOBAL, WindowKind.OVER):
            return self.source.count()
        return self._agg(aggregate("count"))

    def sum(self, column: Expr = "value") -> DataFrame:
        return self._agg(aggregate("sum", _col(column)))

    def min(self, column: Expr = "value") -> DataFrame:
        return self._agg(aggregate("min", _col(column)))

    def max(self, column: Expr = "value") -> DataFrame:
        return self._agg(aggregate("max", _col(column)))

    def avg(self, column: Expr = "value") -> DataFrame:
        return self._agg(aggregate("avg", _col(column)))

    def aggregate(self, f: Column | Callable[[Sequence], Any], schema: str | T.StructType | None = None) -> DataFrame:
        """One value a window: an aggregate expression, or a function of the window's records."""
        if isinstance(f, Column):
            return self._agg(f.alias("value"))
        return self.apply(lambda records: [f(records)], schema)

    def apply(self, f: Callable[[Sequence], Iterable], schema: str | T.StructType | None = None) -> DataFrame:
        """Any number of results a window, from a function of its records.

        A window, of each key, goes through one task; so do all rows, where windows
        have no time field. Its records are a sequence that is read from Arrow
        batches, large windows' from a file, so memory holds what the function
        keeps of them. For the first rows of a window see ``top``.
        """
        if schema is None:
            raise PipelineError("a Python function on windows needs the schema of its results")
        from ..functions.callables import struct_of

        out = struct_of(schema)
        df, keys = self.source.df, list(self.source.keys)
        names = out.fieldNames()

        def spread(x: Any) -> tuple:
            return tuple(x.get(n) for n in names) if isinstance(x, dict) else tuple(x) if len(names) > 1 else (x,)

        if not self.spec.timed:
            every = df.withColumn("__all", F.lit(0))
            return per_group(every, ["__all"], lambda _, records: f(records), out, ["__all"])
        if self.spec.kind is WindowKind.SESSION:
            windowed = self._sessions()
        else:
            windowed = df.withColumn("window", self.spec.column(df)).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *df.columns)
        by = [*keys, "window_start", "window_end"]
        result = T.StructType([*[windowed.schema[k] for k in by], *out.fields])

        def run(key: tuple, records: Sequence) -> Iterable:
            return ((*key, *spread(x)) for x in f(records))

        return per_group(windowed, by, run, result, ["window_start", "window_end"])

    def top(self, n: int, *order: Column) -> DataFrame:
        """The first ``n`` rows of each window, and key, in an order: each task passes on ``n`` of its own at most, so no window is held by one."""
        df, keys = self.source.df, list(self.source.keys)
        if not self.spec.timed:
            windowed, bounds = df, []
        elif self.spec.kind is WindowKind.SESSION:
            windowed, bounds = self._sessions(), ["window_start", "window_end"]
        else:
            bounds = ["window_start", "window_end"]
            windowed = df.withColumn("window", self.spec.column(df)).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *df.columns)
        if not (keys or bounds):
            return windowed.orderBy(*order).limit(n)
        ranked = windowed.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys, *bounds).orderBy(*order)))
        return ranked.where(F.col("__rank") <= n).drop("__rank")

    def _sessions(self) -> DataFrame:
        """Rows with their session's bounds."""
        df, keys = self.source.df, list(self.source.keys)
        from ..plans.prefix import sessions
        from .windows import _span, event_time

        time = event_time(df, self.spec.time_field)
        if not keys:
            return sessions(df, time, _span(self.spec.gap))
        w = Window.partitionBy(*keys).orderBy(time)
        marked = df.withColumn("__t", time).withColumn("__new", (F.col("__t") > F.lag("__t").over(w) + F.expr(f"interval {_span(self.spec.gap)}")).cast("int"))
        numbered = marked.withColumn("__s", F.sum(F.coalesce("__new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        inside = Window.partitionBy(*keys, "__s")
        bounds = numbered.withColumns({"window_start": F.min("__t").over(inside), "window_end": F.max("__t").over(inside) + F.expr(f"interval {_span(self.spec.gap)}")})
        return bounds.select("window_start", "window_end", *df.columns)

    def running(self, column: Expr = "value", kind: str = "sum", order: str | None = None) -> DataFrame:
        """For ``over``: each row with ``value``, the aggregate from the first row in time to this one, within its key."""
        time = order or self.spec.time_field
        if time is None:
            raise PipelineError("a running aggregate needs a time field or an order")
        df, keys = self.source.df, self.source.keys
        if keys:
            w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
            return df.withColumn("value", plain(kind, _col(column)).over(w))
        from ..plans.prefix import running_max, running_sum

        if kind == "count":
            return running_sum(df.withColumn("__v", F.lit(1).cast("long")), [time], "__v").drop("__v")
        f = {"sum": running_sum, "max": running_max}[kind]
        return f(df.withColumn("__v", _col(column)), [time], "__v").drop("__v")
