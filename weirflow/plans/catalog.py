"""The registered queries of the engine's own operators, each with the SQL that must give the same rows."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.expressions import extreme_range, word_list
from ..operators.delivery import DeliveryMode, deduplicated, record_id
from ..operators.eventlog import EventLog, latest_by_key
from ..operators.pipeline import Pipeline
from ..operators.serving import MergeView, ServingView, merged
from ..operators.windows import WindowType
from ..sources.readers import CollectionSource, DatagenSource, FileSource, GeneratorSource
from ..sources.sinks import FileSink
from ..streaming.state import KeyedProcessFunction, MemoryStateBackend, StateConfig, drive_keyed
from ..streaming.viscosity import GranularityLevel, Viscosity, ViscosityController
from ..streaming.watermarks import WatermarkStrategy, WatermarkTracker, late_split
from ..types import FieldType, Schema
from .architectures import AdaptiveFlow, KappaFlow, LambdaFlow, per_chunk
from .flow import Flow
from .prefix import numbered
from .scratch import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> Pipeline:
    return Pipeline(table(spark, d, "events"))


#: Sums of money are exact: decimals inside, a double outside.
def cents() -> Column:
    return F.col("value").cast("decimal(18,2)")


def sum_cents() -> Column:
    return F.sum(cents()).cast("double")


SQL_CENTS = "CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE)"
WEEK = "time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01')"
WEEKLY = WindowType.tumbling("7 days", "ts")


def _weekly(value: str) -> str:
    return f"SELECT {WEEK} AS window_start, {WEEK} + INTERVAL 7 DAY AS window_end, {value} AS value FROM events GROUP BY 1, 2"


# windows


@query(_weekly(SQL_CENTS))
def tumbling_sum(spark, d):
    return events(spark, d).window(WEEKLY).aggregate(sum_cents())


@query(_weekly("COUNT(*)"))
def tumbling_count(spark, d):
    return events(spark, d).window(WEEKLY).count()


@query(_weekly("MIN(value)"))
def tumbling_min(spark, d):
    return events(spark, d).window(WEEKLY).min("value")


@query(_weekly("MAX(value)"))
def tumbling_max(spark, d):
    return events(spark, d).window(WEEKLY).max("value")


@query(_weekly(f"ROUND({SQL_CENTS} / COUNT(*), 6)"))
def tumbling_avg(spark, d):
    return events(spark, d).window(WEEKLY).aggregate(F.round(sum_cents() / F.count("*"), 6))


@query(f"SELECT event_type, {WEEK} AS window_start, {WEEK} + INTERVAL 7 DAY AS window_end, {SQL_CENTS} AS value FROM events GROUP BY 1, 2, 3")
def tumbling_keyed_sum(spark, d):
    return events(spark, d).key_by("event_type").window(WEEKLY).aggregate(sum_cents())


DAYS = "SELECT unnest([date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts)]) AS window_start, value, ts FROM events"


@query(f"SELECT window_start, window_start + INTERVAL 2 DAY AS window_end, COUNT(*) AS value FROM ({DAYS}) GROUP BY 1, 2")
def sliding_count(spark, d):
    return events(spark, d).window(WindowType.sliding("2 days", "1 day", "ts")).count()


@query(f"SELECT window_start, window_start + INTERVAL 2 DAY AS window_end, {SQL_CENTS} AS value FROM ({DAYS}) GROUP BY 1, 2")
def sliding_sum(spark, d):
    return events(spark, d).window(WindowType.sliding("2 days", "1 day", "ts")).aggregate(sum_cents())


@query(f"SELECT window_start, window_start + INTERVAL 2 DAY AS window_end, MIN(value) AS low, MAX(value) AS high FROM ({DAYS}) GROUP BY 1, 2")
def sliding_min_max(spark, d):
    w = events(spark, d).window(WindowType.sliding("2 days", "1 day", "ts"))
    return w._agg(F.min("value").alias("low"), F.max("value").alias("high"))


@query("""
SELECT w AS window_start, w + INTERVAL 10 HOUR AS window_end, COUNT(*) AS value FROM (
  SELECT ts, unnest([b - INTERVAL 8 HOUR, b - INTERVAL 4 HOUR, b]) AS w
  FROM (SELECT ts, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS b FROM events))
WHERE ts < w + INTERVAL 10 HOUR GROUP BY 1, 2""")
def sliding_nondivisible(spark, d):
    return events(spark, d).window(WindowType.sliding("10 hours", "4 hours", "ts")).count()


def _sessions(gap: str, key: str = "", value: str = "COUNT(*)") -> str:
    part, sel, by = (f"PARTITION BY {key} ", f"{key}, ", f"{key}, s") if key else ("", "", "s")
    return f"""
WITH m AS (SELECT *, CASE WHEN ts > LAG(ts) OVER ({part}ORDER BY ts) + INTERVAL {gap} THEN 1 ELSE 0 END AS n FROM events),
 s AS (SELECT *, SUM(n) OVER ({part}ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT {sel}MIN(ts) AS window_start, MAX(ts) + INTERVAL {gap} AS window_end, {value} AS value FROM s GROUP BY {by}"""


@query(_sessions("10 MINUTE"))
def session_global(spark, d):
    return events(spark, d).window(WindowType.session("10 minutes", "ts")).count()


@query(_sessions("6 HOUR", "user_id", SQL_CENTS))
def session_keyed(spark, d):
    return events(spark, d).key_by("user_id").window(WindowType.session("6 hours", "ts")).aggregate(sum_cents())


@query(_sessions("6 HOUR", "user_id", "MAX(value) - MIN(value)"))
def session_range(spark, d):
    return events(spark, d).key_by("user_id").window(WindowType.session("6 hours", "ts")).aggregate(extreme_range("value"))


@query(f"SELECT {SQL_CENTS} AS value FROM events")
def over_total(spark, d):
    return events(spark, d).window(WindowType.over("ts")).aggregate(sum_cents())


@query("SELECT event_id, CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS value FROM events")
def over_running_sum(spark, d):
    run = events(spark, d).window(WindowType.over("event_id")).running(cents())
    return run.select("event_id", F.col("value").cast("double").alias("value"))


@query("SELECT event_id, user_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS value FROM events")
def over_running_count_keyed(spark, d):
    return events(spark, d).key_by("user_id").window(WindowType.over("event_id")).running(kind="count").select("event_id", "user_id", "value")


@query(f"SELECT {SQL_CENTS} AS value FROM events")
def global_window_sum(spark, d):
    return events(spark, d).window(WindowType.global_window()).aggregate(sum_cents())


@query("SELECT COUNT(*) AS value FROM events")
def global_window_count(spark, d):
    return events(spark, d).window(WindowType.global_window()).count()


@query(_weekly("MAX(value) - MIN(value)"))
def window_aggregate_custom(spark, d):
    return events(spark, d).window(WEEKLY).aggregate(extreme_range("value"))


@query(f"""
SELECT window_start, window_end, event_id, value FROM (
  SELECT {WEEK} AS window_start, {WEEK} + INTERVAL 7 DAY AS window_end, event_id, value,
    row_number() OVER (PARTITION BY {WEEK} ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3""")
def window_apply_topn(spark, d):
    """A Python function on each window's records, of which the three largest come back."""
    slim = events(spark, d).map(["event_id", "ts", "value"])
    return slim.window(WEEKLY).apply(lambda rs: [{"event_id": r["event_id"], "value": r["value"]} for r in heapq.nsmallest(3, rs, key=lambda r: (-r["value"], r["event_id"]))], "event_id long, value double")


TOP = f"""
SELECT window_start, window_end, event_id, value FROM (
  SELECT {WEEK} AS window_start, {WEEK} + INTERVAL 7 DAY AS window_end, event_id, value,
    row_number() OVER (PARTITION BY {WEEK} ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3"""


@query(TOP)
def window_top(spark, d):
    """The same without a Python function: each task passes on three rows of a window at most."""
    return events(spark, d).map(["event_id", "ts", "value"]).window(WEEKLY).top(3, F.desc("value"), F.col("event_id")).select("window_start", "window_end", "event_id", "value")


@query(_sessions("10 MINUTE", "", SQL_CENTS))
def session_global_sum(spark, d):
    return events(spark, d).window(WindowType.session("10 minutes", "ts")).aggregate(sum_cents())


@query(_sessions("6 HOUR", "", "COUNT(DISTINCT user_id)"))
def session_global_apply(spark, d):
    """A Python function on each session of all rows."""
    slim = events(spark, d).map(["ts", "user_id"])
    return slim.window(WindowType.session("6 hours", "ts")).apply(lambda rs: [len({r["user_id"] for r in rs})], "long")


@query("SELECT COUNT(*) AS value FROM events")
def untimed_window_count(spark, d):
    return events(spark, d).window(WindowType.tumbling("7 days")).count()


@query(f"SELECT {SQL_CENTS} AS value FROM events")
def untimed_window_sum(spark, d):
    return events(spark, d).window(WindowType.sliding("7 days", "1 day")).aggregate(sum_cents())


@query("SELECT MIN(n_nationkey) AS value FROM nation UNION ALL SELECT MAX(n_nationkey) FROM nation")
def untimed_window_apply(spark, d):
    keys = Pipeline(table(spark, d, "nation")).map("n_nationkey")
    return keys.window(WindowType.session("1 day")).apply(lambda rs: [f(r["value"] for r in rs) for f in (min, max)], "int")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 7")
def untimed_window_top(spark, d):
    return events(spark, d).map(["event_id", "value"]).window(WindowType.global_window()).top(7, F.desc("value"), F.col("event_id"))


# rows


@query("SELECT event_id, value * 2 AS value FROM events")
def map_double(spark, d):
    return events(spark, d).map({"event_id": "event_id", "value": "value * 2"}).df


@query("SELECT event_id, upper(event_type) || '-' || CAST(user_id AS VARCHAR) AS value FROM events")
def map_callable(spark, d):
    """A Python function, in Arrow batches."""
    slim = events(spark, d).map(["event_id", "event_type", "user_id"])
    return slim.map(lambda r: {"event_id": r["event_id"], "value": f"{r['event_type'].upper()}-{r['user_id']}"}, "event_id long, value string").df


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def filter_purchase(spark, d):
    return events(spark, d).filter("event_type = 'purchase'").select("event_id", "user_id", "value").df


WORDS = r"unnest(regexp_split_to_array(lower(text), '\s+'))"


@query(f"SELECT w AS value FROM (SELECT {WORDS} AS w FROM documents) WHERE w <> ''")
def flat_map_words(spark, d):
    return Pipeline(table(spark, d, "documents")).flat_map(word_list("text")).df


@query(f"SELECT w AS word, COUNT(*) AS value FROM (SELECT {WORDS} AS w FROM documents) WHERE w <> '' GROUP BY 1")
def wordcount(spark, d):
    words = Pipeline(table(spark, d, "documents")).flat_map(word_list("text"))
    return words.key_by(word="value").count()


@query("SELECT event_id AS value FROM events WHERE event_type = 'click' UNION ALL SELECT -event_id FROM events WHERE event_type = 'click'")
def process_multi(spark, d):
    """A function that gives none or two results a record."""
    slim = events(spark, d).map(["event_id", "event_type"])
    return slim.process(lambda r: [r["event_id"], -r["event_id"]] if r["event_type"] == "click" else None, "long").df


class _Score:
    def process(self, r: dict) -> dict | None:
        return {"event_id": r["event_id"], "points": len(r["event_type"]) * 10} if r["user_id"] % 3 else None


@query("SELECT event_id, CAST(length(event_type) * 10 AS BIGINT) AS points FROM events WHERE user_id % 3 <> 0")
def process_fn(spark, d):
    slim = events(spark, d).map(["event_id", "event_type", "user_id"])
    return slim.process(_Score(), "event_id long, points long").df


@query("SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS c_phone FROM customer")
def schema_enforced(spark, d):
    wanted = Schema.from_pairs([("c_custkey", FieldType.LONG), ("c_name", FieldType.STRING), ("c_phone", FieldType.STRING)])
    return Pipeline(table(spark, d, "customer")).with_schema(wanted).df


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 8000 THEN 'A' WHEN c_acctbal >= 4000 THEN 'B' ELSE 'C' END AS grade FROM customer")
def grade_labels(spark, d):
    grade = F.when(F.col("c_acctbal") >= 8000, "A").when(F.col("c_acctbal") >= 4000, "B").otherwise("C")
    return Pipeline(table(spark, d, "customer")).map({"c_custkey": "c_custkey", "grade": grade}).df


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice >= 300000 THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM orders WHERE o_totalprice >= 200000")
def fraud_flagging(spark, d):
    flagged = Pipeline(table(spark, d, "orders")).filter("o_totalprice >= 200000")
    return flagged.map({"o_orderkey": "o_orderkey", "o_totalprice": "o_totalprice", "risk": F.when(F.col("o_totalprice") >= 300000, "HIGH").otherwise("MEDIUM")}).df


# aggregates


@query("SELECT event_type, COUNT(*) AS n, md5(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) AS ids FROM events GROUP BY 1")
def key_by_groups(spark, d):
    """The groups themselves, digested."""
    groups = events(spark, d).map(["event_type", "event_id"]).key_by("event_type").groups("event_id")
    ids = F.array_join(F.transform("records", lambda r: r["event_id"].cast("string")), ",")
    return groups.select("event_type", F.size("records").cast("long").alias("n"), F.md5(ids.cast("binary")).alias("ids"))


def _by_user(value: str) -> str:
    return f"SELECT user_id, {value} AS value FROM events GROUP BY user_id"


@query(_by_user(SQL_CENTS))
def keyed_sum(spark, d):
    return events(spark, d).key_by("user_id").reduce(sum_cents())


@query(_by_user("COUNT(*)"))
def keyed_count(spark, d):
    return events(spark, d).key_by("user_id").count()


@query(_by_user("MIN(value)"))
def keyed_min(spark, d):
    return events(spark, d).key_by("user_id").min("value")


@query(_by_user("MAX(value)"))
def keyed_max(spark, d):
    return events(spark, d).key_by("user_id").max("value")


@query(_by_user("CAST(SUM(event_id) AS BIGINT)"))
def keyed_reduce(spark, d):
    """An associative Python fold within each key: in partitions before the shuffle."""
    slim = events(spark, d).map(["user_id", "event_id"])
    return slim.key_by("user_id").reduce(lambda a, b: a + b, "event_id", associative=True)


@query("SELECT user_id, string_agg(CAST(event_id AS VARCHAR), '>' ORDER BY event_id) AS value FROM events WHERE user_id % 10 = 3 GROUP BY 1")
def keyed_reduce_ordered(spark, d):
    """A fold that is told the order: each key in one task."""
    slim = events(spark, d).filter("user_id % 10 = 3").map({"user_id": "user_id", "event_id": "event_id", "text": "cast(event_id as string)"})
    return slim.key_by("user_id").reduce(lambda a, b: f"{a}>{b}", "text", "event_id")


@query(f"SELECT {SQL_CENTS} AS value FROM events")
def global_sum(spark, d):
    return events(spark, d).reduce(sum_cents())


@query("SELECT COUNT(*) AS value FROM lineitem")
def global_count(spark, d):
    return Pipeline(table(spark, d, "lineitem")).count()


@query("SELECT MIN(l_extendedprice) AS value FROM lineitem")
def global_min(spark, d):
    return Pipeline(table(spark, d, "lineitem")).min("l_extendedprice")


@query("SELECT MAX(l_extendedprice) AS value FROM lineitem")
def global_max(spark, d):
    return Pipeline(table(spark, d, "lineitem")).max("l_extendedprice")


@query("SELECT bit_xor(event_id) AS value FROM events")
def global_reduce(spark, d):
    """An associative Python fold: in partitions, then over their results."""
    return events(spark, d).reduce(lambda a, b: a ^ b, "event_id")


# tables


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def table_select_where(spark, d):
    return Pipeline(table(spark, d, "lineitem")).where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity").df


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS value FROM lineitem GROUP BY 1, 2")
def table_group_count(spark, d):
    return Pipeline(table(spark, d, "lineitem")).group_by("l_returnflag", "l_linestatus").count()


@query("SELECT l_returnflag, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem GROUP BY 1")
def table_group_sum(spark, d):
    return Pipeline(table(spark, d, "lineitem")).group_by("l_returnflag").reduce(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"))


@query("SELECT l_returnflag, ROUND(CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*), 6) AS value FROM lineitem GROUP BY 1")
def table_group_avg(spark, d):
    total = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")
    return Pipeline(table(spark, d, "lineitem")).group_by("l_returnflag").reduce(F.round(total / F.count("*"), 6))


@query("SELECT o_orderpriority, MIN(o_orderkey) AS first_key, MAX(o_orderkey) AS last_key FROM orders GROUP BY 1")
def table_group_select(spark, d):
    return Pipeline(table(spark, d, "orders")).group_by("o_orderpriority").aggregate(first_key=F.min("o_orderkey"), last_key=F.max("o_orderkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice NULLS FIRST, o_orderkey LIMIT 25")
def order_by_limit(spark, d):
    return Pipeline(table(spark, d, "orders")).order_by("o_totalprice", "o_orderkey").limit(25).select("o_orderkey", "o_totalprice").df


# delivery, time


@query("SELECT DISTINCT sha256(text) AS record_id FROM documents")
def exactly_once_dedup(spark, d):
    texts = table(spark, d, "documents").select("text")
    return deduplicated(texts.select(record_id(texts).alias("record_id")))


@query("SELECT DISTINCT user_id, event_type FROM events")
def exactly_once_columns(spark, d):
    return events(spark, d).exactly_once("user_id", "event_type").select("user_id", "event_type").df


#: Arrival mixes up the order of event times.
ARRIVED = "SELECT *, (event_id * 7919) % 10007 AS arrival FROM events"
LATE = f"""
SELECT *, ts < MAX(ts) OVER (ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING) - INTERVAL 1 DAY AS is_late
FROM ({ARRIVED})"""


def _late(spark: SparkSession, d: str) -> DataFrame:
    arrived = table(spark, d, "events").withColumn("arrival", F.expr("(event_id * 7919) % 10007 * 10000000 + event_id"))
    return late_split(arrived, "arrival", "ts", "1 day")


@query(f"SELECT event_id, ts FROM ({LATE}) WHERE is_late")
def late_records(spark, d):
    return _late(spark, d).where("is_late").select("event_id", "ts")


@query(f"SELECT {WEEK} AS window_start, {WEEK} + INTERVAL 7 DAY AS window_end, COUNT(*) AS value FROM ({LATE}) WHERE NOT is_late GROUP BY 1, 2")
def ontime_window_count(spark, d):
    return Pipeline(_late(spark, d).where("not is_late")).window(WEEKLY).count()


# state


class _Count(KeyedProcessFunction):
    def process_element(self, value, context):
        n = context.value_state("n", 0)
        n.update(n.value() + 1)

    def open(self, context):
        context.value_state("n", 0)

    def on_batch_end(self, context):
        return (context.current_key, context.value_state("n", 0).value())


class _Last3(KeyedProcessFunction):
    def open(self, context):
        context.list_state("last")

    def process_element(self, value, context):
        last = context.list_state("last")
        last.replace(sorted([*last.get(), value["event_id"]])[-3:])

    def on_batch_end(self, context):
        return (context.current_key, ",".join(map(str, context.list_state("last").get())))


class _Types(KeyedProcessFunction):
    def open(self, context):
        context.map_state("types")

    def process_element(self, value, context):
        types = context.map_state("types")
        types.put(value["event_type"], types.get(value["event_type"], 0) + 1)

    def on_batch_end(self, context):
        return [(context.current_key, k, n) for k, n in context.map_state("types").items()]


class _Largest(KeyedProcessFunction):
    def open(self, context):
        context.reducing_state("largest", max)

    def process_element(self, value, context):
        context.reducing_state("largest", max).add(value["value"])

    def on_batch_end(self, context):
        return (context.current_key, context.reducing_state("largest", max).get())


class _Mean(KeyedProcessFunction):
    def _state(self, context):
        return context.aggregating_state("mean", lambda a, v: [a[0] + v, a[1] + 1], lambda: [0, 0], lambda a: a[0] / a[1])

    def open(self, context):
        self._state(context)

    def process_element(self, value, context):
        self._state(context).add(value["event_id"])

    def on_batch_end(self, context):
        return (context.current_key, self._state(context).get())


def _keyed(spark: SparkSession, d: str, columns: list[str], function: type, schema: str) -> DataFrame:
    return events(spark, d).map(["user_id", *columns]).key_by("user_id").process_keyed(function, schema)


@query(_by_user("COUNT(*)"))
def stateful_running_count(spark, d):
    return _keyed(spark, d, ["event_id"], _Count, "user_id long, value long")


@query("SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3 GROUP BY 1")
def state_list_last3(spark, d):
    return _keyed(spark, d, ["event_id"], _Last3, "user_id long, value string")


@query("SELECT user_id, event_type, COUNT(*) AS value FROM events GROUP BY 1, 2")
def state_map_counts(spark, d):
    return _keyed(spark, d, ["event_type"], _Types, "user_id long, event_type string, value long")


@query(_by_user("MAX(value)"))
def state_reducing_max(spark, d):
    return _keyed(spark, d, ["value"], _Largest, "user_id long, value double")


@query(_by_user("ROUND(CAST(SUM(event_id) AS DOUBLE) / COUNT(*), 6)"))
def state_aggregating_avg(spark, d):
    out = _keyed(spark, d, ["event_id"], _Mean, "user_id long, value double")
    return out.select("user_id", F.round("value", 6).alias("value"))


# log, views, architectures


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def latest_per_key(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "value", F.col("event_id").alias("offset"))
    return latest_by_key("user_id")(rows).select("user_id", "event_id", "value")


@query('SELECT "offset", event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS "offset" FROM events) WHERE "offset" >= 200 AND "offset" < 700')
def log_replay_range(spark, d):
    log = EventLog(spark, f"{scratch_dir(spark)}/log", segment_size=1000)
    log.append_frame(table(spark, d, "events").select("event_id", "user_id"), ["event_id"])
    return log.read(200, 500).select("offset", "event_id", "user_id")


@query("""
WITH l AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS o FROM events)
SELECT user_id, event_id FROM (SELECT user_id, MAX(event_id) AS event_id FROM l WHERE o < 600 GROUP BY 1) UNION ALL SELECT user_id, event_id FROM l WHERE o >= 600""")
def log_compacted(spark, d):
    log = EventLog(spark, f"{scratch_dir(spark)}/log")
    log.append_frame(table(spark, d, "events").select("event_id", "user_id"), ["event_id"])
    log.compact(latest_by_key("user_id"), 600)
    return log.frame().select("user_id", "event_id")


@query(f"SELECT event_type, {SQL_CENTS} AS value FROM events GROUP BY 1")
def kappa_replay_aggregate(spark, d):
    flow = KappaFlow(spark, lambda df: Pipeline(df).key_by("event_type").reduce(sum_cents()), f"{scratch_dir(spark)}/log", order=["event_id"])
    flow.execute(table(spark, d, "events").select("event_id", "event_type", "value"))
    return flow.replay_to_stream()


@query('SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS "offset" FROM events')
def log_offsets(spark, d):
    return numbered(table(spark, d, "events").select("event_id"), ["event_id"]).select("event_id", "offset")


CUT = "TIMESTAMP '2024-01-20'"
LAYERS = f"""
b AS (SELECT user_id, CAST(SUM(event_id) AS BIGINT) AS v FROM events WHERE ts < {CUT} AND event_type <> 'click' GROUP BY 1),
s AS (SELECT user_id, CAST(SUM(event_id) AS BIGINT) AS v FROM events WHERE ts >= {CUT} AND event_type <> 'view' GROUP BY 1),
m AS (SELECT COALESCE(b.user_id, s.user_id) AS user_id, b.v AS bv, s.v AS sv FROM b FULL OUTER JOIN s ON b.user_id = s.user_id)"""


def _layers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = Pipeline(table(spark, d, "events"))
    batch = e.filter(f"ts < {CUT} and event_type <> 'click'").key_by("user_id").sum("event_id")
    return batch, e.filter(f"ts >= {CUT} and event_type <> 'view'").key_by("user_id").sum("event_id")


@query(f"WITH {LAYERS} SELECT user_id, COALESCE(sv, bv) AS value FROM m")
def serving_latest(spark, d):
    return merged(*_layers(spark, d), ["user_id"], MergeView.latest).select("user_id", "value")


@query(f"WITH {LAYERS} SELECT user_id, COALESCE(bv, sv) AS value FROM m")
def serving_prefer_batch(spark, d):
    return merged(*_layers(spark, d), ["user_id"], MergeView.prefer_batch).select("user_id", "value")


@query(f"WITH {LAYERS} SELECT user_id, COALESCE(bv, 0) + COALESCE(sv, 0) AS value FROM m")
def serving_combine_sum(spark, d):
    return merged(*_layers(spark, d), ["user_id"], MergeView.combine_sum).select("user_id", "value")


@query(f"""
WITH x AS (SELECT user_id, event_type, MAX(event_id) FILTER (WHERE ts < {CUT}) AS b, MAX(event_id) FILTER (WHERE ts >= {CUT}) AS s FROM events GROUP BY 1, 2)
SELECT user_id, event_type, COALESCE(s, b) AS value FROM x""")
def serving_merge_dicts(spark, d):
    last = table(spark, d, "events").groupBy("user_id", "event_type", (F.col("ts") < F.expr(CUT)).alias("old")).agg(F.max("event_id").alias("v"))

    def maps(old: bool) -> DataFrame:
        return last.where(F.col("old") == old).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("value"))

    return merged(maps(True), maps(False), ["user_id"], MergeView.merge_dicts).select("user_id", F.explode("value").alias("event_type", "value"))


@query(f"WITH {LAYERS} SELECT user_id, COALESCE(bv, 0) + COALESCE(sv, 0) AS value FROM m")
def lambda_execute(spark, d):
    e = table(spark, d, "events")
    flow = LambdaFlow(
        lambda df: Pipeline(df).filter("event_type <> 'click'").key_by("user_id").sum("event_id"),
        lambda df: Pipeline(df).filter("event_type <> 'view'").key_by("user_id").sum("event_id"), ["user_id"], MergeView.combine_sum,
    )
    return flow.execute(e.where(f"ts < {CUT}"), e.where(f"ts >= {CUT}")).frame().select("user_id", "value")


@query(f"SELECT chunk, {SQL_CENTS} AS value FROM (SELECT value, (row_number() OVER (ORDER BY event_id) - 1) // 100 AS chunk FROM events) GROUP BY 1")
def adaptive_chunk_sum(spark, d):
    """One result a chunk of a level's batch size, as a run at that level emits them."""
    return per_chunk(table(spark, d, "events").select("event_id", "value"), ["event_id"], 100, sum_cents().alias("value"))


@query(f"SELECT event_type, {SQL_CENTS} AS value FROM events GROUP BY 1")
def adaptive_execute(spark, d):
    flow = AdaptiveFlow(lambda df: Pipeline(df).key_by("event_type").reduce(sum_cents()))
    return flow.execute_batch_like(table(spark, d, "events"))


# files and streams


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def file_json_round_trip(spark, d):
    path = f"{scratch_dir(spark)}/nation"
    Pipeline(table(spark, d, "nation")).sink_to(FileSink(path, "json"))
    return FileSource(path, "json", "n_nationkey int, n_name string, n_regionkey int").batch(spark)


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def file_csv_round_trip(spark, d):
    """CSV with a header; without a schema all fields are strings."""
    path = f"{scratch_dir(spark)}/customer"
    Pipeline(table(spark, d, "customer")).select("c_custkey", "c_name", "c_mktsegment").sink_to(FileSink(path, "csv"))
    return FileSource(path, "csv").batch(spark)


@query("SELECT p_name AS value FROM part")
def file_text_round_trip(spark, d):
    path = f"{scratch_dir(spark)}/part"
    Pipeline(table(spark, d, "part")).map("p_name").sink_to(FileSink(path, "text"))
    return FileSource(path, "text").batch(spark)


def _stream(spark: SparkSession, d: str) -> Pipeline:
    schema = table(spark, d, "events").schema
    # a folder source takes the files of events.parquet, be it one file or a folder
    src = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    path = f"{d}/events.parquet"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    df = src.parquet(path) if folder else src.option("pathGlobFilter", "events.parquet").parquet(d)
    return Pipeline(df.withColumn("ts", F.col("ts").cast("timestamp")))


def _finished(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives on the data there is, by Spark's memory sink (of aggregates) or files (of rows)."""
    base = scratch_dir(spark)
    if mode == "append":
        df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{base}/out")
    name = "stream_" + base.rsplit("-", 1)[-1]
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query(_weekly(SQL_CENTS))
def stream_tumbling_sum(spark, d):
    timed = _stream(spark, d).watermark(WatermarkStrategy.bounded_out_of_orderness(3600, "ts"))
    out = _finished(spark, timed.window(WEEKLY).aggregate(sum_cents()), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "value")


@query(_by_user("COUNT(*)"))
def stream_keyed_count(spark, d):
    return _finished(spark, _stream(spark, d).key_by("user_id").count(), "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    return _finished(spark, _stream(spark, d).select("user_id", "event_type").exactly_once().df, "append")


@query("SELECT event_id, value * 2 AS value FROM events WHERE event_type = 'purchase'")
def stream_map_filter(spark, d):
    return _finished(spark, _stream(spark, d).filter("event_type = 'purchase'").map({"event_id": "event_id", "value": "value * 2"}).df, "append")


@query("SELECT user_id, COUNT(*) AS value FROM events GROUP BY 1")
def stream_without_watermark(spark, d):
    timed = _stream(spark, d).watermark(WatermarkStrategy.no_watermarks().on("ts"))
    return _finished(spark, timed.key_by("user_id").count(), "complete")


@query(_weekly("MAX(value)"))
def stream_monotonous_max(spark, d):
    timed = _stream(spark, d).assign_timestamps("ts", WatermarkStrategy.monotonous(), "at")
    out = _finished(spark, timed.window(WindowType.tumbling("7 days", "at")).max("value"), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "value")


# sources and sinks that the driver holds


@query("SELECT range * 2 AS value FROM range(1000)")
def source_collection(spark, d):
    return Pipeline(CollectionSource(list(range(1000))).batch(spark)).map("value * 2").df


@query("SELECT range * range AS value FROM range(500)")
def source_generator(spark, d):
    return GeneratorSource(lambda: (k * k for k in itertools.count()), max_items=500).batch(spark)


@query("SELECT range AS id, 'value_' || range AS name, true AS inside FROM range(1000)")
def source_datagen(spark, d):
    made = DatagenSource(fields={"value": FieldType.DOUBLE, "name": FieldType.STRING}, max_records=1000).batch(spark)
    return made.select("id", "name", F.col("value").between(0, 1000).alias("inside"))


@query("SELECT n_nationkey * 3 AS value FROM nation")
def flow_from_source(spark, d):
    """A flow with a named source, a pipeline and a sink, executed."""
    path = f"{scratch_dir(spark)}/nation"
    flow = Flow("nations", spark=spark)
    flow.sink(Pipeline(table(spark, d, "nation")).select("n_nationkey"), FileSink(path, "parquet"), "copy")
    flow.execute()
    again = Flow("again", spark=spark)
    again.sink(again.from_source(FileSource(path, "parquet")).map("n_nationkey * 3"), name="tripled")
    return spark.createDataFrame([(x,) for x in again.execute()["tripled"]], "value int")


def _nations(spark: SparkSession, d: str) -> Pipeline:
    return Pipeline(table(spark, d, "nation")).select("n_nationkey", "n_name")


def _rows_of(spark: SparkSession, records: list) -> DataFrame:
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in records], "n_nationkey int, n_name string")


NATIONS = "SELECT n_nationkey, n_name FROM nation"


@query(NATIONS)
def sink_collect(spark, d):
    return _rows_of(spark, _nations(spark, d).collect())


@query(NATIONS)
def sink_callback(spark, d):
    got: list = []
    _nations(spark, d).for_each(got.append)
    return _rows_of(spark, got)


@query(NATIONS)
def sink_insert_into(spark, d):
    path = f"{scratch_dir(spark)}/inserted"
    _nations(spark, d).insert_into(FileSink(path, "orc"))
    return FileSource(path, "orc").batch(spark)


@query("SELECT event_id, ts + INTERVAL 1 HOUR AS event_time FROM events")
def assigned_timestamps(spark, d):
    return events(spark, d).assign_timestamps("ts + interval 1 hour").select("event_id", "event_time").df


@query("""
SELECT n_nationkey, t, COALESCE(t < MAX(t) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 20, false) AS late
FROM (SELECT n_nationkey, CAST(n_nationkey * 7919 % 101 AS DOUBLE) AS t FROM nation)""")
def watermark_tracker(spark, d):
    """Single event times against the watermark that those before them left."""
    tracker, out = WatermarkTracker(WatermarkStrategy.bounded_out_of_orderness(20), strict=True), []
    for r in table(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey").collect():
        t = float(r[0] * 7919 % 101)
        out.append((r[0], t, tracker.is_late(t)))
        tracker.on_event(t)
    return spark.createDataFrame(out, "n_nationkey int, t double, late boolean")


def _fails_on_sevens(r: dict) -> dict:
    if r["user_id"] % 7 == 0:
        raise ValueError("no sevens")
    return {"event_id": r["event_id"]}


@query("SELECT event_id FROM events WHERE user_id % 7 <> 0")
def at_most_once_map(spark, d):
    """Records that fail are given up."""
    slim = events(spark, d).map(["event_id", "user_id"]).with_delivery(DeliveryMode.AT_MOST_ONCE)
    return slim.map(_fails_on_sevens, "event_id long").df


class _FailsAtFirst:
    def __init__(self):
        self.tried: set = set()

    def __call__(self, r: dict) -> dict:
        if r["event_id"] % 50 == 0 and r["event_id"] not in self.tried:
            self.tried.add(r["event_id"])
            raise OSError("try again")
        return {"event_id": r["event_id"]}


@query("SELECT event_id FROM events")
def at_least_once_map(spark, d):
    """Records that fail are tried again."""
    slim = events(spark, d).map(["event_id"]).map({"event_id": "event_id", "extra": "1"}).with_delivery(DeliveryMode.AT_LEAST_ONCE)
    return slim.map(_FailsAtFirst(), "event_id long").df


@query("SELECT event_type, COUNT(*) AS n, CAST(MAX(event_id) AS BIGINT) AS last FROM events GROUP BY 1")
def process_groups_callable(spark, d):
    slim = events(spark, d).map(["event_type", "event_id"])
    return slim.key_by("event_type").process_groups(lambda key, rs: [(*key, len(rs), max(r["event_id"] for r in rs))], "event_type string, n long, last long")


class _Alarm(KeyedProcessFunction):
    def process_element(self, value, context):
        context.timer_service.register(value["t"] + 10.0)

    def on_timer(self, timestamp, context):
        return (context.current_key, timestamp)


@query("SELECT k, t + 10 AS fired FROM (SELECT n_regionkey AS k, CAST(n_nationkey * 100 AS DOUBLE) AS t, MAX(n_nationkey * 100) OVER () AS top FROM nation) WHERE t + 10 <= top")
def state_timers(spark, d):
    """Timers of event time fire when the largest time of all keys has passed them."""
    rows = [{"k": r[0], "t": r[1] * 100.0} for r in table(spark, d, "nation").select("n_regionkey", "n_nationkey").orderBy("n_nationkey").collect()]
    return spark.createDataFrame(drive_keyed(rows, lambda r: r["k"], _Alarm(), lambda r: r["t"]), "k int, fired double")


class _Expiring(KeyedProcessFunction):
    config = StateConfig(ttl=86_400)

    def process_element(self, value, context):
        n = context.value_state("n", 0, self.config)
        n.update(n.value() + 1)

    def open(self, context):
        context.value_state("n", 0, self.config)

    def on_batch_end(self, context):
        return (context.current_key, context.value_state("n", 0, self.config).value())


@query(_by_user("COUNT(*)"))
def state_with_ttl(spark, d):
    """State that expires a day after it was written, on the batch that writes it."""
    slim = events(spark, d).map(["user_id", "event_id"]).key_by("user_id")
    return slim.process_keyed(_Expiring, "user_id long, value long", "update", "processingTime")


@query("SELECT n_regionkey, COUNT(*) AS n, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def state_backends(spark, d):
    """State on the driver: kept by a backend, restored from its checkpoint half way."""
    backend = MemoryStateBackend()
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()
    for k, r in enumerate(rows):
        backend.set("value", r["n_regionkey"], "n", backend.get("value", r["n_regionkey"], "n", 0) + 1)
        backend.set("list", r["n_regionkey"], "names", [*backend.get("list", r["n_regionkey"], "names", []), r["n_name"]])
        if k == len(rows) // 2:
            snapshot, backend = backend.checkpoint(), MemoryStateBackend()
            backend.restore(snapshot)
    found = [(r, backend.get("value", r, "n"), ",".join(backend.get("list", r, "names"))) for r in sorted({r["n_regionkey"] for r in rows})]
    return spark.createDataFrame(found, "n_regionkey int, n long, names string")


# more of the log, views and architectures


def _log(spark: SparkSession, d: str, **how) -> EventLog:
    log = EventLog(spark, f"{scratch_dir(spark)}/log", **how)
    log.append_frame(table(spark, d, "events").select("event_id"), ["event_id"])
    return log


NUMBERED = 'SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS "offset" FROM events'


@query('SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS "offset" FROM nation')
def log_append_batch(spark, d):
    """Records of the driver, in several appends."""
    log = EventLog(spark, f"{scratch_dir(spark)}/log", segment_size=10)
    rows = [r.asDict() for r in _nations(spark, d).df.orderBy("n_nationkey").collect()]
    log.append(rows[0])
    log.append_batch(rows[1:7])
    log.append_batch(rows[7:])
    return log.frame().select("n_nationkey", "n_name", "offset")


@query(f'SELECT * FROM ({NUMBERED}) WHERE "offset" >= 400')
def log_truncated(spark, d):
    log = _log(spark, d, segment_size=200)
    log.truncate(599)
    return log.frame().select("event_id", "offset")


@query(f'SELECT * FROM ({NUMBERED}) WHERE "offset" >= 400 AND "offset" < 600')
def log_segment(spark, d):
    return _log(spark, d, segment_size=200).read_segment(2).select("event_id", "offset")


@query("SELECT COUNT(*) AS next, (COUNT(*) + 199) // 200 AS segments FROM events")
def log_counts(spark, d):
    log = _log(spark, d, segment_size=200)
    return spark.createDataFrame([(log.offset, log.segment_count)], "next long, segments long")


@query(NUMBERED)
def log_batches_once(spark, d):
    """A batch of a stream that comes again after a restart is not appended again."""
    path = f"{scratch_dir(spark)}/log"
    rows = table(spark, d, "events").select("event_id")
    half = rows.agg(F.median("event_id")).first()[0]
    for part, batch in ((rows.where(F.col("event_id") <= half), 0), (rows.where(F.col("event_id") > half), 1), (rows.where(F.col("event_id") > half), 1)):
        EventLog(spark, path).append_frame(part, ["event_id"], ("stream", batch))
    return EventLog(spark, path).frame().select("event_id", "offset")


def _view(spark: SparkSession, d: str) -> ServingView:
    view = ServingView(["user_id"], MergeView.combine_sum)
    batch, speed = _layers(spark, d)
    view.update_batch(batch)
    view.update_speed(speed)
    return view


@query(f"WITH {LAYERS} SELECT user_id, CAST(COALESCE(bv, 0) + COALESCE(sv, 0) AS BIGINT) AS value FROM m")
def serving_query_all(spark, d):
    return spark.createDataFrame(list(_view(spark, d).query_all().items()), "user_id long, value long")


@query(f"WITH {LAYERS} SELECT user_id, CAST(COALESCE(bv, 0) + COALESCE(sv, 0) AS BIGINT) AS value FROM m WHERE user_id IN (1, 2, 3)")
def serving_lookup(spark, d):
    """Single keys, from the copy that the driver holds."""
    view = _view(spark, d)
    view.hold()
    return spark.createDataFrame([(k, v) for k in (1, 2, 3) if (v := view.query(k)) is not None], "user_id long, value long")


@query("SELECT user_id, CAST(SUM(event_id) AS BIGINT) AS value FROM events GROUP BY 1")
def lambda_batch_only(spark, d):
    flow = LambdaFlow(lambda df: Pipeline(df).key_by("user_id").sum("event_id"), None, ["user_id"])
    return flow.execute_batch_only(table(spark, d, "events")).frame().select("user_id", "value")


@query("SELECT n_regionkey, COUNT(*) AS value FROM nation GROUP BY 1")
def kappa_append_to_log(spark, d):
    flow = KappaFlow(spark, lambda df: Pipeline(df).key_by("n_regionkey").count(), f"{scratch_dir(spark)}/log")
    for r in table(spark, d, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect():
        flow.append_to_log(r.asDict())
    return flow.replay_to_stream()


@query(NUMBERED)
def kappa_stream_logged(spark, d):
    """A stream's micro-batches go through the log."""
    base = scratch_dir(spark)
    flow = KappaFlow(spark, lambda df: df, f"{base}/log", order=["event_id"])
    flow.execute(_stream(spark, d).df.select("event_id"), f"{base}/cp").awaitTermination()
    return flow.replay().select("event_id", "offset")


def _by_type(df: DataFrame) -> DataFrame:
    return Pipeline(df).key_by("event_type").count()


@query("SELECT 'adaptive' AS how, event_type, COUNT(*) AS value FROM events GROUP BY 2 UNION ALL SELECT 'kappa', event_type, COUNT(*) FROM events GROUP BY 2 UNION ALL SELECT 'lambda', event_type, COUNT(*) FROM events GROUP BY 2")
def flow_architectures(spark, d):
    """One pipeline function in three architectures."""
    rows, flow = table(spark, d, "events").select("event_id", "event_type"), Flow("three", spark=spark)
    by_lambda = flow.as_lambda(_by_type, ["event_type"], MergeView.combine_sum).execute(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")).frame().select("event_type", "value")
    by_kappa = flow.as_kappa(_by_type, f"{scratch_dir(spark)}/log", ["event_id"]).execute(rows)
    by_adaptive = flow.as_adaptive(_by_type).execute(rows)
    parts = [x.select(F.lit(how).alias("how"), "event_type", F.col("value").cast("long").alias("value")) for how, x in (("lambda", by_lambda), ("kappa", by_kappa), ("adaptive", by_adaptive))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT event_id FROM events WHERE value > 50")
def adaptive_stream(spark, d):
    """A stream run by the adaptive mode: at its thickest level all there is comes as one batch."""
    base = scratch_dir(spark)
    flow = AdaptiveFlow(lambda df: df.where("value > 50").select("event_id"), viscosity=Viscosity.FROZEN)
    flow.run_stream(_stream(spark, d).df, lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out/{n}"), f"{base}/cp", rounds=60)
    return spark.read.option("recursiveFileLookup", True).parquet(f"{base}/out")


@query("SELECT * FROM (VALUES ('volatile', 'micro', 1, 0.01, 0.0, true, false), ('fluid', 'fine', 10, 0.1, 0.25, true, false), ('honeyed', 'medium', 100, 0.5, 0.5, false, false), ('sluggish', 'coarse', 1000, 2.0, 0.75, false, true), ('frozen', 'macro', 100000, 10.0, 1.0, false, true)) AS t(level, granularity, batch_size, batch_timeout, eta, flowing, solid)")
def adaptive_levels(spark, d):
    rows = [(v.value, GranularityLevel.of(v).value, v.batch_size, v.batch_timeout, v.eta, v.is_flowing, v.is_solid) for v in Viscosity]
    return spark.createDataFrame(rows, "level string, granularity string, batch_size int, batch_timeout double, eta double, flowing boolean, solid boolean")


@query("SELECT * FROM (VALUES (0, 'fluid'), (1, 'volatile'), (2, 'volatile'), (3, 'fluid'), (4, 'honeyed'), (5, 'sluggish'), (6, 'frozen')) AS t(step, level)")
def adaptive_controller(spark, d):
    """Three looks at an idle stream, four at a flooded one."""
    controller, out = ViscosityController(adjust_interval=0), []
    for step in range(7):
        controller.update_metrics(**(dict(arrival_rate=2, queue_depth=1, backlog_size=1) if step < 3 else dict(arrival_rate=5000, queue_depth=9000, backlog_size=90000)))
        out.append((step, controller.adjust().value))
    return spark.createDataFrame(out, "step int, level string")
