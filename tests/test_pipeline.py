"""Verbs, windows and delivery on small fixtures with known results."""

import sys
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weirflow.errors import PipelineError
from weirflow.functions.callables import Records, fold_global, guarded
from weirflow.operators import DeliveryMode, Pipeline, WindowType
from weirflow.plans.architectures import AdaptiveFlow, KappaFlow, LambdaFlow
from weirflow.plans.flow import ArchitectureMode, Flow, RuntimeMode
from weirflow.plans.prefix import numbered, ranged, running_sum
from weirflow.sources import CollectionSource, DatagenSource, FileSink, FileSource, GeneratorSource, KafkaSink, KafkaSource
from weirflow.streaming import LateRouter, WatermarkStrategy, WatermarkTracker
from weirflow.types import Field, FieldType, Schema


def pipe(spark, rows, schema=None):
    return Pipeline(CollectionSource(rows, schema).batch(spark))


def value(df):
    return [r["value"] for r in df.collect()]


def test_row_verbs(spark):
    ints = pipe(spark, list(range(10)), "value long")
    assert ints.map("value * 2").collect() == [2 * i for i in range(10)]
    assert ints.map(lambda x: x + 1, "long").collect() == list(range(1, 11))
    assert ints.filter("value % 2 = 0").collect() == [0, 2, 4, 6, 8]
    assert ints.filter(lambda x: x > 7).collect() == [8, 9]
    assert ints.flat_map(lambda x: [x] * (x % 3), "long").df.count() == 9
    assert ints.process(lambda x: None if x < 8 else [x, -x], "long").collect() == [8, -8, 9, -9]
    with pytest.raises(PipelineError):
        ints.map(lambda x: x)


def test_branches_do_not_share(spark):
    base = pipe(spark, [1, 2, 3], "value long")
    doubled, kept = base.map("value * 2"), base.filter("value > 2")
    assert (base.collect(), doubled.collect(), kept.collect()) == ([1, 2, 3], [2, 4, 6], [3])


def test_global_aggregates_of_nothing(spark):
    empty = pipe(spark, [], "value long")
    assert value(empty.sum()) == value(empty.min()) == value(empty.max()) == []
    assert value(empty.reduce(lambda a, b: a + b)) == []
    assert value(empty.count()) == [0]


def test_keyed_aggregates(spark):
    p = pipe(spark, [("Alice", 10), ("Bob", 20), ("Alice", 30), ("Bob", 15)], "k string, v long").key_by("k")
    assert dict(p.sum("v").collect()) == {"Alice": 40, "Bob": 35}
    assert dict(p.min("v").collect()) == {"Alice": 10, "Bob": 15}
    assert dict(p.reduce(lambda a, b: a * b, "v").collect()) == {"Alice": 300, "Bob": 300}
    assert dict(p.collect())["Alice"] == [{"v": 10}, {"v": 30}]
    assert dict(p.process_groups(lambda k, rs: [(k[0], max(r["v"] for r in rs))], "k string, top long").collect()) == {"Alice": 30, "Bob": 20}


def test_reduce_over_many(spark):
    assert value(Pipeline(spark.range(1, 10001).toDF("value")).reduce(lambda a, b: a + b)) == [50005000]


def test_tumbling(spark):
    p = pipe(spark, [(float(i), i) for i in range(20)], "ts double, val long")
    assert sorted(value(p.window(WindowType.tumbling(5, "ts")).count())) == [5, 5, 5, 5]
    assert value(p.window(WindowType.global_window()).sum("val")) == [190]
    assert value(p.window(WindowType.tumbling(5)).sum("val")) == [190]  # without a time field, one window


def test_sliding(spark):
    p = pipe(spark, [(1.0, 10), (5.0, 20), (7.0, 30), (10.0, 40)], "ts double, val long")
    got = p.window(WindowType.sliding(5, 2, "ts")).count().orderBy("window_start").collect()
    assert [r["value"] for r in got] == [1, 1, 1, 2, 2, 1, 1]
    assert got[0]["window_start"].timestamp() % 2 == 0


def test_sessions_merge_at_the_gap(spark):
    p = pipe(spark, [(1.0, 10), (2.0, 20), (10.0, 30), (11.0, 40)], "ts double, val long")
    assert sorted(value(p.window(WindowType.session(5, "ts")).sum("val"))) == [30, 70]
    q = pipe(spark, [(0.0, 1), (5.0, 1), (10.0, 1)], "ts double, val long")
    assert value(q.window(WindowType.session(5, "ts")).count()) == [3]
    spans = p.window(WindowType.session(5, "ts")).apply(lambda rs: [len(rs)], "long")
    assert sorted(r["value"] for r in spans.collect()) == [2, 2]


def test_window_functions_in_python(spark):
    p = pipe(spark, [(float(i), i) for i in range(10)], "ts double, val long")
    assert sorted(value(p.window(WindowType.tumbling(5, "ts")).aggregate(lambda rs: max(r["val"] for r in rs), "long"))) == [4, 9]
    assert sorted(value(p.window(WindowType.tumbling(5, "ts")).apply(lambda rs: [r["val"] for r in rs if r["val"] % 2], "long"))) == [1, 3, 5, 7, 9]


def test_properties_of_windows(spark):
    p = Pipeline(spark.range(500).select((F.col("id") * 7 % 301).cast("double").alias("ts"), (F.col("id") % 5).alias("k")))
    assert sum(value(p.window(WindowType.tumbling(10, "ts")).count())) == 500
    assert sum(value(p.window(WindowType.sliding(20, 5, "ts")).count())) == 2000
    assert sum(value(p.key_by("k").window(WindowType.session(3, "ts")).count())) == 500


def test_running(spark):
    p = pipe(spark, [(i, 1) for i in range(100)], "id long, v long")
    got = p.window(WindowType.over("id")).running("v").orderBy("id").collect()
    assert [r["value"] for r in got] == list(range(1, 101))
    assert p.window(WindowType.over("id")).running("id", "max").where("value <> id").count() == 0


def test_delivery(spark):
    p = pipe(spark, [1, 2, 3], "value long")

    def picky(x):
        if x == 2:
            raise ValueError(x)
        return x * 2

    assert p.with_delivery(DeliveryMode.AT_MOST_ONCE).map(picky, "long").collect() == [2, 6]
    with pytest.raises(Exception):
        p.with_delivery(DeliveryMode.AT_LEAST_ONCE, 1).map(picky, "long").collect()
    twice = pipe(spark, [1, 1, 2, 2, 3], "value long").exactly_once()
    assert sorted(twice.map("value * 2").collect()) == [2, 4, 6]


def test_tables_and_schemas(spark):
    p = pipe(spark, [("b", 2), ("a", 1), ("c", 3)], "name string, val long")
    assert [r["name"] for r in p.order_by("name").limit(2).collect()] == ["a", "b"]
    s = Schema.from_pairs([("val", FieldType.LONG), ("extra", FieldType.STRING)])
    assert p.to_table(s).order_by("val").collect()[0] == {"val": 1, "extra": None}
    with pytest.raises(PipelineError):
        p.to_table(None)
    nested = Schema((Field("tags", FieldType.ARRAY, element_type=FieldType.STRING), Field("m", FieldType.MAP, key_type=FieldType.STRING, value_type=FieldType.LONG), Field("r", FieldType.ROW, fields=(Field("x", FieldType.DATE),))))
    assert nested.to_struct().simpleString() == "struct<tags:array<string>,m:map<string,bigint>,r:struct<x:date>>"
    assert nested.column_count() == 3 and nested.get_field("m").name == "m" and nested.get_field("q") is None


def test_files(spark, tmp_path):
    p = pipe(spark, [("alice", 10), ("bob", 20)], "name string, v long")
    for fmt in ("json", "csv", "parquet", "orc"):
        path = str(tmp_path / fmt)
        p.sink_to(FileSink(path, fmt))
        p.sink_to(FileSink(path, fmt))  # overwrites
        got = FileSource(path, fmt, "name string, v long").batch(spark)
        assert sorted(map(tuple, got.collect())) == [("alice", 10), ("bob", 20)]
    (tmp_path / "one.json").write_text('[{"a": 1}, {"a": 2}]')
    assert FileSource(str(tmp_path / "one.json"), "json", multi_line=True).batch(spark).count() == 2
    with pytest.raises(PipelineError):
        FileSource(str(tmp_path / "none")).batch(spark)


def test_sources(spark):
    assert GeneratorSource(lambda: iter(range(100)), 5).batch(spark).count() == 5
    made = DatagenSource(fields={"value": FieldType.DOUBLE, "name": FieldType.STRING, "n": FieldType.INTEGER}, max_records=1000).batch(spark)
    assert made.count() == 1000 and made.where("value < 0 or value > 1000 or n > 1000 or name <> concat('value_', id)").count() == 0
    assert made.collect() == DatagenSource(fields={"value": FieldType.DOUBLE, "name": FieldType.STRING, "n": FieldType.INTEGER}, max_records=1000).batch(spark).repartition(3).orderBy("id").collect()
    assert KafkaSource("t", "h:1", "g").options(True) == {"kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "latest", "kafka.group.id": "g"}
    assert KafkaSink("t", key="k").shape(spark.createDataFrame([(1, "x")], "k int, v string")).first()["value"] == '{"k":1,"v":"x"}'


def test_flow(spark, tmp_path):
    flow = Flow("words", spark=spark)
    words = flow.from_collection(["hello world", "hello again"]).flat_map("split(value, ' ')")
    flow.sink(words.key_by(word="value").count(), name="counts")
    flow.sink(words, FileSink(str(tmp_path / "w"), "text"))
    assert {r["word"]: r["value"] for r in flow.execute()["counts"]} == {"hello": 2, "world": 1, "again": 1}
    assert "HashAggregate" in flow.explain()
    with pytest.raises(PipelineError):
        Flow("none", spark=spark).execute()


def test_streaming_flow(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a\nb\na\n")
    flow = Flow("lines", RuntimeMode.STREAMING, spark=spark)
    lines = flow.from_file(str(tmp_path / "in"), "text")
    assert lines.df.isStreaming
    assert sorted(lines.exactly_once().collect()) == ["a", "b"]


def test_watermarks():
    bounded = WatermarkTracker(WatermarkStrategy.bounded_out_of_orderness(3))
    for t in (10, 20, 30):
        bounded.on_event(t)
    assert bounded.current_watermark() == 27 and not bounded.is_late(25) and bounded.is_late(5)
    strict = WatermarkTracker(WatermarkStrategy.bounded_out_of_orderness(3), strict=True)
    strict.on_event(30)
    assert strict.is_late(25)
    two = WatermarkTracker(WatermarkStrategy.bounded_out_of_orderness(2))
    assert [two.on_event(t).timestamp for t in (10, 15)] == [8, 13]


def test_late_rows_go_aside(spark, tmp_path):
    on_time, late = [], []
    keep = lambda held: lambda df, _: held.extend(r["v"] for r in df.collect())
    note = str(tmp_path / "largest.json")
    router = LateRouter("ts", 10, keep(on_time), keep(late), note)
    batches = [[(100, 1)], [(95, 2), (80, 3), (120, 4)], [(111, 5), (109, 6)]]
    for n, rows in enumerate(batches):
        router(spark.createDataFrame(rows, "ts long, v long").withColumn("ts", F.timestamp_seconds("ts")), n)
    assert (sorted(on_time), sorted(late), router.records_late) == ([1, 2, 4, 5], [3, 6], 2)
    again = LateRouter("ts", 10, keep(on_time), keep(late), note)  # after a restart the largest time is known
    again(spark.createDataFrame([(90, 7), (130, 8)], "ts long, v long").withColumn("ts", F.timestamp_seconds("ts")), 3)
    assert late[-1] == 7 and on_time[-1] == 8 and again.largest == 130


def test_late_rows_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, rows in enumerate(["{\"ts\": 100}", "{\"ts\": 50}\n{\"ts\": 101}"]):
        (tmp_path / "in" / f"{n}.json").write_text(rows)
        import os
        os.utime(tmp_path / "in" / f"{n}.json", (1000 + n, 1000 + n))
    late = []
    df = spark.readStream.schema("ts long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("ts"))
    router = LateRouter("ts", 10, lambda df, n: None, lambda df, n: late.append(df.count()))
    df.writeStream.foreachBatch(router).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert late == [1]


def test_one_pipeline_in_all_architectures(spark, tmp_path):
    layer = lambda df: Pipeline(df).key_by("k").sum("v")
    rows = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v long")
    flow = Flow("f", spark=spark)
    assert isinstance(flow.in_architecture(ArchitectureMode.LAMBDA, layer, keys=["k"]), LambdaFlow)
    assert isinstance(flow.in_architecture(ArchitectureMode.ADAPTIVE, layer), AdaptiveFlow)
    assert flow.in_architecture(ArchitectureMode.SIMPLE, layer) is flow
    kappa = flow.as_kappa(layer, str(tmp_path / "log"), order=["v"])
    assert isinstance(kappa, KappaFlow)
    assert layer(rows).collect() == kappa.execute(rows).collect() == kappa.replay_to_stream().collect() == flow.as_adaptive(layer).execute(rows).collect()
    assert flow.as_lambda(layer, ["k"]).execute(rows, rows).query("a") == 3


def test_socket_source_and_sink(spark, tmp_path):
    import socket
    import threading
    import time

    from weirflow.sources import SocketSink, SocketSource

    server = socket.create_server(("127.0.0.1", 0))
    got = []

    def take():
        link, _ = server.accept()
        with link:
            got.append(link.makefile().read())

    taker = threading.Thread(target=take)
    taker.start()
    SocketSink("127.0.0.1", server.getsockname()[1]).write(spark.createDataFrame([(1, "x")], "a int, b string").coalesce(1))
    taker.join(20)
    assert got == ['{"a": 1, "b": "x"}\n']

    def give():
        link, _ = server.accept()
        link.sendall("eins|zwei||drei|".encode())
        time.sleep(20)

    threading.Thread(target=give, daemon=True).start()
    df = SocketSource("127.0.0.1", server.getsockname()[1], "|").stream(spark)
    query = df.writeStream.format("memory").queryName("from_socket").option("checkpointLocation", str(tmp_path / "cp")).start()
    until = time.time() + 20
    while spark.table("from_socket").count() < 3 and time.time() < until:
        time.sleep(0.3)
    query.stop()
    assert sorted(r["value"] for r in spark.table("from_socket").collect()) == ["drei", "eins", "zwei"]


def test_kafka_end_to_end(spark, tmp_path):
    """The Kafka source and sink against a broker of the same shape."""
    from broker import FolderBroker

    from weirflow.sources import KafkaSink, KafkaSource

    spark.dataSource.register(FolderBroker)
    at = {"bootstrap_servers": str(tmp_path / "broker"), "fmt": FolderBroker.name()}
    rows = spark.createDataFrame([("a", 1), ("b", None)], "k string, v long")
    assert Pipeline(rows).sink_to(KafkaSink("t", key="k", **at)) is None
    KafkaSink("t", **at).write(spark.createDataFrame([("plain",)], "value string"))
    got = {(r["key"], r["value"]) for r in KafkaSource("t", **at).batch(spark).collect()}
    assert got == {("a", '{"k":"a","v":1}'), ("b", '{"k":"b"}'), (None, "plain")}
    parsed = KafkaSource("t", schema="k string, v long", **at).batch(spark).where("k is not null")
    assert {(r["k"], r["v"], r["key"]) for r in parsed.collect()} == {("a", 1, "a"), ("b", None, "b")}
    stream = Flow("f", RuntimeMode.STREAMING, spark=spark).from_source(KafkaSource("t", start_from="earliest", schema="k string, v long", **at))
    query = stream.filter("v = 1").select("k", "v").sink_to(KafkaSink("out", key="k", **at), checkpoint=str(tmp_path / "cp"), trigger={"processingTime": "100 milliseconds"})
    until = time.time() + 60
    while KafkaSource("out", **at).batch(spark).count() < 1 and time.time() < until:
        time.sleep(0.5)
    query.stop()
    assert [r["value"] for r in KafkaSource("out", **at).batch(spark).collect()] == ['{"k":"a","v":1}']


def test_print_callback_and_insert_into(spark, tmp_path, capfd):
    rows = Pipeline(spark.createDataFrame([(1, "x"), (2, None)], "a int, b string"))
    rows.print()
    out = capfd.readouterr().out
    assert "|1  |x   |" in out and "|2  |NULL|" in out
    got = []
    rows.for_each(got.append)
    assert got == [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    rows.insert_into(FileSink(str(tmp_path / "json"), "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text('{"a": 3}\n')
    stream = Pipeline(spark.readStream.schema("a int").json(str(tmp_path / "in")))
    stream.for_each(got.append).awaitTermination()
    assert got[-1] in ({"a": 3}, 3)
    stream.insert_into(FileSink(str(tmp_path / "out"), "parquet")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_folds_keep_order_and_partitions(spark):
    frame = spark.range(0, 1000, numPartitions=40).selectExpr("id", "cast(id as string) as s", "id % 3 as k")
    assert fold_global(frame, lambda a, b: a + b, "id", fan_in=4).collect() == [(499500,)]
    assert fold_global(frame.where("id < 100"), lambda a, b: f"{a},{b}", "s", fan_in=4).first()[0] == ",".join(map(str, range(100)))
    assert fold_global(frame.limit(0), lambda a, b: a, "id").count() == 0
    got = dict(Pipeline(frame).key_by("k").reduce(lambda a, b: a + b, "id", associative=True).collect())
    assert got == {k: sum(range(k, 1000, 3)) for k in range(3)}
    plan = fold_global(frame, max, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan


def test_global_orders_need_no_single_task(spark):
    rows = [(i * 37 % 500 if i % 5 else None, i) for i in range(1500)] + [(7, 2000 + i) for i in range(400)]  # a hot value, and nulls
    frame = spark.createDataFrame(rows, "t long, id long").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = {r["id"]: r["offset"] for r in numbered(frame, ["t", "id"], start=10).collect()}
    assert got == {r[1]: 10 + k for k, r in enumerate(order)}
    held = ranged(frame, ["t", "id"], 8).groupBy("__range").count().collect()
    assert len(held) == 8 and max(r["count"] for r in held) < 2 * len(rows) / 8  # the hot value is split, too
    total, want = 0, {}
    for _, i in order:
        total += i
        want[i] = total
    run = running_sum(frame, ["t", "id"], "id")
    assert {r["id"]: r["value"] for r in run.collect()} == want
    assert "SinglePartition" not in run._jdf.queryExecution().executedPlan().toString()
    names = spark.createDataFrame([(x,) for x in "delta alpha bravo charlie".split()], "s string")
    assert [tuple(r) for r in numbered(names, ["s"], "n").orderBy("n").collect()] == [("alpha", 0), ("bravo", 1), ("charlie", 2), ("delta", 3)]


@pytest.mark.parametrize("seed, gap", [(1, 3), (2, 10), (3, 40), (4, 100000)])
def test_global_sessions_over_ranges(spark, seed, gap):
    import random

    rng = random.Random(seed)
    times = [rng.choice((rng.randrange(3000), rng.randrange(40) * 100)) for _ in range(400)] + [None, 17, 17]
    frame = spark.createDataFrame([(t, k) for k, t in enumerate(times)], "t long, v long").repartition(3)
    got = Pipeline(frame).window(WindowType.session(gap, "t")).aggregate(F.count("*"))
    rows = sorted((r["window_start"].timestamp(), r["window_end"].timestamp(), r["value"]) for r in got.collect())
    want = []
    for t in sorted(x for x in times if x is not None):
        if want and t <= want[-1][1]:
            want[-1] = (want[-1][0], t + gap, want[-1][2] + 1)
        else:
            want.append((t, t + gap, 1))
    assert rows == want
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert Pipeline(frame.limit(0)).window(WindowType.session(gap, "t")).count().count() == 0


def test_records_of_a_group_are_read_from_a_file(spark):
    batches = [pa.RecordBatch.from_pydict({"w": [0] * n, "i": list(range(at, at + n))}) for at, n in ((0, 5000), (5000, 0), (5000, 1), (5001, 9000))]
    for kept in (0, 60_000, 1 << 24):
        held = Records(iter(batches), ["w"], kept)
        assert len(held) == 14001 and held == [{"i": i} for i in range(14001)] and [r["i"] for r in held] == list(range(14001))
        assert held[-1] == {"i": 14000} and held[4095:4097] == [{"i": 4095}, {"i": 4096}] and {"i": 5000} in held and held[::7000] == [{"i": 0}, {"i": 7000}, {"i": 14000}]
        assert [(a["i"], b["i"]) for a, b in zip(held, reversed(held))][:2] == [(0, 14000), (1, 13999)] and bool(held._stored) == (kept < 1 << 24)
        with pytest.raises(IndexError):
            held[14001]
    assert list(Records([pa.RecordBatch.from_pydict({"value": [1, 2]})])) == [1, 2] and not Records([])


def test_a_large_group_is_not_in_memory(spark):
    """A function sees few more objects than a worker has anyway: no record of 400,000 stays."""
    rows = spark.range(400_000).select(F.lit(1.0).alias("ts"), F.lit("a").alias("k"), "id")

    def seen(records):
        return [max(sys.getallocatedblocks() for i, r in enumerate(records) if i % 20_000 == 0), sum(r["id"] for r in records), len(records)]

    for got in (
        Pipeline(rows).window(WindowType.tumbling(5, "ts")).apply(seen, "long"),
        Pipeline(rows).window(WindowType.session(5, "ts")).apply(seen, "long"),
        Pipeline(rows).window(WindowType.global_window()).apply(seen, "long"),
        Pipeline(rows).key_by("k").process_groups(lambda key, rs: seen(rs), "value long"),
    ):
        blocks, *found = [r["value"] for r in got.collect()]
        assert blocks < 900_000 and found == [400_000 * 399_999 // 2, 400_000]


def test_failing_records_wait_together(spark):
    class FailsTwice:
        def __init__(self):
            self.tried = {}

        def __call__(self, x):
            self.tried[x] = self.tried.get(x, 0) + 1
            if x % 2 and self.tried[x] < 3:
                raise OSError(x)
            return [x, -x] if x % 3 else []

    f, began = FailsTwice(), time.perf_counter()
    assert guarded(f, "retry", 2)(list(range(2000))) == [[x, -x] if x % 3 else [] for x in range(2000)]
    assert time.perf_counter() - began < 5 and set(f.tried.values()) == {1, 3}
    with pytest.raises(OSError):
        guarded(FailsTwice(), "retry", 1)([2, 3, 4])
    f = FailsTwice()
    assert guarded(f, "skip", 3)([1, 2, 4]) == [[], [2, -2], [4, -4]] and f.tried == {1: 1, 2: 1, 4: 1}
    f = FailsTwice()
    with pytest.raises(OSError):
        guarded(f, "raise", 3)([2, 1, 4])
    assert f.tried == {2: 1, 1: 1}
    began = time.perf_counter()
    made = Pipeline(spark.range(4000).toDF("value").coalesce(1)).flat_map(FailsTwice(), "long")
    assert made.collect() == [y for x in range(4000) if x % 3 for y in (x, -x)] and time.perf_counter() - began < 20
