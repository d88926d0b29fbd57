"""Keyed state, timers, the event log, serving views, architectures, adaptive control."""

import random
import time

import pytest
from pyspark.sql import functions as F

from weirflow.errors import PipelineError
from weirflow.operators import EventLog, MergeView, Pipeline, ServingView
from weirflow.operators.eventlog import latest_by_key
from weirflow.plans.architectures import AdaptiveFlow, KappaFlow, LambdaFlow
from weirflow.streaming import AggregatingState, FlowMetrics, GranularityLevel, GranularityPolicy, JsonFileStateBackend, KeyedProcessFunction, ListState, MapState, ReducingState, StateConfig, ValueState, Viscosity, ViscosityController, ViscosityPolicy
from weirflow.streaming.state import drive_keyed
from weirflow.streaming.viscosity import place


class Running(KeyedProcessFunction):
    config = None

    def open(self, context):
        context.value_state("n", 0, self.config)

    def process_element(self, value, context):
        n = context.value_state("n", 0, self.config)
        n.update(n.value() + 1)
        return (value["k"], n.value())


class Expiring(Running):
    config = StateConfig(ttl=3600)


class Alarm(KeyedProcessFunction):
    def process_element(self, value, context):
        context.timer_service.register(value["ts"] + 10)

    def on_timer(self, timestamp, context):
        return (context.current_key, timestamp)


def test_keyed_state(spark):
    rows = [("a", 1), ("b", 2), ("a", 3), ("b", 4), ("a", 5)]
    got = Pipeline(spark.createDataFrame(rows, "k string, v long")).key_by("k").process_keyed(Running, "k string, n long", "append")
    want = [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)]
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(drive_keyed([{"k": k, "v": v} for k, v in rows], lambda r: r["k"], Running())) == want


def test_state_over_micro_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text('{"k": "a"}\n{"k": "a"}\n')
    df = spark.readStream.schema("k string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = Pipeline(df).key_by("k").process_keyed(Expiring, "k string, n long", "append", "processingTime")
    # by processing time there is always another batch to come: stop when the rows are there
    query = out.writeStream.format("memory").queryName("running_counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    until = time.time() + 60
    while spark.table("running_counts").count() < 6 and time.time() < until:
        time.sleep(0.5)
    query.stop()
    assert sorted(r["n"] for r in spark.table("running_counts").collect()) == [1, 2, 3, 4, 5, 6]


def test_timers_fire_in_order():
    rows = [{"k": "a", "ts": t} for t in (5, 10, 15, 50)]
    assert drive_keyed(rows, lambda r: r["k"], Alarm(), lambda r: r["ts"]) == [("a", 15), ("a", 20), ("a", 25)]


def test_state_primitives():
    v, items, m = ValueState(default=7), ListState(), MapState()
    assert v.value() == 7
    v.update({"x": 1})
    assert v.value() == {"x": 1}
    v.clear()
    assert v.value() == 7
    items.add(1)
    items.add("b")
    assert list(items) == [1, "b"] and len(items) == 2
    items.replace([])
    assert items.get() == []
    m.put("a", 1)
    m.put("b", None)
    assert m.items() == [("a", 1), ("b", None)] and m.contains("b") and m.get("c", 0) == 0
    m.remove("a")
    assert m.keys() == ["b"]
    r = ReducingState(lambda a, b: a + b)
    for x in (1, 2, 3):
        r.add(x)
    assert r.get() == 6
    a = AggregatingState(lambda acc, x: [acc[0] + x, acc[1] + 1], lambda: [0, 0], lambda acc: acc[0] / acc[1])
    assert a.get() is None
    a.add(1)
    a.add(2)
    assert a.get() == 1.5


def test_backends(tmp_path):
    one = JsonFileStateBackend(str(tmp_path))
    one.set("value", "k", "n", 3)
    one.set("list", ("a", 1), "l", [1, 2])
    one.save("s")
    two = JsonFileStateBackend(str(tmp_path))
    assert two.load("s") and two.get("value", "k", "n") == 3 and two.get("list", ("a", 1), "l") == [1, 2]
    assert not two.load("other")


def test_event_log(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"), segment_size=5)
    assert log.append({"i": 0}) == 0
    assert log.append_batch([{"i": i} for i in range(1, 20)]) == list(range(1, 20))
    assert [r["i"] for r in log.read(5, 3).collect()] == [5, 6, 7]
    assert log.offset == 20 and log.segment_count == 4 and log.read_segment(1).count() == 5
    assert log.truncate(12) == 2 and [r["i"] for r in log.read().collect()] == list(range(10, 20))
    log.truncate(100)
    assert log.append({"i": 20}) == 20  # offsets are never given twice
    start, end = log.append_frame(spark.range(7).toDF("i"), ["i"])
    assert (start, end) == (21, 28) and [r["i"] for r in log.read(21).collect()] == list(range(7))


def test_compaction(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"), segment_size=100)
    log.append_frame(spark.range(1000).select((F.col("id") % 100).alias("key"), F.floor(F.col("id") / 100).alias("version"), "id"), ["id"])
    log.compact(latest_by_key("key"), 1000)
    assert log.frame().count() == 100 and log.frame().where("version <> 9").count() == 0 and log.offset == 1000
    with pytest.raises(PipelineError):
        EventLog(spark, str(tmp_path / "none")).read()


def test_log_survives_crashes(spark, tmp_path):
    path = str(tmp_path / "log")
    log = EventLog(spark, path, segment_size=4)
    log.append_batch([{"i": i} for i in range(6)])
    # files of an append that was never committed are not seen, and its offsets come again
    spark.range(3).selectExpr("id as i", "id + 6 as offset", "1 as segment").write.partitionBy("segment").parquet(f"{path}/_staged-lost")
    assert EventLog(spark, path, 4).offset == 6 and EventLog(spark, path, 4).frame().count() == 6
    assert log.append({"i": 6}) == 6
    # one that was committed but whose files were not moved is finished by whoever opens the log
    other = EventLog(spark, path, 4)
    other._settle = lambda staged: None
    other.append_batch([{"i": 7}, {"i": 8}])
    again = EventLog(spark, path, 4)
    assert [r["i"] for r in again.read().collect()] == list(range(9)) and again.offset == 9
    assert [r["i"] for r in EventLog(spark, path, 4).read().collect()] == list(range(9))
    # a compaction that was not committed changes nothing
    broken = EventLog(spark, path, 4)
    broken._file.save = lambda state: 1 / 0
    with pytest.raises(ZeroDivisionError):
        broken.compact(lambda df: df.where("offset % 2 = 0"), 6)
    assert EventLog(spark, path, 4).frame().count() == 9
    log.compact(lambda df: df.where("offset % 2 = 0"), 6)
    assert [r["offset"] for r in log.read().collect()] == [0, 2, 4, 6, 7, 8]
    log.compact(lambda df: df.where("offset % 4 = 0"), 8)  # over the one before
    assert [r["offset"] for r in log.read().collect()] == [0, 4, 8] and [r["i"] for r in log.read(4, 1).collect()] == [4]
    assert log.truncate(4) == 1 and [r["offset"] for r in log.read().collect()] == [4, 8]
    assert log.truncate(8) == 1 and [r["offset"] for r in log.read().collect()] == [8] and log.append({"i": 9, "new": "x"}) == 9
    assert [(r["i"], r["new"]) for r in log.read().collect()] == [(8, None), (9, "x")]
    # a torn state file is one that isn't there
    assert not [n for n in log.folder.names("_state") if n.startswith("_part")]


def test_log_lookups_need_no_job(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"))
    log.append({"i": 0})
    spark.sparkContext.setJobGroup("quiet", "no job")
    began = time.perf_counter()
    for k in range(5):
        log.append_batch([{"i": k, "tags": {"a": "b"}, "many": [1, 2]}])
    assert log.offset == 6 and (time.perf_counter() - began) < 10
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("quiet")
    with pytest.raises(PipelineError):
        log.append({"i": "text"})
    with pytest.raises(PipelineError):
        log.append_frame(spark.range(2).selectExpr("cast(id as string) as i"), ["i"])
    assert log.offset == 6
    spark.sparkContext.setJobGroup("loud", "jobs")
    assert [r["tags"] for r in log.read(1).collect()] == [{"a": "b"}] * 5


def test_kappa_stream_is_logged_once_over_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = lambda name, ids: (tmp_path / "in" / name).write_text("".join(f'{{"key": "a", "v": {i}}}\n' for i in ids))
    rows("0.json", range(5))
    df = spark.readStream.schema("key string, v long").json(str(tmp_path / "in"))
    run = lambda: KappaFlow(spark, lambda x: x, str(tmp_path / "log"), order=["v"]).execute(df, str(tmp_path / "cp")).awaitTermination()
    run()
    rows("1.json", range(5, 9))
    run()
    # the query forgets that its last batch was done, as after a crash before its commit
    (last,) = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1:]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert sorted(r["v"] for r in KappaFlow(spark, lambda x: x, str(tmp_path / "log")).replay().collect()) == list(range(9))


def test_serving_times_and_lookups(spark):
    view = ServingView(["key"], MergeView.latest)
    frame = lambda rows: spark.createDataFrame(rows, "key string, value long")
    assert view.last_batch_time == view.last_speed_time == 0 and view.hold() and view.query("a") is None
    before = time.time()
    view.update_batch(frame([("a", 1), ("b", None)]))
    assert before <= view.last_batch_time <= time.time() and view.last_speed_time == 0
    assert view.query("a") == 1 and view.hold() and view.query("a") == 1 and view.query("b") is None
    began = time.perf_counter()
    for _ in range(1000):
        view.query("a")
    assert time.perf_counter() - began < 1  # a lookup takes less than a millisecond
    view.update_speed(frame([("a", 2)]))  # the copy is gone with the update
    assert view.query("a") == 2 and view.last_speed_time >= view.last_batch_time
    assert not view.hold(at_most=1) and view.query("a") == 2


def test_serving(spark):
    view = ServingView(["key"], MergeView.combine_sum)
    frame = lambda rows: spark.createDataFrame(rows, "key string, value long")
    assert view.query("a") is None and view.query_all() == {}
    view.update_batch(frame([("a", 10), ("b", 1)]))
    view.update_batch(frame([("a", 5)]))
    view.update_speed(frame([("a", 1), ("c", 3)]))
    assert view.query_all() == {"a": 16, "b": 1, "c": 3} and view.query("c") == 3
    view.clear()
    assert view.query_all() == {}


def test_lambda_and_kappa(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, v long")
    layer = lambda df: Pipeline(df).key_by("key").sum("v")
    seen = []
    flow = LambdaFlow(layer, layer, ["key"], MergeView.combine_sum).on_speed_result(seen.append)
    flow.execute(rows, rows.limit(0).union(rows))
    assert flow.query_all() == {"a": 6, "b": 6} and len(seen) == 1
    with pytest.raises(PipelineError):
        LambdaFlow(None, layer).execute_batch_only(rows)
    kappa = KappaFlow(spark, layer, str(tmp_path / "log"), order=["v"], keys=["key"])
    kappa.execute(rows)
    kappa.append_to_log({"key": "b", "v": 4})
    assert dict(kappa.replay_to_stream().collect()) == {"a": 3, "b": 7}
    assert dict(kappa.replay_to_stream(1, 2).collect()) == {"a": 2, "b": 3}
    with pytest.raises(PipelineError):
        KappaFlow(spark, layer).replay()


def test_kappa_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v long")
    rows.write.json(str(tmp_path / "in"))
    df = spark.readStream.schema("key string, v long").json(str(tmp_path / "in"))
    kappa = KappaFlow(spark, lambda x: x, str(tmp_path / "log"), order=["v"])
    kappa.execute(df, str(tmp_path / "cp")).awaitTermination()
    assert kappa.replay().count() == 2


V = Viscosity


@pytest.mark.parametrize(
    "policy, start, metrics, thresholds, end",
    [
        (ViscosityPolicy.BALANCED, V.HONEYED, dict(arrival_rate=5, queue_depth=3, backlog_size=10), None, V.FLUID),
        (ViscosityPolicy.BALANCED, V.HONEYED, dict(arrival_rate=500, queue_depth=2000, backlog_size=5000), None, V.HONEYED),
        (ViscosityPolicy.BALANCED, V.HONEYED, dict(arrival_rate=50000, queue_depth=8000, backlog_size=20000), None, V.SLUGGISH),
        (ViscosityPolicy.BALANCED, V.FLUID, dict(arrival_rate=5000, queue_depth=8000, backlog_size=15000, processing_latency_ms=5), None, V.HONEYED),
        (ViscosityPolicy.BALANCED, V.HONEYED, dict(arrival_rate=5000, queue_depth=5, backlog_size=5), None, V.HONEYED),
        (ViscosityPolicy.BALANCED, V.HONEYED, dict(arrival_rate=1, queue_depth=5, backlog_size=20000, processing_latency_ms=600), None, V.SLUGGISH),  # triggers that don't keep up
        (ViscosityPolicy.BALANCED, V.FROZEN, dict(error_rate=0.5, arrival_rate=1, queue_depth=2, backlog_size=5), None, V.SLUGGISH),
        (ViscosityPolicy.EFFICIENT, V.HONEYED, dict(arrival_rate=600, queue_depth=3000, backlog_size=6000), None, V.FROZEN),
        (ViscosityPolicy.EFFICIENT, V.VOLATILE, dict(arrival_rate=200, queue_depth=300, backlog_size=600), dict(high_arrival_rate=100, high_queue_depth=200, high_backlog=500), V.HONEYED),
        (ViscosityPolicy.EFFICIENT, V.FROZEN, dict(arrival_rate=1, queue_depth=1, backlog_size=1), None, V.FROZEN),
        (ViscosityPolicy.EFFICIENT, V.SLUGGISH, dict(error_rate=0.5), None, V.HONEYED),
        (ViscosityPolicy.RESPONSIVE, V.HONEYED, dict(processing_latency_ms=600, backlog_size=20000, error_rate=0.2), None, V.HONEYED),
        (ViscosityPolicy.RESPONSIVE, V.SLUGGISH, dict(arrival_rate=1, queue_depth=1, backlog_size=1, processing_latency_ms=1), None, V.FLUID),
        (ViscosityPolicy.MANUAL, V.FLUID, dict(arrival_rate=999999, queue_depth=999999, backlog_size=999999, error_rate=0.9), None, V.FLUID),
    ],
)
def test_controller_moves(policy, start, metrics, thresholds, end):
    c = ViscosityController(start, policy, adjust_interval=0, thresholds=thresholds)
    c.update_metrics(**metrics)
    assert c.adjust() is end


def test_controller():
    changes, now = [], [0.0]
    c = ViscosityController(on_change=lambda a, b: changes.append((a, b)), max_viscosity=V.SLUGGISH, clock=lambda: now[0])
    c.freeze()
    assert c.level is V.SLUGGISH and changes == [(V.HONEYED, V.SLUGGISH)] and c.adjustments_count == 1
    c.set_viscosity("micro")
    assert c.granularity is GranularityLevel.MICRO and c.batch_size == 1
    with pytest.raises(ValueError):
        c.set_viscosity("thick")
    with pytest.raises(ValueError):
        c.set_viscosity(3)
    c.update_metrics(arrival_rate=50000, queue_depth=8000, backlog_size=20000)
    assert c.adjust() is V.FLUID and c.adjust() is V.FLUID  # not twice within the interval
    now[0] = 2.0
    assert c.adjust() is V.HONEYED and "eta 0.50" in c.explain()
    assert [x.batch_size for x in V] == [1, 10, 100, 1000, 100000] and [x.eta for x in V] == [0, 0.25, 0.5, 0.75, 1]
    assert V.VOLATILE < V.FROZEN and V.FLUID.is_flowing and V.FROZEN.is_solid and not V.HONEYED.is_solid
    m = FlowMetrics(arrival_rate=100, backlog_size=200, processing_latency_ms=50)
    assert m.shear_rate == 100 and m.shear_stress == 2.05 and abs(m.measured_viscosity - 2.05 / 3.05) < 1e-9
    assert FlowMetrics().shear_stress == FlowMetrics().measured_viscosity == 0 and FlowMetrics().utilisation is None
    assert m.snapshot().keys() >= {"arrival_rate", "shear_rate", "shear_stress", "measured_viscosity"}


def test_controller_reads_progress():
    progress = {"inputRowsPerSecond": 500.0, "processedRowsPerSecond": 200.0, "durationMs": {"triggerExecution": 300}, "numInputRows": 100, "sources": [{"metrics": {"maxOffsetsBehindLatest": "700"}}]}
    c = ViscosityController(V.FLUID, adjust_interval=0, on_change=lambda a, b: 1 / 0)  # a listener's failure is its own
    c.update_from_progress(progress)
    assert c.metrics.backlog_size == 700 and c.metrics.utilisation == 2.5 and c.pressure() == 1
    assert c.adjust() is V.HONEYED and c.history[0]["from"] == "fluid" and c.history[0]["metrics"]["arrival_rate"] == 500
    assert c.adjust() is V.SLUGGISH  # rows still come faster than they go
    c.update_from_progress(progress | {"processedRowsPerSecond": 2000.0})
    assert c.pressure() == 0 and c.adjust() is V.SLUGGISH
    for _ in range(1200):
        c.thaw()
        c.freeze()
    assert len(c.history) == 1000 and c.adjustments_count > 2000


@pytest.mark.parametrize("x, at", [(0, 0), (10, 0), (100, 0.5), (1000, 1), (10**6, 1)])
def test_places_are_logarithmic(x, at):
    assert abs(place(x, 10, 1000) - at) < 1e-9


def test_adaptive(spark, tmp_path):
    flow = AdaptiveFlow(lambda df: df.where("v > 0"), policy=GranularityPolicy.THROUGHPUT, initial_granularity=GranularityLevel.COARSE)
    assert flow.controller.policy is ViscosityPolicy.EFFICIENT and flow.controller.level is V.SLUGGISH
    rows = spark.createDataFrame([(i - 2,) for i in range(10)], "v long")
    assert flow.execute_batch_like(rows).count() == flow.execute_stream_like(rows).count() == 7
    rows.write.parquet(str(tmp_path / "in"))
    got = []
    flow.set_viscosity(V.FROZEN)
    levels = flow.run_stream(spark.readStream.schema("v long").parquet(str(tmp_path / "in")), lambda df, n: got.append(df.count()), str(tmp_path / "cp"), seconds=20, rounds=3)
    assert levels[0] is V.FROZEN and sum(got) == 7


def _files(tmp_path):
    return sorted((tmp_path / "log" / "live").rglob("*.parquet"))


def test_small_segments_share_folders(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"), segment_size=2)
    log.append_frame(spark.range(3000).toDF("i"), ["i"])
    assert log.append_batch([{"i": i} for i in range(3000, 4001)]) == list(range(3000, 4001))
    assert len(_files(tmp_path)) <= 9 and log.segment_count == 2001  # a file each of 2001 segments before
    assert [(r["i"], r["offset"], r["segment"]) for r in log.frame().orderBy("offset").collect()] == [(i, i, i // 2) for i in range(4001)]
    assert log.truncate(1001) == 500 and log.segment_count == 1501 and log.frame().count() == 3001 and log.read(0, 1).first()["offset"] == 1000
    assert log.truncate(9000) == 1501 and log.segment_count == 0 and log.frame().count() == 0 and not _files(tmp_path)
    assert log.append({"i": 7}) == 4001 and log.segment_count == 1 and [r["offset"] for r in log.read().collect()] == [4001]
    # a log whose segments have a folder each, as written before
    old = EventLog(spark, str(tmp_path / "old"), segment_size=2)
    old.span = 1
    old.append_batch([{"i": i} for i in range(7)])
    new = EventLog(spark, str(tmp_path / "old"), segment_size=2)
    assert new.append({"i": 7}) == 7 and [r["i"] for r in new.read(3).collect()] == [3, 4, 5, 6, 7] and [r["i"] for r in new.read_segment(3).collect()] == [6, 7]
    assert new.truncate(5) == 2 and [r["i"] for r in new.read().collect()] == [4, 5, 6, 7] and new.segment_count == 2


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_log_against_a_model(spark, tmp_path, span):
    size, turn = 4, random.Random(span)
    log, live, old, n, start, floor = EventLog(spark, str(tmp_path / "log"), segment_size=size), {}, {}, 0, 0, 0
    log.span = span
    for step in range(16):
        do = turn.choice(["rows", "rows", "frame", "truncate", "compact"]) if step else "rows"
        at = turn.randrange(n + 1)
        if do in ("rows", "frame"):
            new = list(range(n, n + turn.randrange(1, 14)))
            got = log.append_batch([{"i": i} for i in new]) if do == "rows" else list(range(*log.append_frame(spark.createDataFrame([(i,) for i in new], "i long"), ["i"])))
            assert got == new
            live |= dict.fromkeys(new)
            n += len(new)
        elif do == "truncate":
            floor = max(floor, at // size * size)
            kept, under = {i for i in old if i >= floor}, {i // size for i in old if i < min(floor, start)}
            gone = {i // size for i in live if (i // size + 1) * size <= at // size * size}
            assert log.truncate(at) == len(gone) + len(under)
            live, old = {i: None for i in live if i >= floor}, dict.fromkeys(kept)
            if floor >= start:
                old, start = {}, start if not old else start
        else:
            at = max(at, start)
            log.compact(lambda df: df.where("offset % 3 = 0"), at)
            merged = {i: None for i in [*live, *old] if i < at and i % 3 == 0}
            start = at
            live, old = {i: None for i in live if i >= start}, merged
        assert [(r["i"], r["offset"]) for r in log.read().collect()] == [(i, i) for i in sorted([*live, *old])], (step, do, at)
        assert log.offset == n and [r["i"] for r in log.read_segment(at // size).collect()] == [i for i in sorted([*live, *old]) if i // size == at // size]
        assert log.segment_count == len({i // size for i in live}) + (log._state()["compacted"] is not None)


def test_a_segment_is_read_from_its_folder(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"), segment_size=2)
    log.span = 50
    log.append_frame(spark.range(1000).toDF("i"), ["i"])
    folders = sorted((tmp_path / "log" / "live").iterdir())
    assert len(folders) == 10  # of 500 segments
    for folder in folders:
        if folder.name != "segment=100":
            for file in folder.glob("*.parquet"):  # opening one of these fails
                file.write_bytes(b"none")
                (folder / f".{file.name}.crc").unlink(missing_ok=True)
    assert [[r["i"] for r in log.read_segment(k).collect()] for k in (100, 120, 149)] == [[200, 201], [240, 241], [298, 299]]
    with pytest.raises(Exception):
        log.read_segment(99).collect()


def test_segments_are_counted_from_the_state(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"), segment_size=2)
    log.append_frame(spark.range(41).toDF("i"), ["i"])
    names = log.folder.names
    log.folder.names = lambda name="": names(name) if name != "live" else 1 / 0  # no folder is listed for it
    assert (log.offset, log.segment_count) == (41, 21)
