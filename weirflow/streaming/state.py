"""Keyed state and timers, on Spark's ``transformWithState`` for batch and stream alike.

A ``KeyedProcessFunction`` sees one record at a time with its key's state, made on
first use by name. Values are kept as JSON, so any plain value can be stored; a
time to live is Spark's, counted from the last write in processing time.
"""

from __future__ import annotations

import json
import os
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..errors import StateError
from ..functions.callables import struct_of

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class StateConfig:
    """Seconds after which state that is not written again is gone; None for never."""

    ttl: float | None = None
    update_type: str = "on_write"

    @property
    def ttl_ms(self) -> int | None:
        return None if self.ttl is None else round(self.ttl * 1000)


def _dump(x: Any) -> str:
    try:
        return json.dumps(x, default=str)
    except (TypeError, ValueError) as e:
        raise StateError(f"{x!r} can't be stored") from e


class _Cell:
    """One value in memory, with the methods of a store's value state."""

    def __init__(self):
        self.held: tuple | None = None

    def exists(self) -> bool:
        return self.held is not None

    def get(self) -> tuple | None:
        return self.held

    def update(self, row: tuple) -> None:
        self.held = row

    def clear(self) -> None:
        self.held = None


class ValueState:
    def __init__(self, store: Any = None, default: Any = None):
        self._store, self._default = store if store is not None else _Cell(), default

    def value(self) -> Any:
        return json.loads(self._store.get()[0]) if self._store.exists() else self._default

    def update(self, value: Any) -> None:
        self._store.update((_dump(value),))

    def clear(self) -> None:
        self._store.clear()


class ReducingState(ValueState):
    """The fold of what was added."""

    def __init__(self, reduce: Callable[[Any, Any], Any], store: Any = None):
        super().__init__(store)
        self._reduce = reduce

    def add(self, value: Any) -> None:
        self.update(self._reduce(self.value(), value) if self._store.exists() else value)

    get = ValueState.value


class AggregatingState(ValueState):
    """An accumulator: ``add(accumulator, value)`` from ``initial()``, read through ``result``."""

    def __init__(self, add: Callable[[Any, Any], Any], initial: Callable[[], Any], result: Callable[[Any], Any] = lambda a: a, store: Any = None):
        super().__init__(store)
        self._add, self._initial, self._result = add, initial, result

    def add(self, value: Any) -> None:
        self.update(self._add(self.value() if self._store.exists() else self._initial(), value))

    def get(self) -> Any:
        return self._result(self.value()) if self._store.exists() else None


class _Entries:
    """A list in memory, with the methods of a store's list state."""

    def __init__(self):
        self.rows: list[tuple] = []

    def get(self) -> Iterator[tuple]:
        return iter(list(self.rows))

    def appendValue(self, row: tuple) -> None:
        self.rows.append(row)

    def put(self, rows: list[tuple]) -> None:
        self.rows = list(rows)

    def clear(self) -> None:
        self.rows = []


class ListState:
    def __init__(self, store: Any = None):
        self._store = store if store is not None else _Entries()

    def add(self, value: Any) -> None:
        self._store.appendValue((_dump(value),))

    def get(self) -> list:
        return [json.loads(r[0]) for r in self._store.get()]

    def replace(self, values: list) -> None:
        if values:
            self._store.put([(_dump(v),) for v in values])
        else:
            self._store.clear()

    def clear(self) -> None:
        self._store.clear()

    def __len__(self) -> int:
        return len(self.get())

    def __iter__(self) -> Iterator:
        return iter(self.get())


class _Pairs:
    """A map in memory, with the methods of a store's map state."""

    def __init__(self):
        self.rows: dict[tuple, tuple] = {}

    def containsKey(self, k: tuple) -> bool:
        return k in self.rows

    def getValue(self, k: tuple) -> tuple | None:
        return self.rows.get(k)

    def updateValue(self, k: tuple, v: tuple) -> None:
        self.rows[k] = v

    def removeKey(self, k: tuple) -> None:
        self.rows.pop(k, None)

    def iterator(self) -> Iterator[tuple]:
        return iter(list(self.rows.items()))

    def clear(self) -> None:
        self.rows.clear()


class MapState:
    def __init__(self, store: Any = None):
        self._store = store if store is not None else _Pairs()

    def get(self, key: Any, default: Any = None) -> Any:
        k = (_dump(key),)
        return json.loads(self._store.getValue(k)[0]) if self._store.containsKey(k) else default

    def put(self, key: Any, value: Any) -> None:
        self._store.updateValue((_dump(key),), (_dump(value),))

    def remove(self, key: Any) -> None:
        self._store.removeKey((_dump(key),))

    def contains(self, key: Any) -> bool:
        return self._store.containsKey((_dump(key),))

    def items(self) -> list[tuple[Any, Any]]:
        return [(json.loads(k[0]), json.loads(v[0])) for k, v in self._store.iterator()]

    def keys(self) -> list:
        return [k for k, _ in self.items()]

    def values(self) -> list:
        return [v for _, v in self.items()]

    def clear(self) -> None:
        self._store.clear()


class _BackedValue(_Cell):
    """A store's value of the current key, read once and written once a batch."""

    def __init__(self, store: Any):
        super().__init__()
        self.store, self.loaded, self.changed = store, False, False

    def exists(self) -> bool:
        if not self.loaded:
            self.held, self.loaded = (self.store.get() if self.store.exists() else None), True
        return self.held is not None

    def get(self) -> tuple | None:
        return self.held if self.exists() else None

    def update(self, row: tuple) -> None:
        self.held, self.loaded, self.changed = row, True, True

    def clear(self) -> None:
        self.held, self.loaded, self.changed = None, True, True

    def flush(self) -> None:
        if self.changed:
            if self.held is None:
                self.store.clear()
            else:
                self.store.update(self.held)
        self.held, self.loaded, self.changed = None, False, False


class _BackedList(_Entries):
    """A store's list of the current key; what is only added is appended once a batch."""

    def __init__(self, store: Any):
        super().__init__()
        self.store, self.loaded, self.replaced, self.added = store, False, False, []

    def get(self) -> Iterator[tuple]:
        if not self.loaded:
            self.rows, self.loaded = [tuple(r) for r in self.store.get()], True
        return iter([*self.rows, *self.added])

    def appendValue(self, row: tuple) -> None:
        self.added.append(row)

    def put(self, rows: list[tuple]) -> None:
        self.rows, self.added, self.loaded, self.replaced = list(rows), [], True, True

    def clear(self) -> None:
        self.put([])

    def flush(self) -> None:
        if self.replaced and not (self.rows or self.added):
            self.store.clear()
        elif self.replaced:
            self.store.put([*self.rows, *self.added])
        elif self.added:
            self.store.appendList(self.added)
        self.rows, self.added, self.loaded, self.replaced = [], [], False, False


class _BackedMap(_Pairs):
    """A store's map of the current key; each entry is read once and written once a batch."""

    def __init__(self, store: Any):
        super().__init__()
        self.store, self.changed = store, set()

    def containsKey(self, k: tuple) -> bool:
        if k not in self.rows:
            self.rows[k] = self.store.getValue(k) if self.store.containsKey(k) else None
        return self.rows[k] is not None

    def getValue(self, k: tuple) -> tuple | None:
        return self.rows[k] if self.containsKey(k) else None

    def updateValue(self, k: tuple, v: tuple) -> None:
        self.rows[k] = v
        self.changed.add(k)

    def removeKey(self, k: tuple) -> None:
        self.rows[k] = None
        self.changed.add(k)

    def iterator(self) -> Iterator[tuple]:
        self.flush()
        return iter([(tuple(k), tuple(v)) for k, v in self.store.iterator()])

    def clear(self) -> None:
        self.rows, self.changed = {}, set()
        self.store.clear()

    def flush(self) -> None:
        for k in self.changed:
            if self.rows[k] is not None:
                self.store.updateValue(k, self.rows[k])
            elif self.store.containsKey(k):
                self.store.removeKey(k)
        self.rows, self.changed = {}, set()


class TimerService:
    """Timers of the current key, in seconds; without a handle, of a test's own making."""

    def __init__(self, handle: StatefulProcessorHandle | None = None):
        self._handle, self._due = handle, set()
        self.watermark = self.processing_time = float("-inf")

    def register(self, timestamp: float) -> None:
        if self._handle is not None:
            self._handle.registerTimer(round(timestamp * 1000))
        else:
            self._due.add(timestamp)

    register_event_time = register_processing_time = register

    def delete(self, timestamp: float) -> None:
        if self._handle is not None:
            self._handle.deleteTimer(round(timestamp * 1000))
        else:
            self._due.discard(timestamp)

    def pending(self) -> list[float]:
        return sorted(t / 1000 for t in self._handle.listTimers()) if self._handle is not None else sorted(self._due)

    def fire(self, upto: float) -> list[float]:
        """Due timers in order, taken out; for functions driven without Spark."""
        due = sorted(t for t in self._due if t <= upto)
        self._due.difference_update(due)
        return due


class RuntimeContext:
    """What a keyed function sees of its key: its state by name, its timers."""

    def __init__(self, handle: StatefulProcessorHandle | None = None):
        self._handle = handle
        self._stores: dict[str, Any] = {}
        self._of_key: dict[Any, dict[str, Any]] = {}
        self.current_key: Any = None
        self.timer_service = TimerService(handle)

    def _store(self, kind: str, name: str, config: StateConfig | None) -> Any:
        if self._handle is None:  # in memory, for each key
            held = self._of_key.setdefault(self.current_key, {})
            return held.setdefault(name, {"value": _Cell, "list": _Entries, "map": _Pairs}[kind]())
        if name not in self._stores:
            ttl = config.ttl_ms if config else None
            if kind == "value":
                self._stores[name] = _BackedValue(self._handle.getValueState(name, "v string", ttl))
            elif kind == "list":
                self._stores[name] = _BackedList(self._handle.getListState(name, "v string", ttl))
            else:
                self._stores[name] = _BackedMap(self._handle.getMapState(name, "k string", "v string", ttl))
        return self._stores[name]

    def flush(self) -> None:
        """Write the current key's changes back."""
        for store in self._stores.values():
            store.flush()

    def value_state(self, name: str, default: Any = None, config: StateConfig | None = None) -> ValueState:
        return ValueState(self._store("value", name, config), default)

    def list_state(self, name: str, config: StateConfig | None = None) -> ListState:
        return ListState(self._store("list", name, config))

    def map_state(self, name: str, config: StateConfig | None = None) -> MapState:
        return MapState(self._store("map", name, config))

    def reducing_state(self, name: str, reduce: Callable[[Any, Any], Any], config: StateConfig | None = None) -> ReducingState:
        return ReducingState(reduce, self._store("value", name, config))

    def aggregating_state(self, name: str, add: Callable[[Any, Any], Any], initial: Callable[[], Any], result: Callable[[Any], Any] = lambda a: a, config: StateConfig | None = None) -> AggregatingState:
        return AggregatingState(add, initial, result, self._store("value", name, config))


class ProcessFunction:
    """One record to a result; None gives none."""

    def process(self, value: Any) -> Any:
        raise NotImplementedError


class KeyedProcessFunction:
    """Results are a dict, a tuple, a list of these, or None. ``open`` must name all state that ``process_element`` uses."""

    def open(self, context: RuntimeContext) -> None:
        pass

    def process_element(self, value: dict, context: RuntimeContext) -> Any:
        raise NotImplementedError

    def on_timer(self, timestamp: float, context: RuntimeContext) -> Any:
        return None

    def on_batch_end(self, context: RuntimeContext) -> Any:
        """Called when a micro-batch's records of a key are through."""
        return None

    def close(self) -> None:
        pass


class _Processor(StatefulProcessor):
    def __init__(self, function: KeyedProcessFunction, names: list[str]):
        self.function, self.names = function, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.context = RuntimeContext(handle)
        self.function.open(self.context)

    def _rows(self, got: Any) -> Iterator[Row]:
        if got is None:
            return
        for x in got if isinstance(got, list) else [got]:
            if x is None:
                continue
            if isinstance(x, dict):
                yield Row(**{n: x.get(n) for n in self.names})
            else:
                yield Row(**dict(zip(self.names, x if isinstance(x, tuple) else (x,))))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        self.context.current_key = key[0] if len(key) == 1 else tuple(key)
        for row in rows:
            yield from self._rows(self.function.process_element(row.asDict(recursive=True), self.context))
        yield from self._rows(self.function.on_batch_end(self.context))
        self.context.flush()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.context.current_key = key[0] if len(key) == 1 else tuple(key)
        yield from self._rows(self.function.on_timer(expiredTimerInfo.getExpiryTimeInMs() / 1000, self.context))
        self.context.flush()

    def close(self) -> None:
        self.function.close()


def run_keyed(df: DataFrame, keys: list[str], function: KeyedProcessFunction | type, schema: T.StructType | str, mode: str = "update", time_mode: str = "none") -> DataFrame:
    """Apply a keyed function; ``time_mode`` is none, eventTime or processingTime.

    Timers need a mode other than none, a time to live needs processingTime.

    Needs the RocksDB state store, which is set on the session. Within a
    micro-batch, and so in a batch, a key's rows come in no certain order.
    """
    made = function() if isinstance(function, type) else function
    out = struct_of(schema)
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    df.sparkSession.streams.active  # starts the state stores' coordinator, which a batch needs, too
    return df.groupBy(*keys).transformWithState(_Processor(made, out.fieldNames()), out, mode, time_mode)


def drive_keyed(records: list[dict], key: Callable[[dict], Any], function: KeyedProcessFunction, time: Callable[[dict], float] | None = None) -> list:
    """A keyed function over records in order, without Spark: for tests of its logic. Timers fire as the largest time passes them."""
    context, out = RuntimeContext(), []
    timers: dict[Any, TimerService] = {}
    largest = float("-inf")

    def keep(got: Any) -> None:
        out.extend(x for x in (got if isinstance(got, list) else [got]) if x is not None)

    for r in records:
        context.current_key = key(r)
        context.timer_service = timers.setdefault(context.current_key, TimerService())
        function.open(context)
        keep(function.process_element(r, context))
        if time is not None:
            largest = max(largest, time(r))
            for k, service in timers.items():
                for due in service.fire(largest):
                    context.current_key, context.timer_service = k, service
                    function.open(context)
                    keep(function.on_timer(due, context))
    function.close()
    return out


@dataclass
class MemoryStateBackend:
    """Plain values, lists and maps by key and name, with snapshots; for drivers and tests."""

    held: dict[str, dict[Any, dict[str, Any]]] = field(default_factory=lambda: {"value": {}, "list": {}, "map": {}})

    def __post_init__(self):
        self._lock = threading.RLock()

    def get(self, kind: str, key: Any, name: str, default: Any = None) -> Any:
        with self._lock:
            return self.held[kind].get(key, {}).get(name, default)

    def set(self, kind: str, key: Any, name: str, value: Any) -> None:
        with self._lock:
            self.held[kind].setdefault(key, {})[name] = value

    def checkpoint(self) -> str:
        with self._lock:
            return json.dumps({kind: [[k, names] for k, names in by.items()] for kind, by in self.held.items()})

    def restore(self, snapshot: str) -> None:
        with self._lock:
            self.held = {kind: {(tuple(k) if isinstance(k, list) else k): names for k, names in rows} for kind, rows in json.loads(snapshot).items()}


class JsonFileStateBackend(MemoryStateBackend):
    """A memory backend that is saved to and loaded from a folder's JSON files."""

    def __init__(self, folder: str):
        super().__init__()
        self.folder = folder

    def save(self, name: str) -> str:
        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, f"{name}.json")
        with open(f"{path}.new", "w") as f:
            f.write(self.checkpoint())
        os.replace(f"{path}.new", path)
        return path

    def load(self, name: str) -> bool:
        path = os.path.join(self.folder, f"{name}.json")
        if not os.path.exists(path):
            return False
        with open(path) as f:
            self.restore(f.read())
        return True


class KeyedState:
    """One key's part of a backend."""

    def __init__(self, backend: MemoryStateBackend, key: Any):
        self.backend, self.key = backend, key

    def get(self, name: str, default: Any = None, kind: str = "value") -> Any:
        return self.backend.get(kind, self.key, name, default)

    def set(self, name: str, value: Any, kind: str = "value") -> None:
        self.backend.set(kind, self.key, name, value)
