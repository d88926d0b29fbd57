"""A serving view of a batch and a speed layer, and the rules that merge them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

Merge = Callable[[Column, Column], Column]


class MergeView:
    """Rules for one key's batch and speed values; null stands for an absent one."""

    @staticmethod
    def latest(batch: Column, speed: Column) -> Column:
        return F.coalesce(speed, batch)

    @staticmethod
    def prefer_batch(batch: Column, speed: Column) -> Column:
        return F.coalesce(batch, speed)

    @staticmethod
    def combine_sum(batch: Column, speed: Column) -> Column:
        return F.coalesce(batch, F.lit(0)) + F.coalesce(speed, F.lit(0))

    @staticmethod
    def merge_dicts(batch: Column, speed: Column) -> Column:
        """Union of maps; the speed layer's entry wins."""
        both = F.map_concat(F.map_filter(batch, lambda k, _: ~F.array_contains(F.map_keys(speed), k)), speed)
        return F.when(batch.isNull(), speed).when(speed.isNull(), batch).otherwise(both)


def merged(batch: DataFrame, speed: DataFrame, keys: list[str], merge: Merge, value: str = "value") -> DataFrame:
    """V(k) = merge(B(k), S(k)) for every key of either: (keys, value, source)."""
    b = batch.select(*keys, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    s = speed.select(*keys, F.col(value).alias("__s"), F.lit(True).alias("__in_s"))
    source = F.when(F.col("__in_b").isNull(), "speed").when(F.col("__in_s").isNull(), "batch").otherwise("both")
    return b.join(s, keys, "full_outer").select(*keys, merge(F.col("__b"), F.col("__s")).alias(value), source.alias("source"))


class ServingView:
    """The merged view of what the layers delivered so far; updates with a key that is there merge into it."""

    def __init__(self, keys: list[str], merge: Merge = MergeView.latest, value: str = "value"):
        self.keys, self.merge, self.value = keys, merge, value
        self._batch: DataFrame | None = None
        self._speed: DataFrame | None = None
        #: When each layer last delivered, in seconds since 1970; 0 before it has.
        self.last_batch_time = self.last_speed_time = 0.0
        self._held: dict | None = None

    def _into(self, held: DataFrame | None, new: DataFrame) -> DataFrame:
        new = new.select(*self.keys, self.value)
        return new if held is None else merged(held, new, self.keys, self.merge, self.value).drop("source")

    def update_batch(self, df: DataFrame) -> None:
        self._batch, self._held = self._into(self._batch, df), None
        self.last_batch_time = time.time()

    def update_speed(self, df: DataFrame) -> None:
        self._speed, self._held = self._into(self._speed, df), None
        self.last_speed_time = time.time()

    def frame(self) -> DataFrame | None:
        if self._batch is None or self._speed is None:
            one, source = (self._batch, "batch") if self._speed is None else (self._speed, "speed")
            return None if one is None else one.withColumn("source", F.lit(source))
        return merged(self._batch, self._speed, self.keys, self.merge, self.value)

    def hold(self, at_most: int = 1_000_000) -> bool:
        """Keep the view's values on the driver for lookups until the next update, if there are at most so many keys."""
        view = self.frame()
        rows = [] if view is None else view.select(*self.keys, self.value).limit(at_most + 1).collect()
        self._held = {tuple(r[k] for k in self.keys): r[self.value] for r in rows} if len(rows) <= at_most else None
        return self._held is not None

    def query(self, *key: object) -> object | None:
        """One key's value: from the driver's copy after ``hold``, else by a filter that reaches the layers."""
        if self._held is not None:
            return self._held.get(key)
        view = self.frame()
        if view is None:
            return None
        for k, v in zip(self.keys, key):
            view = view.where(F.col(k).eqNullSafe(F.lit(v)))
        row = view.first()
        return None if row is None else row[self.value]

    def query_all(self) -> dict:
        view = self.frame()
        if view is None:
            return {}
        return {(r[self.keys[0]] if len(self.keys) == 1 else tuple(r[k] for k in self.keys)): r[self.value] for r in view.toLocalIterator()}

    def clear(self) -> None:
        self._batch = self._speed = self._held = None
