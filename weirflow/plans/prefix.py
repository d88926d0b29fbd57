"""Running totals, numbering and sessions in a global order without one task that holds everything.

Rows are dealt to ranges of the full order, cut at a sample of it; a window runs
inside each range, and what the ranges before it add up to, one row a range, is
joined on. There are as many ranges as shuffle partitions. Only the sample, some
rows a range, and one row a range reach the driver.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

SAMPLED = 24  # rows a range


def ranged(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` and ``__range``, which grows with the order. Null comes first, as in a window; rows that tie in all of it stay together."""
    n = ranges or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    count = df.count() if n > 1 else 0
    if count <= n:
        return df.withColumn("__range", F.lit(0))
    picked = df.select(*order).sample(min(1.0, SAMPLED * n / count), seed=5).orderBy(*order).collect()
    cuts = list(dict.fromkeys(tuple(picked[i * len(picked) // n]) for i in range(1, n))) if picked else []
    if not cuts:
        return df.withColumn("__range", F.lit(0))
    kinds = [df.schema[c].dataType for c in order]
    literal = [F.struct(*(F.lit(v).cast(k).alias(c) for v, k, c in zip(cut, kinds, order))) for cut in cuts]
    steps = len(cuts).bit_length()
    literal += [literal[-1]] * ((1 << steps) - 1 - len(cuts))
    own, halves = F.struct(*order), F.array(*[F.lit(1 << k) for k in range(steps - 1, -1, -1)])
    at = F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get(F.array(*literal), at + half - 1) < own, at + half).otherwise(at))
    return df.withColumn("__range", F.least(at, F.lit(len(cuts))))


def _carried(found: list[tuple], join: Callable[[Any, Any], Any]) -> list[tuple[int, Any]]:
    """For each range what all before it come to."""
    out, held = [], None
    with decimal.localcontext() as exact:
        exact.prec = 60
        for at, part in sorted(found, key=lambda r: r[0]):
            out.append((at, held))
            if part is not None:
                held = part if held is None else join(held, part)
    return out


def _running(df: DataFrame, order: list[str], value: str, combine: Callable[[Column], Column], name: str, add: Callable[[Any, Any], Any], join: Callable[[Column, Column], Column]) -> DataFrame:
    """``name``: ``combine`` over this row and all before it; ``add`` and ``join`` merge two partial results."""
    rows = ranged(df, order)
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("__range").agg(combine(F.col(value)).alias("__before"))
    before = df.sparkSession.createDataFrame(_carried([tuple(r) for r in sums.collect()], add), sums.schema)  # one row a range
    joined = rows.withColumn(name, combine(F.col(value)).over(inside)).join(F.broadcast(before), "__range")
    return joined.withColumn(name, join(F.col("__before"), F.col(name))).drop("__range", "__before")


def running_sum(df: DataFrame, order: list[str], value: str, name: str = "value") -> DataFrame:
    return _running(df, order, value, F.sum, name, lambda a, b: a + b, lambda a, b: F.coalesce(a + b, b, a))


def running_max(df: DataFrame, order: list[str], value: str, name: str = "value") -> DataFrame:
    return _running(df, order, value, F.max, name, max, F.greatest)


def numbered(df: DataFrame, order: list[str], name: str = "offset", start: int = 0) -> DataFrame:
    """Positions in a global order, from ``start``."""
    one = running_sum(df.withColumn("__one", F.lit(1).cast("long")), order, "__one", name)
    return one.withColumn(name, F.col(name) - 1 + F.lit(start)).drop("__one")


def sessions(df: DataFrame, time: Column, gap: str) -> DataFrame:
    """Rows with the bounds of their session among all rows: ``window_start``, and ``window_end``, the last time plus the gap.

    Sessions are found inside ranges of time; those that touch across ranges are
    put together by the ranges' first and last ones. Rows without a time are in none.
    """
    length = F.expr(f"interval {gap}")
    timed = df.withColumn("__t", time).where("__t is not null")
    rows = ranged(timed, ["__t"])
    inside = Window.partitionBy("__range").orderBy("__t")
    starts = F.coalesce((F.col("__t") > F.lag("__t").over(inside) + length).cast("int"), F.lit(0))
    local = rows.withColumn("__new", starts).withColumn("__s", F.sum("__new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("__range", "__s")
    local = local.withColumns({"__from": F.min("__t").over(own), "__to": F.max("__t").over(own)})
    # one row a range: its ends, where its first session ends and its last begins, and whether the next range's begins within the gap
    ends = local.groupBy("__range").agg(F.min("__t").alias("a"), F.max("__t").alias("z"), F.min("__to").alias("first_to"), F.max("__from").alias("last_from"))
    spark, schema = df.sparkSession, ends.schema
    found = sorted(ends.withColumn("reach", F.col("z") + length).collect(), key=lambda r: r["__range"])
    joins = [k > 0 and r["a"] <= found[k - 1]["reach"] for k, r in enumerate(found)]
    begin, end = [r["a"] for r in found], [r["z"] for r in found]
    for k, r in enumerate(found):  # where the session that this range's first belongs to begins
        if joins[k]:
            begin[k] = begin[k - 1] if found[k - 1]["last_from"] == found[k - 1]["a"] else found[k - 1]["last_from"]
    for k in range(len(found) - 2, -1, -1):  # where the session that this range's last belongs to ends
        if joins[k + 1]:
            end[k] = end[k + 1] if found[k + 1]["first_to"] == found[k + 1]["z"] else found[k + 1]["first_to"]
    kind = schema["a"].dataType.simpleString()
    bounds = spark.createDataFrame([(r["__range"], r["a"], r["z"], b, e) for r, b, e in zip(found, begin, end)], f"__range int, __a {kind}, __z {kind}, __begin {kind}, __end {kind}")
    joined = local.join(F.broadcast(bounds), "__range")
    start = F.when(F.col("__from") == F.col("__a"), F.col("__begin")).otherwise(F.col("__from"))
    stop = F.when(F.col("__to") == F.col("__z"), F.col("__end")).otherwise(F.col("__to"))
    return joined.withColumns({"window_start": start, "window_end": stop + length}).select("window_start", "window_end", *df.columns)
