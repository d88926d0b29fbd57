"""Column expressions that pipelines use; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}


def plain(kind: str, column: Column | str | None = None) -> Column:
    """count, sum, min, max or avg of a column."""
    return F.count("*") if kind == "count" else _AGGREGATES[kind](column)


def aggregate(kind: str, column: Column | str | None = None) -> Column:
    """The same as ``value``."""
    return plain(kind, column).alias("value")


def extreme_range(column: Column | str) -> Column:
    return F.max(column) - F.min(column)


def word_list(text: Column | str) -> Column:
    """Lower-cased words of a text, cut at white space, without empty ones."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
