"""Counts of words over all texts, packed as sorted arrays by hash part.

Tasks count within their rows, cut their counts by hash part and send one row a
part; a part's counts are added up in one place and stay packed, so that a corpus
with any number of words needs no row for each of them. Counts grow with the
corpus and never reach the driver; what does is a histogram of 256 bins a part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import kept, partitions_for

BINS = 256


def bin_of(counts: np.ndarray) -> np.ndarray:
    """Four bins for each doubling; 1, 2, 3 and 4 have bins of their own."""
    return np.minimum(np.log2(counts) * 4, BINS - 1).astype(np.int64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def by_part(keys: np.ndarray, values: np.ndarray, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
    part = part_of(keys, parts)
    order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
    keys, values, ends = keys[order], values[order], np.cumsum(np.bincount(part, minlength=parts))
    for p, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
        if b > a:
            yield p, keys[a:b].tobytes(), values[a:b].tobytes()


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    new = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[new], np.add.reduceat(c, new) if len(k) else c


def _count(words: Callable, parts: int, flush: int = 1 << 19):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def out() -> pa.RecordBatch:
            rows = list(by_part(*summed(keys, counts), parts))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "keys", "counts"])

        for batch in batches:
            for w in words(batch.column(0)):
                if len(w):
                    k, c = np.unique(w, return_counts=True)
                    keys.append(k)
                    counts.append(c.astype(np.int64))
                    held += len(k)
                if held > flush:
                    k, c = summed(keys, counts)
                    keys, counts, held = [k], [c], len(k)
                    if held > flush // 2:
                        yield out()
                        keys, counts, held = [], [], 0
        if keys:
            yield out()

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of part to one row a part."""
    part, keys, counts = None, [], []

    def out() -> pa.RecordBatch:
        k, c = summed(keys, counts)
        sizes = np.bincount(bin_of(c), minlength=BINS)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary()), pa.array([int(c.sum())]), pa.array([len(k)]), pa.array([sizes.tolist()], pa.list_(pa.int64()))], names=["part", "keys", "counts", "n", "v", "sizes"])

    for batch in batches:
        for p, k, c in zip(*(batch.column(x).to_pylist() for x in ("part", "keys", "counts"))):
            if p != part and keys:
                yield out()
                keys, counts = [], []
            part = p
            keys.append(np.frombuffer(k, np.uint64))
            counts.append(np.frombuffer(c, np.int64))
    if keys:
        yield out()


def count_words(texts: DataFrame, words: Callable, parts: int) -> DataFrame:
    """(part, keys, counts, n, v, sizes) of a frame with one column of texts.

    ``words`` gives, for a text column, arrays of hashes to count: with a text's
    repeats for how often words come, without for how many texts hold them. n is
    the sum of a part's counts, v its number of words, sizes their histogram.
    """
    spread = texts.mapInArrow(_count(words, parts), "part int, keys binary, counts binary")
    joined = spread.repartition(partitions_for(texts.sparkSession), "part").sortWithinPartitions("part")
    return kept(joined.mapInArrow(_total, "part int, keys binary, counts binary, n long, v long, sizes array<long>"))


def histogram(counted: DataFrame) -> tuple[int, int, np.ndarray]:
    """(sum of all counts, number of words, words by bin of their count)."""
    n, v, sizes = 0, 0, np.zeros(BINS, np.int64)
    for b, held, total, words in counted.select("n", "v", F.posexplode("sizes").alias("bin", "held")).groupBy("bin").agg(F.sum("held"), F.sum("n"), F.sum("v")).collect():
        sizes[b] = held
        n, v = total, words
    return n, v, sizes


def first_bin(sizes: np.ndarray, at_most: int) -> int:
    """The lowest bin from which on there are at most ``at_most`` words."""
    above = np.cumsum(sizes[::-1])[::-1]
    return int(np.argmax(above <= at_most)) if (above <= at_most).any() else BINS
