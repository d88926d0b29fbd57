"""Line deduplication on levelled sorted runs of line hashes. DataFrame functions only.

The store holds runs: tables of (key, docs, last, fresh) in buckets by key, sorted
by it within each bucket. A key is a 128-bit line hash, docs the number of documents
of the run's batches that hold the line and last the largest id among them. A new
batch of documents is reduced to its own keys, which the one shuffle deals to the
buckets, and merge-anti-joined with the fresh entries of all runs: keys that none has
are fresh entries of the batch's run, the others only add to what an earlier run
holds. So a key has one fresh entry in all runs. The runs are read as they lie,
neither shuffled nor sorted. When a level has ``fanout`` runs, a
merge, again without a shuffle, compacts them to one run of the next level, so that
a key is rewritten a logarithmic number of times however many batches come. A key's
total is its fresh entry and what later batches added, if any did.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import UNMARKED, delete_path, kept, new_path, partitions_for

#: `[\x20\x09-\x0D]`
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(STRIPPED)), UPPER, LOWER)


def key_hash(key: Column) -> Column:
    return F.unhex(F.md5(key.cast("binary")))


def line_hashes(text: Column, min_chars: int) -> Column:
    """Hashes of the distinct keys of at least ``min_chars`` code points."""
    keys = F.filter(F.transform(split_lines(text), line_key), lambda k: F.char_length(k) >= min_chars)
    return F.transform(F.array_distinct(keys), key_hash)


@contextmanager
def _sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Scans of buckets with one file each are known to be sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass
class Run:
    """A bucketed, sorted table in the shared folder."""

    spark: SparkSession
    name: str
    path: str

    @property
    def frame(self) -> DataFrame:
        return self.spark.table(self.name)

    def fresh_keys(self) -> DataFrame:
        return self.frame.where("fresh").select("key").hint("merge")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_path(self.spark, self.path)


class LineRuns:
    """Levelled sorted runs in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        """``buckets`` is as many as there are shuffle partitions, so that a batch's only shuffle deals it to them."""
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or partitions_for(spark)
        self.levels: list[list[Run]] = []

    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def _written(self, df: DataFrame) -> Run:
        run = Run(self.spark, f"line_run_{uuid.uuid4().hex}", new_path(self.spark, "run"))
        df.write.format("parquet").options(**UNMARKED).bucketBy(self.buckets, "key").sortBy("key").option("path", run.path).saveAsTable(run.name)
        return run

    def ingest(self, occurrences: DataFrame) -> Run:
        """Add a batch of (key, doc_id), one row per key and document; returns the batch's own run, which a compaction may take away.

        Its ``fresh`` entries are the keys that no earlier batch held.
        """
        batch = occurrences.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))
        earlier = self.runs()
        with _sorted_buckets(self.spark):
            run = self._written(self.told_apart(batch, earlier) if earlier else batch.withColumn("fresh", F.lit(True)))
            self._add(0, run)
        return run

    @staticmethod
    def told_apart(batch: DataFrame, earlier: list[Run]) -> DataFrame:
        """``batch`` with ``fresh``: true for what merge-anti-joins with the fresh entries of all runs leave of it, false for the rest, that one of them has."""
        first = reduce(lambda left, run: left.join(run.fresh_keys(), "key", "left_anti"), earlier, batch)
        marked = batch.join(first.select("key", F.lit(True).alias("fresh")).hint("merge"), "key", "left")
        return marked.withColumn("fresh", F.coalesce("fresh", F.lit(False)))

    def _union(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [r.frame for r in self.runs()])

    def _add(self, level: int, run: Run) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            every = reduce(DataFrame.unionByName, [r.frame for r in runs])
            merged = self._written(every.groupBy("key").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"), F.max("fresh").alias("fresh")))
            for r in runs:
                r.drop()
            self._add(level + 1, merged)

    def totals(self) -> DataFrame:
        """(key, docs, last) over all that came in: each key's fresh entry and what later batches added to it."""
        every = self._union()
        added = every.where("not fresh").groupBy("key").agg(F.sum("docs").alias("more"), F.max("last").alias("later"))
        both = every.where("fresh").select("key", "docs", "last").join(added.hint("merge"), "key", "left")
        return both.select("key", (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs"), F.greatest("last", "later").alias("last"))

    def forget(self) -> None:
        """Take the runs' names out of the catalog; frames made of them still read the files."""
        for r in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {r.name}")
        self.levels = []


def dedup_lines(
    docs: DataFrame,
    min_docs: int = 2,
    min_chars: int = 40,
    batches: int = 3,
    fanout: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    lines_out: str = "n_lines",
    dropped_out: str = "n_dropped",
) -> DataFrame:
    """All columns of ``docs``, ``text_col`` without repeated lines, and ``lines_out`` and ``dropped_out``, numbers of lines.

    A line's key is the line stripped of `[\\x20\\x09-\\x0D]` and with A-Z
    lower-cased. Keys of at least ``min_chars`` code points that ``min_docs``
    rows or more hold lose all their lines except in the rows with the largest
    id among them. A null or empty text is one empty line and comes back empty.
    A null id is below every other; if all holders have one, all keep the line.
    Rows that repeat an id each count as a document. Columns of ``docs`` with the
    names of the two numbers are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in (text_col, lines_out, dropped_out)]
    seen = docs.select(F.col(id_col).alias("doc_id"), F.explode(line_hashes(F.col(text_col), min_chars)).alias("key"))
    seen = seen.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    seen = kept(seen)
    store = LineRuns(spark, fanout)
    for b in range(batches):
        store.ingest(seen.where(F.col("batch") == b))
    repeated = store.totals().where(F.col("docs") >= min_docs)
    store.forget()
    # the key as an expression: the join shuffles this side anew, and adaptive execution can split a hot line
    repeated = repeated.withColumn("key", F.substring("key", 1, 16))
    doomed = seen.join(repeated, "key").where(~F.col("doc_id").eqNullSafe(F.col("last")))
    doomed = doomed.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("key").alias("__doomed"))
    joined = docs.join(doomed.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("__id")), "left")
    lines = split_lines(F.col(text_col))
    staying = F.filter(
        lines,
        lambda line: ~((F.char_length(line) >= min_chars) & F.array_contains("__doomed", key_hash(line_key(line)))),
    )
    out = joined.select(*names, F.col(text_col), "__doomed", F.when(F.col("__doomed").isNotNull(), staying).alias("__kept"))
    n_lines = F.size(split_lines(F.col(text_col)))
    text = F.when(F.col("__kept").isNull(), F.coalesce(text_col, F.lit(""))).otherwise(F.array_join("__kept", "\n")).alias(text_col)
    return out.select(
        *[text if c == text_col else c for c in docs.columns if c not in (lines_out, dropped_out)],
        n_lines.cast("long").alias(lines_out),
        F.when(F.col("__kept").isNull(), 0).otherwise(n_lines - F.size("__kept")).cast("long").alias(dropped_out),
    )
