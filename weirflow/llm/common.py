"""Helpers that all operators of this folder share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent and all runs on one machine (tests), a temporary
    folder is created once per session and set as the session's checkpoint folder.
    On a cluster the setting is required.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        configured = "file://" + tempfile.mkdtemp(prefix="weirflow-")
        spark.conf.set("spark.checkpoint.dir", configured)
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/weirflow/{label}-{uuid.uuid4().hex}"


#: Options of intermediate tables: no marker file, as only a write that has ended is read.
UNMARKED = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there."""
    path = new_path(df.sparkSession, label)
    df.write.options(**UNMARKED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """``df`` on the executors' disks for the several uses within one operator.

    For tables a step or two from their input: blocks that go with an executor
    are computed again. Loops cut their lineage with ``stored``.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_stored(spark: SparkSession, df: DataFrame) -> None:
    """Remove what ``stored`` wrote, once nothing will read it again."""
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/weirflow/" in root:
            delete_path(spark, root)


def partitions_for(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, text cast to string with null read as empty."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def with_text(df: DataFrame, carried: list[str], text_col: str) -> tuple[DataFrame, int]:
    """The columns ``carried``, and the text as a string, and which column that is: one of theirs where it is one already, so that no text is sent twice."""
    if text_col in carried and df.schema[text_col].dataType.typeName() == "string":
        return df.select(*carried), carried.index(text_col)
    return df.select(*carried, F.col(text_col).cast("string").alias("__text")), len(carried)


#: Rows and bytes of the batches in which texts go to Python: what JVM and worker hold of them at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def give_back() -> None:
    """Freed memory to the system."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(spark: SparkSession | None, run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, for ``mapInArrow``, in batches of bounded size, and what it freed given back to the system at a task's end.

    The batch size of ``spark``, if given, is lowered where it is above ``BATCH``;
    workers live on between tasks and would keep their heaps at the largest size.
    """
    for name, most in BATCH.items() if spark is not None else ():
        now = int(spark.conf.get(name).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))

    def limited(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return limited
