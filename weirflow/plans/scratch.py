"""Folders for what a query writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from ..errors import PipelineError


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``, which a cluster's machines share; a temporary one where that is unset and all runs on one machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise PipelineError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="weirflow-")
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"
