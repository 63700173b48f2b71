"""Where intermediate tables go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which all machines see. Where that is unset, a local folder will do if Spark
    runs on this machine alone; on a cluster it is an error."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines see")
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='spark-lodestat-')}"
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/lodestat-{uuid.uuid4().hex}"
