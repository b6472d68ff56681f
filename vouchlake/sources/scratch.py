"""Where jobs keep what they need for a while: a folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir. Where that is unset: a temporary one on a single machine, an error on a cluster."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that all machines share")
        conf = tempfile.mkdtemp(prefix="vouchlake-")
    return f"{conf.rstrip('/')}/vouchlake-{name}-{uuid.uuid4().hex}"
