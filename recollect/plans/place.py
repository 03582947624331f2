"""Folders for tables and checkpoints that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def base(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local master without that setting gets a
    temporary folder, one for the session."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not have:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="recollect-"))
        have = sc.getCheckpointDir()
    return have.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new folder there."""
    return f"{base(spark)}/{name}-{uuid.uuid4().hex}"
