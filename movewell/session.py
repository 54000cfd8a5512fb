"""Session settings and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def job_session(name: str) -> SparkSession:
    """The session of a submitted job. Master, sizes and partitions come from spark-submit."""
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def local_session(name: str, cores: str = "8", **settings: str) -> SparkSession:
    """A session on this machine, for tests and timings."""
    builder = SparkSession.builder.appName(name).master(f"local[{cores}]")
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": cores,
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one the cluster names, which every executor can reach.

    Only a local session may fall back to the machine's own temporary folder; anywhere else
    a missing setting is an error, since other machines could not read what is written.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
        base = tempfile.mkdtemp(prefix="movewell-")
        spark.conf.set(CHECKPOINT_DIR, base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
