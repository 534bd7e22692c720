"""A Spark session with the settings that the library is used with."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew handling, UTC and Arrow; a cluster's own master and sizes stay unless given."""
    builder = SparkSession.builder.appName("lamella")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    fixed = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (fixed | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the session names for all executors; in a local session without one, a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lamella-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/lamella-{label}-{uuid.uuid4().hex}"
