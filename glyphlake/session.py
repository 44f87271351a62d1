"""Session settings and the shared folder that lineage is cut into."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "glyphlake", memory: str = "12g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    Only a single-machine session may go without one; a cluster that names none
    is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        root = context.getCheckpointDir() or tempfile.mkdtemp(prefix="glyphlake-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written copy."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the checkpoint folder for a written table."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}")


def by_key(spark: SparkSession) -> SparkSession:
    """A session of the same application and settings whose joins keep rows where they lie.

    Tables that are dealt by one key are then joined and grouped by that key and any others without a shuffle. It is for
    keys whose rows are bounded by what they are; the given session keeps its settings.
    """
    side = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if side.conf.get(name, None) != value:
            side.conf.set(name, value)
    side.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return side
