"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def build_session(name: str = "frameprobe", master: str | None = None,
                  shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution on; the cluster's own settings stay in force."""
    builder = (SparkSession.builder.appName(name)
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true"))
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set, a temporary one in local mode, else an
    error: executors of a cluster would each write to a folder of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not (spark.sparkContext.master or "").startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        named = tempfile.mkdtemp(prefix="frameprobe-")
        spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder for a table that must be written and read back."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """For jobs run inside: methods over 8,000 bytes, which HotSpot does not compile but interprets, are
    not generated; Spark's own advice for ``METHOD_LIMIT``. Expressions of many columns beside each other
    come to that. Rows in long form are better off without, so the session's value returns afterwards.
    """
    before = spark.conf.get(METHOD_LIMIT)
    spark.conf.set(METHOD_LIMIT, str(min(int(before), 8_000)))
    try:
        yield
    finally:
        spark.conf.set(METHOD_LIMIT, before)
