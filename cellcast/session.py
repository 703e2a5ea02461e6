"""Session settings and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

# Settings every job relies on. Hours are computed from wall-clock parts, but
# pinning UTC keeps any timestamp text formatting free of DST shifts.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join on (period, cell) may use a partitioning by cell alone: see operators.features.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "cellcast", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings the library assumes."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    The folder comes from ``spark.checkpoint.dir``. Only a local-mode session
    (tests, laptops) may fall back to a private temporary folder; on a cluster
    an unset value is an error, since a machine-local folder would not survive
    the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="cellcast-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


_given: ContextVar[list[str] | None] = ContextVar("given", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end the scratch folders given out inside, also after an error.

    What reads them must be written or collected by then. An inner scope deletes its own.
    """
    given: list[str] = []
    token = _given.set(given)
    try:
        yield
    finally:
        _given.reset(token)
        for path in given:
            delete_path(spark, path)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint location for written tables."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if not base:
        base = os.path.dirname(ensure_checkpoint_dir(spark).rstrip("/"))
    path = f"{base.rstrip('/')}/cellcast-{name}-{uuid.uuid4().hex[:12]}"
    if (given := _given.get()) is not None:
        given.append(path)
    return path


def _file(spark: SparkSession, path: str):
    """A path and the file system it lies in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file(spark, path)
    return fs.exists(at)


def modified_at(spark: SparkSession, path: str | None) -> float:
    """When a path was last changed, in seconds; ``None`` is now."""
    if path is None:
        return time.time()
    at, fs = _file(spark, path)
    return fs.getFileStatus(at).getModificationTime() / 1000.0


def delete_folder(spark: SparkSession, path: str) -> None:
    at, fs = _file(spark, path)
    fs.delete(at, True)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`scratch_dir` gave out, by the file system it lies in."""
    if "/cellcast-" not in path:
        raise ValueError(f"not a scratch folder: {path}")
    delete_folder(spark, path)
