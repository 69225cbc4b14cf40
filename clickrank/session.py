"""Session factory (C1) and the shared scratch folder.

Everything that is written to disk mid-job (lineage cuts, round-trip tables,
experiment sinks) goes below ``spark.checkpoint.dir``: on a cluster that is a
shared folder every executor can reach.  A session without that setting only
gets a private one when it runs in local mode (tests, bench); a cluster
session without it is an error rather than a silent machine-local path.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_session(
    master: str | None = None,
    app_name: str = "clickrank",
    driver_memory: str | None = None,
    shuffle_partitions: int | None = None,
    adaptive: bool = True,
    extra_conf: dict[str, object] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the settings the library relies on.

    Session time zone is UTC so epoch seconds, timestamps and dates agree with
    the SQL oracle; AQE is on so shuffle partition counts, skewed joins and
    broadcast decisions are re-planned from runtime sizes.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf: dict[str, object] = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": str(adaptive).lower(),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if driver_memory:
        conf["spark.driver.memory"] = driver_memory
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, registering it with the context.

    Reads ``spark.checkpoint.dir`` from the session.  Only a local-mode session
    without that setting gets a fresh private folder.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        if not _is_local(spark):
            raise RuntimeError(
                f"{CHECKPOINT_CONF} is not set; a cluster job needs a shared folder for checkpoints"
            )
        path = tempfile.mkdtemp(prefix="clickrank-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique location below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession):
    """Within it, a query's shuffle files go when it ends, not when the driver happens to collect its garbage.

    Spark before 4.1 doesn't know the setting and keeps them.
    """
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
