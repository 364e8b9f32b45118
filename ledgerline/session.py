"""Session settings and the shared work folder.

The engine needs three things from a session:

* ``spark.sql.session.timeZone=UTC`` – instants are parsed from text that carries
  its own offset, but date/hour extraction and ``timestamp -> timestamp_ntz``
  conversions must not depend on the machine's zone;
* adaptive execution on (runtime join re-planning, partition coalescing and the
  skew-join split) – large joins are written as plain equi-joins and AQE turns
  them into broadcast joins only when the *measured* side is below the threshold;
* dynamic partition overwrite is requested per write (never session-wide, so a
  user's own partitioned overwrites keep their meaning);
* a shared folder for checkpoints and versioned tables, read from
  ``spark.checkpoint.dir`` (on a cluster also set
  ``spark.cleaner.referenceTracking.cleanCheckpoints=true`` at submit time so
  checkpoint files are removed when no longer referenced). Only in local mode, where one
  process runs everything, a session that names none gets a private temporary folder; on a
  cluster that is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the engine relies on to an existing session."""
    for key, value in SESSION_DEFAULTS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "ledgerline") -> SparkSession:
    """A local session for tests and the benchmark (UI off, no ports beyond Spark's own)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("LEDGERLINE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # recording the Python call site of every column costs more than building the columns
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # remove checkpoint files once their DataFrame is garbage-collected
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


_FALLBACK_ROOT: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    When a local session names none, a private folder is created once per application.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = _FALLBACK_ROOT.get(sc.applicationId)
        if root is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="ledgerline-ckpt-")
            _FALLBACK_ROOT[sc.applicationId] = root
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/ledgerline/{name}-{uuid.uuid4().hex[:12]}"
