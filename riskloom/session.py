"""Session construction and shared-storage helpers.

Everything that must survive an executor loss (cut lineage, staged tables) goes to the
folder the cluster names in ``spark.checkpoint.dir``. We only set that folder ourselves
when the session has none, which happens in local tests.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "riskloom", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if none is set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        # a machine-local folder serves tests and benches only: other executors cannot see it
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="riskloom-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder for staged tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "staged", f"{name}-{uuid.uuid4().hex[:12]}")


def default_buckets(spark: SparkSession, minimum: int = 16) -> int:
    """Bucket count for ordered passes: enough slices to keep every task small."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(minimum, 2 * parts)


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()  # Spark refuses a second file of the same name


def ship_package(spark: SparkSession) -> None:
    """Make ``riskloom`` importable in Python workers (executors) once per application:
    the package is zipped on the driver and distributed with ``addPyFile``, the same way
    ``--py-files`` would ship it. Needed wherever task-side Python (``mapInPandas``) refers
    to package functions. Folds that train side by side call this at the same time: the first
    ships, the others wait for it."""
    sc = spark.sparkContext
    app = sc.applicationId
    with _SHIPPING:
        if app in _SHIPPED:
            return
        import zipfile
        pkg_dir = os.path.dirname(os.path.abspath(__file__))
        root = os.path.dirname(pkg_dir)
        out = os.path.join(tempfile.mkdtemp(prefix="riskloom-pyfiles-"), "riskloom.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
            for dirpath, _, files in os.walk(pkg_dir):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(dirpath, f)
                        zf.write(full, os.path.relpath(full, root))
        sc.addPyFile(out)
        _SHIPPED.add(app)
