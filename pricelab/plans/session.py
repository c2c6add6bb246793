"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import hashlib
import io
import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# Settings for a large cluster (hundreds of executors, tens of TB per job).  Shuffles
# start wide and AQE coalesces them to ~256 MB partitions; a partition 5x the median
# and above 512 MB counts as skewed and is split; scans cut files into 256 MB splits;
# dimension tables are broadcast only when measured below 64 MB.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(64 << 20),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def build_session(master: str | None = "local[8]", shuffle_partitions: int | None = 8, app: str = "pricelab",
                  extra: dict[str, str] | None = None, cluster: bool = False) -> SparkSession:
    """Session with this package's defaults; ``cluster=True`` adds :data:`CLUSTER_CONF`
    (pass ``master=None`` to keep the cluster manager's master)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {**DEFAULT_CONF, **(CLUSTER_CONF if cluster else {})}
    if shuffle_partitions and not cluster:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    The cluster setting always wins.  Only a local master without one (tests)
    gets a private scratch folder; elsewhere executors would not share it, so
    its absence is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote (Connect) sessions have no SparkContext
        if not configured:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share") from None
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = configured or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="pricelab-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table inside the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), "tables", name)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a scratch table once nothing reads it any more (only inside the scratch folder)."""
    root = os.path.join(ensure_checkpoint_dir(spark), "tables") + "/"
    if not path.startswith(root):
        raise ValueError(f"{path} is no scratch table")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors, which need it for every function that runs in Python.

    The sources go once for each application, as a zip file in the shared folder, to ``addPyFile``.
    Remote (Connect) sessions have no SparkContext; there the package must be installed on the cluster."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001
        return
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                file = os.path.join(folder, name)
                out.write(file, os.path.relpath(file, os.path.dirname(root)))
    code = held.getvalue()
    path = scratch_path(spark, f"{os.path.basename(root)}-{hashlib.sha256(code).hexdigest()[:16]}-{sc.applicationId}.zip")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(code))
    finally:
        stream.close()
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


_SHIPPED: set[str] = set()
