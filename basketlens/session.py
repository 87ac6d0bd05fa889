"""SparkSession construction and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC so hour/day buckets are stable, AQE for
# runtime partition coalescing and skew-join splitting, Arrow for the few
# grouped-map pandas operators.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "basketlens", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the project's defaults.

    ``master`` defaults to ``local[$BENCH_CPUS or *]``; on a cluster the
    launcher's master wins because ``getOrCreate`` keeps an existing one.
    """
    cpus = os.environ.get("BENCH_CPUS", "*")
    builder = SparkSession.builder.appName(app).master(master or f"local[{cpus}]")
    conf = dict(BASE_CONF)
    conf["spark.driver.memory"] = os.environ.get("SPARK_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``. Only a local master
    may leave it unset (a private folder is made); on a cluster each executor
    would write to a disk of its own, so that is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="basketlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cluster_conf(input_bytes: int, executor_cores: int, executors: int,
                 target_partition_bytes: int = 192 << 20) -> dict:
    """Starting sizes for a large cluster: enough shuffle partitions that each
    holds ~``target_partition_bytes`` of the input (AQE then coalesces the
    small ones and splits skewed ones), never fewer than 3 waves of tasks,
    and scan splits of 256 MB."""
    slots = max(1, executor_cores * executors)
    parts = max(3 * slots, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
    }


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``basketlens`` importable in the Python workers (once per
    SparkContext): the package is zipped on the driver and distributed with
    ``addPyFile``, Spark's own file distribution. Needed for the grouped-map
    operators whose functions live in this package."""
    import shutil

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    staging = tempfile.mkdtemp(prefix="basketlens-pkg-")
    archive = shutil.make_archive(os.path.join(staging, "basketlens"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="basketlens")
    sc.addPyFile(archive)
    _SHIPPED.add(key)
