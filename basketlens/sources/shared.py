"""Intermediate tables on the cluster's shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

#: Folders written by ``materialize`` in this process.
_WRITTEN: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint dir; ``drop_materialized`` deletes it too."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/basketlens/{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint dir and return a fresh scan of
    it. Cuts the lineage: a lost executor costs one stage, and branches that
    read the result see the same rows whatever the plan."""
    path = shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_materialized(spark: SparkSession, keep: int = 0) -> int:
    """Delete the folders that ``materialize`` wrote after the first ``keep``
    (jobs call it once their outputs are written). Returns their number."""
    n = 0
    while len(_WRITTEN) > keep:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def written() -> int:
    """How many folders exist so far (the ``keep`` of a job that starts now)."""
    return len(_WRITTEN)
