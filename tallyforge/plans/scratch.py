"""Shared scratch space: where lineage is cut and intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or else the session's own checkpoint folder.

    Where neither is set, only a local session, whose executor is the driver, gets a temporary
    one; on a cluster that is an error, as other executors would not see the files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.conf.get("spark.master", "local").startswith(("local[", "local")) or spark.conf.get("spark.master", "").startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="tallyforge-")
    spark.sparkContext.setCheckpointDir(root)
    return f"file://{root}"


#: The paths that each open scope has handed out, the innermost scope last.
_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """Collects the scratch paths that are handed out within this, so they can be dropped once a result is written."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.remove(made)


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within this, a query's shuffle files go when it has ended, and not only when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it back.

    Cuts the lineage without depending on any executor's local disk: a task that is
    lost later rereads the files. The shuffles behind df are not needed again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
