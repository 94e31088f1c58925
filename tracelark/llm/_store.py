"""Intermediate tables that survive the loss of executors.

They go to the shared folder that the cluster names in ``spark.checkpoint.dir``. Where it is unset, a local master
(tests, a laptop) gets a folder below /tmp/checkpoints; a cluster gets an error, as its machines share no such folder.

What a returned frame still reads must stay until it is used, so tables are removed when their reader says so (``drop``,
``sweep``) and at the latest when the process ends.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "/tmp/checkpoints/tracelark"
    return base.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return the reread table."""
    return reread(df.sparkSession, store(df, name))


def store(df: DataFrame, name: str) -> str:
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append((df.sparkSession, path))
    df.write.mode("overwrite").parquet(path)
    return path


def reread(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a stored table that no plan needs any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _written[:] = [x for x in _written if x[1] != path]


def since(n: int = 0) -> list[str]:
    """The paths stored after the first n that are still there; since() tells how many there are now."""
    return [path for _, path in _written[n:]]


def sweep(spark: SparkSession, paths: list[str], but: DataFrame) -> None:
    """Delete these tables, except those that `but` reads."""
    needed = {f.rsplit("/", 2)[-2] for f in but.inputFiles()} if paths else set()
    for path in paths:
        if path.rsplit("/", 1)[-1] not in needed:
            drop(spark, path)


@atexit.register
def _at_end() -> None:
    try:
        for spark, path in list(_written):
            if spark.sparkContext._jsc is not None:
                drop(spark, path)
    except Exception:  # the JVM may have gone before; then the folder's owner clears it
        pass
