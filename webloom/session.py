"""Session helpers shared by all operators."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Arrow batches hold whole texts, and vectorised functions take several times a batch's size.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20)}

#: Python workers live on between stages; these make them give back what their arrays took.
_MALLOC = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(1 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when the driver runs from another folder, and bound their batches.

    Batch sizes that the session sets itself stay.
    """
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    env.update({k: v for k, v in _MALLOC.items() if k not in os.environ})
    for name, value in _BATCHES.items():
        if not spark._jsparkSession.sessionState().conf().contains(name):
            spark.conf.set(name, value)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """df, a plain scan, dealt out over all cores where it has fewer tasks than there are cores, as a file of one row group has.

    A table of more tasks is left as it is, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df in eight tasks a core at least, by a hash of ``key``: for rows of which a few take very long, so that all cores end together."""
    tasks = max(8 * df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution().toRdd().getNumPartitions())
    return df.repartition(tasks, key)


#: Folders made within ``scratch``, innermost last.
_made: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that all executors share.

    The cluster names that folder in spark.checkpoint.dir; only where it is unset and everything runs on one
    machine (tests), a temporary folder takes its place.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="webloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/webloom-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows, read back from a table in the shared folder: lineage ends here."""
    path = path or shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables that are made inside it, once what needs them has been written elsewhere."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            delete(spark, path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as readers outside Spark need it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
