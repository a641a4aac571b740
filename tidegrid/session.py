"""Session helpers: settings for local runs and shared-folder materialisation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_SCOPES: list[list[str]] = []


def local_session(cpus: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidegrid")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local session may fall back to a temporary one."""
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="tidegrid-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


@contextmanager
def table_scope(spark: SparkSession) -> Iterator[None]:
    """Drop the tables written inside when the block ends; results must be consumed or written in it."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; ``keep`` outlives a ``table_scope``.

    Used at decision points that several later branches read. The table
    survives lost executors, keeps column pruning, and its file size lets the
    planner broadcast it only when it is below the broadcast threshold.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidegrid/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)
