"""Small helpers around the session: code path of workers, checkpoints, tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PACKAGE_PARENT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package, and give checkpoints a folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that
    is unset and all runs on one machine a folder of our own is made; elsewhere it is an error.
    """
    sc = spark.sparkContext
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_PARENT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([PACKAGE_PARENT, *paths])
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="granary-checkpoint-"))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage in the shared checkpoint folder.

    Reliable checkpoints outlive executors; local ones do not and are never used here.
    """
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


_collecting: list[list[str]] = []


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of the tables kept inside, to be given to ``free`` when their readers are done."""
    paths: list[str] = []
    _collecting.append(paths)
    try:
        yield paths
    finally:
        _collecting.remove(paths)


def keep(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Write ``df`` to a table in the shared checkpoint folder and read it back.

    Like ``cut``, but columnar and compressed; for results that are read more than once.
    The table goes with ``free``, or when the session's process ends. ``tidy`` removes the
    shuffle files of the write at once; otherwise they stay until the driver collects garbage.
    """
    spark = prepare(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/granary-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, None)
    if tidy:
        spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.set(TIDY, before or "false")
    atexit.register(free, spark, [path])
    for paths in _collecting:
        paths.append(path)
    return spark.read.parquet(path)


def free(spark: SparkSession, paths: list[str]) -> None:
    """Removes kept tables."""
    try:
        jvm = spark.sparkContext._jvm
        for path in paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already; the folder is the cluster's scratch space
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of the data folder.

    A table stored in fewer pieces than there are cores is spread over them first; that
    is a shuffle of a few megabytes. Larger tables are read as they lie.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
