"""Session defaults, the shared scratch folder and lineage cutting."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster bring your own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("voxquarry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="spark-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition rows whose processing is dear although their bytes are few.

    Adaptive execution merges partitions by size; a fixed number of them
    (``spark.sql.shuffle.partitions``) keeps all cores busy.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


ROWS_PER_TASK = 500_000


def spread_rows(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """Hash-partition ``rows`` rows so that a task gets about ``ROWS_PER_TASK``, however many there are.

    For steps that sort or hash a task's rows several times; adaptive execution
    leaves the number alone.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // ROWS_PER_TASK)), *cols)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of the next join, which then shuffles both sides and broadcasts neither.

    Stored tables are planned by the size of their files, which may be a
    thirtieth of their rows in memory.  A table that grows with the input would
    be collected by the driver until its files reach the broadcast threshold.
    """
    return df.hint("merge")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table lies at ``path`` on whatever file system it names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    done = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return done.getFileSystem(conf).exists(done)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), os.path.basename(here))
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
    _SHIPPED.add(sc.applicationId)


_STAGES: dict[str, list[str]] = {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    Columnar files survive the loss of executors, are pruned by later readers
    and tell the optimizer their size, so joins on them are planned well.
    This runs a job at once.  Delete the table with ``drop_stage`` or at the
    end of a ``stage_scope``.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    _STAGES.setdefault(spark.sparkContext.applicationId, []).append(path)
    stored = spark.read.schema(schema).parquet(path)
    stored.stage_path = path
    return stored


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).delete(place, True)


def drop_stage(stored: DataFrame) -> None:
    """Delete a table of ``cut_lineage`` that nothing reads any more."""
    spark, path = stored.sparkSession, stored.stage_path
    _delete(spark, path)
    _STAGES[spark.sparkContext.applicationId].remove(path)


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Delete, on leaving, all stages stored inside; results must be written or collected by then."""
    written = _STAGES.setdefault(spark.sparkContext.applicationId, [])
    before = len(written)
    try:
        yield
    finally:
        for path in written[before:]:
            _delete(spark, path)
        del written[before:]
