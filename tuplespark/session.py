"""Session construction and the shared scratch location.

Intermediate tables (round trips of sinks, iterative matching rounds) are
written under the folder the cluster names in ``spark.checkpoint.dir``. Only
when nothing is configured (unit tests, a laptop) do we create one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark drops a query's shuffle files as soon as it ends, instead of when the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(app: str = "tuplespark", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Text parsing and edit distances cost far more CPU per byte than a
        # scan: keep coalesced shuffle partitions small so that work spreads.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; set one up only when none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return spark.sparkContext.getCheckpointDir() or configured
    if not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="tuplespark-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tuplespark", f"{name}-{uuid.uuid4().hex}")


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """For writes: the shuffle files behind what is written go when it is written."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under the shared folder and continue from
    the written copy: later stages neither recompute it nor re-plan its
    lineage, read only the columns they need, and a lost executor costs a
    re-read, not a recomputation. With ``partition_by`` a filter on those
    columns reads only their files. The shuffles behind it are dropped."""
    path = scratch_path(df.sparkSession, "table")
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    with dropping_shuffles(df.sparkSession):
        writer.option("compression", "zstd").parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._written = path
    return written


def release(df: DataFrame) -> None:
    """Delete the files of ``df``, as ``materialize`` returned it, once nothing
    reads them any more; else they stay until the checkpoint folder goes."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Make ``tuplespark`` importable in Python workers (once per context).

    Python-side operators (the generator hook, pandas-UDF plug-ins) refer to
    module functions by name, so executors must be able to import the
    package. Clusters usually pass it with ``--py-files``; this does the same
    with ``SparkContext.addPyFile`` from a zip the driver builds of its own
    copy of the package (Spark then distributes it to every executor)."""
    import tempfile as _tf
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_tuplespark_shipped", False):
        return
    import tuplespark
    root = os.path.dirname(os.path.abspath(tuplespark.__file__))
    path = os.path.join(_tf.mkdtemp(prefix="tuplespark-pkg-"), "tuplespark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _dirs, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._tuplespark_shipped = True
