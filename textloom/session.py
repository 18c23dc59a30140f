"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = 8, partitions: int = 8, app: str = "textloom") -> SparkSession:
    """A local session with the settings the test-suite and bench rely on."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")  # small inputs still use all cores
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TEXTLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; any Spark-readable path works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Used only by local sessions that name no shared folder (tests, notebooks).
FALLBACK_SHARED_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    On a cluster that setting must be there, as a machine's own folder is no shared one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = FALLBACK_SHARED_DIR
    return path.rstrip("/")


#: What this process has stored and not dropped.
_STORED: list[str] = []


def drop_stored(spark: SparkSession) -> int:
    """Delete the tables that this process stored, once no result that reads them is needed; returns how many."""
    n = len(_STORED)
    while _STORED:
        _delete(spark, _STORED.pop())
    return n


def keep(path: str) -> str:
    """Note a folder that this process writes itself, so that `drop_stored` deletes it too; returns it."""
    _STORED.append(path)
    return path


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, such as those of an earlier round."""
    for df in tables:
        if df.stored_at in _STORED:
            _STORED.remove(df.stored_at)
            _delete(df.sparkSession, df.stored_at)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage: later reads survive lost executors, and nothing is computed
    twice. Rows are as they were written, so an operator may rely on values
    that another evaluation could produce in another order.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom-{uuid.uuid4().hex}"
    _STORED.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


#: Rows of an Arrow batch that goes to Python: texts of some kilobytes each make a few megabytes.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of no more than ``BATCH_ROWS`` rows in this session, so that what tasks hold outside the heap stays small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """Prepare an input of Python stages: small batches, and few parts are dealt over all cores.

    A small file is often one row group and would keep one core busy. Inputs with
    at least as many parts as cores are left as they are, without a shuffle.
    """
    small_batches(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
