"""Session helpers: a local session for tests, and the stage boundaries the library uses."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "tagloom", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    A folder of our own is made only where none is configured, and then only for a
    local master: on a cluster a machine-local folder would be lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tagloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files.

    Used where the plan would otherwise grow (iterations) or where a small table feeds
    many branches; a lost executor costs a re-read, not a recomputation.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def filed(df: DataFrame) -> DataFrame:
    """As ``stage``, as compressed Parquet files: a fraction of the disk, and a size that joins know when they are planned."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/filed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._filed_at = path
    return kept


def forget(kept: DataFrame) -> None:
    """Remove the files of what ``filed`` returned, once nothing reads them any more."""
    spark = kept.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(kept._filed_at)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more. It does so when the driver's collector
    finds them, which a small driver program may not do for half an hour while rounds fill the disks of the executors."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
