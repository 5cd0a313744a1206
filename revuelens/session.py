"""Session defaults and the places a job may put intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("revuelens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the session's checkpoint folder.

    Only a local session without one gets a folder of its own; on a cluster
    other machines could not read it back.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="revuelens-"))
    return context.getCheckpointDir()


_written: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the stored table.

    Cuts the lineage at a point where several later passes read the same rows;
    readers keep column pruning and filter pushdown, which a row checkpoint
    would lose. ``drop_stored`` deletes what a session has stored.
    """
    path = f"{work_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> int:
    """Delete the tables that this process has stored; frames that read them are void after."""
    conf, dropped = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _written:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        dropped += bool(place.getFileSystem(conf).delete(place, True))
    return dropped


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by ``key`` when a scan has fewer partitions than there are cores.

    One file with one row group cannot be split by reading it in smaller pieces, and
    would have all its texts worked on by a single task. A scan that fills the
    cluster is left alone; the rows are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
