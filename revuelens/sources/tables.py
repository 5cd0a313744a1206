"""Stored tables: Parquet stages, splits, vectors, CSV, text and JSON reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revuelens.schema import EMBEDDED


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _table_name(path: str) -> str:
    return f"revuelens_{hashlib.md5(path.rstrip('/').encode()).hexdigest()}"


def _layout(spark: SparkSession, path: str) -> dict | None:
    """How a bucketed table was written; null for any other folder. No job."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/_layout/part")
    system = place.getFileSystem(conf)
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return json.loads(jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine())
    finally:
        stream.close()


def _keep_layout(spark: SparkSession, path: str, layout: dict) -> None:
    """One short file in a folder that readers of the table pass over."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_layout/part")
    sink = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        sink.write(bytearray((json.dumps(layout) + "\n").encode()))
    finally:
        sink.close()


def _quoted(names: Sequence[str]) -> str:
    return ", ".join("`" + n.replace("`", "``") + "`" for n in names)


def write_bucketed(
    df: DataFrame,
    path: str,
    key: str,
    buckets: int | None = None,
    partition_by: Sequence[str] = (),
    mode: str = "error",
) -> None:
    """A Parquet table in which rows of one ``key`` lie in one of ``buckets`` files, in its order.

    Tables with the same number of buckets join by ``key`` without moving a row. The number
    is the session's ``spark.sql.shuffle.partitions`` unless given; a table that is appended
    to keeps its own. Rows are moved once, here, so each task writes one file per
    partition value. The folder says how it was written, and needs no catalogue that outlives
    the session; other readers see plain Parquet. Null keys share a bucket.
    """
    spark = df.sparkSession
    held = _layout(spark, path) if mode == "append" else None
    if held:
        buckets, key, partition_by = held["buckets"], held["key"], held["partition_by"]
        read_bucketed(spark, path)
    else:
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(f"drop table if exists {_table_name(path)}")
    sink = df.repartition(buckets, key).write.mode(mode).format("parquet").option("path", path)
    if partition_by:
        sink = sink.partitionBy(*partition_by)
    sink.bucketBy(buckets, key).sortBy(key).saveAsTable(_table_name(path))
    layout = {"buckets": buckets, "key": key, "partition_by": list(partition_by), "schema": df.schema.jsonValue()}
    _keep_layout(spark, path, held or layout)


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``write_bucketed``, with its buckets known to the planner."""
    layout = _layout(spark, path)
    if layout is None:
        raise ValueError(f"{path} holds no bucketed table")
    name, key = _table_name(path), _quoted([layout["key"]])
    fields = ", ".join(
        f"{_quoted([f.name])} {f.dataType.simpleString()}" for f in T.StructType.fromJson(layout["schema"]).fields
    )
    parted = f"partitioned by ({_quoted(layout['partition_by'])})" if layout["partition_by"] else ""
    location = path.replace("\\", "\\\\").replace("'", "\\'")
    # The table points to the folder; dropping it leaves the files.
    spark.sql(f"drop table if exists {name}")
    spark.sql(
        f"create table {name} ({fields}) using parquet {parted} "
        f"clustered by ({key}) sorted by ({key}) into {layout['buckets']} buckets location '{location}'"
    )
    if parted:
        spark.sql(f"alter table {name} recover partitions")
    return spark.table(name)


def _write_by_id(df: DataFrame, path: str, partition_by: Sequence[str], mode: str, key: str, buckets: int | None) -> None:
    if key in df.columns:
        write_bucketed(df, path, key, buckets, partition_by, mode)
    else:
        write_table(df, path, partition_by, mode)


def _read_either(spark: SparkSession, path: str) -> DataFrame:
    return read_bucketed(spark, path) if _layout(spark, path) else spark.read.parquet(path)


def write_splits(
    df: DataFrame, path: str, mode: str = "error", key: str = "review_id", buckets: int | None = None
) -> None:
    """One folder per split, so reading one split touches only its files.

    Inside, rows are bucketed by ``key`` where the table has it, so a split joins
    vectors and latents of the same number of buckets where they lie.
    """
    _write_by_id(df, path, ["split"], mode, key, buckets)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return _read_either(spark, path).filter(F.col("split") == split)


def write_embeddings(df: DataFrame, path: str, mode: str = "error", buckets: int | None = None) -> None:
    """Both vectors of each review, bucketed by ``review_id``."""
    write_bucketed(df.select("review_id", "body_emb", "head_emb"), path, "review_id", buckets, (), mode)


def read_embeddings(spark: SparkSession, path: str, id_type: str = "string") -> DataFrame:
    """Vectors by ``review_id``; ``id_type`` is the type that ids of a plain Parquet folder have."""
    if _layout(spark, path):
        return read_bucketed(spark, path)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EMBEDDED.fields[1:])
    return spark.read.schema(f"review_id {id_type}, {fields}").parquet(path)


def write_latents(df: DataFrame, path: str, mode: str = "error", buckets: int | None = None) -> None:
    """The latent vector of each review, bucketed by ``review_id``."""
    write_bucketed(df.select("review_id", "latent"), path, "review_id", buckets, (), mode)


def read_latents(spark: SparkSession, path: str) -> DataFrame:
    return read_bucketed(spark, path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).options(header=True, quote='"', escape='"').csv(path)


def sample_block() -> Column:
    """Readable block of a generated review (fixed format)."""
    return F.format_string(
        "[%s, %d, Q:%.2f]\n%s\n", "category", "star_rating", "gan_quality", "text"
    )


def write_text(df: DataFrame, path: str, block: Column | None = None, mode: str = "error") -> None:
    """One formatted block per row."""
    rows = df.select((sample_block() if block is None else block).alias("value"))
    rows.write.mode(mode).text(path)


def write_report(scalars: DataFrame, path: str, mode: str = "error") -> None:
    """A one-row table of summary scalars as JSON."""
    scalars.write.mode(mode).json(path)
