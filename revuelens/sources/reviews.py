"""Typed scan of tab-separated review files."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from revuelens.schema import RAW
from revuelens.sources.lines import MISSING, ReviewLines, file_uri

_TYPES = {f.name: f.dataType for f in RAW.fields}


def _files(spark: SparkSession, paths: Sequence[str]) -> list:
    """Status of every file behind the paths, folders and patterns opened; no job."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(conf)
        for found in system.globStatus(place) or []:
            inside = system.listStatus(found.getPath()) if found.isDirectory() else [found]
            out += [f for f in inside if f.isFile() and f.getPath().getName()[0] not in "._"]
    return out


def _header(spark: SparkSession, file) -> list[str]:
    """Names in the first line of a file, of which only the first bytes are read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    stream = file.getPath().getFileSystem(conf).open(file.getPath())
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(file.getPath())
        plain = stream if codec is None else codec.createInputStream(stream)
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine()
    finally:
        stream.close()
    return [name.strip().strip('"') for name in line.split("\t")] if line else []


def scan_reviews(
    spark: SparkSession,
    paths: Sequence[str],
    columns: Sequence[str] = tuple(RAW.fieldNames()),
    max_rows_per_file: int | None = None,
    layout: Sequence[str] | None = None,
    multi_line: bool = False,
    long_lines: str = "drop",
    missing: Sequence[str] = MISSING,
) -> DataFrame:
    """Wanted columns of review files, by header name, as one table.

    Paths that do not exist are skipped and absent columns are null. Short lines are
    padded with null. ``long_lines`` says what becomes of lines with more fields than the
    header, the extra one empty or not: ``drop``, or ``cut`` to the header's width, which is what
    pandas does when columns are chosen. Texts in ``missing`` are null. A word in a number
    column is null. The driver reads the first line of each file; ``layout`` declares the
    header of all files and saves that. ``max_rows_per_file`` keeps the first rows of each file,
    of which only the head is read. ``multi_line`` allows line breaks inside quotes but keeps a
    file from being split among tasks; so do compression and a cap.
    """
    if long_lines not in ("drop", "cut"):
        raise ValueError("long_lines is drop or cut")
    files = []
    for file in _files(spark, paths):
        names = list(layout) if layout is not None else _header(spark, file)
        files.append((file_uri(file.getPath().toString()), file.getLen(), names))
    schema = T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in columns])
    if not files:
        return spark.createDataFrame([], schema)
    settings = {
        "files": files,
        "max_rows": max_rows_per_file,
        "multi_line": multi_line,
        "drop_long": long_lines == "drop",
        "missing": list(missing),
        "range_bytes": _range_bytes(spark, sum(size for _, size, _ in files)),
    }
    spark.dataSource.register(ReviewLines)
    return spark.read.format(ReviewLines.name()).schema(schema).option("settings", json.dumps(settings)).load()


def _range_bytes(spark: SparkSession, total: int) -> int:
    """As Spark sizes the partitions of a file scan: within its limit, and enough to fill the cores."""
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return max(1 << 16, min(most, -(-total // spark.sparkContext.defaultParallelism)))
