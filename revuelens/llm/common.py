"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revuelens.session import materialize

SLICE_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def seeded_sample(df: DataFrame, id_column: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows, chosen by a seeded hash of their id.

    Rows are counted, and cut by their hash to little more than ``n`` before they are
    put in order, so that no task receives more than that.
    """
    total = df.count()
    order = F.xxhash64(id_column, F.lit(seed))
    if total > n:
        share = min(1.0, 1.2 * n / total + 8 / total)
        df = df.filter(F.pmod(order, F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))
    return df.orderBy(order, id_column).limit(n)


def release() -> None:
    """Give back what a worker process holds but no longer uses; processes outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work`` over the batches of a task, and its memory released when the task ends."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def text_slices(batch: pa.RecordBatch, column: int = 1, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about ``limit`` bytes of text each, one row at least."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = np.zeros(n + 1, dtype=np.int64)
    sizes[1:] = np.cumsum([len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(column)])
    start = 0
    while start < n:
        stop = int(np.searchsorted(sizes, sizes[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def utf8(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array as one array, and each row's bounds (null: empty)."""
    array = values.cast(pa.large_binary()) if not pa.types.is_large_binary(values.type) else values
    array = array.fill_null(b"") if array.null_count else array
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _state(edges: DataFrame) -> tuple:
    """Row count and an order-free fingerprint."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum("b")).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of every vertex of ``edges(a, b)``.

    Alternates two steps on the edge table until nothing changes: every vertex
    hands its larger neighbours to its smallest one, then every vertex and its
    smaller neighbours are tied to the smallest. Stars of any size only cost
    their own rows; the rounds grow with the logarithm of the longest chain.
    """
    current = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = _state(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(low, "a")
            .filter("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        # Every row of ``large`` has a > b.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        current = materialize(small)
        before, state = state, _state(current)
        if before == state:
            break
    members = current.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree in the first ``n_keys`` columns, over batch borders.

    Rows must come sorted by those columns, which hold integers without nulls.
    """
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            here = tuple(keys[a].tolist())
            if held and here != key:
                yield pa.Table.from_batches(held)
                held = []
            key = here
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
