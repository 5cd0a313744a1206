"""Exact ranks, cumulative counts and quantiles without a one-task group.

A plain ``row_number`` or ``percentile`` sends a whole group to one task. Here
rows are first counted in ordered buckets; the running totals of the (few)
buckets place each bucket, and only rows of one bucket are ordered together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revuelens.functions.scalars import seeded_hash
from revuelens.operators.joins import join_lookup, null_safe_join
from revuelens.session import materialize

_STEPS = 1024  # buckets per doubling of the value
_SHIFT = 1100 * _STEPS  # above the exponent of the smallest double
_END = 1 << 40  # bucket of infinity
_VALUES = 1024  # distinct values that a part of a bucket holds if they lie evenly


def _bucket(value: Column) -> Column:
    """Order-preserving bucket number of a double; a bucket is 0.07 % wide, 0 and the infinities are their own."""
    size = F.when(F.abs(value) == float("inf"), F.lit(_END)).otherwise(
        F.floor(F.log2(F.when(F.abs(value) < float("inf"), F.abs(value)).otherwise(1.0)) * _STEPS) + _SHIFT
    )
    size = size.cast("long")
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("long"))


def count_values(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows per (by, value): ``value`` as double without nulls and NaN, and ``n``."""
    v = F.col(value).cast("double")
    return (
        df.select(*by, v.alias("value"))
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy(*by, "value")
        .agg(F.count("*").alias("n"))
    )


def cumulative_counts(
    counts: DataFrame, by: Sequence[str], measures: Sequence[str] = ("n",)
) -> DataFrame:
    """Add ``cum_<m>`` (up to and with the value) and ``total_<m>`` per group.

    ``counts`` has one row per (by, value). Buckets are totalled and ordered first;
    there are some thousand of them per group whatever the number of rows. A bucket
    with many values is cut again, evenly between its smallest and its largest, so
    values that all lie close together spread as well. Then values are ordered
    inside their part only.
    """
    by = list(by)
    coarse = counts.withColumn("_wide", _bucket(F.col("value")))
    extent = coarse.groupBy(*by, "_wide").agg(
        F.min("value").alias("_low"), F.max("value").alias("_high"), F.ceil(F.count("*") / _VALUES).alias("_parts")
    )
    several = (F.col("_parts") > 1) & (F.col("_high") > F.col("_low"))
    part = F.floor((F.col("value") - F.col("_low")) / (F.col("_high") - F.col("_low")) * F.col("_parts"))
    rows = null_safe_join(coarse, extent, [*by, "_wide"]).select(
        *counts.columns, F.struct("_wide", F.when(several, part).otherwise(0).cast("long").alias("_part")).alias("_bucket")
    )
    # Without keys the one group is the bucket table, never the rows.
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    earlier = group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*by, "_bucket")
        .agg(*[F.sum(m).alias(m) for m in measures])
        .select(
            *by,
            "_bucket",
            *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_before_{m}") for m in measures],
            *[F.sum(m).over(group).alias(f"total_{m}") for m in measures],
        )
    )
    # A bucket's offsets enter its window as a leading row, so values move once
    # and null keys meet without a join.
    values = rows.select(
        *by,
        "_bucket",
        "value",
        *measures,
        *[F.lit(None).cast("long").alias(f"_before_{m}") for m in measures],
        *[F.lit(None).cast("long").alias(f"total_{m}") for m in measures],
    )
    leading = offsets.select(
        "*",
        F.lit(None).cast("double").alias("value"),
        *[F.lit(0).cast("long").alias(m) for m in measures],
    )
    upto = (
        W.partitionBy(*by, "_bucket")
        .orderBy(F.col("value").asc_nulls_first())
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    ranked = values.unionByName(leading).select(
        *counts.columns,
        *[(F.sum(m).over(upto) + F.max(f"_before_{m}").over(upto)).alias(f"cum_{m}") for m in measures],
        *[F.max(f"total_{m}").over(upto).alias(f"total_{m}") for m in measures],
    )
    return ranked.filter(F.col("value").isNotNull())


def quantiles_of_counts(
    counts: DataFrame, by: Sequence[str], probs: Sequence[float]
) -> DataFrame:
    """``quantiles`` array per group, linear between neighbours, from value counts."""
    ranked = cumulative_counts(counts, by)
    picks, shares = [], []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("total_n") - 1)
        for name, rank in ((f"_lo{i}", F.floor(position)), (f"_hi{i}", F.ceil(position))):
            picks.append(F.min(F.when(F.col("cum_n") > rank, F.col("value"))).alias(name))
        shares.append(
            F.col(f"_lo{i}")
            + (F.col(f"_hi{i}") - F.col(f"_lo{i}"))
            * (F.lit(float(p)) * (F.col("n_values") - 1) - F.floor(F.lit(float(p)) * (F.col("n_values") - 1)))
        )
    picked = ranked.groupBy(*by).agg(F.max("total_n").alias("n_values"), *picks)
    return picked.select(*by, "n_values", F.array(*shares).alias("quantiles"))


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]
) -> DataFrame:
    """Exact interpolated quantiles per group; groups without values are absent."""
    return quantiles_of_counts(count_values(df, by, value), by, probs)


def rank_cuts(
    df: DataFrame,
    keys: Sequence[str],
    id_column: str,
    seed: int,
    ranks: Mapping[str, Column],
) -> DataFrame:
    """Per stratum, the (hash, id) found at given ranks of the seeded hash order.

    ``ranks`` maps an output name to an expression over ``n_rows``, the stratum's
    size. A cut lets later passes decide a row's side by comparison alone, so wide
    rows are never moved to be ranked. Rank 0 gives a null cut. ``id_column`` must
    be unique.
    """
    keys = list(keys)
    # As many hex digits as leave about a thousand rows of the stratum to a bucket.
    digits = F.greatest(F.lit(1), F.ceil(F.log2(F.count("*") / 1024.0) / 4)).cast("int")
    sizes = df.groupBy(*keys).agg(digits.alias("_digits"))
    narrow = df.select(*keys, seeded_hash(id_column, seed).alias("_hash"), F.col(id_column).alias("_id"))
    sized = join_lookup(narrow, sizes, keys) if keys else narrow.withColumn("_digits", F.lit(3))
    hashed = sized.withColumn("_bucket", F.expr("substring(_hash, 1, _digits)")).drop("_digits")
    group = W.partitionBy(*keys)
    spans = (
        hashed.groupBy(*keys, "_bucket")
        .agg(F.count("*").alias("_n"))
        .select(
            *keys,
            "_bucket",
            "_n",
            F.sum("_n").over(group.orderBy("_bucket")).alias("_end"),
            F.sum("_n").over(group).alias("n_rows"),
        )
    )
    wanted = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank"))
                for name, rank in ranks.items()
            ]
        )
    )
    hits = (
        spans.select("*", wanted.alias("_want"))
        .filter(
            (F.col("_want.rank") > F.col("_end") - F.col("_n"))
            & (F.col("_want.rank") <= F.col("_end"))
        )
        .select(
            *keys,
            "_bucket",
            F.col("_want.name").alias("_name"),
            (F.col("_want.rank") - F.col("_end") + F.col("_n")).alias("_offset"),
        )
    )
    in_bucket = W.partitionBy(*keys, "_bucket", "_name").orderBy("_hash", "_id")
    found = (
        join_lookup(hashed, hits, [*keys, "_bucket"])
        .withColumn("_row", F.row_number().over(in_bucket))
        .filter(F.col("_row") == F.col("_offset"))
        .groupBy(*keys)
        .agg(
            *[
                F.max(
                    F.when(
                        F.col("_name") == name,
                        F.struct(F.col("_hash").alias("h"), F.col("_id").alias("id")),
                    )
                ).alias(name)
                for name in ranks
            ]
        )
    )
    return found


def order_key(id_column: str, seed: int) -> Column:
    """The value compared with a cut of ``rank_cuts``."""
    return F.struct(seeded_hash(id_column, seed).alias("h"), F.col(id_column).alias("id"))


def number_distinct(df: DataFrame, column: str, name: str) -> DataFrame:
    """Alphabetical 0-based number of each distinct non-null value of a column.

    Values are dealt out by range and stored; one short row per range carries the
    offset, so values with a common beginning spread like any others.
    """
    distinct = df.select(column).filter(F.col(column).isNotNull()).distinct()
    placed = materialize(distinct.repartitionByRange(column).withColumn("_range", F.spark_partition_id()))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    row = F.row_number().over(W.partitionBy("_range").orderBy(column))
    return (
        placed.withColumn("_row", row)
        .join(starts, "_range")
        .select(column, (F.col("_start") + F.col("_row") - 1).cast("int").alias(name))
    )
