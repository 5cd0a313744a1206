"""Profile state that merges: counts, moments, ends and sketches per group and column.

A state is a small table, one row per group and column. The state of new rows is computed
from them alone and appended; merging states gives what one pass over all rows would:
exactly for counts, mean, deviation and ends, inside ``RANK_ERROR`` for quantiles and
about ``DISTINCT_ERROR`` for the number of different values. ``profile.describe`` stays the
exact way; this is for tables that are only ever added to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parameters of the sketches, and the errors that go with them.
QUANTILE_SIZE, RANK_ERROR = 200, 0.0133
DISTINCT_BITS, DISTINCT_ERROR = 12, 0.016


def profile_state(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``column``, ``n_rows``, ``n``, ``mean``, ``m2``, ``low``, ``high``, ``quantiles``, ``distinct``.

    Numbers have all of these, other types counts and ``distinct`` only. NaN counts as missing.
    One pass with partial aggregation; what is moved is a row per task, group and column.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def cell(name: str):
        value = F.col(name)
        if isinstance(kinds[name], (T.FloatType, T.DoubleType)):
            value = F.when(~F.isnan(value), value)
        number = value.cast("double") if isinstance(kinds[name], T.NumericType) else F.lit(None).cast("double")
        return F.struct(F.lit(name).alias("column"), number.alias("_v"), value.cast("string").alias("_t"))

    long = df.select(*by, F.inline(F.array(*[cell(c) for c in columns])))
    number = F.count("_v")
    return long.groupBy(*by, "column").agg(
        F.count("*").alias("n_rows"),
        F.count("_t").alias("n"),
        number.alias("n_numbers"),
        F.avg("_v").alias("mean"),
        (F.var_pop("_v") * number).alias("m2"),
        F.min("_v").alias("low"),
        F.max("_v").alias("high"),
        F.kll_sketch_agg_double("_v", QUANTILE_SIZE).alias("quantiles"),
        F.hll_sketch_agg("_t", DISTINCT_BITS).alias("distinct"),
    )


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per group and column from any number of them.

    Moments are put together pair by pair, so values far from zero lose no digits; a group's
    states are as many as were appended since the last ``compact_state``.
    """
    moments = F.struct(F.col("n_numbers").alias("n"), "mean", "m2")
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def join(a, b):
        n = a["n"] + b["n"]
        gap = b["mean"] - a["mean"]
        return F.struct(
            n.alias("n"),
            (a["mean"] + gap * b["n"] / n).alias("mean"),
            (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n).alias("m2"),
        )

    merged = states.groupBy(*by, "column").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n").alias("n"),
        F.aggregate(F.sort_array(F.collect_list(F.when(F.col("n_numbers") > 0, moments))), begin, join).alias("_m"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"),
    )
    some = F.col("_m.n") > 0
    return merged.select(
        *by,
        "column",
        "n_rows",
        "n",
        F.col("_m.n").alias("n_numbers"),
        F.when(some, F.col("_m.mean")).alias("mean"),
        F.when(some, F.col("_m.m2")).alias("m2"),
        "low",
        "high",
        "quantiles",
        "distinct",
    )


def summary(state: DataFrame, by: Sequence[str] = (), probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """What a merged state says: counts, nulls, mean, std (n - 1), ends, quantiles and number of values."""
    some = F.col("n_numbers") > 0
    asked = F.array(*[F.lit(float(p)) for p in probs])
    return state.select(
        *by,
        "column",
        "n",
        (F.col("n_rows") - F.col("n")).alias("nulls"),
        "mean",
        F.when(F.col("n_numbers") > 1, F.sqrt(F.col("m2") / (F.col("n_numbers") - 1))).alias("std"),
        F.col("low").alias("min"),
        F.col("high").alias("max"),
        F.when(some, F.kll_sketch_get_quantile_double("quantiles", asked)).alias("quantiles"),
        F.hll_sketch_estimate("distinct").alias("n_distinct"),
    )


def add_to_state(df: DataFrame, path: str, columns: Sequence[str], by: Sequence[str] = ()) -> None:
    """Append the state of new rows; rows that are in it already are not read again."""
    profile_state(df, columns, by).write.mode("append").parquet(path)


def read_state(spark: SparkSession, path: str, by: Sequence[str] = ()) -> DataFrame:
    return merge_states(spark.read.parquet(path), by)


def compact_state(spark: SparkSession, path: str, new_path: str, by: Sequence[str] = ()) -> None:
    """The merged state as a table of its own, with one row per group and column."""
    read_state(spark, path, by).write.parquet(new_path)
