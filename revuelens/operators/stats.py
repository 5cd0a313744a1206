"""Correlation and two-sample statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revuelens.functions.scalars import clip_upper
from revuelens.operators.ranks import cumulative_counts


def gamma_ratio(z: Column) -> Column:
    """Gamma(z + 1/2) / Gamma(z) for z > 0: twenty steps up, then the series in 1/z."""
    up = z + 20.0
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(19)), F.lit(1.0), lambda p, k: p * (z + k) / (z + k + 0.5))
    # Coefficients of the series.
    series = 1 - 1 / (8 * up) + 1 / (128 * up**2) + 5 / (1024 * up**3) - 21 / (32768 * up**4)
    return steps * F.sqrt(up) * series


def student_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|), by one formula for all degrees of freedom from 1 on.

    With u = sqrt(v) sinh(y / sqrt(v)) the density beyond t becomes cosh(y / sqrt(v)) ** -v, which
    falls at least as fast as the hyperbolic secant and is smooth at a scale of one whatever
    v is, so Simpson's rule over a fixed range has the same small error everywhere.
    """
    v = dof.cast("double")
    root = F.sqrt(v)
    begin = root * F.asinh(F.abs(t) / root)
    # Range and number of steps.
    width, n = 40.0, 4000
    step = width / n

    def height(k: Column) -> Column:
        half = F.sinh((begin + k * step) / (2 * root))
        return F.exp(-v * F.log1p(2 * half * half))

    def add(total: Column, k: Column) -> Column:
        weight = F.when((k == 0) | (k == n), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
        return total + weight * height(k)

    area = F.aggregate(F.sequence(F.lit(0), F.lit(n)), F.lit(0.0), add) * step / 3
    return F.least(F.lit(1.0), 2 * gamma_ratio(v / 2) / F.sqrt(v * math.pi) * area)


def pearson_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation over ``n`` pairs; null below three pairs."""
    spare = 1 - r * r
    t = r * F.sqrt((n - 2) / F.when(spare > 0, spare))
    return F.when(r.isNull() | F.isnan(r) | (n < 3), None).when(spare <= 0, 0.0).otherwise(student_two_sided(t, n - 2))


def length_helpfulness_corr(
    df: DataFrame,
    words: str = "review_body_words",
    ratio: str = "helpfulness_ratio",
    clip: int = 500,
) -> DataFrame:
    """Pearson r of clipped length and helpfulness, pair count and two-sided p.

    The p-value is computed on the single result row.
    """
    pairs = df.select(clip_upper(words, clip).cast("double").alias("x"), F.col(ratio).alias("y"))
    pairs = pairs.na.drop()
    row = pairs.agg(F.corr("x", "y").alias("r"), F.count("*").alias("n_pairs"))
    return row.withColumn("p_value", pearson_p(F.col("r"), F.col("n_pairs")))


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r of every pair below the diagonal, over rows where both are known."""
    pairs = [(b, a) for a, b in combinations(columns, 2)]
    one = df.agg(
        *[
            F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias(f"_{i}")
            for i, (x, y) in enumerate(pairs)
        ]
    )
    rows = [
        F.struct(F.lit(x).alias("row_col"), F.lit(y).alias("col_col"), F.col(f"_{i}").alias("r"))
        for i, (x, y) in enumerate(pairs)
    ]
    return one.select(F.inline(F.array(*rows)))


def _two_sample_counts(df: DataFrame, value: str, first: Column) -> DataFrame:
    """Per distinct value: rows of the first sample ``a`` and of the second ``b``."""
    v = F.col(value).cast("double")
    return (
        df.select(v.alias("value"), first.alias("_first"))
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("value")
        .agg(F.count_if("_first").alias("a"), F.count_if(~F.col("_first")).alias("b"))
    )


def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve; ties count one half. Null without both classes."""
    ranked = cumulative_counts(
        _two_sample_counts(df, score, F.col(label) == 1), [], ["a", "b"]
    )
    wins = F.sum(F.col("a") * (F.col("cum_b") - F.col("b") * 0.5))
    return ranked.agg(
        F.try_divide(wins, F.max("total_a").cast("double") * F.max("total_b")).alias("auc"),
        F.max("total_a").alias("n_pos"),
        F.max("total_b").alias("n_neg"),
    )


EXACT_UP_TO = 10_000  # rows of the larger sample up to which p is exact


def walk_leaves(n: int, m: int, reach: int) -> float:
    """Chance that a random order of ``n`` and ``m`` rows has a gap |x m - y n| of ``reach`` at least.

    Orders are lattice paths; all are equally likely. The mass that is still inside moves one
    row at a time, and what leaves is summed up, so a small chance keeps its digits.
    """
    if reach <= 0:
        return 1.0
    inside = np.zeros(n + 1)
    inside[0], out = 1.0, 0.0
    low, high = 0, 0  # places that hold mass
    for t in range(1, n + m + 1):
        left = n + m - t + 1
        x = np.arange(max(low, t - m), min(high + 1, n) + 1)
        if not len(x):
            return 1.0
        before = t - 1 - x
        stay = np.where((before >= 0) & (x <= high) & (x >= low), inside[x] * (m - before) / left, 0.0)
        come = np.where((x >= 1) & (x - 1 <= high) & (x - 1 >= low), inside[x - 1] * (n - x + 1) / left, 0.0)
        mass = stay + come
        gone = np.abs(x * m - (t - x) * n) >= reach
        out += float(mass[gone].sum())
        mass[gone] = 0.0
        held = np.flatnonzero(~gone)
        if not len(held):
            return min(1.0, out)
        inside[x] = mass
        low, high = int(x[held[0]]), int(x[held[-1]])
    return min(1.0, out)


def ks_two_sample(df: DataFrame, value: str, first: Column, exact_up_to: int = EXACT_UP_TO) -> DataFrame:
    """Largest gap of two empirical distributions, and its p-value.

    Up to ``exact_up_to`` rows in the larger sample p is exact, by a count of paths in the one
    result row; beyond that it is the limit's. Null without rows in both samples.
    """
    ranked = cumulative_counts(_two_sample_counts(df, value, first), [], ["a", "b"])
    gap = F.abs(F.col("cum_a") * F.col("total_b") - F.col("cum_b") * F.col("total_a"))
    row = ranked.agg(
        F.max(F.abs(F.try_divide("cum_a", "total_a") - F.try_divide("cum_b", "total_b"))).alias("statistic"),
        F.max("total_a").alias("n_first"),
        F.max("total_b").alias("n_second"),
        F.max(F.when(F.greatest("total_a", "total_b") <= exact_up_to, gap)).alias("_reach"),
    )

    @F.arrow_udf(T.DoubleType())
    def exact(n: pa.Array, m: pa.Array, reach: pa.Array) -> pa.Array:
        rows = zip(n.to_pylist(), m.to_pylist(), reach.to_pylist(), strict=True)
        return pa.array([None if h is None or not a or not b else walk_leaves(a, b, h) for a, b, h in rows], pa.float64())

    n, m = F.col("n_first").cast("double"), F.col("n_second").cast("double")
    scaled = F.try_divide(F.pow(F.col("statistic"), 2) * n * m, n + m)

    def term(total, k):
        return total + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * scaled)

    series = F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.lit(0.0), term)
    # The alternating series does not settle near zero, where p is 1.
    limit = F.when(scaled < 0.04, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))
    small = F.greatest("n_first", "n_second") <= exact_up_to
    counted = row.withColumn("_exact", exact("n_first", "n_second", "_reach"))
    p = F.when((F.col("n_first") > 0) & (F.col("n_second") > 0), F.when(small, F.col("_exact")).otherwise(limit))
    return counted.withColumn("p_value", p).drop("_reach", "_exact")
