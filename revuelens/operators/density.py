"""Conditional density of a number given its stratum: counts, not a neural flow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revuelens.operators.joins import join_lookup, null_safe_join
from revuelens.session import materialize


def _slot(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of a value, with values outside the fitted range in the end bins."""
    position = F.floor((value - lo) / (hi - lo) * bins)
    return F.greatest(F.lit(0), F.least(position, F.lit(bins - 1))).cast("int")


def fit_conditional_density(
    df: DataFrame, by: Sequence[str], value: str, bins: int = 50, smoothing: float = 1.0
) -> DataFrame:
    """Smoothed histogram density of ``value`` per stratum on shared edges.

    One row per stratum and bin: ``lo``, ``hi``, ``n``, ``prob``, ``density``. Every
    bin of a seen stratum is listed, so no value in range has density zero. The
    fitted table is stored: its users read it more than once, the rows only here.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf"))
    )
    flat = F.min("_v") == F.max("_v")
    ends = rows.agg(
        F.array(
            F.when(flat, F.min("_v") - 0.5).otherwise(F.min("_v")),
            F.when(flat, F.max("_v") + 0.5).otherwise(F.max("_v")),
        )
    ).scalar()
    counts = rows.groupBy(*by, _slot(F.col("_v"), ends[0], ends[1], bins).alias("bin")).agg(
        F.count("*").alias("n")
    )
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    frame = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (ends[1] - ends[0]) / bins
    prob = (F.col("n") + smoothing) / (F.col("_total") + smoothing * bins)
    fitted = null_safe_join(frame, counts, [*by, "bin"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )
    return materialize(
        fitted.select(
            *by,
            "bin",
            (ends[0] + F.col("bin") * width).alias("lo"),
            (ends[0] + (F.col("bin") + 1) * width).alias("hi"),
            "n",
            prob.alias("prob"),
            (prob / width).alias("density"),
        )
    )


def _edges(model: DataFrame):
    return model.agg(F.array(F.min("lo"), F.max("hi"), F.max("bin") + 1.0)).scalar()


def _binned(df: DataFrame, model: DataFrame, value: str) -> DataFrame:
    edges = _edges(model)
    v = F.col(value).cast("double")
    position = F.floor((v - edges[0]) / (edges[1] - edges[0]) * edges[2])
    slot = F.greatest(F.lit(0.0), F.least(position.cast("double"), edges[2] - 1)).cast("int")
    return df.withColumn("bin", slot)


def log_density(df: DataFrame, model: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Add the log density of each row's value; null for an unseen stratum."""
    table = model.select(*by, "bin", F.log("density").alias("log_density"))
    return join_lookup(_binned(df, model, value), table, [*by, "bin"], "left").drop("bin")


def loglik_by(
    df: DataFrame,
    model: DataFrame,
    strata: Sequence[str],
    value: str,
    by: Sequence[str],
    min_support: int = 0,
) -> DataFrame:
    """Mean log density per group; null below ``min_support`` rows.

    Rows are counted per stratum and bin first, so only counts meet the model.
    """
    keys = list(dict.fromkeys([*strata, *by]))
    rows = df.filter(F.col(value).isNotNull())
    counts = _binned(rows, model, value).groupBy(*keys, "bin").agg(F.count("*").alias("_n"))
    table = model.select(*strata, "bin", F.log("density").alias("_ll"))
    joined = null_safe_join(counts, table, [*strata, "bin"], "left")
    total = F.sum(F.when(F.col("_ll").isNotNull(), F.col("_n")))
    mean = F.sum(F.col("_ll") * F.col("_n")) / total
    return joined.groupBy(*by).agg(
        F.coalesce(total, F.lit(0)).alias("n"),
        F.when(total >= min_support, mean).alias("mean_loglik"),
    )


def loglik_matrix(
    df: DataFrame, model: DataFrame, value: str, min_support: int = 10
) -> DataFrame:
    """Mean log density by category (rows) and rating (columns ``r1``..``r5``)."""
    keys = ["product_category", "star_rating"]
    cells = loglik_by(df, model, keys, value, keys, min_support)
    return cells.groupBy("product_category").agg(
        *[
            F.max(F.when(F.col("star_rating") == r, F.col("mean_loglik"))).alias(f"r{r}")
            for r in range(1, 6)
        ]
    )


def sample_values(
    requests: DataFrame,
    model: DataFrame,
    by: Sequence[str],
    uniform: Column,
    name: str = "helpfulness",
) -> DataFrame:
    """Draw a value for each request by inverting its stratum's distribution.

    ``uniform`` is a number in [0, 1) per request. A stratum's bins travel as one
    array, at most as long as the number of bins.
    """
    bins = model.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("bin", "lo", "hi", "prob"))).alias("_bins")
    )
    joined = join_lookup(requests.withColumn("_u", uniform), bins, by, "left")
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("value"))

    def step(state, b):
        inside = (F.col("_u") - state["cum"]) / b["prob"]
        hit = state["value"].isNull() & (inside < 1)
        value = F.when(hit, b["lo"] + inside * (b["hi"] - b["lo"])).otherwise(state["value"])
        return F.struct((state["cum"] + b["prob"]).alias("cum"), value.alias("value"))

    drawn = F.aggregate("_bins", start, step)["value"]
    top = F.element_at("_bins", -1)["hi"]
    # Rounding may leave the last bin's end just short of one.
    return joined.withColumn(name, F.coalesce(drawn, top)).drop("_bins", "_u")
