"""The tables behind the usual charts of a review data set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revuelens.operators.joins import join_lookup, null_safe_join
from revuelens.operators.ranks import count_values, quantiles_of_counts
from revuelens.schema import RATINGS


def _is(column: str, value: str) -> Column:
    return F.coalesce(F.col(column) == value, F.lit(False))


def scan_profile(df: DataFrame, by: str = "product_category") -> DataFrame:
    """Rows, columns, share of verified purchases and mean rating per group."""
    return df.groupBy(by).agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        (F.avg(_is("verified_purchase", "Y").cast("int")) * 100.0).alias("verified_pct"),
        F.avg("star_rating").alias("mean_rating"),
    )


def table_summary(df: DataFrame) -> DataFrame:
    """Rows, distinct categories, mean helpfulness and mean words."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("product_category").alias("n_categories"),
        F.avg("helpfulness_ratio").alias("mean_helpfulness"),
        F.avg("review_body_words").alias("mean_words"),
    )


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per non-null value (or combination), largest first, and their share."""
    counts = df.na.drop(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("n"))
    # The total is that of the counted rows, whose exchange it shares; they never meet in one task.
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total).orderBy(F.desc("n"), *columns)


def rating_share(df: DataFrame) -> DataFrame:
    """Count and percent of all rows for each of the five ratings, present or not."""
    one = df.agg(F.count("*").alias("_all"), *[_rated(r).alias(f"_r{r}") for r in RATINGS])
    rows = F.array(*[F.struct(F.lit(r).alias("star_rating"), F.col(f"_r{r}").alias("n")) for r in RATINGS])
    return one.select("_all", F.inline(rows)).select(
        "star_rating", "n", F.try_divide(F.col("n") * 100.0, F.col("_all")).alias("pct")
    )


def rating_by_category(df: DataFrame) -> DataFrame:
    return df.groupBy("product_category", "star_rating").agg(F.count("*").alias("n"))


def _rated(rating: int) -> Column:
    return F.count_if(F.col("star_rating") == rating)


def rating_mix(df: DataFrame) -> DataFrame:
    """Proportion of each rating inside a category, one column per rating."""
    rated = F.count("star_rating")
    return df.groupBy("product_category").agg(
        *[F.coalesce(F.try_divide(_rated(r), rated), F.lit(0.0)).alias(f"r{r}") for r in RATINGS]
    )


def strata_balance(df: DataFrame) -> DataFrame:
    """Rows per category and rating, with the smallest and largest cell of all."""
    table = df.groupBy("product_category").agg(*[_rated(r).alias(f"r{r}") for r in RATINGS])
    cells = [F.col(f"r{r}") for r in RATINGS]
    ends = table.agg(F.array(F.min(F.least(*cells)), F.max(F.greatest(*cells)))).scalar()
    return table.select("*", ends[0].alias("min_cell"), ends[1].alias("max_cell"))


def crosstab_margins(df: DataFrame) -> DataFrame:
    """Category by rating counts with row, column and grand totals (``All``)."""
    counts = (
        df.na.drop(subset=["product_category", "star_rating"])
        .groupBy("product_category", "star_rating")
        .agg(F.count("*").alias("n"))
    )
    cells = [
        F.coalesce(F.sum(F.when(F.col("star_rating") == r, F.col("n"))), F.lit(0)).alias(f"r{r}")
        for r in RATINGS
    ]
    label = F.when(F.grouping("product_category") == 1, "All").otherwise(F.col("product_category"))
    return (
        counts.rollup("product_category")
        .agg(label.alias("category"), *cells, F.sum("n").alias("r_all"))
        .drop("product_category")
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Type, non-null count, null count and null percent of every column."""
    counted = df.agg(
        F.count("*").alias("_rows"),
        *[F.count(F.col(c)).alias(f"_c{i}") for i, c in enumerate(df.columns)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(kind).alias("type"),
                F.col(f"_c{i}").alias("non_null"),
            )
            for i, (c, kind) in enumerate(df.dtypes)
        ]
    )
    nulls = F.col("_rows") - F.col("non_null")
    return counted.select("_rows", F.inline(rows)).select(
        "column",
        "type",
        "non_null",
        nulls.alias("nulls"),
        F.round(F.try_divide(nulls * F.lit(100.0), F.col("_rows")), 2).alias("null_pct"),
    )


def describe(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """Count, mean, std (n-1), min, exact quantiles and max of a value per group."""
    v = F.col(value).cast("double")
    moments = df.groupBy(*by).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    quantiles = quantiles_of_counts(count_values(df, by, value), by, probs)
    named = [
        F.element_at("quantiles", i + 1).alias(f"p{round(p * 100)}") for i, p in enumerate(probs)
    ]
    quantiles = quantiles.select(*by, *named)
    return null_safe_join(moments, quantiles, by, "left")


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) rows of numeric columns."""
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ]
    return df.select(F.inline(F.array(*pairs)))


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``describe`` of several columns, one row per column."""
    return describe(_long(df, columns), ["column"], "value")


def helpfulness_percentiles(df: DataFrame, by: str = "product_category") -> DataFrame:
    return describe(df, [by], "helpfulness_ratio", (0.1, 0.25, 0.5, 0.75, 0.9))


def length_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and median of each length column."""
    return describe(_long(df, columns), ["column"], "value", [0.5]).select(
        "column", "mean", F.col("p50").alias("median")
    )


def purchase_breakdown(df: DataFrame) -> DataFrame:
    """Rows per verified flag and rating, and their share of all such rows."""
    return value_counts(df, "verified_purchase", "star_rating")


def vine_breakdown(df: DataFrame) -> DataFrame:
    return value_counts(df, "vine")


def box_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and number of outliers per group."""
    counts = count_values(df, by, value)
    quartiles = quantiles_of_counts(counts, by, (0.25, 0.5, 0.75)).select(
        *by,
        F.col("n_values").alias("n_rows"),
        *[F.element_at("quantiles", i).alias(q) for i, q in enumerate(("q1", "median", "q3"), 1)],
    )
    joined = join_lookup(counts, quartiles, by)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    stats = [F.max(c).alias(c) for c in ("n_rows", "q1", "median", "q3")]
    return joined.groupBy(*by).agg(
        *stats,
        F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("n_outliers"),
    )


def histogram(
    df: DataFrame, value: str, bins: int, by: Sequence[str] = (), below: float | None = None
) -> DataFrame:
    """Counts and density in ``bins`` equal bins between the smallest and largest value.

    All groups share the edges; empty bins are listed. ``below`` keeps only
    smaller values. NaN and infinite values have no bin and are left out.
    """
    by = list(by)
    v = F.col(value).cast("double")
    rows = df.select(*by, v.alias("value")).filter(
        F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    )
    if below is not None:
        rows = rows.filter(F.col("value") < below)
    # A single distinct value gets a bin range of one, centred on it.
    flat = F.min("value") == F.max("value")
    ends = rows.agg(
        F.array(
            F.when(flat, F.min("value") - 0.5).otherwise(F.min("value")),
            F.when(flat, F.max("value") + 0.5).otherwise(F.max("value")),
        )
    ).scalar()
    width = (ends[1] - ends[0]) / bins
    slot = F.least(F.floor((F.col("value") - ends[0]) / width), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy(*by, slot.alias("bin")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    frame = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return (
        null_safe_join(frame, counts, [*by, "bin"], "left")
        .withColumn("n", n)
        .select(
            *by,
            "bin",
            (ends[0] + F.col("bin") * width).alias("lo"),
            (ends[0] + (F.col("bin") + 1) * width).alias("hi"),
            "n",
            F.try_divide(F.col("n"), F.col("_total") * width).alias("density"),
        )
    )


def kde(
    df: DataFrame, by: Sequence[str], value: str, points: int = 200, bins: int = 512
) -> DataFrame:
    """Gaussian density on a grid per group, from binned values (Scott bandwidth).

    The grid reaches three bandwidths past the data. After one pass that counts
    bins, the cost depends on ``bins * points`` per group and not on the rows.
    Groups with fewer than two distinct values have no density.
    """
    by = list(by) or ["_all"]
    rows = df.withColumn("_all", F.lit(0)) if by == ["_all"] else df
    rows = rows.select(*by, F.col(value).cast("double").alias("value")).filter(
        F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    )
    stats = (
        rows.groupBy(*by)
        .agg(
            F.count("*").alias("_n"),
            F.min("value").alias("_lo"),
            F.max("value").alias("_hi"),
            (F.stddev_samp("value") * F.pow(F.count("*").cast("double"), F.lit(-0.2))).alias("_bw"),
        )
        .filter(F.col("_bw") > 0)
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.least(F.floor((F.col("value") - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    binned = (
        join_lookup(rows, stats, by)
        .groupBy(*by, "_n", "_lo", "_hi", "_bw", slot.alias("_bin"))
        .agg(F.count("*").alias("_count"))
    )
    start = F.col("_lo") - 3 * F.col("_bw")
    step = (F.col("_hi") - F.col("_lo") + 6 * F.col("_bw")) / (points - 1)
    centre = F.col("_lo") + (F.col("_bin") + 0.5) * width
    grid = binned.select(
        *by,
        "_n",
        "_bw",
        "_count",
        centre.alias("_centre"),
        start.alias("_start"),
        step.alias("_step"),
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"),
    ).withColumn("x", F.col("_start") + F.col("point") * F.col("_step"))
    z = (F.col("x") - F.col("_centre")) / F.col("_bw")
    scale = F.col("_n") * F.col("_bw") * F.sqrt(2 * F.pi())
    density = grid.groupBy(*by, "point", "x").agg(
        F.sum(F.col("_count") * F.exp(-0.5 * z * z) / scale).alias("density")
    )
    return density.drop("_all")


def monthly_trend(df: DataFrame, date: str = "review_date") -> DataFrame:
    """Reviews and mean rating per month end; quiet months are listed."""
    months = (
        df.filter(F.col(date).isNotNull())
        .groupBy(F.last_day(date).alias("month"))
        .agg(F.count("*").alias("n_reviews"), F.avg("star_rating").alias("mean_rating"))
    )
    span = F.sequence(
        F.trunc(F.min("month"), "month"), F.trunc(F.max("month"), "month"), F.expr("interval 1 month")
    )
    calendar = months.agg(F.explode(span).alias("_start")).select(F.last_day("_start").alias("month"))
    return calendar.join(months, "month", "left").select(
        "month", F.coalesce("n_reviews", F.lit(0)).alias("n_reviews"), "mean_rating"
    )


def split_report(df: DataFrame) -> DataFrame:
    """Rows per split and rating, share inside the split, and the split's percent of all."""
    cells = df.groupBy("split", "star_rating").agg(F.count("*").alias("n"))
    in_split = F.sum("n").over(W.partitionBy("split"))
    total = cells.agg(F.sum("n")).scalar()
    return cells.withColumn("split_rows", in_split).select(
        "split",
        "star_rating",
        "n",
        "split_rows",
        (F.col("n") / F.col("split_rows")).alias("share_in_split"),
        (F.col("split_rows") * 100.0 / total).alias("split_pct"),
    )
