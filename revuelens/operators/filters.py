"""Row filters and the retention they cause."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns a review must have to be used.
REQUIRED = ["star_rating", "review_body", "review_headline", "product_category"]


def _holds(condition: Column) -> Column:
    """Condition with unknown read as false."""
    return F.coalesce(condition, F.lit(False))


def keep_conditions(
    min_total_votes: int,
    verified: bool = True,
    require: Sequence[str] = REQUIRED,
    exclude_vine: bool = False,
) -> dict[str, Column]:
    """The filters of ``filter_reviews`` by name, in the order they apply."""
    conditions: dict[str, Column] = {}
    if verified:
        conditions["verified"] = F.col("verified_purchase") == "Y"
    conditions["voted"] = F.col("total_votes") >= min_total_votes
    if require:
        present = [F.col(c).isNotNull() for c in require]
        conditions["complete"] = reduce(lambda a, b: a & b, present)
    if exclude_vine:
        conditions["not_vine"] = F.col("vine").isNull() | (F.col("vine") != "Y")
    return conditions


def filter_reviews(
    df: DataFrame,
    min_total_votes: int,
    verified: bool = True,
    require: Sequence[str] = REQUIRED,
    exclude_vine: bool = False,
) -> DataFrame:
    """Verified, sufficiently voted and complete reviews."""
    for condition in keep_conditions(min_total_votes, verified, require, exclude_vine).values():
        df = df.filter(condition)
    return df


def length_condition(words: str = "review_body_words", lo: int = 5, hi: int = 300) -> Column:
    return (
        F.col(words).between(lo, hi)
        & F.col("star_rating").isNotNull()
        & F.col("review_body").isNotNull()
        & F.col("review_headline").isNotNull()
    )


def filter_length(
    df: DataFrame, lo: int = 5, hi: int = 300, words: str = "review_body_words"
) -> DataFrame:
    """Reviews of a usable length."""
    return df.filter(length_condition(words, lo, hi))


def drop_empty_text(
    df: DataFrame, columns: Sequence[str] = ("clean_body", "clean_headline")
) -> DataFrame:
    for c in columns:
        df = df.filter(F.length(c) > 0)
    return df


def slice_reviews(
    df: DataFrame, category: str | None = None, rating: int | Sequence[int] | None = None
) -> DataFrame:
    """Reviews of a category, a rating (or several), or both."""
    if category is not None:
        df = df.filter(F.col("product_category") == category)
    if rating is not None:
        wanted = [rating] if isinstance(rating, int) else list(rating)
        df = df.filter(F.col("star_rating").isin(wanted))
    return df


def select_categories(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.filter(F.col("product_category").isin(list(names)))


def retention_report(
    df: DataFrame, stages: Mapping[str, Column], by: Sequence[str] = ("product_category",)
) -> DataFrame:
    """Rows before and after each stage, cumulatively, in one pass.

    One row per group and stage: ``rows_before``, ``rows_after``, ``pct_kept``
    (of the stage's input).
    """
    names = list(stages)
    held, parts = F.lit(True), []
    for name in names:
        held = held & _holds(stages[name])
        parts.append(F.count_if(held).alias(f"_{name}"))
    counted = df.groupBy(*by).agg(F.count("*").alias("_all"), *parts)
    before = ["_all", *[f"_{n}" for n in names[:-1]]]
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i + 1).alias("step"),
                    F.lit(n).alias("stage"),
                    F.col(b).alias("rows_before"),
                    F.col(f"_{n}").alias("rows_after"),
                )
                for i, (n, b) in enumerate(zip(names, before))
            ]
        )
    )
    out = counted.select(*by, rows.alias("r")).select(*by, "r.*")
    pct = F.try_divide(F.col("rows_after") * F.lit(100.0), F.col("rows_before"))
    return out.withColumn("pct_kept", pct)
