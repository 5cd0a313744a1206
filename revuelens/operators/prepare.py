"""From filtered raw reviews to model-ready rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revuelens.functions.scalars import helpfulness
from revuelens.functions.text import clean_text, word_count
from revuelens.operators.filters import filter_length, filter_reviews
from revuelens.operators.joins import join_lookup
from revuelens.operators.ranks import exact_quantiles, number_distinct
from revuelens.operators.sampling import stratified_sample, stratified_split
from revuelens.session import materialize

STRATUM = ["product_category", "star_rating"]


def with_helpfulness(df: DataFrame) -> DataFrame:
    return df.withColumn("helpfulness_ratio", helpfulness())


def with_lengths(df: DataFrame) -> DataFrame:
    """Character and word counts of body and headline."""
    return df.select(
        "*",
        F.length("review_body").alias("review_body_len"),
        word_count(F.col("review_body")).alias("review_body_words"),
        F.length("review_headline").alias("review_headline_len"),
        word_count(F.col("review_headline")).alias("review_headline_words"),
    )


def with_clean_text(df: DataFrame) -> DataFrame:
    """Cleaned body and headline; a missing headline reads ``no headline``."""
    headline = F.coalesce(F.col("review_headline"), F.lit("no headline"))
    return df.select(
        "*",
        clean_text(F.col("review_body")).alias("clean_body"),
        clean_text(headline).alias("clean_headline"),
    )


def cleaning_report(df: DataFrame) -> DataFrame:
    """How many bodies and headlines are empty after cleaning."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.length("clean_body") == 0).alias("empty_bodies"),
        F.count_if(F.length("clean_headline") == 0).alias("empty_headlines"),
    )


def impute_by_group(
    df: DataFrame, column: str, keys: Sequence[str] = STRATUM, default: float = 0.0
) -> DataFrame:
    """Replace nulls by the exact median of the group, then by ``default``."""
    medians = exact_quantiles(df, keys, column, [0.5]).select(
        *keys, F.element_at("quantiles", 1).alias("_median")
    )
    joined = join_lookup(df, medians, keys, "left")
    filled = F.coalesce(F.col(column), F.col("_median"), F.lit(default))
    return joined.withColumn(column, filled).drop("_median")


def category_codes(df: DataFrame, column: str = "product_category") -> DataFrame:
    """Dictionary of a text column: value and its alphabetical index from 0."""
    return number_distinct(df, column, "category_encoded")


def encode_category(
    df: DataFrame, codes: DataFrame | None = None, column: str = "product_category"
) -> DataFrame:
    codes = category_codes(df, column) if codes is None else codes
    return join_lookup(df, codes, [column], "left")


def decode_category(df: DataFrame, codes: DataFrame, column: str = "product_category") -> DataFrame:
    """Add the category name of each ``category_encoded``."""
    return join_lookup(df, codes.select("category_encoded", column), ["category_encoded"], "left")


def standardize(df: DataFrame, columns: dict[str, str], fit_on: DataFrame | None = None) -> DataFrame:
    """Add ``(x - mean) / population std`` for each ``{source: output}`` column.

    The moments are those of ``fit_on`` (default: of ``df``), as one scalar
    subquery; a constant column is only centred.
    """
    parts = []
    for c in columns:
        parts += [F.avg(c), F.stddev_pop(c)]
    moments = (df if fit_on is None else fit_on).agg(F.array(*parts)).scalar()
    outputs = []
    for i, (source, output) in enumerate(columns.items()):
        std = moments[2 * i + 1]
        scale = F.when(std == 0, F.lit(1.0)).otherwise(std)
        outputs.append(((F.col(source) - moments[2 * i]) / scale).alias(output))
    return df.select("*", *outputs)


def clean_reviews(df: DataFrame, min_total_votes: int, exclude_vine: bool = False) -> DataFrame:
    """Filter, measure, clean, impute and encode; every step of the row stage.

    The texts are read and cleaned in one pass whose result is stored. The medians
    and the category codes then come from narrow columns of the stored table.
    """
    kept = filter_reviews(df, min_total_votes, exclude_vine=exclude_vine)
    cleaned = with_clean_text(filter_length(with_lengths(with_helpfulness(kept))))
    usable = (F.length("clean_body") > 0) & (F.length("clean_headline") > 0)
    stored = materialize(cleaned.withColumn("_usable", usable))
    # Medians are those of all rows in the length band, as are the codes.
    encoded = encode_category(impute_by_group(stored, "helpfulness_ratio"))
    return encoded.filter("_usable").drop("_usable")


def prepare(
    df: DataFrame, min_total_votes: int, per_stratum: int, seed: int, exclude_vine: bool = False
) -> DataFrame:
    """The whole preparation: clean, sample per stratum, split, scale.

    The scaler is fitted on the train rows alone. Medians and category codes are
    taken before, over all clean rows: they describe strata, not the split. The
    sample is stored, because its moments and the split's cuts each read it.
    """
    cleaned = clean_reviews(df, min_total_votes, exclude_vine)
    sample = stratified_sample(cleaned, STRATUM, per_stratum, seed, "review_id")
    words = word_count(F.col("clean_body"))
    sample = materialize(sample.withColumn("review_body_words", words))
    split = stratified_split(sample, STRATUM, (0.8, 0.1, 0.1), seed, "review_id")
    scaled = {"review_body_words": "length_scaled", "helpfulness_ratio": "helpfulness_scaled"}
    return standardize(split, scaled, split.filter("split = 'train'"))
