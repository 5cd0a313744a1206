"""Seeded samples, splits, first rows of a group, and request grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revuelens.operators.joins import join_lookup
from revuelens.operators.ranks import order_key, rank_cuts


def stratified_sample(
    df: DataFrame, keys: Sequence[str], n: int, seed: int, id_column: str = "review_id"
) -> DataFrame:
    """Up to ``n`` rows of each stratum, the same rows for the same seed.

    Two narrow passes find each stratum's cut in hash order; the third keeps the
    rows at or before it. Wide rows are filtered, not shuffled.
    """
    cuts = rank_cuts(df, keys, id_column, seed, {"_cut": F.least(F.lit(n), F.col("n_rows"))})
    kept = join_lookup(df, cuts, keys).filter(order_key(id_column, seed) <= F.col("_cut"))
    return kept.drop("_cut")


def sample_n(df: DataFrame, n: int, seed: int, id_column: str = "review_id") -> DataFrame:
    """A simple random sample of at most ``n`` rows."""
    tagged = df.withColumn("_all", F.lit(0))
    return stratified_sample(tagged, ["_all"], n, seed, id_column).drop("_all")


def stratified_split(
    df: DataFrame,
    keys: Sequence[str],
    fractions: Sequence[float],
    seed: int,
    id_column: str = "review_id",
    source: DataFrame | None = None,
) -> DataFrame:
    """Add ``split``: train / val / test shares inside every stratum, in hash order.

    ``source`` may give a cheaper table with the same keys and ids for finding
    the cuts.
    """
    train, val = fractions[0], fractions[0] + fractions[1]
    size = F.col("n_rows")
    ranks = {
        "_train": F.floor(size * F.lit(train) + F.lit(0.5)),
        "_val": F.floor(size * F.lit(val) + F.lit(0.5)),
    }
    cuts = rank_cuts(df if source is None else source, keys, id_column, seed, ranks)
    key = order_key(id_column, seed)
    split = (
        F.when(key <= F.col("_train"), "train").when(key <= F.col("_val"), "val").otherwise("test")
    )
    joined = join_lookup(df, cuts, keys, "left")
    return joined.withColumn("split", split).drop("_train", "_val")


def top_n_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    n: int,
    spread: str,
    parts: int = 64,
) -> DataFrame:
    """First ``n`` rows of each group in the given (total) order.

    Groups are first cut to ``n`` in ``parts`` hashed pieces, so a hot group is
    spread over tasks and the final task sees at most ``n * parts`` of its rows.
    ``spread`` names a column that varies inside a group.
    """
    piece = F.pmod(F.xxhash64(F.col(spread)), F.lit(parts))
    first = W.partitionBy(*keys, "_piece").orderBy(*order)
    last = W.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_piece", piece)
        .withColumn("_row", F.row_number().over(first))
        .filter(F.col("_row") <= n)
        .withColumn("_row", F.row_number().over(last))
        .filter(F.col("_row") <= n)
        .drop("_piece", "_row")
    )


def request_grid(
    categories: DataFrame, ratings: Sequence[int], n: int, limit: int | None = None
) -> DataFrame:
    """``n`` numbered requests for every category and rating.

    ``limit`` keeps the first requests in category and rating order.
    """
    grid = categories.select("product_category").distinct().select(
        "product_category", F.explode(F.array(*[F.lit(r) for r in ratings])).alias("star_rating")
    )
    grid = grid.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("sample_no"))
    if limit is not None:
        grid = grid.orderBy("product_category", "star_rating", "sample_no").limit(limit)
    return grid.withColumn(
        "request_id",
        F.concat_ws("_", "product_category", F.col("star_rating").cast("string"), F.col("sample_no").cast("string")),
    )
