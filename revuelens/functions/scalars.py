"""Scalar column expressions over review attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def helpfulness(helpful: str = "helpful_votes", total: str = "total_votes") -> Column:
    """Share of helpful votes; null when there were no votes."""
    return F.try_divide(F.col(helpful).cast("double"), F.col(total).cast("double"))


def parse_date(column: str) -> Column:
    """ISO date, null when the text is not one."""
    return F.try_to_date(F.col(column), "yyyy-MM-dd")


def clip_upper(column: str, limit: int) -> Column:
    """Upper clip that keeps nulls (``least`` alone would skip them)."""
    return F.when(F.col(column).isNotNull(), F.least(F.col(column), F.lit(limit)))


def rating_class(column: str = "star_rating") -> Column:
    return F.col(column) - 1


def class_rating(column: str = "label") -> Column:
    return F.col(column) + 1


def stratum_key(*columns: str) -> Column:
    return F.concat_ws("_", *[F.col(c).cast("string") for c in columns])


def perplexity(loss: Column) -> Column:
    """exp of a mean loss, with the exponent held at 20."""
    return F.exp(F.least(loss, F.lit(20.0)))


def seeded_hash(id_column: str, seed: int, salt: str = "") -> Column:
    """Portable order key: the same hex digest in any engine with md5."""
    return F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f"#{seed}{salt}")))


def hex_uniform(digest: Column, start: int = 1) -> Column:
    """48 bits of a hex digest as a double in [0, 1)."""
    digits = F.conv(F.substring(digest, start, 12), 16, 10)
    return digits.cast("double") / F.lit(float(2**48))
