"""Joins of statistics, dictionary and lookup tables onto rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which null keys match each other, as they do in a group-by.

    The key columns appear once, with the left side's values.
    """
    if not keys:
        raise ValueError("null_safe_join needs at least one key")
    renamed = right.select(
        *[F.col(k).alias(f"_right_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    matches: list[Column] = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    joined = left.join(renamed, reduce(lambda a, b: a & b, matches), how)
    return joined.drop(*[f"_right_{k}" for k in keys])


def join_lookup(df: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a per-group table onto rows; null keys match.

    An ordinary equi-join at every size: the session's broadcast limit and adaptive
    execution decide how it runs, and split a hot key where it is not broadcast.
    """
    return null_safe_join(df, lookup, keys, how)
