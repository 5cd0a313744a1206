"""Expressions over ``array<float|double>`` vectors, computed in double."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from revuelens.functions.scalars import hex_uniform, seeded_hash


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2(a: Column) -> Column:
    squares = F.transform(a, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(_total(squares))


def _squared_gaps(a: Column, b: Column) -> Column:
    def gap(x, y):
        d = x.cast("double") - y.cast("double")
        return d * d

    return _total(F.zip_with(a, b, gap))


def l2_dist(a: Column, b: Column) -> Column:
    return F.sqrt(_squared_gaps(a, b))


def vec_mse(a: Column, b: Column) -> Column:
    return _squared_gaps(a, b) / F.size(a)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when a vector has no length."""
    return F.try_divide(dot(a, b), l2(a) * l2(b))


def vec_concat(*vectors: Column) -> Column:
    return F.concat(*vectors)


def vec_split(vector: Column, width: int) -> tuple[Column, Column]:
    """First ``width`` elements and the rest."""
    return F.slice(vector, 1, width), F.slice(vector, width + 1, F.size(vector) - width)


def one_hot(index: Column, size: int) -> Column:
    """0/1 array of ``size``; all zeros for an index outside it."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.when(i == index, 1.0).otherwise(0.0),
    )


def lerp(a: Column, b: Column, alpha: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * (1 - alpha) + y * alpha)


def seeded_normals(id_column: str, seed: int, size: int) -> Column:
    """``size`` standard normals per row from the row's id (Box-Muller on md5)."""

    def pair(j):
        digest = F.md5(
            F.concat(F.col(id_column).cast("string"), F.lit(f"#{seed}#"), j.cast("string"))
        )
        radius = F.sqrt(-2.0 * F.log(1.0 - hex_uniform(digest, 1)))
        angle = hex_uniform(digest, 13) * (2.0 * math.pi)
        return F.array(radius * F.cos(angle), radius * F.sin(angle))

    pairs = F.transform(F.sequence(F.lit(0), F.lit((size - 1) // 2)), pair)
    return F.slice(F.flatten(pairs), 1, size)


def seeded_step(id_column: str, seed: int, steps: int) -> Column:
    """A step number 0..steps-1 per row from the row's id."""
    digest = seeded_hash(id_column, seed, "#step")
    return F.floor(hex_uniform(digest) * steps).cast("int")
