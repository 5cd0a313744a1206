"""Operators over embedding columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revuelens.functions.text import words
from revuelens.functions.vectors import (
    cosine,
    l2,
    l2_dist,
    lerp,
    one_hot,
    seeded_normals,
    seeded_step,
    vec_mse,
)

from revuelens.operators.text import release, row_runs, text_bytes


def attach_embeddings(df: DataFrame, embeddings: DataFrame, how: str = "inner") -> DataFrame:
    """Vectors joined to rows by key, whatever the row order."""
    return df.join(embeddings, "review_id", how)


def attach_latents(df: DataFrame, latents: DataFrame, how: str = "inner") -> DataFrame:
    return df.join(latents.select("review_id", "latent"), "review_id", how)


def with_condition(df: DataFrame, n_categories: int, name: str = "condition") -> DataFrame:
    """One-hot category followed by one-hot rating."""
    return df.withColumn(
        name,
        F.concat(
            one_hot(F.col("category_encoded"), n_categories),
            one_hot(F.col("star_rating") - 1, 5),
        ),
    )


def coherence(
    df: DataFrame, by: Sequence[str] = (), a: str = "body_emb", b: str = "head_emb"
) -> DataFrame:
    """Mean and population std of the cosine between two vector columns."""
    sims = df.select(*by, cosine(F.col(a), F.col(b)).alias("_sim"))
    return sims.groupBy(*by).agg(
        F.avg("_sim").alias("coherence"),
        F.stddev_pop("_sim").alias("coherence_std"),
        F.count("_sim").alias("n_pairs"),
    )


def random_coherence(rows: DataFrame, dim: int, seed: int, id_column: str = "review_id") -> DataFrame:
    """Coherence of unrelated normal vectors, one pair per row of ``rows``."""
    pairs = rows.select(
        seeded_normals(id_column, seed, dim).alias("body_emb"),
        seeded_normals(id_column, seed + 1, dim).alias("head_emb"),
    )
    return coherence(pairs)


def embedding_stats(df: DataFrame, vector: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, width and mean, population std, min, max over all elements."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    rows = df.select(*by, wide.alias("_v")).select(
        *by,
        F.size("_v").alias("_n"),
        F.aggregate("_v", F.lit(0.0), lambda t, x: t + x).alias("_sum"),
        F.aggregate("_v", F.lit(0.0), lambda t, x: t + x * x).alias("_sq"),
        F.array_min("_v").alias("_min"),
        F.array_max("_v").alias("_max"),
    )
    n = F.sum("_n")
    mean = F.sum("_sum") / n
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.min("_n").alias("min_width"),
        F.max("_n").alias("max_width"),
        mean.alias("mean"),
        F.sqrt(F.greatest(F.sum("_sq") / n - mean * mean, F.lit(0.0))).alias("std"),
        F.min("_min").alias("min"),
        F.max("_max").alias("max"),
    )


def centroids(df: DataFrame, by: Sequence[str], vector: str = "body_emb") -> DataFrame:
    """Element-wise mean vector per group, merged from partial sums."""
    mean = Summarizer.mean(array_to_vector(F.col(vector)))
    return df.groupBy(*by).agg(
        vector_to_array(mean).alias("centroid"), F.count("*").alias("n_rows")
    )


def centroid_distances(cents: DataFrame, key: str, blocks: int = 16) -> DataFrame:
    """Euclidean distance of every ordered pair of group centroids.

    The matrix is the result, so it has the square of the groups' number of rows;
    filter ``cents`` first where fewer are wanted. Both sides are dealt into blocks
    that meet in an equi-join, so no task gets the whole table.
    """
    own = F.pmod(F.xxhash64(key), F.lit(blocks))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left = cents.select(F.col(key).alias("group_a"), "centroid", own.alias("_i"), every.alias("_j"))
    right = cents.select(F.col(key).alias("group_b"), F.col("centroid").alias("_other"), own.alias("_j"), every.alias("_i"))
    return left.join(right, ["_i", "_j"]).select(
        "group_a", "group_b", l2_dist(F.col("centroid"), F.col("_other")).alias("distance")
    )


def interpolate(ends: DataFrame, a: str, b: str, points: int = 7, keep: Sequence[str] = ()) -> DataFrame:
    """``points`` vectors on the line from ``a`` to ``b`` of every row, with norms."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i / F.lit(float(points - 1)))
    steps = ends.select(*keep, a, b, F.explode(grid).alias("alpha"))
    mixed = steps.select(
        *keep,
        "alpha",
        lerp(F.col(a), F.col(b), F.col("alpha")).alias("vector"),
        l2_dist(F.col(a), F.col(b)).alias("end_distance"),
    )
    return mixed.withColumn("norm", l2(F.col("vector")))


def reconstruction_error(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and population std of body plus headline squared error per group."""
    error = vec_mse(F.col("body_emb"), F.col("body_rec")) + vec_mse(
        F.col("head_emb"), F.col("head_rec")
    )
    rows = df.select(*by, error.alias("_error"))
    return rows.groupBy(*by).agg(
        F.avg("_error").alias("mse"), F.stddev_pop("_error").alias("mse_std"), F.count("*").alias("n")
    )


def reconstruction_cosine(df: DataFrame) -> DataFrame:
    """Mean and population std of the cosine with the reconstruction."""
    rows = df.select(
        cosine(F.col("body_emb"), F.col("body_rec")).alias("_body"),
        cosine(F.col("head_emb"), F.col("head_rec")).alias("_head"),
    )
    return rows.agg(
        F.avg("_body").alias("body_mean"),
        F.stddev_pop("_body").alias("body_std"),
        F.avg("_head").alias("head_mean"),
        F.stddev_pop("_head").alias("head_std"),
    )


# Ends of the linear noise schedule and its number of steps.
BETA_START, BETA_END, NOISE_STEPS = 1e-4, 0.02, 100


def noise_schedule(spark: SparkSession, steps: int = NOISE_STEPS) -> DataFrame:
    """Beta, alpha, running product of alpha and its two roots per step.

    One short row per step, so the running product is a one-task window.
    """
    beta = F.lit(BETA_START) + F.col("step") * F.lit((BETA_END - BETA_START) / (steps - 1))
    upto = W.orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        spark.range(steps)
        .select(F.col("id").cast("int").alias("step"))
        .withColumn("beta", beta)
        .withColumn("alpha", 1 - F.col("beta"))
        .withColumn("alpha_bar", F.product("alpha").over(upto))
        .withColumn("signal", F.sqrt("alpha_bar"))
        .withColumn("noise", F.sqrt(1 - F.col("alpha_bar")))
    )


def add_noise(
    df: DataFrame, vector: str, dim: int, seed: int, id_column: str = "review_id", steps: int = NOISE_STEPS
) -> DataFrame:
    """The vector at a seeded random step of the forward noise process."""
    schedule = noise_schedule(df.sparkSession, steps).select("step", "signal", "noise")
    staged = df.withColumn("step", seeded_step(id_column, seed, steps))
    # The schedule has exactly ``steps`` rows.
    joined = staged.join(F.broadcast(schedule), "step")
    mixed = F.zip_with(
        vector,
        seeded_normals(id_column, seed, dim),
        lambda x, e: F.col("signal") * x.cast("double") + F.col("noise") * e,
    )
    return joined.withColumn("noisy", mixed).drop("signal", "noise")


def embed_text(
    df: DataFrame,
    columns: dict[str, str],
    dim: int,
    id_column: str = "review_id",
    encoder: Callable[[pd.Series], Sequence[Sequence[float]]] | None = None,
) -> DataFrame:
    """Vectors of text columns, ``{text column: vector column}``, keyed by id.

    The default is a signed hash of words and word pairs, normalised to length
    one. ``encoder`` plugs in a model: it gets a batch of texts and returns one
    vector for each.
    """
    if encoder is not None:
        return _encode_with(df, columns, id_column, encoder)
    found = {v: words(F.lower(F.col(text))) for text, v in columns.items()}
    return df.select(id_column, *[_hashed_unit(dim)(items).alias(v) for v, items in found.items()])


def _hashed_unit(dim: int):
    """Arrow-batched signed hash of an array of words and of its neighbouring pairs.

    A vector depends on its own row only, so nothing is grouped; null and empty
    texts have a zero vector.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def hashed(rows: pa.Array) -> pa.Array:
        known: dict[str, int] = {}

        def code(term: str) -> int:
            digest = hashlib.md5(term.encode()).digest()
            return int.from_bytes(digest[:4]) % dim * 2 + (digest[4] < 128)

        out = np.zeros((len(rows), dim))
        for i, items in enumerate(rows.to_pylist()):
            if not items:
                continue
            # Words come again within a batch, pairs seldom do.
            known.update((w, code(w)) for w in set(items).difference(known))
            codes = [known[w] for w in items] + [code(f"{a} {b}") for a, b in pairwise(items)]
            counts = np.bincount(codes, minlength=2 * dim)
            out[i] = counts[1::2] - counts[::2]
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        unit = (out / np.where(length > 0, length, 1.0)).astype(np.float32)
        ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dim)
        return pa.ListArray.from_arrays(ends, pa.array(unit.ravel()))

    # Else a filter that an explode of the vector implies would run it a second time.
    return hashed.asNondeterministic()


def _encode_with(df: DataFrame, columns: dict[str, str], id_column: str, encoder) -> DataFrame:
    fields = [df.schema[id_column]] + [
        T.StructField(v, T.ArrayType(T.FloatType())) for v in columns.values()
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A run of texts at a time; the encoder may take much more memory than its texts.
        try:
            for batch in batches:
                for start, stop in row_runs(np.sum([text_bytes(batch.column(c)) for c in columns], axis=0)):
                    part = batch.slice(start, stop - start)
                    out = [part.column(id_column)]
                    for text in columns:
                        found = encoder(part.column(text).fill_null("").to_pandas())
                        out.append(pa.array([np.asarray(v, dtype=np.float32) for v in found], pa.list_(pa.float32())))
                    yield pa.RecordBatch.from_arrays(out, [id_column, *columns.values()])
        finally:
            release()

    return df.select(id_column, *columns).mapInArrow(run, T.StructType(fields))


def mean_and_covariance(df: DataFrame, vector: str):
    """Mean vector and sample covariance matrix of a vector column (NumPy).

    Only the width of the vectors decides what reaches the driver.
    """
    rows = df.select(array_to_vector(F.col(vector)).alias("v"))
    summary = rows.select(Summarizer.metrics("mean", "std").summary(F.col("v")).alias("s")).first()["s"]
    std = summary["std"].toArray()
    corr = Correlation.corr(rows, "v").first()[0].toArray()
    # A constant element has no correlation and no covariance.
    return summary["mean"].toArray(), np.nan_to_num(corr) * np.outer(std, std)


def fit_projection(df: DataFrame, vector: str, k: int) -> tuple[PCAModel, list[float]]:
    """Principal axes of a vector column and its mean."""
    rows = df.select(array_to_vector(F.col(vector)).alias("_vec"))
    mean = rows.select(Summarizer.mean(F.col("_vec"))).first()[0]
    model = PCA(k=k, inputCol="_vec", outputCol="_proj").fit(rows)
    return model, [float(x) for x in mean.toArray()]


def project_2d(df: DataFrame, vector: str = "body_emb") -> DataFrame:
    """Centred 2-d projection of a vector column, with the variance share of each axis."""
    model, mean = fit_projection(df, vector, 2)
    axes = model.pc.toArray()
    centre = [float(x) for x in mean @ axes]
    share = [float(x) for x in model.explainedVariance.toArray()]
    projected = model.transform(df.withColumn("_vec", array_to_vector(F.col(vector))))
    xy = vector_to_array(F.col("_proj"))
    return projected.withColumn("_xy", xy).select(
        *df.columns,
        (F.col("_xy")[0] - centre[0]).alias("pc1"),
        (F.col("_xy")[1] - centre[1]).alias("pc2"),
        F.lit(share[0]).alias("pc1_share"),
        F.lit(share[1]).alias("pc2_share"),
    )
