"""Probabilistic latent space: x = W z + mean + noise, with z standard normal.

The rows are read for their mean and covariance only; expectation and maximisation then
work on those sums alone, so a fit reads the rows no more often however many rounds it takes.
Every row has a normal posterior over z, from which vectors are drawn.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revuelens.functions.vectors import seeded_normals
from revuelens.operators.models import _affine, _joint
from revuelens.operators.vectors import mean_and_covariance


@dataclass
class ProbabilisticLatent:
    """Loadings ``weights`` (width by k), ``mean`` and ``noise``, the variance that z leaves open."""

    weights: np.ndarray
    mean: np.ndarray
    noise: float
    width: int
    n_categories: int
    rounds: int

    @property
    def precision(self) -> np.ndarray:
        """Inverse posterior covariance times the noise."""
        return self.weights.T @ self.weights + self.noise * np.eye(self.weights.shape[1])

    @property
    def covariance(self) -> np.ndarray:
        """Of the posterior, the same for every row."""
        return self.noise * np.linalg.inv(self.precision)


def expectation_maximisation(
    moments: np.ndarray, k: int, max_rounds: int = 2000, tolerance: float = 1e-9, seed: int = 0
) -> tuple[np.ndarray, float, int]:
    """Loadings, noise variance and rounds for a covariance matrix; stops when the likelihood stands still."""
    d = len(moments)
    k = min(k, d - 1)
    scale = max(np.trace(moments) / d, 1e-300)
    weights = np.random.default_rng(seed).normal(size=(d, k)) * np.sqrt(scale)
    noise, before = scale, -np.inf
    for done in range(1, max_rounds + 1):
        inverse = np.linalg.inv(weights.T @ weights + noise * np.eye(k))
        seen = moments @ weights
        better = seen @ np.linalg.inv(noise * np.eye(k) + inverse @ weights.T @ seen)
        noise = max(float(np.trace(moments) - np.sum((seen @ inverse) * better)) / d, 1e-12 * scale)
        weights = better
        now = mean_log_likelihood(moments, weights, noise)
        if now - before < tolerance * max(1.0, abs(now)):
            return weights, noise, done
        before = now
    return weights, noise, max_rounds


def mean_log_likelihood(moments: np.ndarray, weights: np.ndarray, noise: float) -> float:
    """Of rows with these centred second moments, per row."""
    d, k = weights.shape
    inner = weights.T @ weights + noise * np.eye(k)
    log_det = np.linalg.slogdet(inner)[1] + (d - k) * np.log(noise)
    explained = np.sum(np.linalg.solve(inner, weights.T @ moments) * weights.T)
    return float(-0.5 * (d * np.log(2 * np.pi) + log_det + (np.trace(moments) - explained) / noise))


def fit_probabilistic(df: DataFrame, k: int, width: int, n_categories: int, seed: int = 0) -> ProbabilisticLatent:
    """Fitted to the joint [body, head, condition] vectors; rows with a null vector have no part.

    Only a width-by-width matrix leaves the cluster.
    """
    mean, covariance = mean_and_covariance(_joint(df, n_categories).filter("_joint is not null"), "_joint")
    weights, noise, rounds = expectation_maximisation(np.asarray(covariance), k, seed=seed)
    return ProbabilisticLatent(weights, np.asarray(mean), noise, width, n_categories, rounds)


def posterior(model: ProbabilisticLatent, df: DataFrame) -> DataFrame:
    """Add ``latent`` (posterior mean) and ``latent_kl``, its divergence from the prior; null vectors give null."""
    to_mean = np.linalg.solve(model.precision, model.weights.T).T
    project = _affine(to_mean, -model.mean @ to_mean)
    spread = model.covariance
    k = len(spread)
    constant = float(np.trace(spread) - k - np.linalg.slogdet(spread)[1])
    squares = F.aggregate("latent", F.lit(0.0), lambda t, x: t + x * x)
    rows = _joint(df, model.n_categories).withColumn("latent", project("_joint")).drop("_joint")
    return rows.withColumn("latent_kl", (squares + constant) / 2)


def sample_posterior(model: ProbabilisticLatent, df: DataFrame, seed: int, id_column: str = "review_id") -> DataFrame:
    """Add ``latent_sample``: ``latent`` plus a seeded draw with the posterior's covariance."""
    root = np.linalg.cholesky(model.covariance)
    shake = _affine(root.T, np.zeros(len(root)))
    noise = df.withColumn("_noise", shake(seeded_normals(id_column, seed, len(root))))
    drawn = F.zip_with("latent", "_noise", lambda m, e: m + e)
    return noise.withColumn("latent_sample", drawn).drop("_noise")


def rebuild(
    model: ProbabilisticLatent, df: DataFrame, latent: str = "latent", body: str = "body_rec", head: str = "head_rec"
) -> DataFrame:
    """Add the vectors of least squared error for a posterior mean: the projection on the loadings' span."""
    gram = model.weights.T @ model.weights
    outward = (model.weights @ np.linalg.solve(gram, model.precision)).T
    return _outward(model, df, latent, outward, body, head)


def expected_vectors(
    model: ProbabilisticLatent, df: DataFrame, latent: str = "latent_sample", body: str = "body_emb", head: str = "head_emb"
) -> DataFrame:
    """Add the vectors that a drawn z stands for, without the noise."""
    return _outward(model, df, latent, model.weights.T, body, head)


def _outward(model: ProbabilisticLatent, df: DataFrame, latent: str, matrix: np.ndarray, body: str, head: str) -> DataFrame:
    w = model.width
    rows = df.withColumn("_rebuilt", _affine(matrix[:, : 2 * w], model.mean[: 2 * w])(latent))
    return rows.withColumns({body: F.slice("_rebuilt", 1, w), head: F.slice("_rebuilt", w + 1, w)}).drop("_rebuilt")


def log_likelihood(model: ProbabilisticLatent, df: DataFrame) -> DataFrame:
    """Add ``log_likelihood`` of each row's joint vector; null vectors give null."""
    d, k = model.weights.shape
    values, axes = np.linalg.eigh(model.weights @ model.weights.T + model.noise * np.eye(d))
    whiten = axes / np.sqrt(values)
    constant = -0.5 * (d * np.log(2 * np.pi) + np.log(values).sum())

    @F.arrow_udf(T.DoubleType())
    def score(rows: pa.Array) -> pa.Array:
        known = rows.is_valid().to_numpy(zero_copy_only=False)
        flat = rows.filter(rows.is_valid()).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        out = np.zeros(len(rows))
        out[known] = constant - 0.5 * np.square((flat - model.mean) @ whiten).sum(axis=1)
        return pa.array(out, pa.float64(), mask=~known)

    return _joint(df, model.n_categories).withColumn("log_likelihood", score("_joint")).drop("_joint")
