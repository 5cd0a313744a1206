"""Spark ML models: topics, rating classifier, realism score, linear latent space."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revuelens.functions.text import tokens
from revuelens.functions.vectors import seeded_normals
from revuelens.operators.joins import join_lookup
from revuelens.operators.metrics import classification_metrics, label_union
from revuelens.operators.vectors import fit_projection, mean_and_covariance, with_condition
from revuelens.session import materialize

# Defaults of the topic model.
TOPICS, TOPIC_ROUNDS, MIN_DOCS, MAX_DOC_SHARE, TOPIC_TERMS = 5, 10, 2, 0.95, 1000
PART_TOKENS = 1 << 21  # of a task, which holds them as objects of some 40 bytes


@dataclass
class TopicModel:
    lda: LDAModel
    vocabulary: list[str]


def fit_topics(
    df: DataFrame,
    text: str,
    seed: int,
    k: int = TOPICS,
    rounds: int = TOPIC_ROUNDS,
    stop_words: Sequence[str] = (),
    id_column: str = "review_id",
    partitions: int | None = None,
    min_docs: int = MIN_DOCS,
    max_doc_share: float = MAX_DOC_SHARE,
    max_terms: int = TOPIC_TERMS,
) -> TopicModel:
    """Online LDA over word counts.

    Terms in fewer than ``min_docs`` texts or more than ``max_doc_share`` of them are
    no terms of the model, and of the others the ``max_terms`` most frequent are.
    The fit depends on how rows lie in partitions, so rows are first ranged and
    sorted by id; ``partitions`` fixes the layout when a run must be repeatable. Without
    it a layout of more than ``PART_TOKENS`` tokens a task is dealt out finer, since the
    counter keeps the tokens of a task in memory.
    """
    bags = df.select(id_column, tokens(F.col(text), stop_words).alias("_tokens"))
    bags = (
        bags.repartitionByRange(partitions, id_column)
        if partitions
        else bags.repartitionByRange(id_column)
    ).sortWithinPartitions(id_column)
    bags = materialize(bags)
    pieces = 0 if partitions else math.ceil((bags.agg(F.sum(F.size("_tokens"))).first()[0] or 0) / PART_TOKENS)
    pieces = pieces if pieces > bags.rdd.getNumPartitions() else 0

    def ranged(rows: DataFrame) -> DataFrame:
        return rows.repartitionByRange(pieces, id_column).sortWithinPartitions(id_column) if pieces else rows

    counter = CountVectorizer(
        inputCol="_tokens", outputCol="features", minDF=min_docs, maxDF=max_doc_share, vocabSize=max_terms
    ).fit(ranged(bags))
    lda = LDA(k=k, maxIter=rounds, optimizer="online", seed=seed).fit(ranged(counter.transform(bags).drop("_tokens")))
    return TopicModel(lda, counter.vocabulary)


def topic_terms(model: TopicModel, n: int = 10) -> DataFrame:
    """The ``n`` heaviest terms of each topic, heaviest first."""
    topics = model.lda.describeTopics(n)
    words = F.array(*[F.lit(w) for w in model.vocabulary])
    pairs = F.arrays_zip("termIndices", "termWeights")
    return topics.select("topic", F.posexplode(pairs).alias("rank", "_t")).select(
        "topic",
        (F.col("rank") + 1).alias("rank"),
        F.get(words, F.col("_t.termIndices")).alias("term"),
        F.col("_t.termWeights").alias("weight"),
    )


def fit_rating_classifier(
    train: DataFrame,
    val: DataFrame,
    vector: str = "body_emb",
    penalties: Sequence[float] = (0.1, 0.01),
    rounds: int = 20,
) -> tuple[LogisticRegressionModel, DataFrame]:
    """Multinomial model of the rating from a vector; the best on ``val`` is kept.

    Also returns the history: (model, epoch, metric, value), one epoch per penalty.
    """
    rows = _labelled(train, vector)
    best, best_accuracy, history = None, -1.0, []
    for epoch, penalty in enumerate(penalties, 1):
        model = LogisticRegression(family="multinomial", regParam=penalty, maxIter=rounds).fit(rows)
        scores = classification_metrics(
            predict_rating(model, val, vector), model.numClasses, "probability"
        ).first()
        for metric in ("accuracy", "f1_macro", "loss"):
            history.append(("rating_classifier", epoch, f"val_{metric}", scores[metric]))
        if scores["accuracy"] > best_accuracy:
            best, best_accuracy = model, scores["accuracy"]
    schema = "model string, epoch int, metric string, value double"
    return best, train.sparkSession.createDataFrame(history, schema)


def _labelled(df: DataFrame, vector: str) -> DataFrame:
    return df.filter(F.col(vector).isNotNull() & F.col("star_rating").isNotNull()).select(
        array_to_vector(F.col(vector)).alias("features"),
        (F.col("star_rating") - 1).cast("double").alias("label"),
    )


def predict_rating(
    model: LogisticRegressionModel, df: DataFrame, vector: str = "body_emb"
) -> DataFrame:
    """Add ``label`` (when rated), ``prediction`` and the class probabilities."""
    rows = df.withColumn("features", array_to_vector(F.col(vector)))
    columns = [F.col(c) for c in df.columns if c not in ("label", "prediction", "probability")]
    if "star_rating" in df.columns:
        columns.append((F.col("star_rating") - 1).cast("int").alias("label"))
    return model.transform(rows).select(
        *columns,
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability").alias("probability"),
    )


REALISM_COLUMNS = ("body_emb", "head_emb", "helpfulness", "category_encoded", "star_rating")


def _realism_features(df: DataFrame, n_categories: int) -> DataFrame:
    conditioned = with_condition(df, n_categories, "_condition")
    parts = F.concat(
        F.col("body_emb").cast("array<double>"),
        F.col("head_emb").cast("array<double>"),
        F.array(F.col("helpfulness").cast("double")),
        F.col("_condition"),
    )
    return conditioned.withColumn("features", array_to_vector(parts)).drop("_condition")


def fit_discriminator(
    real: DataFrame, fake: DataFrame, n_categories: int, rounds: int = 20, penalty: float = 0.01
) -> LogisticRegressionModel:
    """Probability that a row is real, from vectors, helpfulness and condition."""
    rows = _realism_features(label_union(real, fake), n_categories)
    rows = rows.select("features", F.col("label").cast("double").alias("label"))
    return LogisticRegression(family="binomial", regParam=penalty, maxIter=rounds).fit(rows)


def score_realism(
    model: LogisticRegressionModel, df: DataFrame, n_categories: int, name: str = "gan_quality"
) -> DataFrame:
    """Add the probability that a row is real; null where a feature is."""
    rows = df.withColumn("_known", reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in REALISM_COLUMNS]))
    features = _realism_features(rows.filter("_known"), n_categories)
    scored = model.transform(features).select(*df.columns, vector_to_array("probability")[1].alias(name))
    rest = rows.filter("not _known").select(*df.columns, F.lit(None).cast("double").alias(name))
    return scored.unionByName(rest)


@dataclass
class LatentModel:
    """Linear latent space of [body, head, condition]: principal axes and a mean."""

    axes: np.ndarray
    mean: np.ndarray
    width: int
    n_categories: int
    strata: DataFrame


LATENT_KEYS = ["category_encoded", "star_rating"]


def _affine(matrix: np.ndarray, offset: np.ndarray):
    """Arrow-batched ``x @ matrix + offset`` over an array column; null in, null out."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def apply(rows: pa.Array) -> pa.Array:
        known = rows.is_valid().to_numpy(zero_copy_only=False)
        given = rows.filter(rows.is_valid())
        flat = given.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(matrix))
        out = flat @ matrix + offset
        bounds = np.concatenate([[0], np.cumsum(known)]) * out.shape[1]
        ends = pa.array(bounds.astype(np.int32), mask=np.append(~known, False))
        return pa.ListArray.from_arrays(ends, pa.array(out.ravel(), pa.float64()))

    return apply


def _joint(df: DataFrame, n_categories: int) -> DataFrame:
    joint = F.concat(
        F.col("body_emb").cast("array<double>"), F.col("head_emb").cast("array<double>"), F.col("_condition")
    )
    return with_condition(df, n_categories, "_condition").withColumn("_joint", joint).drop("_condition")


def fit_latent(df: DataFrame, k: int, width: int, n_categories: int) -> LatentModel:
    """Principal axes of the joint vectors, and each stratum's latent mean and std.

    A linear stand-in for a variational autoencoder, not a non-linear model.
    """
    model, mean = fit_projection(_joint(df, n_categories), "_joint", k)
    latent = LatentModel(model.pc.toArray(), np.array(mean), width, n_categories, df)
    z = array_to_vector(F.col("latent"))
    stats = Summarizer.metrics("mean", "std").summary(z)
    # Stored with the model: a later call must not encode the fitted rows again.
    latent.strata = materialize(
        encode(latent, df)
        .groupBy(*LATENT_KEYS)
        .agg(stats.alias("_s"))
        .select(
            *LATENT_KEYS,
            vector_to_array("_s.mean").alias("latent_mean"),
            vector_to_array("_s.std").alias("latent_std"),
        )
    )
    return latent


def encode(model: LatentModel, df: DataFrame) -> DataFrame:
    """Add ``latent``: the centred joint vector on the principal axes."""
    project = _affine(model.axes, -model.mean @ model.axes)
    rows = _joint(df, model.n_categories)
    return rows.withColumn("latent", project("_joint")).drop("_joint")


def decode(model: LatentModel, df: DataFrame, body: str = "body_rec", head: str = "head_rec") -> DataFrame:
    """Add body and headline vectors rebuilt from ``latent``."""
    w = model.width
    rebuild = _affine(model.axes.T[:, : 2 * w], model.mean[: 2 * w])
    rows = df.withColumn("_rebuilt", rebuild("latent"))
    return rows.select(
        "*", F.slice("_rebuilt", 1, w).alias(body), F.slice("_rebuilt", w + 1, w).alias(head)
    ).drop("_rebuilt")


def sample_latent(
    model: LatentModel, requests: DataFrame, seed: int, id_column: str = "request_id"
) -> DataFrame:
    """A seeded latent vector around the stratum's mean for each request; null for a stratum not fitted."""
    joined = join_lookup(requests, model.strata, LATENT_KEYS, "left")
    noise = seeded_normals(id_column, seed, model.axes.shape[1])
    shifted = F.zip_with(F.col("latent_std"), noise, lambda s, e: s * e)
    latent = F.zip_with(F.col("latent_mean"), shifted, lambda m, e: m + e)
    return joined.withColumn("latent", latent).drop("latent_mean", "latent_std")


def frechet_distance(a: DataFrame, b: DataFrame, vector: str = "body_emb") -> float:
    """Distance of two normal fits; only width-by-width matrices leave the cluster."""
    (mean_a, cov_a), (mean_b, cov_b) = (mean_and_covariance(x, vector) for x in (a, b))
    values, axes = np.linalg.eigh(cov_a)
    root = (axes * np.sqrt(np.clip(values, 0, None))) @ axes.T
    cross = np.sqrt(np.clip(np.linalg.eigvalsh(root @ cov_b @ root), 0, None)).sum()
    gap = mean_a - mean_b
    return float(gap @ gap + np.trace(cov_a) + np.trace(cov_b) - 2 * cross)
