"""Synthetic review records for requested categories and ratings.

The text of a record is retrieved, not written: it is the real review of the
same category and rating whose vectors are nearest to the sampled ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revuelens.functions.scalars import hex_uniform, seeded_hash
from revuelens.functions.text import target
from revuelens.operators.cells import build_cells, search_cells
from revuelens.operators.density import sample_values
from revuelens.operators.models import LATENT_KEYS, LatentModel, decode, sample_latent, score_realism
from revuelens.session import materialize


@dataclass
class ReviewModels:
    """What sampling needs: density of helpfulness, latent space, realism score."""

    density: DataFrame
    latent: LatentModel
    realism: LogisticRegressionModel


def nearest_in_stratum(
    requests: DataFrame,
    reviews: DataFrame,
    vector: str,
    keys: Sequence[str] = LATENT_KEYS,
    request_id: str = "request_id",
    id_column: str = "review_id",
) -> DataFrame:
    """For each request the review of its stratum with the highest cosine.

    Both sides have ``keys`` and ``vector``; the smaller id wins a tie. The reviews are laid out
    in cells, and a request meets only the cells that its best find does not rule out (see
    ``operators.cells``). Null keys match each other. A request whose vector is null, zero or
    not finite, or whose stratum has no review with a usable one, comes back with a null
    review and similarity.
    """
    cells = build_cells(reviews, vector, keys, id_column)
    matched = search_cells(cells, requests, vector, request_id).drop("compared")
    everyone = requests.select(request_id)
    named = matched.withColumnRenamed(request_id, "_request")
    return everyone.join(named, F.col(request_id) == F.col("_request"), "left").drop("_request")


def sample_records(requests: DataFrame, models: ReviewModels, seed: int) -> DataFrame:
    """Requests with sampled helpfulness, latent and decoded vectors.

    ``requests`` has ``request_id``, ``category_encoded`` and ``star_rating``.
    """
    uniform = hex_uniform(seeded_hash("request_id", seed, "#help"))
    drawn = sample_values(requests, models.density, LATENT_KEYS, uniform)
    return decode(models.latent, sample_latent(models.latent, drawn, seed), "body_emb", "head_emb")


def generate_reviews(
    requests: DataFrame,
    models: ReviewModels,
    reviews: DataFrame,
    seed: int,
    headline: str = "review_headline",
    body: str = "review_body",
) -> DataFrame:
    """One record per request: helpfulness, realism score and retrieved text.

    Every request is answered: one whose stratum has no fitted statistics or no
    review has nulls and ``matched`` false.

    ``reviews`` has ``review_id``, the stratum keys, body and headline vectors and
    texts. The matched review's vectors are returned as ``body_emb``/``head_emb``.
    """
    sampled = sample_records(requests, models, seed)
    both = F.concat(F.col("body_emb").cast("array<double>"), F.col("head_emb").cast("array<double>"))
    # Stored: the sampled vectors enter the search and the records.
    sampled = materialize(sampled)
    nearest = nearest_in_stratum(
        sampled.withColumn("_both", both), reviews.withColumn("_both", both), "_both"
    )
    texts = reviews.select("review_id", target(headline, body).alias("text"), "body_emb", "head_emb")
    retrieved = nearest.join(texts, "review_id", "left").withColumn("matched", F.col("review_id").isNotNull())
    records = sampled.drop("body_emb", "head_emb", "latent").join(retrieved, "request_id", "left")
    scored = score_realism(models.realism, records, models.latent.n_categories)
    return scored.withColumn("helpfulness", F.round("helpfulness", 4)).withColumn(
        "gan_quality", F.round("gan_quality", 4)
    )
