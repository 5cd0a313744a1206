"""Fitted models and sampling over the planted-signal vectors and the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revuelens.functions.text import SHOWN, preview
from revuelens.functions.vectors import seeded_normals
from revuelens.operators import generate, latent, metrics, models, profile, stats, vectors
from revuelens.operators.density import fit_conditional_density
from revuelens.operators.sampling import request_grid, stratified_split
from revuelens.plans import fixtures as fx
from revuelens.plans.catalog import query
from revuelens.session import materialize

CATEGORIES, LATENT = 5, 8
KEYS = models.LATENT_KEYS


@query("topic_terms")
def _(spark, sf):
    model = models.fit_topics(fx.filtered(spark, sf), "review_body", fx.SEED, stop_words=fx.STOP_WORDS)
    return models.topic_terms(model)


@query("project_2d")
def _(spark, sf):
    projected = vectors.project_2d(fx.planted_vectors(spark, sf).select("review_id", "star_rating", "body_emb"))
    return projected.drop("body_emb")


def rated_vectors(spark, sf) -> DataFrame:
    """Planted vectors whose rating follows the label, split 80/10/10 and stored."""
    rating = (1 + F.col("label") % 5).cast("int")
    rows = fx.planted_vectors(spark, sf, 0.1).withColumn("star_rating", rating)
    return materialize(stratified_split(rows, ["star_rating"], (0.8, 0.1, 0.1), fx.SEED))


def fitted_classifier(spark, sf):
    rows = rated_vectors(spark, sf)
    parts = {name: rows.filter(F.col("split") == name) for name in ("train", "val", "test")}
    model, history = models.fit_rating_classifier(parts["train"], parts["val"])
    return model, history, parts["test"]


@query("predict_rating")
def _(spark, sf):
    model, _, test = fitted_classifier(spark, sf)
    return models.predict_rating(model, test).select("review_id", "label", "prediction")


@query("rating_classifier_metrics")
def _(spark, sf):
    model, history, test = fitted_classifier(spark, sf)
    predicted = models.predict_rating(model, test)
    scores = metrics.classification_metrics(predicted, model.numClasses, "probability")
    best = metrics.best_epoch(history, "val_accuracy").select(
        F.col("epoch").alias("best_epoch"), F.col("value").alias("best_val_accuracy")
    )
    return scores.withColumn("model", F.lit("rating_classifier")).join(
        best.withColumn("model", F.lit("rating_classifier")), "model"
    )


def stored_vectors(spark, sf) -> DataFrame:
    """Planted vectors with a helpfulness that depends on the rating, split and stored."""
    value = F.pmod(F.col("review_id") * 13, F.lit(17)) / 40.0 + F.col("star_rating") / 10.0
    rows = fx.planted_vectors(spark, sf).withColumn("helpfulness", value)
    return materialize(stratified_split(rows, KEYS, (0.8, 0.0, 0.2), fx.SEED))


def part(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter(F.col("split") == name).drop("split")


def latent_model(rows: DataFrame) -> models.LatentModel:
    """Fitted on the train rows alone."""
    return models.fit_latent(part(rows, "train"), LATENT, fx.VECTOR_WIDTH, CATEGORIES)


def encoded(spark, sf) -> DataFrame:
    rows = stored_vectors(spark, sf)
    return models.encode(latent_model(rows), rows)


def rebuilt(spark, sf) -> DataFrame:
    """Test rows, rebuilt by a model that has not seen them."""
    rows = stored_vectors(spark, sf)
    model = latent_model(rows)
    return models.decode(model, models.encode(model, part(rows, "test")))


@query("encode_latent")
def _(spark, sf):
    norm = F.sqrt(F.aggregate("latent", F.lit(0.0), lambda t, x: t + x * x))
    return encoded(spark, sf).select("review_id", *KEYS, norm.alias("latent_norm"))


@query("reconstruction_error_by_category")
def _(spark, sf):
    return vectors.reconstruction_error(rebuilt(spark, sf), ["category_encoded"])


@query("reconstruction_error_by_rating")
def _(spark, sf):
    return vectors.reconstruction_error(rebuilt(spark, sf), ["star_rating"])


@query("reconstruction_cosine")
def _(spark, sf):
    return vectors.reconstruction_cosine(rebuilt(spark, sf))


def judged(spark, sf):
    """A model of the train rows, and the test rows with their posterior."""
    rows = stored_vectors(spark, sf)
    model = latent.fit_probabilistic(part(rows, "train"), LATENT, fx.VECTOR_WIDTH, CATEGORIES, fx.SEED)
    return model, latent.posterior(model, part(rows, "test"))


@query("latent_posterior")
def _(spark, sf):
    """Size of each test row's latent vector, its divergence from the prior and the row's likelihood."""
    model, rows = judged(spark, sf)
    norm = F.sqrt(F.aggregate("latent", F.lit(0.0), lambda t, x: t + x * x))
    scored = latent.log_likelihood(model, rows)
    return scored.select("review_id", *KEYS, norm.alias("latent_norm"), "latent_kl", "log_likelihood")


@query("posterior_reconstruction")
def _(spark, sf):
    model, rows = judged(spark, sf)
    return vectors.reconstruction_error(latent.rebuild(model, rows), ["star_rating"])


@query("posterior_samples")
def _(spark, sf):
    """How far vectors drawn from each test row's posterior lie from the row's own."""
    model, rows = judged(spark, sf)
    drawn = latent.expected_vectors(model, latent.sample_posterior(model, rows, fx.SEED), body="body_rec", head="head_rec")
    return vectors.reconstruction_error(drawn, ["category_encoded"])


@query("latent_centroid_distances")
def _(spark, sf):
    cents = vectors.centroids(encoded(spark, sf), ["category_encoded"], "latent")
    return vectors.centroid_distances(cents, "category_encoded")


@query("latent_histograms")
def _(spark, sf):
    elements = F.posexplode(F.slice("latent", 1, 8)).alias("dimension", "z")
    return profile.histogram(encoded(spark, sf).select(elements), "z", 30, ["dimension"])


def requests_for(spark, sf, per_stratum: int = 2) -> DataFrame:
    """A request for every category code and rating seen in the vectors."""
    grid = request_grid(
        fx.review_vectors(spark, sf).select(F.col("category_encoded").alias("product_category")),
        [1, 2, 3, 4, 5],
        per_stratum,
    )
    return grid.select("request_id", F.col("product_category").alias("category_encoded"), "star_rating")


def decoded_samples(rows: DataFrame, latent: models.LatentModel) -> DataFrame:
    """One unrefined sample per real row, in the row's own stratum, drawn from the train rows' models."""
    density = fit_conditional_density(part(rows, "train"), KEYS, "helpfulness", 20)
    requests = rows.select(F.col("review_id").cast("string").alias("request_id"), *KEYS, "split")
    bundle = generate.ReviewModels(density, latent, None)
    return materialize(generate.sample_records(requests, bundle, fx.SEED))


def _scored_columns(df: DataFrame) -> DataFrame:
    wide = [F.col(c).cast("array<double>").alias(c) for c in ("body_emb", "head_emb")]
    return df.select(*wide, "helpfulness", *KEYS)


def fitted_models(real: DataFrame) -> tuple[generate.ReviewModels, DataFrame]:
    """Models of the train rows, and one sample for every row of either part."""
    latent = latent_model(real)
    fake = decoded_samples(real, latent)
    train = part(real, "train")
    realism = models.fit_discriminator(_scored_columns(train), _scored_columns(part(fake, "train")), CATEGORIES)
    density = fit_conditional_density(train, KEYS, "helpfulness", 20)
    return generate.ReviewModels(density, latent, realism), fake


@query("score_realism")
def _(spark, sf):
    real = stored_vectors(spark, sf)
    bundle, _ = fitted_models(real)
    scored = models.score_realism(bundle.realism, real, CATEGORIES)
    return scored.select("review_id", *KEYS, "gan_quality")


@query("realism_auc")
def _(spark, sf):
    real = stored_vectors(spark, sf)
    bundle, fake = fitted_models(real)
    both = metrics.label_union(_scored_columns(part(real, "test")), _scored_columns(part(fake, "test")))
    return stats.roc_auc(models.score_realism(bundle.realism, both, CATEGORIES, "score"))


def retrieved(spark, sf):
    """Generated records, unrefined samples, the real vectors, and the models."""
    real = stored_vectors(spark, sf)
    bundle, fake = fitted_models(real)
    # No more of a text than ``target`` shows is moved to the vectors.
    shown = [preview(F.col(c), n).alias(c) for c, n in SHOWN.items()]
    texts = fx.reviews(spark, sf).select("review_id", *shown)
    pool = real.join(texts, "review_id", "left").drop("helpfulness", "split")
    requests = requests_for(spark, sf)
    return materialize(generate.generate_reviews(requests, bundle, pool, fx.SEED)), fake, real, bundle


@query("generate_reviews")
def _(spark, sf):
    records, *_ = retrieved(spark, sf)
    return records.select("request_id", *KEYS, "helpfulness", "gan_quality", "review_id", "similarity", "text", "matched")


@query(
    "nearest_in_stratum",
    """select cast(r.review_id as varchar) as request_id, p.review_id,
    round(list_cosine_similarity(r.head_emb, p.body_emb), 6) as similarity
    from vectors r join vectors p using (category_encoded, star_rating)
    qualify row_number() over (partition by r.review_id
        order by list_cosine_similarity(r.head_emb, p.body_emb) desc, p.review_id) = 1""",
    ("vectors",),
)
def _(spark, sf):
    # Each headline vector asks for the nearest body vector of its stratum.
    rows = fx.review_vectors(spark, sf)
    wanted = F.col("review_id").cast("string").alias("request_id")
    requests = rows.select(wanted, *KEYS, F.col("head_emb").alias("v"))
    return generate.nearest_in_stratum(requests, rows.withColumnRenamed("body_emb", "v"), "v")


def variants(spark, sf) -> DataFrame:
    """Coherence, AUC against held-out real rows and mean quality: real, full, unrefined, random; all measured."""
    records, fake, real, bundle = retrieved(spark, sf)
    held_out = part(real, "test")
    width = fx.VECTOR_WIDTH
    noise = held_out.select(
        "review_id",
        *KEYS,
        "helpfulness",
        seeded_normals("review_id", fx.SEED, width).alias("body_emb"),
        seeded_normals("review_id", fx.SEED + 1, width).alias("head_emb"),
    )
    # Stored: read once each for coherence, quality and two passes of the area below the curve.
    noise = materialize(noise)
    named = {"real": held_out, "full": records.filter("matched"), "unrefined": part(fake, "test"), "random": noise}
    true_scores = _scored_columns(held_out)
    tables = {}
    for name, rows in named.items():
        scored = models.score_realism(bundle.realism, _scored_columns(rows), CATEGORIES)
        table = vectors.coherence(rows).withColumn("quality", scored.agg(F.avg("gan_quality")).scalar())
        if name != "real":
            both = metrics.label_union(true_scores, _scored_columns(rows))
            judged = models.score_realism(bundle.realism, both, CATEGORIES, "score")
            judged = materialize(judged.select("label", "score"))
            table = table.withColumn("auc", stats.roc_auc(judged).select("auc").scalar())
        tables[name] = table
    return materialize(metrics.metric_table(tables))


@query("variant_coherence")
def _(spark, sf):
    return variants(spark, sf)


@query("ablation_of_variants")
def _(spark, sf):
    return metrics.ablation_delta(variants(spark, sf), "full")


@query("checks_of_variants")
def _(spark, sf):
    return metrics.success_checks(variants(spark, sf), "full", "random", "unrefined")


@query("generated_rating_counts")
def _(spark, sf):
    model, _, _ = fitted_classifier(spark, sf)
    real = stored_vectors(spark, sf)
    fake = decoded_samples(real, latent_model(real))
    predicted = models.predict_rating(model, fake.select("request_id", "body_emb"))
    return predicted.groupBy("prediction").agg(F.count("*").alias("n"))


@query("frechet_distance")
def _(spark, sf):
    rows = stored_vectors(spark, sf)
    fake = decoded_samples(rows, latent_model(rows))
    distances = [
        ("real_vs_real", models.frechet_distance(rows, rows)),
        ("test_vs_sampled", models.frechet_distance(part(rows, "test"), part(fake, "test"))),
    ]
    return spark.createDataFrame(distances, "pair string, distance double")
