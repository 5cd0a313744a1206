"""Fitted models recover planted signals; sampling stays in its stratum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from revuelens.operators import cells, generate, latent, metrics, models, vectors
from revuelens.session import materialize


@pytest.fixture(scope="module")
def planted(spark):
    """Six-wide vectors raised in the element of their rating; category is id % 2."""
    noise = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.sin(F.col("id") * 7.3 + i * 2.1) * 0.3)
    raised = F.transform(noise, lambda x, i: (x + F.when(i == F.col("id") % 5, 2.0).otherwise(0.0)).cast("float"))
    rows = spark.range(0, 300, 1, 3).select(
        F.col("id").alias("review_id"),
        (F.col("id") % 2).cast("int").alias("category_encoded"),
        (1 + F.col("id") % 5).cast("int").alias("star_rating"),
        raised.alias("body_emb"),
        raised.alias("head_emb"),
        (F.col("id") % 10 / 10.0).alias("helpfulness"),
    )
    return materialize(rows)


def test_classifier_learns_the_planted_rating(planted):
    held = planted.filter("review_id % 3 = 0")
    model, history = models.fit_rating_classifier(planted.filter("review_id % 3 > 0"), held, penalties=(0.01,), rounds=10)
    scores = metrics.classification_metrics(models.predict_rating(model, held), 5, "probability").first()
    assert scores["accuracy"] > 0.95 and scores["loss"] < 0.5
    assert metrics.best_epoch(history, "val_accuracy").first()["epoch"] == 1


def test_full_rank_latent_rebuilds_the_vectors(planted):
    model = models.fit_latent(planted, 12, 6, 2)
    rebuilt = models.decode(model, models.encode(model, planted))
    error = vectors.reconstruction_error(rebuilt, ["star_rating"]).agg(F.max("mse")).first()[0]
    assert error < 0.05
    assert vectors.reconstruction_cosine(rebuilt).first()["body_mean"] > 0.97


def _moments(n, d, k, noise, seed=1):
    draw = np.random.default_rng(seed)
    weights = draw.normal(size=(d, k)) * 2
    rows = draw.normal(size=(n, k)) @ weights.T + np.sqrt(noise) * draw.normal(size=(n, d)) + 5
    return rows, np.cov(rows.T)


def test_noise_variance_is_found_and_likelihood_is_highest():
    rows, moments = _moments(20_000, 10, 3, 0.25)
    weights, noise, rounds = latent.expectation_maximisation(moments, 3)
    assert noise == pytest.approx(0.25, rel=0.02) and rounds < 2000
    # The known solution: the mean of the eigenvalues left out, and a model that has the covariance.
    values = np.linalg.eigvalsh(moments)
    assert noise == pytest.approx(values[:7].mean(), rel=1e-4)
    assert np.abs(weights @ weights.T + noise * np.eye(10) - moments).max() < 0.1
    best = latent.mean_log_likelihood(moments, weights, noise)
    for other in (weights * 1.05, weights[:, ::-1] * [1, 0.9, 1]):
        assert latent.mean_log_likelihood(moments, other, noise) < best
    assert latent.mean_log_likelihood(moments, weights, noise * 1.1) < best


def test_posterior_rebuilds_held_out_rows_like_principal_axes(spark):
    rows, _ = _moments(1500, 12, 3, 0.1)
    table = materialize(
        spark.createDataFrame(
            [(i, i % 2, 1 + i % 5, r[:6].tolist(), r[6:].tolist()) for i, r in enumerate(rows)] + [(9999, 0, 1, None, [0.0] * 6)],
            "review_id long, category_encoded int, star_rating int, body_emb array<float>, head_emb array<float>",
        )
    )
    train, test = table.filter("review_id < 1200"), table.filter("review_id between 1200 and 1499")
    model = latent.fit_probabilistic(train, 3, 6, 2)
    assert model.noise == pytest.approx(0.1, abs=0.05)
    judged = latent.posterior(model, test)
    ours = vectors.reconstruction_error(latent.rebuild(model, judged), []).first()["mse"]
    linear = models.fit_latent(train, 3, 6, 2)
    theirs = vectors.reconstruction_error(models.decode(linear, models.encode(linear, test)), []).first()["mse"]
    assert ours <= theirs * 1.01
    # The posterior by the book, and draws with its covariance.
    row = judged.filter("review_id = 1300").first()
    joint = np.array([*row.body_emb, *row.head_emb, 1, 0, 1, 0, 0, 0, 0], dtype=float)
    gain = model.weights.T @ np.linalg.inv(model.weights @ model.weights.T + model.noise * np.eye(19))
    assert np.allclose(row.latent, gain @ (joint - model.mean), atol=1e-6)
    many = spark.range(4000).select(F.col("id").alias("review_id"), F.array(*[F.lit(0.0)] * 3).alias("latent"))
    drawn = np.array([r[0] for r in latent.sample_posterior(model, many, 7).select("latent_sample").collect()])
    assert np.allclose(np.cov(drawn.T), model.covariance, atol=0.15 * model.covariance.max())
    assert latent.sample_posterior(model, many, 7).select("latent_sample").first()[0] == drawn[0].tolist()
    scored = latent.log_likelihood(model, table.filter("review_id in (1300, 9999)")).collect()
    spread = model.weights @ model.weights.T + model.noise * np.eye(19)
    gap = joint - model.mean
    by_hand = -0.5 * (19 * np.log(2 * np.pi) + np.linalg.slogdet(spread)[1] + gap @ np.linalg.solve(spread, gap))
    assert {r.review_id: r.log_likelihood for r in scored} == {1300: pytest.approx(by_hand), 9999: None}
    empty = latent.posterior(model, table.filter("review_id = 9999")).first()
    assert empty.latent is None and empty.latent_kl is None


def test_projection_is_centred(planted):
    pc1, pc2 = vectors.project_2d(planted).agg(F.avg("pc1"), F.avg("pc2")).first()
    assert abs(pc1) < 1e-9 and abs(pc2) < 1e-9


def test_frechet_distance_of_a_shift(planted):
    shifted = planted.withColumn("body_emb", F.transform("body_emb", lambda x: x + 1.0))
    assert models.frechet_distance(planted, planted) == pytest.approx(0, abs=1e-6)
    assert models.frechet_distance(planted, shifted) == pytest.approx(6, rel=1e-4)


@pytest.mark.parametrize("block", [2048, 7])
def test_nearest_equals_brute_force_in_any_blocks(planted, block, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", block)
    monkeypatch.setattr(cells, "CELL", 20 if block == 7 else block)
    requests = planted.filter("review_id < 40").select(
        F.col("review_id").cast("string").alias("request_id"),
        *models.LATENT_KEYS,
        F.reverse("head_emb").alias("v"),
    )
    pool = planted.withColumnRenamed("body_emb", "v")
    pdf, wanted = pool.toPandas(), requests.toPandas()
    best = {}
    for _, r in wanted.iterrows():
        group = pdf[(pdf.category_encoded == r.category_encoded) & (pdf.star_rating == r.star_rating)]
        m = np.stack(group.v.to_numpy()).astype(float)
        v = np.array(r.v, dtype=float)
        best[r.request_id] = (m @ v / np.linalg.norm(m, axis=1) / np.linalg.norm(v)).max()
    found = generate.nearest_in_stratum(requests, pool, "v").collect()
    assert {r["request_id"]: pytest.approx(r["similarity"], abs=1e-9) for r in found} == best


def test_cells_rule_out_most_pairs(spark, monkeypatch):
    """Clustered vectors with copies and scaled copies: the brute-force answer from a small part of the pairs."""
    monkeypatch.setattr(cells, "CELL", 64)
    monkeypatch.setattr(cells, "BLOCK", 100)
    draw = np.random.default_rng(3)
    middles = draw.normal(size=(40, 12))
    points = middles[draw.integers(40, size=6000)] + 0.05 * draw.normal(size=(6000, 12))
    points[5000:5200] = points[0]
    points[5200:5400] = points[1] * np.arange(1, 201)[:, None]
    rows = [(i, "hot" if i % 3 else None, p.tolist()) for i, p in enumerate(points)]
    pool = spark.createDataFrame(rows, "review_id long, s string, v array<double>")
    asked = middles[draw.integers(40, size=150)] + 0.05 * draw.normal(size=(150, 12))
    requests = spark.createDataFrame(
        [(i, "hot" if i % 2 else None, p.tolist()) for i, p in enumerate(asked)], "request_id int, s string, v array<double>"
    )
    index = cells.build_cells(pool, "v", ["s"])
    assert len(index.levels) > 1
    # Only vectors that no centre can part stay together beyond the limit.
    sizes = index.vectors.groupBy("_node").count()
    assert len(index.levels) < 6 and sizes.filter("count > 64").count() <= 2
    got = {r["request_id"]: r for r in cells.search_cells(index, requests, "v").collect()}
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    n_pairs = 0
    for i, q in enumerate(asked):
        members = [k for k in range(6000) if (k % 3 != 0) == (i % 2 == 1)]
        n_pairs += len(members)
        similar = unit[members] @ (q / np.linalg.norm(q))
        assert got[i]["similarity"] == pytest.approx(similar.max(), abs=1e-9)
        assert similar[members.index(got[i]["review_id"])] == pytest.approx(similar.max(), abs=1e-9)
    assert sum(r["compared"] for r in got.values()) < 0.15 * n_pairs


@pytest.mark.parametrize("page", [90, 5000])
def test_a_request_meets_a_page_once_not_every_cell(spark, monkeypatch, page):
    """Vectors without structure, where no cell is ruled out; also a leaf of more vectors than a page, and ids that repeat."""
    monkeypatch.setattr(cells, "CELL", 16)
    monkeypatch.setattr(cells, "PAGE", page)
    draw = np.random.default_rng(5)
    points = draw.normal(size=(1000, 12))
    points[800:] = points[0] * np.arange(2, 202)[:, None]
    pool = spark.createDataFrame([(i, "s", p.tolist()) for i, p in enumerate(points)], "review_id long, s string, v array<double>")
    asked = draw.normal(size=(60, 12))
    requests = spark.createDataFrame(
        [(i // 2, "s", asked[i // 2].tolist()) for i in range(120)], "request_id int, s string, v array<double>"
    )
    index = cells.build_cells(pool, "v", ["s"])
    sent = []
    told = cells._pages_to_ask
    monkeypatch.setattr(cells, "_pages_to_ask", lambda *a: sent.append(told(*a)) or sent[-1])
    got = {r["request_id"]: r for r in cells.search_cells(index, requests, "v").collect()}
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    for i, q in enumerate(asked):
        similar = unit @ (q / np.linalg.norm(q))
        assert got[i]["similarity"] == pytest.approx(similar.max(), abs=1e-9)
        assert similar[got[i]["review_id"]] == pytest.approx(similar.max(), abs=1e-9)
    pages = cells._leaves(index).agg(F.max(F.col("_page") + F.col("_pages"))).first()[0]
    n_cells = index.vectors.select("_node").distinct().count()
    n_sent = sent[0].groupBy("_row").count().agg(F.max("count")).first()[0]
    assert n_sent <= pages <= 1000 / page + 4 and n_cells > 5 * pages


def test_every_request_is_answered(spark):
    requests = spark.createDataFrame(
        [(1, 0, 1, [1.0, 0.0]), (2, 0, 1, [0.0, 0.0]), (3, 0, 1, None), (4, 9, 9, [1.0, 1.0]), (5, None, 1, [1.0, 0.0])],
        "request_id int, category_encoded int, star_rating int, v array<double>",
    )
    pool = spark.createDataFrame(
        [(8, 0, 1, [2.0, 0.0]), (7, 0, 1, [3.0, 0.0]), (6, 0, 1, None), (9, None, 1, [1.0, 1.0]), (5, 0, 1, [0.0, 0.0])],
        "review_id long, category_encoded int, star_rating int, v array<double>",
    )
    got = {r["request_id"]: (r["review_id"], r["similarity"]) for r in generate.nearest_in_stratum(requests, pool, "v").collect()}
    assert got[1] == (7, pytest.approx(1.0)) and got[5] == (9, pytest.approx(0.5**0.5))
    assert got[2] == got[3] == got[4] == (None, None)


def test_distance_matrix_has_no_limit(spark):
    cents = spark.range(60).select(F.col("id").alias("g"), F.array(F.col("id").cast("double"), F.lit(0.0)).alias("centroid"))
    rows = vectors.centroid_distances(cents, "g").collect()
    assert len(rows) == 3600 and all(r["distance"] == abs(r["group_a"] - r["group_b"]) for r in rows)


@pytest.mark.parametrize("sent", [32 << 20, 0])
def test_rows_that_share_an_id_stay_apart(spark, monkeypatch, sent):
    from revuelens.operators import text

    monkeypatch.setattr(text, "SENT_BYTES", sent)

    rows = spark.createDataFrame([(1, "good good"), (1, "bad"), (None, "good"), (None, None)], "review_id long, t string")
    words = spark.createDataFrame([("good", 1.0), ("bad", -2.0), ("good", 0.5), (None, 9.0)], "word string, valence double")
    got = text.lexicon_sentiment(rows, "t", words).collect()
    assert sorted(r["valence"] for r in got) == [-2.0, 0.0, 1.5, 3.0]
    vocabulary = spark.createDataFrame([("good", 2)], "word string, word_id int")
    ids = text.token_ids(rows, "t", vocabulary, 2).collect()
    assert sorted(r["input_ids"] for r in ids) == [[0, 0], [1, 0], [2, 0], [2, 2]]
    assert len(vectors.embed_text(rows, {"t": "v"}, 8).collect()) == 4


def test_generated_records_stay_in_their_stratum(spark, planted):
    bundle = generate.ReviewModels(
        generate_density(planted), models.fit_latent(planted, 4, 6, 2), None
    )
    requests = planted.filter("review_id < 10").select(
        F.concat(F.lit("q"), F.col("review_id").cast("string")).alias("request_id"), *models.LATENT_KEYS
    )
    fake = generate.sample_records(requests, bundle, 3)
    columns = ["body_emb", "head_emb", "helpfulness", *models.LATENT_KEYS]
    wide = [F.col(c).cast("array<double>").alias(c) if c.endswith("emb") else F.col(c) for c in columns]
    bundle.realism = models.fit_discriminator(planted.select(*wide), fake.select(*wide), 2, rounds=5)
    pool = planted.drop("helpfulness").select(
        "*", F.lit("h").alias("review_headline"), F.concat(F.lit("b"), F.col("review_id").cast("string")).alias("review_body")
    )
    out = generate.generate_reviews(requests, bundle, pool, 3).collect()
    again = generate.generate_reviews(requests, bundle, pool.repartition(5), 3).collect()
    assert {(r["request_id"], r["text"]) for r in out} == {(r["request_id"], r["text"]) for r in again}
    assert len(out) == 10 and all(0 <= r["gan_quality"] <= 1 and r["matched"] for r in out)
    unknown = requests.limit(1).withColumn("category_encoded", F.lit(77))
    lone = generate.generate_reviews(unknown, bundle, pool, 3).first()
    assert not lone["matched"] and lone["text"] is None and lone["gan_quality"] is None
    for r in out:
        assert r["review_id"] % 2 == r["category_encoded"] and 1 + r["review_id"] % 5 == r["star_rating"]


def generate_density(rows):
    from revuelens.operators.density import fit_conditional_density

    return fit_conditional_density(rows, models.LATENT_KEYS, "helpfulness", 10)


def test_topics_name_their_terms(spark):
    rows = spark.createDataFrame(
        [(i, "camera lens photo lens" if i % 2 else "book story novel story") for i in range(40)], "review_id long, t string"
    )
    model = models.fit_topics(rows, "t", 1, k=2, rounds=5, partitions=2)
    terms = models.topic_terms(model, 3).collect()
    assert len(terms) == 6 and {r["term"] for r in terms} <= {"camera", "lens", "photo", "book", "story", "novel"}


def test_encoder_hook(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "review_id long, t string")
    out = vectors.embed_text(rows, {"t": "v"}, 2, encoder=lambda texts: [[len(t), 1.0] for t in texts])
    assert {r["review_id"]: r["v"] for r in out.collect()} == {1: [2.0, 1.0], 2: [0.0, 1.0]}


def test_hashed_vectors_have_length_one(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None)], "review_id long, t string")
    got = {r["review_id"]: r["v"] for r in vectors.embed_text(rows, {"t": "v"}, 16).collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-6)
    assert got[2] == [0.0] * 16 and got[3] == [0.0] * 16


def test_noise_schedule_ends(spark):
    rows = vectors.noise_schedule(spark).orderBy("step").collect()
    assert len(rows) == 100 and rows[0]["beta"] == pytest.approx(1e-4) and rows[-1]["beta"] == pytest.approx(0.02)
    assert rows[-1]["alpha_bar"] == pytest.approx(np.prod(1 - np.linspace(1e-4, 0.02, 100)))


def test_the_counter_gets_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(models, "PART_TOKENS", 400)
    texts = [(i, " ".join(f"w{i * j % 23}" for j in range(1, 40))) for i in range(120)]
    rows = spark.createDataFrame(texts, "review_id long, t string")
    given = []
    fit = models.CountVectorizer.fit
    monkeypatch.setattr(models.CountVectorizer, "fit", lambda self, df: given.append(df) or fit(self, df))
    model = models.fit_topics(rows, "t", 1, k=2, rounds=2, min_docs=1, max_doc_share=1000.0)
    assert len(model.vocabulary) == 23
    held = given[0].groupBy(F.spark_partition_id()).agg(F.sum(F.size("_tokens")).alias("n")).agg(F.sum("n"), F.max("n")).first()
    assert held[0] == 120 * 39 and held[1] <= 800


def test_moved_texts_are_no_longer_than_shown(spark):
    """A record's text is the same from the cut headline and body."""
    from revuelens.functions.text import SHOWN, preview, target

    rows = spark.createDataFrame(
        [("h" * 70, "b" * 300), ("short", "body"), (None, "b"), ("h", None), ("\U0001f600" * 60, "é" * 201)],
        "review_headline string, review_body string",
    )
    cut = rows.select(*[preview(F.col(c), n).alias(c) for c, n in SHOWN.items()])
    assert cut.select(target()).collect() == rows.select(target()).collect()
    assert cut.agg(F.max(F.length("review_headline")), F.max(F.length("review_body"))).first() == (50, 200)


def test_scores_are_stored_before_they_are_ranked(spark, monkeypatch):
    from revuelens.plans import queries_models as q

    judged = []
    ranked = q.stats.roc_auc
    monkeypatch.setattr(q.stats, "roc_auc", lambda df, *a: judged.append(df) or ranked(df, *a))
    table = spark.range(0, 40, 1, 2).select(
        F.col("id").alias("review_id"),
        (F.col("id") % 2).cast("int").alias("category_encoded"),
        (1 + F.col("id") % 5).cast("int").alias("star_rating"),
        (F.col("id") % 10 / 10.0).alias("helpfulness"),
        F.array([F.sin(F.col("id") + i).cast("float") for i in range(q.fx.VECTOR_WIDTH)]).alias("body_emb"),
        F.array([F.cos(F.col("id") * i).cast("float") for i in range(q.fx.VECTOR_WIDTH)]).alias("head_emb"),
        F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"),
    )
    real = materialize(table)
    other = real.withColumn("head_emb", F.col("body_emb"))
    realism = models.fit_discriminator(q._scored_columns(real), q._scored_columns(other), q.CATEGORIES)
    records = q.part(other, "test").withColumn("matched", F.lit(True))
    monkeypatch.setattr(q, "retrieved", lambda *_: (records, other, real, generate.ReviewModels(None, None, realism)))
    assert q.variants(spark, "").count() == 4
    assert len(judged) == 3 and all(df.columns == ["label", "score"] for df in judged)
