"""Embedding columns: similarity, centroids, noise, density of a conditioned value."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revuelens.functions import vectors as fv
from revuelens.functions.scalars import hex_uniform, seeded_hash
from revuelens.operators import density, quantile_density, vectors, word_vectors
from revuelens.operators.text import word_vocabulary
from revuelens.plans import fixtures as fx
from revuelens.plans import oracle as o
from revuelens.plans.catalog import query

BODY, HEAD = "body_emb", "head_emb"


@query(
    "vector_pairs",
    """select review_id, round(list_cosine_similarity(body_emb, head_emb), 6) as cosine,
    round(list_distance(body_emb, head_emb), 6) as distance,
    round(pow(list_distance(body_emb, head_emb), 2) / len(body_emb), 6) as mse,
    round(sqrt(list_dot_product(body_emb, body_emb)), 6) as norm from vectors""",
    ("vectors",),
)
def _(spark, sf):
    return fx.review_vectors(spark, sf).select(
        "review_id",
        fv.cosine(F.col(BODY), F.col(HEAD)).alias("cosine"),
        fv.l2_dist(F.col(BODY), F.col(HEAD)).alias("distance"),
        fv.vec_mse(F.col(BODY), F.col(HEAD)).alias("mse"),
        fv.l2(F.col(BODY)).alias("norm"),
    )


@query(
    "vec_concat_split",
    """select review_id, len(body_emb) + len(head_emb) as width,
    round(list_sum(body_emb), 6) as first_sum, round(list_sum(head_emb), 6) as second_sum from vectors""",
    ("vectors",),
)
def _(spark, sf):
    both = fx.review_vectors(spark, sf).select("review_id", fv.vec_concat(F.col(BODY), F.col(HEAD)).alias("both"))
    first, second = fv.vec_split(F.col("both"), fx.VECTOR_WIDTH)

    def total(v):
        return F.aggregate(v, F.lit(0.0), lambda t, x: t + x)

    return both.select(
        "review_id",
        F.size("both").cast("bigint").alias("width"),
        total(first).alias("first_sum"),
        total(second).alias("second_sum"),
    )


@query(
    "attach_embeddings",
    """select review_id, r.product_category, r.star_rating, round(list_cosine_similarity(body_emb, head_emb), 6) as cosine
    from reviews r join vectors v using (review_id)""",
    ("reviews", "vectors"),
)
def _(spark, sf):
    vectors_only = fx.review_vectors(spark, sf).select("review_id", "body_emb", "head_emb")
    joined = vectors.attach_embeddings(fx.reviews(spark, sf), vectors_only)
    return joined.select(
        "review_id", "product_category", "star_rating", fv.cosine(F.col(BODY), F.col(HEAD)).alias("cosine")
    )


@query(
    "attach_latents",
    """select review_id, r.star_rating, len(latent) as width, round(sqrt(list_sum(list_transform(latent, lambda x: x * x))), 6) as latent_norm
    from reviews r join (select review_id, list_transform(range(0, 16),
        lambda j: list_sum(list_transform(range(1, 65), lambda i: body_emb[i] * cos(i * (j + 1))))) as latent from vectors) v
    using (review_id)""",
    ("reviews", "vectors"),
)
def _(spark, sf):
    """Latents are projections of the whole vector on sixteen fixed axes."""
    axes = [F.array(*[F.lit(math.cos(i * (j + 1))) for i in range(1, 65)]) for j in range(16)]
    wide = F.col("body_emb").cast("array<double>")

    def along(axis):
        return F.aggregate(F.zip_with(wide, axis, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)

    latents = fx.review_vectors(spark, sf).select("review_id", F.array(*[along(a) for a in axes]).alias("latent"))
    joined = vectors.attach_latents(fx.reviews(spark, sf), latents)
    squares = F.aggregate("latent", F.lit(0.0), lambda t, x: t + x * x)
    return joined.select(
        "review_id", "star_rating", F.size("latent").cast("long").alias("width"), F.sqrt(squares).alias("latent_norm")
    )


@query(
    "with_condition",
    """select review_id, array_to_string(list_concat(
    list_transform(range(0, 5), lambda i: cast(i = category_encoded as int)),
    list_transform(range(0, 5), lambda i: cast(i = star_rating - 1 as int))), ',') as condition from vectors""",
    ("vectors",),
)
def _(spark, sf):
    rows = vectors.with_condition(fx.review_vectors(spark, sf), 5)
    flags = F.transform("condition", lambda x: x.cast("int").cast("string"))
    return rows.select("review_id", F.array_join(flags, ",").alias("condition"))


def _coherence_sql(by: str, source: str = "vectors") -> str:
    select, group = (f"{by}, ", " group by 1") if by else ("", "")
    sim = "list_cosine_similarity(body_emb, head_emb)"
    return f"""select {select}round(avg({sim}), 6) as coherence, round(stddev_pop({sim}), 6) as coherence_std,
    count(*) as n_pairs from {source}{group}"""


@query("coherence", _coherence_sql(""), ("vectors",))
def _(spark, sf):
    return vectors.coherence(fx.review_vectors(spark, sf))


@query("coherence_by_rating", _coherence_sql("star_rating"), ("vectors",))
def _(spark, sf):
    return vectors.coherence(fx.review_vectors(spark, sf), ["star_rating"])


@query(
    "coherence_first_rows",
    _coherence_sql(
        "star_rating",
        """(select * from vectors qualify row_number() over (partition by star_rating order by review_id) <= 50)""",
    ),
    ("vectors",),
)
def _(spark, sf):
    from revuelens.operators.sampling import top_n_per_group

    first = top_n_per_group(
        fx.review_vectors(spark, sf), ["star_rating"], ["review_id"], 50, "review_id"
    )
    return vectors.coherence(first, ["star_rating"])


def _normals(column: str, seed: int, size: int) -> str:
    digest = f"md5(cast({column} as varchar) || '#{seed}#' || cast(j as varchar))"
    radius = f"sqrt(-2.0::double * ln(1.0::double - {o.uniform(digest)}))"
    angle = f"({o.uniform(digest, 13)} * 2 * pi())"
    return f"""flatten(list_transform(range(0, {(size + 1) // 2}),
        lambda j: [{radius} * cos{angle}, {radius} * sin{angle}]))[1:{size}]"""


@query(
    "random_coherence",
    f"""with p as (select {_normals("event_id", fx.SEED, 16)} as a, {_normals("event_id", fx.SEED + 1, 16)} as b from events)
    select round(avg(list_cosine_similarity(a, b)), 6) as coherence,
    round(stddev_pop(list_cosine_similarity(a, b)), 6) as coherence_std, count(*) as n_pairs from p""",
)
def _(spark, sf):
    return vectors.random_coherence(fx.table(spark, sf, "events"), 16, fx.SEED, "event_id")


@query(
    "embedding_stats",
    """, e as (select star_rating, review_id, unnest(body_emb) as x, len(body_emb) as w from vectors)
    select star_rating, count(distinct review_id) as n_rows, cast(min(w) as int) as min_width,
    cast(max(w) as int) as max_width, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std,
    round(min(x), 6) as min, round(max(x), 6) as max from e group by 1""",
    ("vectors",),
)
def _(spark, sf):
    return vectors.embedding_stats(fx.review_vectors(spark, sf), "body_emb", ["star_rating"])


_CENTROIDS = """, c as (select star_rating, list(m order by i) as centroid from (
        select star_rating, i, avg(body_emb[i]) as m from vectors cross join range(1, 65) t(i) group by 1, 2)
        group by 1)"""


@query(
    "centroids",
    """select star_rating, count(distinct review_id) as n_rows, cast(i - 1 as int) as position,
    round(avg(body_emb[i]), 6) as value from vectors cross join range(1, 65) t(i) group by 1, i""",
    ("vectors",),
)
def _(spark, sf):
    cents = vectors.centroids(fx.review_vectors(spark, sf), ["star_rating"])
    return cents.select("star_rating", "n_rows", F.posexplode("centroid").alias("position", "value"))


@query(
    "centroid_distances",
    _CENTROIDS
    + """ select a.star_rating as group_a, b.star_rating as group_b,
    round(list_distance(a.centroid, b.centroid), 6) as distance from c a cross join c b""",
    ("vectors",),
)
def _(spark, sf):
    cents = vectors.centroids(fx.review_vectors(spark, sf), ["star_rating"])
    return vectors.centroid_distances(cents, "star_rating")


@query(
    "interpolate",
    _CENTROIDS
    + """, e as (select (select centroid from c where star_rating = 1) as a,
        (select centroid from c where star_rating = 5) as b),
    m as (select i / cast(6 as double) as alpha, a, b, list_transform(range(1, 65),
        lambda k: a[k] * (1 - i / cast(6 as double)) + b[k] * (i / cast(6 as double))) as v from e cross join range(0, 7) t(i))
    select round(alpha, 6) as alpha, round(sqrt(list_dot_product(v, v)), 6) as norm,
    round(list_distance(a, b), 6) as end_distance from m""",
    ("vectors",),
)
def _(spark, sf):
    cents = vectors.centroids(fx.review_vectors(spark, sf), ["star_rating"])
    ends = cents.agg(
        F.max(F.when(F.col("star_rating") == 1, F.col("centroid"))).alias("a"),
        F.max(F.when(F.col("star_rating") == 5, F.col("centroid"))).alias("b"),
    )
    return vectors.interpolate(ends, "a", "b", 7).select("alpha", "norm", "end_distance")


@query(
    "add_noise",
    f""", sched as (select step, (select exp(sum(ln(1 - (0.0001::double + i * ((0.02::double - 0.0001::double) / 99)))))
            from range(0, step + 1) t(i)) as ab from range(0, 100) s(step)),
    st as (select review_id, body_emb, cast(floor({o.uniform(o.digest("review_id", fx.SEED, "#step"))} * 100) as int) as step
        from vectors),
    n as (select review_id, step, list_transform(range(1, 65), lambda k: sqrt(ab) * body_emb[k] + sqrt(1 - ab) * e[k]) as v
        from (select st.*, {_normals("review_id", fx.SEED, 64)} as e from st) join sched using (step))
    select review_id, step, round(list_sum(v), 6) as noisy_sum, round(sqrt(list_dot_product(v, v)), 6) as noisy_norm from n""",
    ("vectors",),
)
def _(spark, sf):
    noisy = vectors.add_noise(fx.review_vectors(spark, sf), "body_emb", fx.VECTOR_WIDTH, fx.SEED)
    total = F.aggregate("noisy", F.lit(0.0), lambda t, x: t + x)
    return noisy.select(
        "review_id", "step", total.alias("noisy_sum"), fv.l2(F.col("noisy")).alias("noisy_norm")
    )


def _embed_sql(source: str, id_column: str, texts: dict[str, str], dim: int) -> str:
    parts = []
    for text, name in texts.items():
        terms, known = o.words(f"lower({text})"), f"(select * from {source} where {text} is not null)"
        parts += [
            f"select {id_column}, '{name}' as name, gram as term from ({o.grams(known, id_column, id_column, terms, n)})"
            for n in (1, 2)
        ]
    return f"""tt as ({" union all ".join(parts)}),
    hh as (select {id_column}, name, cast('0x' || substr(md5(term), 1, 8) as bigint) % {dim} as bucket,
        case when substr(md5(term), 9, 1) < '8' then 1 else -1 end as s from tt),
    bb as (select {id_column}, name, bucket, cast(sum(s) as double) as s from hh group by 1, 2, 3)"""


@query(
    "embed_text",
    f"""with {_embed_sql("documents", "doc_id", {"text": "emb"}, 64)},
    nn as (select doc_id, sqrt(sum(s * s)) as len from bb group by 1)
    select doc_id, cast(bucket as int) as position, round(cast(cast(s / len as float) as double), 5) as value
    from bb join nn using (doc_id) where s <> 0""",
)
def _(spark, sf):
    embedded = vectors.embed_text(fx.table(spark, sf, "documents"), {"text": "emb"}, 64, "doc_id")
    long = embedded.select("doc_id", F.posexplode("emb").alias("position", "value"))
    value = F.round(F.col("value").cast("double"), 5)
    return long.filter(F.col("value") != 0).withColumn("value", value)


@query(
    "embed_review_texts",
    f""", {_embed_sql("filtered", "review_id", {"review_body": "body", "review_headline": "head"}, 64)},
    nn as (select review_id, name, sum(s * s) as sq from bb group by 1, 2),
    dd as (select a.review_id, sum(a.s * b.s) as d from bb a join bb b on a.review_id = b.review_id
        and a.bucket = b.bucket and a.name = 'body' and b.name = 'head' group by 1)
    select review_id, round(coalesce(d, 0) / nullif(sqrt(x.sq) * sqrt(y.sq), 0), 4) as cosine
    from filtered left join (select * from nn where name = 'body') x using (review_id)
    left join (select * from nn where name = 'head') y using (review_id) left join dd using (review_id)""",
    ("filtered",),
)
def _(spark, sf):
    embedded = vectors.embed_text(
        fx.filtered(spark, sf), {"review_body": "body_emb", "review_headline": "head_emb"}, 64
    )
    return embedded.select("review_id", F.round(fv.cosine(F.col(BODY), F.col(HEAD)), 4).alias("cosine"))


DENSITY_BINS = 20



# Rows whose seeded digest falls in the first four fifths are fitted, the others scored.
TRAIN_SHARE = 0.8


def parted(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    known = hex_uniform(seeded_hash("review_id", fx.SEED, "#part")) < TRAIN_SHARE
    return df.filter(known), df.filter(~known)


def _held_out_sql(source: str) -> str:
    """``_density_sql`` of the train rows, with ``lls`` over the test rows."""
    chance = o.uniform(o.digest("review_id", fx.SEED, "#part"))
    split = f", fit_rows as (select * from {source} where {chance} < {TRAIN_SHARE}), test_rows as (select * from {source} where {chance} >= {TRAIN_SHARE})"
    bins = DENSITY_BINS
    slot = f"cast(greatest(0, least(floor((helpfulness_ratio - lo) / (hi - lo) * {bins}), {bins - 1})) as int)"
    scored = f""", held as (select review_id, product_category, star_rating, total_votes, {slot} as bin
        from test_rows cross join rng where helpfulness_ratio is not null),
    tlls as (select held.*, ln(density) as ll from held left join model using (product_category, star_rating, bin))"""
    return split + _density_sql("fit_rows") + scored


def _density_sql(source: str) -> str:
    """Fitted histogram ``model`` and the source rows with their bin, ``binned``."""
    bins = DENSITY_BINS
    slot = f"cast(greatest(0, least(floor((helpfulness_ratio - lo) / (hi - lo) * {bins}), {bins - 1})) as int)"
    prob = f"(coalesce(n, 0) + 1.0::double) / (total + {bins}.0::double)"
    return f""", rng as (select min(helpfulness_ratio) as lo, max(helpfulness_ratio) as hi from {source}),
    binned as (select review_id, product_category, star_rating, total_votes, {slot} as bin
        from {source} cross join rng where helpfulness_ratio is not null),
    cnt as (select product_category, star_rating, bin, count(*) as n from binned group by 1, 2, 3),
    tot as (select product_category, star_rating, sum(n) as total from cnt group by 1, 2),
    model as (select tot.product_category, tot.star_rating, cast(i as int) as bin,
        lo + i * ((hi - lo) / {bins}) as lo, lo + (i + 1) * ((hi - lo) / {bins}) as hi,
        coalesce(n, 0) as n, {prob} as prob, {prob} / ((hi - lo) / {bins}) as density
        from tot cross join rng cross join range(0, {bins}) t(i) left join cnt
        on cnt.product_category = tot.product_category and cnt.star_rating = tot.star_rating and cnt.bin = i),
    lls as (select review_id, product_category, star_rating, total_votes, ln(density) as ll
        from binned join model using (product_category, star_rating, bin))"""


STRATA = ["product_category", "star_rating"]


def density_model(spark, sf):
    return density.fit_conditional_density(
        fx.review_facts(spark, sf), STRATA, "helpfulness_ratio", DENSITY_BINS
    )


@query(
    "fit_conditional_density",
    _density_sql("facts")
    + """ select product_category, star_rating, bin, round(lo, 6) as lo, round(hi, 6) as hi, n,
    round(prob, 6) as prob, round(density, 6) as density from model""",
    ("facts",),
)
def _(spark, sf):
    return density_model(spark, sf)


def scored_facts(spark, sf):
    """Test rows with a helpfulness, and the model of the train rows."""
    train, test = parted(fx.review_facts(spark, sf))
    model = density.fit_conditional_density(train, STRATA, "helpfulness_ratio", DENSITY_BINS)
    return test.filter(F.col("helpfulness_ratio").isNotNull()), model


@query(
    "log_density",
    _held_out_sql("facts")
    + """ select review_id, product_category, star_rating, total_votes, round(ll, 6) as log_density from tlls""",
    ("facts",),
)
def _(spark, sf):
    test, model = scored_facts(spark, sf)
    rows = density.log_density(test, model, STRATA, "helpfulness_ratio")
    return rows.select("review_id", *STRATA, "total_votes", "log_density")


@query(
    "loglik_by_category",
    _held_out_sql("facts")
    + " select product_category, count(ll) as n, round(avg(ll), 6) as mean_loglik from tlls group by 1",
    ("facts",),
)
def _(spark, sf):
    test, model = scored_facts(spark, sf)
    return density.loglik_by(test, model, STRATA, "helpfulness_ratio", ["product_category"])


@query(
    "loglik_matrix",
    _held_out_sql("filtered")
    + """, cells as (select product_category, star_rating, case when count(ll) >= 10 then avg(ll) end as ll
        from tlls group by 1, 2)
    select product_category, """
    + ", ".join(f"round(max(ll) filter (star_rating = {r}), 6) as r{r}" for r in range(1, 6))
    + " from cells group by 1",
    ("filtered",),
)
def _(spark, sf):
    train, test = parted(fx.filtered(spark, sf))
    model = density.fit_conditional_density(train, STRATA, "helpfulness_ratio", DENSITY_BINS)
    return density.loglik_matrix(test, model, "helpfulness_ratio")


@query(
    "sample_helpfulness",
    _density_sql("filtered")
    + f""", cum as (select *, coalesce(sum(prob) over (partition by product_category, star_rating order by bin
            rows between unbounded preceding and 1 preceding), 0) as before from model),
    req as (select review_id, product_category, star_rating, {o.uniform(o.digest("review_id", fx.SEED, "#help"))} as u from filtered)
    select review_id, product_category, star_rating, round(lo + (u - before) / prob * (hi - lo), 5) as helpfulness
    from req join cum using (product_category, star_rating)
    where u >= before and (u - before) / prob < 1""",
    ("filtered",),
)
def _(spark, sf):
    rows = fx.filtered(spark, sf)
    model = density.fit_conditional_density(rows, STRATA, "helpfulness_ratio", DENSITY_BINS)
    uniform = hex_uniform(seeded_hash("review_id", fx.SEED, "#help"))
    drawn = density.sample_values(rows.select("review_id", *STRATA), model, STRATA, uniform)
    return drawn.withColumn("helpfulness", F.round("helpfulness", 5))


QUANTILE_STEPS = 16


def _quantile_sql(source: str, value: str, by: str) -> str:
    """Pieces of each stratum, from its quantiles."""
    n = QUANTILE_STEPS
    return f""", vals as (select {by}, cast({value} as double) as v from {source} where {value} is not null),
    quant as (select {by}, count(*) as n_values, quantile_cont(v, list_transform(range({n + 1}), lambda i: i / {n}.0)) as q from vals group by all),
    each_q as (select {by}, n_values, q[{n + 1}] - q[1] as extent, unnest(q) as v, generate_subscripts(q, 1) - 1 as i from quant),
    knots as (select {by}, n_values, extent, v, min(i) / {n}.0::double as f, max(i) / {n}.0::double as t from each_q group by all),
    gaps as (select *, least(v - lag(v) over w, lead(v) over w - v) as gap,
        case when extent > 0 then extent * 0.001::double else 1.0::double end as room from knots window w as (partition by {by} order by v)),
    halves as (select *, case when t > f then least(room / 2, coalesce(gap / 4, room / 2)) else 0 end as half,
        1 / (n_values + 2.0::double) as tail, case when extent > 0 then extent / {n} else 1.0::double end as step from gaps),
    nexts as (select *, lead(v) over w as nv, lead(half) over w as nhalf from halves window w as (partition by {by} order by v)),
    unnumbered as (
        select {by}, -1 as side, v - half - step as lo, v - half as hi, tail as prob, 0.0::double as cum from nexts where f = 0
        union all select {by}, 0, v - half, v + half, (t - f) * (1 - 2 * tail), tail + f * (1 - 2 * tail) from nexts where half > 0
        union all select {by}, 0, v + half, nv - nhalf, 1 / {n}.0::double * (1 - 2 * tail), tail + t * (1 - 2 * tail) from nexts where nv is not null
        union all select {by}, 1, v + half, v + half + step, tail, 1 - tail from nexts where t = 1),
    pieces as (select *, prob / (hi - lo) as density, row_number() over (partition by {by} order by cum, lo) - 1 as piece from unnumbered)"""


@query(
    "fit_quantile_density",
    _quantile_sql("facts", "total_votes", "star_rating")
    + """ select star_rating, side, round(lo, 6) as lo, round(hi, 6) as hi, round(prob, 6) as prob, round(cum, 6) as cum,
    round(density, 6) as density, cast(piece as int) as piece from pieces""",
    ("facts",),
)
def _(spark, sf):
    return quantile_density.fit_quantile_density(fx.review_facts(spark, sf), ["star_rating"], "total_votes", QUANTILE_STEPS)


@query(
    "quantile_loglik",
    _quantile_sql("measured", "review_body_words", "star_rating")
    + """, hit as (select m.star_rating, m.review_body_words as v, p.* exclude (star_rating), row_number() over (
            partition by m.review_id order by p.lo desc) as rn
        from measured m join pieces p on p.star_rating = m.star_rating and (p.lo <= m.review_body_words or p.piece = 0))
    select star_rating, count(*) as n, round(avg(ln(density) + case when side = -1 then least((v - hi) / (hi - lo), 0)
        when side = 1 then -(v - lo) / (hi - lo) else 0 end), 6) as mean_loglik from hit where rn = 1 group by 1""",
    ("measured",),
)
def _(spark, sf):
    """Mean log density of body lengths, whose long tail an even grid would put into one bin."""
    rows = fx.measured(spark, sf)
    model = quantile_density.fit_quantile_density(rows, ["star_rating"], "review_body_words", QUANTILE_STEPS)
    scored = quantile_density.log_density(rows, model, ["star_rating"], "review_body_words")
    return scored.groupBy("star_rating").agg(F.count("*").alias("n"), F.avg("log_density").alias("mean_loglik"))


@query(
    "quantile_draws",
    _quantile_sql("filtered", "helpfulness_ratio", "product_category, star_rating")
    + f""", req as (select review_id, product_category, star_rating,
        greatest({o.uniform(o.digest("review_id", fx.SEED, "#help"))}, pow(2, -53)) as u from filtered),
    hit as (select req.review_id, u, p.*, row_number() over (partition by req.review_id order by p.cum desc, p.lo desc) as rn
        from req join pieces p on p.product_category = req.product_category and p.star_rating = req.star_rating and p.cum <= u)
    select review_id, product_category, star_rating, round(case when side = -1 then hi + (hi - lo) * ln((u - cum) / prob)
        when side = 1 then lo - (hi - lo) * ln(1 - (u - cum) / prob) else lo + (u - cum) / prob * (hi - lo) end, 5) as helpfulness
    from hit where rn = 1""",
    ("filtered",),
)
def _(spark, sf):
    rows = fx.filtered(spark, sf)
    model = quantile_density.fit_quantile_density(rows, STRATA, "helpfulness_ratio", QUANTILE_STEPS)
    uniform = hex_uniform(seeded_hash("review_id", fx.SEED, "#help"))
    drawn = quantile_density.draw_values(rows.select("review_id", *STRATA), model, STRATA, uniform, "helpfulness")
    return drawn.withColumn("helpfulness", F.round("helpfulness", 5))


@query(
    "co_occurrences",
    f""", wv as (select term as word, row_number() over (order by n desc, term) + 1 as word_id from (
        select term, count(*) as n from (select unnest({o.words("lower(review_body)")}) as term from filtered)
        group by 1 order by n desc, term limit 300)),
    w as (select review_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from (
        select review_id, {o.words("lower(review_body)")} as ws from filtered)),
    k as (select review_id, word_id, pos from w join wv using (word)),
    p as (select a.word_id as x, b.word_id as y from k a join k b on a.review_id = b.review_id and b.pos > a.pos and b.pos <= a.pos + 4)
    select cast(i as int) as i, cast(j as int) as j, count(*) as n from (
        select x as i, y as j from p union all select y, x from p) group by 1, 2""",
    ("filtered",),
)
def _(spark, sf):
    rows = fx.filtered(spark, sf)
    return word_vectors.co_occurrences(rows, "review_body", word_vocabulary(rows, "review_body", 300))


@query("learned_text_vectors")
def _(spark, sf):
    """Reviews embedded by word vectors learned from them: how well headline and body agree, by rating."""
    rows = fx.filtered(spark, sf)
    found = word_vectors.learn_word_vectors(rows, "review_body", word_vocabulary(rows, "review_body", 2000), 32, seed=fx.SEED)
    columns = {"review_body": BODY, "review_headline": HEAD}
    embedded = vectors.embed_text(rows, columns, 32, encoder=word_vectors.encoder(found))
    return vectors.coherence(embedded.join(rows.select("review_id", "star_rating"), "review_id"), ["star_rating"])
