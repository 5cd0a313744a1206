"""Filters, row preparation, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from revuelens.functions.scalars import (
    class_rating,
    clip_upper,
    parse_date,
    rating_class,
    seeded_hash,
    stratum_key,
)
from revuelens.functions.text import clean_text, preview
from revuelens.operators import filters, prepare, profile, sampling
from revuelens.plans import fixtures as fx
from revuelens.plans import oracle as o
from revuelens.plans.catalog import query

STRATUM = prepare.STRATUM


@query(
    "filter_reviews",
    "select review_id, product_category, star_rating, total_votes from filtered",
    ("filtered",),
)
def _(spark, sf):
    kept = filters.filter_reviews(fx.reviews(spark, sf), fx.MIN_VOTES)
    return kept.select("review_id", "product_category", "star_rating", "total_votes")


@query(
    "filter_exclude_vine",
    "select review_id, vine from filtered where vine is null or vine <> 'Y'",
    ("filtered",),
)
def _(spark, sf):
    kept = filters.filter_reviews(fx.reviews(spark, sf), fx.MIN_VOTES, exclude_vine=True)
    return kept.select("review_id", "vine")


@query("filter_length", "select review_id, review_body_words from banded", ("banded",))
def _(spark, sf):
    return filters.filter_length(fx.measured(spark, sf)).select("review_id", "review_body_words")


@query(
    "drop_empty_text",
    f"""select review_id from reviews where length({o.clean("review_body")}) > 0
    and length({o.clean("coalesce(review_headline, 'no headline')")}) > 0""",
    ("reviews",),
)
def _(spark, sf):
    cleaned = prepare.with_clean_text(fx.reviews(spark, sf))
    return filters.drop_empty_text(cleaned).select("review_id")


@query(
    "slice_reviews",
    """select review_id, product_category, star_rating from reviews
    where product_category = 'en' and star_rating in (1, 5)""",
    ("reviews",),
)
def _(spark, sf):
    sliced = filters.slice_reviews(fx.reviews(spark, sf), "en", [1, 5])
    return sliced.select("review_id", "product_category", "star_rating")


@query(
    "select_categories",
    "select review_id, product_category from reviews where product_category in ('de', 'fr')",
    ("reviews",),
)
def _(spark, sf):
    chosen = filters.select_categories(fx.reviews(spark, sf), ["de", "fr"])
    return chosen.select("review_id", "product_category")


@query(
    "retention_report",
    """, flags as (select product_category, coalesce(verified_purchase = 'Y', false) as a,
        coalesce(total_votes >= 1, false) as b,
        star_rating is not null and review_body is not null and review_headline is not null
            and product_category is not null as c,
        coalesce(review_body_words between 5 and 300, false) as d
        from (select *, len(regexp_extract_all(review_body, '[^"""
    + o.SPACE
    + """]+')) as review_body_words from reviews)),
    counted as (select product_category, count(*) as n0, count(*) filter (a) as n1,
        count(*) filter (a and b) as n2, count(*) filter (a and b and c) as n3,
        count(*) filter (a and b and c and d) as n4 from flags group by 1),
    steps as (select product_category, 1 as step, 'verified' as stage, n0 as rows_before, n1 as rows_after from counted
        union all select product_category, 2, 'voted', n1, n2 from counted
        union all select product_category, 3, 'complete', n2, n3 from counted
        union all select product_category, 4, 'length', n3, n4 from counted)
    select *, round(rows_after * 100.0::double / nullif(rows_before, 0), 6) as pct_kept from steps""",
    ("reviews",),
)
def _(spark, sf):
    stages = filters.keep_conditions(fx.MIN_VOTES)
    stages["length"] = filters.length_condition()
    return filters.retention_report(prepare.with_lengths(fx.reviews(spark, sf)), stages)


@query(
    "with_helpfulness",
    """select review_id, round(cast(helpful_votes as double) / nullif(total_votes, 0), 6)
    as helpfulness_ratio from reviews""",
    ("reviews",),
)
def _(spark, sf):
    return prepare.with_helpfulness(fx.reviews(spark, sf)).select("review_id", "helpfulness_ratio")


@query(
    "with_lengths",
    """select review_id, review_body_len, review_body_words, review_headline_len,
    review_headline_words from measured""",
    ("measured",),
)
def _(spark, sf):
    return fx.measured(spark, sf).select(
        "review_id",
        "review_body_len",
        "review_body_words",
        "review_headline_len",
        "review_headline_words",
    )


@query("clean_text", f"select doc_id, {o.clean('text')} as cleaned from documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@query(
    "clean_markup",
    f"select page_id, {o.clean('html')} as cleaned, {o.clean('url')} as cleaned_url from pages",
)
def _(spark, sf):
    return fx.table(spark, sf, "pages").select(
        "page_id", clean_text(F.col("html")).alias("cleaned"), clean_text(F.col("url")).alias("cleaned_url")
    )


@query(
    "text_preview",
    """select review_id, substring(review_headline, 1, 80) as headline,
    substring(review_body, 1, 150) as body from reviews""",
    ("reviews",),
)
def _(spark, sf):
    return fx.reviews(spark, sf).select(
        "review_id",
        preview(F.col("review_headline"), 80).alias("headline"),
        preview(F.col("review_body"), 150).alias("body"),
    )


@query(
    "parse_date",
    "select review_id, try_cast(review_date as date) as review_date from reviews",
    ("reviews",),
)
def _(spark, sf):
    return fx.reviews(spark, sf).select("review_id", parse_date("review_date").alias("review_date"))


@query(
    "clip_words",
    """select product_category, cast(sum(case when review_body_words > 300 then 300
    else review_body_words end) as bigint) as clipped_words, count(*) as n from facts group by 1""",
    ("facts",),
)
def _(spark, sf):
    clipped = fx.review_facts(spark, sf).withColumn("clipped", clip_upper("review_body_words", 300))
    return clipped.groupBy("product_category").agg(
        F.sum("clipped").alias("clipped_words"), F.count("*").alias("n")
    )


@query(
    "rating_class",
    """select review_id, star_rating - 1 as label, star_rating as rating_back,
    concat_ws('_', product_category, cast(star_rating as varchar)) as stratum from reviews""",
    ("reviews",),
)
def _(spark, sf):
    rows = fx.reviews(spark, sf).withColumn("label", rating_class())
    return rows.select(
        "review_id", "label", class_rating().alias("rating_back"), stratum_key(*STRATUM).alias("stratum")
    )


@query(
    "encode_category",
    """select review_id, product_category,
    cast(dense_rank() over (order by product_category) - 1 as int) as category_encoded from reviews""",
    ("reviews",),
)
def _(spark, sf):
    encoded = prepare.encode_category(fx.reviews(spark, sf))
    return encoded.select("review_id", "product_category", "category_encoded")


@query(
    "decode_category",
    """, codes as (select product_category, dense_rank() over (order by product_category) - 1 as code
        from (select distinct product_category from reviews)),
    numbers as (select vec_id, label % 5 as category_encoded from embeddings)
    select vec_id, cast(category_encoded as int) as category_encoded, product_category
    from numbers left join codes on code = category_encoded""",
    ("reviews",),
)
def _(spark, sf):
    codes = prepare.category_codes(fx.reviews(spark, sf))
    numbers = fx.table(spark, sf, "embeddings").select(
        "vec_id", (F.col("label") % 5).cast("int").alias("category_encoded")
    )
    return prepare.decode_category(numbers, codes)


@query(
    "impute_by_group",
    """select review_id, round(coalesce(helpfulness_ratio, median(helpfulness_ratio)
    over (partition by product_category, star_rating), 0.0), 6) as helpfulness_ratio from banded""",
    ("banded",),
)
def _(spark, sf):
    imputed = prepare.impute_by_group(fx.banded(spark, sf), "helpfulness_ratio")
    return imputed.select("review_id", "helpfulness_ratio")


@query(
    "standardize",
    """, m as (select avg(review_body_words) as a, stddev_pop(review_body_words) as b,
        avg(helpfulness_ratio) as c, stddev_pop(helpfulness_ratio) as d from facts)
    select product_category, star_rating, count(*) as n,
    round(avg((review_body_words - a) / b), 6) as mean_length,
    round(stddev_pop((review_body_words - a) / b), 6) as std_length,
    round(avg((helpfulness_ratio - c) / d), 6) as mean_helpfulness,
    round(max((helpfulness_ratio - c) / d), 6) as max_helpfulness
    from facts cross join m group by 1, 2""",
    ("facts",),
)
def _(spark, sf):
    scaled = prepare.standardize(
        fx.review_facts(spark, sf),
        {"review_body_words": "length_scaled", "helpfulness_ratio": "helpfulness_scaled"},
    )
    return scaled.groupBy(*STRATUM).agg(
        F.count("*").alias("n"),
        F.avg("length_scaled").alias("mean_length"),
        F.stddev_pop("length_scaled").alias("std_length"),
        F.avg("helpfulness_scaled").alias("mean_helpfulness"),
        F.max("helpfulness_scaled").alias("max_helpfulness"),
    )


@query(
    "cleaning_report",
    f"""select count(*) as n_rows,
    count(*) filter (length({o.clean("review_body")}) = 0) as empty_bodies,
    count(*) filter (length({o.clean("coalesce(review_headline, 'no headline')")}) = 0) as empty_headlines
    from reviews""",
    ("reviews",),
)
def _(spark, sf):
    return prepare.cleaning_report(prepare.with_clean_text(fx.reviews(spark, sf)))


def prepared(spark, sf):
    return prepare.prepare(fx.reviews(spark, sf), fx.MIN_VOTES, fx.PER_STRATUM, fx.SEED)


@query(
    "prepare",
    """select review_id, product_category, star_rating, category_encoded, clean_body, clean_headline,
    review_body_words, round(helpfulness_ratio, 6) as helpfulness_ratio,
    round(length_scaled, 6) as length_scaled, round(helpfulness_scaled, 6) as helpfulness_scaled,
    split from prepared""",
    ("prepared",),
)
def _(spark, sf):
    return prepared(spark, sf).select(
        "review_id",
        *STRATUM,
        "category_encoded",
        "clean_body",
        "clean_headline",
        "review_body_words",
        "helpfulness_ratio",
        "length_scaled",
        "helpfulness_scaled",
        "split",
    )


@query(
    "prepared_balance",
    """, cells as (select product_category,
        count(*) filter (star_rating = 1) as r1, count(*) filter (star_rating = 2) as r2,
        count(*) filter (star_rating = 3) as r3, count(*) filter (star_rating = 4) as r4,
        count(*) filter (star_rating = 5) as r5 from prepared group by 1)
    select *, (select min(least(r1, r2, r3, r4, r5)) from cells) as min_cell,
    (select max(greatest(r1, r2, r3, r4, r5)) from cells) as max_cell from cells""",
    ("prepared",),
)
def prepared_balance(spark, sf):
    return profile.strata_balance(prepared(spark, sf))


@query(
    "split_report",
    """, cells as (select split, star_rating, count(*) as n from prepared group by 1, 2)
    select split, star_rating, n, cast(sum(n) over (partition by split) as bigint) as split_rows,
    round(n / cast(sum(n) over (partition by split) as double), 6) as share_in_split,
    round(sum(n) over (partition by split) * cast(100 as double) / sum(n) over (), 6) as split_pct from cells""",
    ("prepared",),
)
def _(spark, sf):
    return profile.split_report(prepared(spark, sf))


@query(
    "stratified_sample",
    f"""select event_id, event_type from events qualify row_number() over (
    partition by event_type order by {o.digest("event_id")}, event_id) <= 300""",
)
def _(spark, sf):
    events = fx.table(spark, sf, "events")
    sample = sampling.stratified_sample(events, ["event_type"], 300, fx.SEED, "event_id")
    return sample.select("event_id", "event_type")


@query(
    "stratified_split",
    f"""select event_id, event_type, case
        when rn <= floor(n * cast(0.8 as double) + 0.5) then 'train'
        when rn <= floor(n * cast(0.9 as double) + 0.5) then 'val' else 'test' end as split
    from (select event_id, event_type, count(*) over (partition by event_type) as n,
        row_number() over (partition by event_type order by {o.digest("event_id")}, event_id) as rn
        from events)""",
)
def _(spark, sf):
    events = fx.table(spark, sf, "events").select("event_id", "event_type")
    return sampling.stratified_split(events, ["event_type"], (0.8, 0.1, 0.1), fx.SEED, "event_id")


@query(
    "sample_n",
    f"select event_id, event_type from events order by {o.digest('event_id', 7)}, event_id limit 500",
)
def _(spark, sf):
    events = fx.table(spark, sf, "events")
    return sampling.sample_n(events, 500, 7, "event_id").select("event_id", "event_type")


@query(
    "first_rows_per_category",
    """select review_id, product_category, star_rating from filtered
    qualify row_number() over (partition by product_category order by review_id) <= 3""",
    ("filtered",),
)
def _(spark, sf):
    first = sampling.top_n_per_group(
        fx.filtered(spark, sf), ["product_category"], ["review_id"], 3, "review_id"
    )
    return first.select("review_id", "product_category", "star_rating")


@query(
    "top_events_per_user_group",
    """select event_id, event_type, user_id, round(value, 6) as value from events
    qualify row_number() over (partition by event_type order by value desc, event_id) <= 500""",
)
def _(spark, sf):
    events = fx.table(spark, sf, "events").select("event_id", "event_type", "user_id", "value")
    return sampling.top_n_per_group(
        events, ["event_type"], [F.desc("value"), "event_id"], 500, "event_id"
    )


@query(
    "request_grid",
    """, cats as (select distinct product_category from reviews)
    select product_category, cast(r as int) as star_rating, cast(s as int) as sample_no,
    product_category || '_' || r || '_' || s as request_id
    from cats cross join range(1, 6) a(r) cross join range(1, 3) b(s)""",
    ("reviews",),
)
def _(spark, sf):
    return sampling.request_grid(fx.reviews(spark, sf), [1, 2, 3, 4, 5], 2)


@query(
    "request_grid_limited",
    """, cats as (select distinct product_category from reviews)
    select product_category, cast(r as int) as star_rating, 1 as sample_no,
    product_category || '_' || r || '_1' as request_id
    from cats cross join (values (1), (3), (5)) a(r) order by 1, 2 limit 7""",
    ("reviews",),
)
def _(spark, sf):
    return sampling.request_grid(fx.reviews(spark, sf), [1, 3, 5], 1, limit=7)


@query("order_digest", f"select doc_id, {o.digest('doc_id')} as digest from documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", seeded_hash("doc_id", fx.SEED).alias("digest"))
