"""Profile tables and two-sample statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from revuelens.functions.scalars import parse_date
from revuelens.operators import metrics, profile, state, stats
from revuelens.operators.joins import join_lookup
from revuelens.operators.ranks import exact_quantiles
from revuelens.plans import fixtures as fx
from revuelens.plans.catalog import query

RATING_COUNTS = ", ".join(f"count(*) filter (star_rating = {r}) as r{r}" for r in range(1, 6))


@query(
    "scan_profile",
    """select product_category, count(*) as n_rows, 10 as n_columns,
    round(avg(case when verified_purchase = 'Y' then 1 else 0 end) * 100, 6) as verified_pct,
    round(avg(star_rating), 6) as mean_rating from reviews group by 1""",
    ("reviews",),
)
def _(spark, sf):
    return profile.scan_profile(fx.reviews(spark, sf))


@query(
    "table_summary",
    """select count(*) as n_rows, count(distinct product_category) as n_categories,
    round(avg(helpfulness_ratio), 6) as mean_helpfulness, round(avg(review_body_words), 6) as mean_words
    from facts""",
    ("facts",),
)
def _(spark, sf):
    return profile.table_summary(fx.review_facts(spark, sf))


@query(
    "value_counts",
    """select product_category, count(*) as n,
    round(count(*) / cast((select count(product_category) from reviews) as double), 6) as share
    from reviews where product_category is not null group by 1""",
    ("reviews",),
)
def _(spark, sf):
    return profile.value_counts(fx.reviews(spark, sf), "product_category")


@query(
    "rating_share",
    """select cast(r as int) as star_rating, count(star_rating) as n,
    round(count(star_rating) * cast(100 as double) / (select count(*) from reviews), 6) as pct
    from range(1, 6) t(r) left join reviews on star_rating = r group by 1""",
    ("reviews",),
)
def _(spark, sf):
    return profile.rating_share(fx.reviews(spark, sf))


@query(
    "rating_by_category",
    "select product_category, star_rating, count(*) as n from reviews group by 1, 2",
    ("reviews",),
)
def _(spark, sf):
    return profile.rating_by_category(fx.reviews(spark, sf))


@query(
    "rating_mix",
    "select product_category, "
    + ", ".join(
        f"round(count(*) filter (star_rating = {r}) / cast(count(star_rating) as double), 6) as r{r}"
        for r in range(1, 6)
    )
    + " from reviews group by 1",
    ("reviews",),
)
def _(spark, sf):
    return profile.rating_mix(fx.reviews(spark, sf))


@query(
    "strata_balance",
    f""", cells as (select product_category, {RATING_COUNTS} from facts group by 1)
    select *, (select min(least(r1, r2, r3, r4, r5)) from cells) as min_cell,
    (select max(greatest(r1, r2, r3, r4, r5)) from cells) as max_cell from cells""",
    ("facts",),
)
def _(spark, sf):
    return profile.strata_balance(fx.review_facts(spark, sf))


@query(
    "crosstab_margins",
    f"""select case when grouping(product_category) = 1 then 'All' else product_category end as category,
    {RATING_COUNTS}, count(*) as r_all from reviews
    where product_category is not null and star_rating is not null group by rollup (product_category)""",
    ("reviews",),
)
def _(spark, sf):
    return profile.crosstab_margins(fx.reviews(spark, sf))


_NULL_COLUMNS = [
    ("review_id", "bigint"),
    ("product_category", "string"),
    ("star_rating", "int"),
    ("review_headline", "string"),
    ("review_body", "string"),
    ("helpful_votes", "int"),
    ("total_votes", "int"),
    ("vine", "string"),
    ("verified_purchase", "string"),
    ("review_date", "string"),
]


@query(
    "null_profile",
    " union all ".join(
        f"""select '{c}' as "column", '{t}' as "type", count({c}) as non_null, count(*) - count({c}) as nulls,
        round((count(*) - count({c})) * cast(100 as double) / count(*), 2) as null_pct from reviews"""
        for c, t in _NULL_COLUMNS
    ),
    ("reviews",),
)
def _(spark, sf):
    return profile.null_profile(fx.reviews(spark, sf))


def _describe_sql(value: str, probs) -> str:
    quantiles = ", ".join(
        f"round(quantile_cont({value}, {p}), 6) as p{round(p * 100)}" for p in probs
    )
    return f"""count({value}) as n, round(avg({value}), 6) as mean, round(stddev_samp({value}), 6) as std,
    round(cast(min({value}) as double), 6) as min, round(cast(max({value}) as double), 6) as max, {quantiles}"""


_NUMERIC = ["star_rating", "helpful_votes", "total_votes", "helpfulness_ratio"]


@query(
    "describe_numeric",
    " union all ".join(
        f"""select '{c}' as "column", {_describe_sql(f"cast({c} as double)", (0.25, 0.5, 0.75))} from facts"""
        for c in _NUMERIC
    ),
    ("facts",),
)
def _(spark, sf):
    return profile.describe_numeric(fx.review_facts(spark, sf), _NUMERIC)


@query(
    "helpfulness_percentiles",
    f"""select product_category, {_describe_sql("helpfulness_ratio", (0.1, 0.25, 0.5, 0.75, 0.9))}
    from filtered group by 1""",
    ("filtered",),
)
def _(spark, sf):
    return profile.helpfulness_percentiles(fx.filtered(spark, sf))


@query(
    "facts_percentiles",
    f"""select product_category, {_describe_sql("helpfulness_ratio", (0.1, 0.25, 0.5, 0.75, 0.9))}
    from facts group by 1""",
    ("facts",),
)
def _(spark, sf):
    return profile.helpfulness_percentiles(fx.review_facts(spark, sf))


@query(
    "price_quantiles",
    """select l_returnflag, count(*) as n_values, round(quantile_cont(l_extendedprice, 0.1), 6) as p10,
    round(quantile_cont(l_extendedprice, 0.5), 6) as p50,
    round(quantile_cont(l_extendedprice, 0.99), 6) as p99 from lineitem group by 1""",
)
def _(spark, sf):
    found = exact_quantiles(
        fx.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.99]
    )
    return found.select(
        "l_returnflag",
        "n_values",
        *[F.element_at("quantiles", i).alias(c) for i, c in enumerate(("p10", "p50", "p99"), 1)],
    )


_LENGTHS = ["review_body_len", "review_body_words", "review_headline_len", "review_headline_words"]


@query(
    "length_summary",
    " union all ".join(
        f"""select '{c}' as "column", round(avg({c}), 6) as mean, round(median({c}), 6) as median from measured"""
        for c in _LENGTHS
    ),
    ("measured",),
)
def _(spark, sf):
    return profile.length_summary(fx.measured(spark, sf), _LENGTHS)


@query(
    "clean_length_summary",
    """select 'body_len' as "column", round(avg(length(clean_body)), 6) as mean,
        round(median(length(clean_body)), 6) as median from cleaned
    union all select 'headline_len', round(avg(length(clean_headline)), 6),
        round(median(length(clean_headline)), 6) from cleaned""",
    ("cleaned",),
)
def _(spark, sf):
    from revuelens.operators.prepare import clean_reviews

    cleaned = clean_reviews(fx.reviews(spark, sf), fx.MIN_VOTES).select(
        F.length("clean_body").alias("body_len"), F.length("clean_headline").alias("headline_len")
    )
    return profile.length_summary(cleaned, ["body_len", "headline_len"])


@query(
    "purchase_breakdown",
    """select verified_purchase, star_rating, count(*) as n,
    round(count(*) / cast((select count(*) from facts) as double), 6) as share from facts group by 1, 2""",
    ("facts",),
)
def _(spark, sf):
    return profile.purchase_breakdown(fx.review_facts(spark, sf))


@query(
    "vine_breakdown",
    """select vine, count(*) as n, round(count(*) / cast((select count(*) from reviews) as double), 6) as share
    from reviews group by 1""",
    ("reviews",),
)
def _(spark, sf):
    return profile.vine_breakdown(fx.reviews(spark, sf))


def _box_sql(source: str, by: str, value: str) -> str:
    return f""", q as (select {by}, count({value}) as n_rows, quantile_cont({value}, 0.25) as q1,
        median({value}) as med, quantile_cont({value}, 0.75) as q3 from {source} group by 1)
    select {by}, any_value(n_rows) as n_rows, round(any_value(q1), 6) as q1, round(any_value(med), 6) as median,
    round(any_value(q3), 6) as q3,
    round(min({value}) filter ({value} between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as whisker_lo,
    round(max({value}) filter ({value} between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as whisker_hi,
    count(*) filter ({value} not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as n_outliers
    from {source} join q using ({by}) group by 1"""


@query("box_helpfulness_by_rating", _box_sql("facts", "star_rating", "helpfulness_ratio"), ("facts",))
def _(spark, sf):
    return profile.box_stats(fx.review_facts(spark, sf), ["star_rating"], "helpfulness_ratio")


@query(
    "box_helpfulness_by_category",
    _box_sql("facts", "product_category", "helpfulness_ratio"),
    ("facts",),
)
def _(spark, sf):
    return profile.box_stats(fx.review_facts(spark, sf), ["product_category"], "helpfulness_ratio")


@query(
    "box_words_by_rating",
    _box_sql("(select star_rating, cast(review_body_words as double) as w from measured)", "star_rating", "w"),
    ("measured",),
)
def _(spark, sf):
    return profile.box_stats(fx.measured(spark, sf), ["star_rating"], "review_body_words")


def _histogram_sql(source: str, value: str, bins: int, where: str = "true") -> str:
    return f""", v as (select cast({value} as double) as v from {source} where {value} is not null and {where}),
    e as (select min(v) as lo, max(v) as hi, (max(v) - min(v)) / {bins} as w, count(*) as total from v),
    c as (select least(floor((v - lo) / w), {bins - 1}) as bin, count(*) as n from v cross join e group by 1)
    select cast(b as int) as bin, round(lo + b * w, 6) as lo, round(lo + (b + 1) * w, 6) as hi,
    coalesce(n, 0) as n, round(coalesce(n, 0) / (total * w), 6) as density
    from range(0, {bins}) t(b) cross join e left join c on bin = b"""


@query("histogram_helpfulness", _histogram_sql("facts", "helpfulness_ratio", 50), ("facts",))
def _(spark, sf):
    return profile.histogram(fx.review_facts(spark, sf), "helpfulness_ratio", 50)


@query(
    "histogram_body_words",
    _histogram_sql("measured", "review_body_words", 50, "review_body_words < 500"),
    ("measured",),
)
def _(spark, sf):
    return profile.histogram(fx.measured(spark, sf), "review_body_words", 50, below=500)


@query(
    "histogram_headline_words",
    _histogram_sql("measured", "review_headline_words", 30, "review_headline_words < 30"),
    ("measured",),
)
def _(spark, sf):
    return profile.histogram(fx.measured(spark, sf), "review_headline_words", 30, below=30)


@query(
    "histogram_vector_elements",
    """with e as (select min(embedding[i]) as lo, max(embedding[i]) as hi from embeddings, range(1, 65) r(i)),
    v as (select i - 1 as dimension, cast(embedding[i] as double) as v from embeddings, range(1, 65) r(i)),
    c as (select dimension, least(floor((v - lo) / ((cast(hi as double) - lo) / 30)), 29) as bin, count(*) as n
        from v cross join e group by 1, 2)
    select cast(d as int) as dimension, cast(b as int) as bin,
    round(cast(lo as double) + b * ((cast(hi as double) - lo) / 30), 6) as lo,
    round(cast(lo as double) + (b + 1) * ((cast(hi as double) - lo) / 30), 6) as hi, coalesce(n, 0) as n,
    round(coalesce(n, 0) / ((select count(*) from embeddings) * ((cast(hi as double) - lo) / 30)), 6) as density
    from range(0, 64) x(d) cross join range(0, 30) y(b) cross join e left join c on bin = b and dimension = d""",
)
def _(spark, sf):
    every = F.posexplode("embedding").alias("dimension", "element")
    return profile.histogram(
        fx.table(spark, sf, "embeddings").select(every), "element", 30, ["dimension"]
    )


def _kde_sql(source: str, by: str, value: str, points: int, bins: int) -> str:
    return f""", v as (select {by}, cast({value} as double) as v from {source} where {value} is not null),
    s as (select {by}, count(*) as n, min(v) as lo, max(v) as hi, (max(v) - min(v)) / {bins} as w,
        stddev_samp(v) * pow(count(*), -0.2) as bw from v group by 1),
    c as (select {by}, least(floor((v - lo) / w), {bins - 1}) as bin, count(*) as k
        from v join s using ({by}) group by 1, 2),
    g as (select s.*, p, lo - 3 * bw + p * ((hi - lo + 6 * bw) / {points - 1}) as x
        from s cross join range(0, {points}) t(p) where bw > 0)
    select {by}, cast(p as int) as point, round(x, 6) as x,
    round(sum(k * exp(-0.5 * pow((x - (lo + (bin + 0.5) * w)) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 6)
    as density from g join c using ({by}) group by 1, p, x"""


@query("kde_scores", _kde_sql("scores", "event_type", "score", 60, 128), ("scores",))
def _(spark, sf):
    return profile.kde(fx.scores(spark, sf), ["event_type"], "score", 60, 128)


@query(
    "kde_words_by_rating",
    _kde_sql(
        "(select * from measured where review_body_words < 500)", "star_rating", "review_body_words", 40, 64
    ),
    ("measured",),
)
def _(spark, sf):
    rows = fx.measured(spark, sf).filter(F.col("review_body_words") < 500)
    return profile.kde(rows, ["star_rating"], "review_body_words", 40, 64)


@query(
    "length_helpfulness_corr",
    """select round(corr(least(review_body_words, 300), helpfulness_ratio), 6) as r, count(*) as n_pairs
    from facts where review_body_words is not null and helpfulness_ratio is not null""",
    ("facts",),
)
def _(spark, sf):
    return stats.length_helpfulness_corr(fx.review_facts(spark, sf), clip=300).drop("p_value")


@query(
    "length_helpfulness_p_value",
    """, c as (select corr(x, y) as r, count(*) as n from (select cast(least(review_body_words, 500) as double) as x,
        helpfulness_ratio as y from measured) where x is not null and y is not null),
    t as (select *, r * sqrt((n - 2) / (1 - r * r)) as t, n - 2 as v from c),
    a as (select *, atan(abs(t) / sqrt(v)) as low, exp(lgamma((v + 1) / cast(2 as double)) - lgamma(v / cast(2 as double))) / sqrt(pi()) as scale from t),
    s as (select sum(pow(cos(low + (k + 0.5) * (pi() / 2 - low) / 200000), v - 1)) as heights from a, range(200000) g(k))
    select round(r, 6) as r, n as n_pairs, round(2 * scale * heights * (pi() / 2 - low) / 200000, 6) as p_value from a, s""",
    ("measured",),
)
def _(spark, sf):
    return stats.length_helpfulness_corr(fx.measured(spark, sf))


_CORR = ["star_rating", "helpful_votes", "total_votes", "helpfulness_ratio", "review_body_words", "review_headline_words"]


@query(
    "corr_matrix",
    " union all ".join(
        f"select '{b}' as row_col, '{a}' as col_col, round(corr({b}, {a}), 6) as r from measured"
        for i, a in enumerate(_CORR)
        for b in _CORR[i + 1 :]
    ),
    ("measured",),
)
def _(spark, sf):
    return stats.corr_matrix(fx.measured(spark, sf), _CORR)


@query(
    "monthly_trend",
    """, m as (select last_day(try_cast(review_date as date)) as month, count(*) as n_reviews,
        round(avg(star_rating), 6) as mean_rating from filtered
        where try_cast(review_date as date) is not null group by 1)
    select last_day(cast(d as date)) as month, coalesce(n_reviews, 0) as n_reviews, mean_rating
    from (select unnest(generate_series(date_trunc('month', min(month)), date_trunc('month', max(month)),
        interval 1 month)) as d from m) left join m on month = last_day(cast(d as date))""",
    ("filtered",),
)
def _(spark, sf):
    dated = fx.filtered(spark, sf).withColumn("review_date", parse_date("review_date"))
    return profile.monthly_trend(dated)


@query(
    "monthly_trend_facts",
    """select last_day(review_date) as month, count(*) as n_reviews,
    round(avg(star_rating), 6) as mean_rating from facts group by 1""",
    ("facts",),
)
def _(spark, sf):
    return profile.monthly_trend(fx.review_facts(spark, sf))


@query(
    "roc_auc",
    """, c as (select score, count(*) filter (label = 1) as p, count(*) filter (label <> 1) as q
        from scores where score is not null group by 1),
    r as (select p, q, sum(q) over (order by score) as upto from c)
    select round(cast(sum(p * (upto - q * cast(0.5 as double))) as double) / (sum(p) * sum(q)), 6) as auc,
    cast(sum(p) as bigint) as n_pos, cast(sum(q) as bigint) as n_neg from r""",
    ("scores",),
)
def _(spark, sf):
    return stats.roc_auc(fx.scores(spark, sf))


_KS_SQL = """, c as (select {value} as v, count(*) filter ({first}) as p, count(*) filter (not {first}) as q
        from {source} where {value} is not null group by 1),
    r as (select sum(p) over (order by v) as a, sum(q) over (order by v) as b, sum(p) over () as n,
        sum(q) over () as m from c)
    select round(max(abs(cast(a as double) / n - cast(b as double) / m)), 6) as statistic,
    cast(max(n) as bigint) as n_first, cast(max(m) as bigint) as n_second from r"""


@query(
    "ks_two_sample",
    _KS_SQL.format(value="score", first="event_type = 'purchase'", source="scores"),
    ("scores",),
)
def _(spark, sf):
    first = F.col("event_type") == "purchase"
    return stats.ks_two_sample(fx.scores(spark, sf), "score", first).drop("p_value")


@query(
    "ks_helpfulness_by_purchase",
    _KS_SQL.format(value="helpfulness_ratio", first="verified_purchase = 'Y'", source="facts"),
    ("facts",),
)
def _(spark, sf):
    first = F.col("verified_purchase") == "Y"
    return stats.ks_two_sample(fx.review_facts(spark, sf), "helpfulness_ratio", first).drop("p_value")


_KS_LIMIT_SQL = (
    _KS_SQL.replace("\n    select round(max(abs(", ",\n    d as (select max(abs(").replace(" / m)), 6) as", " / m)) as")
    + """),
    l as (select *, statistic * statistic * n_first / cast(n_first + n_second as double) * n_second as x from d)
    select round(statistic, 6) as statistic, n_first, n_second, round(case when x < 0.04 then 1.0 else greatest(0.0, least(1.0,
        (select sum(case when k % 2 = 1 then 2.0 else -2.0 end * exp(-2.0 * k * k * x)) from range(1, 201) g(k)))) end, 6) as p_value from l"""
)


@query(
    "ks_p_value",
    _KS_LIMIT_SQL.format(value="helpfulness_ratio", first="verified_purchase = 'Y'", source="facts"),
    ("facts",),
)
def _(spark, sf):
    """The limit's p, whatever the size."""
    return stats.ks_two_sample(
        fx.review_facts(spark, sf), "helpfulness_ratio", F.col("verified_purchase") == "Y", exact_up_to=0
    )


@query(
    "ks_exact_p",
    """, c as (select helpfulness_ratio as v, count(*) filter (star_rating = 5) as p, count(*) filter (star_rating <> 5) as q
        from measured where helpfulness_ratio is not null group by 1),
    r as (select sum(p) over (order by v) as a, sum(q) over (order by v) as b, sum(p) over () as n, sum(q) over () as m from c),
    g as (select max(abs(a * m - b * n)) as reach, max(n) as n, max(m) as m from r),
    walk as (select 0 as t, 0 as x, cast(1 as double) as mass union all
        select t, x, sum(mass) as mass from (
            select t + 1 as t, x + s as x, mass * (case when s = 1 then n - x else m - (t - x) end) / (n + m - t) as mass
            from walk, g, (values (0), (1)) steps(s) where case when s = 1 then x < n else t - x < m end), g
        where abs(x * g.m - (t - x) * g.n) < reach group by t, x)
    select round(reach / cast(n * m as double), 6) as statistic, cast(n as bigint) as n_first, cast(m as bigint) as n_second,
    round(1 - coalesce((select sum(mass) from walk where t = n + m), 0), 6) as p_value from g""",
    ("measured",),
)
def _(spark, sf):
    """Samples small enough for a count of paths."""
    return stats.ks_two_sample(fx.measured(spark, sf), "helpfulness_ratio", F.col("star_rating") == 5)


@query(
    "confusion_matrix",
    """, c as (select label, prediction, count(*) as n from predictions group by 1, 2)
    select cast(l as int) as label, cast(p as int) as prediction, coalesce(n, 0) as n,
    round(coalesce(coalesce(n, 0) / nullif(cast(sum(coalesce(n, 0)) over (partition by l) as double), 0), 0), 6) as row_share
    from range(0, 3) a(l) cross join range(0, 3) b(p) left join c on label = l and prediction = p""",
    ("predictions",),
)
def _(spark, sf):
    return metrics.confusion_matrix(fx.predictions(spark, sf), 3)


_PER_CLASS = """, k as (select cast(i as int) as class,
        (select count(*) from predictions where label = i) as support,
        (select count(*) from predictions where prediction = i) as predicted,
        (select count(*) from predictions where label = i and prediction = i) as hits
        from range(0, 2) t(i)),
    f as (select class, support, hits, coalesce(hits / nullif(cast(predicted as double), 0), 0) as precision,
        coalesce(hits / nullif(cast(support as double), 0), 0) as recall,
        coalesce(2 * hits / nullif(cast(support + predicted as double), 0), 0) as f1 from k)"""


@query(
    "classification_report",
    _PER_CLASS
    + """
    select cast(class as varchar) as name, round(precision, 6) as precision, round(recall, 6) as recall,
        round(f1, 6) as f1, support from f
    union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
        cast(sum(support) as bigint) from f
    union all select 'weighted avg', round(sum(precision * support) / sum(support), 6),
        round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
        cast(sum(support) as bigint) from f""",
    ("predictions",),
)
def _(spark, sf):
    return metrics.classification_report(fx.predictions(spark, sf), 2)


@query(
    "classification_metrics",
    _PER_CLASS
    + """
    select round(cast(sum(hits) as double) / sum(support), 6) as accuracy, round(avg(f1), 6) as f1_macro,
    (select round(avg(-ln(case when label = 1 then p1 else 1 - p1 end)), 6) from predictions) as loss from f""",
    ("predictions",),
)
def _(spark, sf):
    return metrics.classification_metrics(fx.predictions(spark, sf), 2, "probability")


@query(
    "misclass_patterns",
    """select (label + 1) || '->' || (prediction + 1) as pattern, count(*) as n from predictions
    where label <> prediction group by 1 order by n desc, pattern limit 10""",
    ("predictions",),
)
def _(spark, sf):
    return metrics.misclass_patterns(fx.predictions(spark, sf), 10)


@query(
    "discriminator_accuracy",
    """select round(avg(case when score > 0.5 then 1 else 0 end) filter (label = 1), 6) as acc_real,
    round(avg(case when score <= 0.5 then 1 else 0 end) filter (label = 0), 6) as acc_fake from scores""",
    ("scores",),
)
def _(spark, sf):
    return metrics.discriminator_accuracy(fx.scores(spark, sf))


def _quality_sql(by: str) -> str:
    select, group = (f"{by}, ", " group by 1") if by else ("", "")
    return f"""select {select}round(avg(gan_quality), 6) as mean, round(stddev_samp(gan_quality), 6) as std,
    count(gan_quality) as "count" from generated{group}"""


@query("quality_by_category", _quality_sql("category"), ("generated",))
def _(spark, sf):
    return metrics.quality_by(fx.generated(spark, sf), ["category"])


@query("quality_by_rating", _quality_sql("star_rating"), ("generated",))
def _(spark, sf):
    return metrics.quality_by(fx.generated(spark, sf), ["star_rating"])


@query("quality_overall", _quality_sql(""), ("generated",))
def _(spark, sf):
    return metrics.quality_by(fx.generated(spark, sf))


@query("quality_gate", "select id, round(gan_quality, 6) as gan_quality from generated where gan_quality >= 0.5", ("generated",))
def _(spark, sf):
    return metrics.quality_gate(fx.generated(spark, sf), 0.5).select("id", "gan_quality")


def score_metrics(spark, sf):
    """One-row metric tables of three score subsets, the shape of a model comparison."""
    scores = fx.scores(spark, sf)
    named = {
        "full": F.lit(True),
        "unrefined": F.col("event_type").isin("purchase", "view"),
        "random": F.col("event_type").isin("purchase", "click"),
    }
    tables = {}
    for i, (name, keep) in enumerate(named.items()):
        rows = scores.filter(keep)
        table = stats.roc_auc(rows).select("auc")
        coherence = rows.agg(F.avg("score")).scalar()
        table = table.withColumn("coherence", coherence)
        if i != 1:
            table = table.withColumn("quality", rows.agg(F.max("score")).scalar())
        tables[name] = table
    return metrics.metric_table(tables)


def _auc_sql(where: str) -> str:
    return f"""(select cast(sum(p * (upto - q * cast(0.5 as double))) as double) / (sum(p) * sum(q)) from (
        select p, q, sum(q) over (order by score) as upto from (select score,
        count(*) filter (label = 1) as p, count(*) filter (label <> 1) as q from scores
        where score is not null and {where} group by 1)))"""


def _score_metrics_sql() -> str:
    rows = []
    for name, where, quality in (
        ("full", "true", True),
        ("unrefined", "event_type in ('purchase', 'view')", False),
        ("random", "event_type in ('purchase', 'click')", True),
    ):
        best = f"(select max(score) from scores where {where})" if quality else "cast(null as double)"
        rows.append(
            f"""select '{name}' as model, {_auc_sql(where)} as auc,
            (select avg(score) from scores where {where}) as coherence, {best} as quality"""
        )
    return ", mt as (" + " union all ".join(rows) + ")"


@query(
    "metric_table",
    _score_metrics_sql()
    + " select model, round(auc, 6) as auc, round(coherence, 6) as coherence, round(quality, 6) as quality from mt",
    ("scores",),
)
def _(spark, sf):
    return score_metrics(spark, sf)


_LONG = """, ml as (select model, 'auc' as metric, auc as value from mt union all
    select model, 'coherence', coherence from mt union all select model, 'quality', quality from mt)"""


@query(
    "metric_long",
    _score_metrics_sql()
    + _LONG
    + " select model, metric, round(value, 6) as value from ml where value is not null",
    ("scores",),
)
def _(spark, sf):
    return metrics.metric_long(score_metrics(spark, sf))


@query(
    "ablation_delta",
    _score_metrics_sql()
    + _LONG
    + """ select a.model, a.metric, round(a.value, 6) as value, round(a.value - b.value, 6) as delta
    from ml a join ml b on a.metric = b.metric and b.model = 'full'
    where a.model <> 'full' and a.value is not null and b.value is not null""",
    ("scores",),
)
def _(spark, sf):
    return metrics.ablation_delta(score_metrics(spark, sf), "full")


@query(
    "success_checks",
    _score_metrics_sql()
    + """, w as (select max(coherence) filter (model = 'full') as f, max(coherence) filter (model = 'random') as r,
        max(coherence) filter (model = 'unrefined') as u, max(auc) filter (model = 'full') as a from mt)
    select 'full_above_random' as "check", f > r as passed from w union all
    select 'full_above_unrefined', f > u from w union all select 'auc_above_half', a > 0.5 from w""",
    ("scores",),
)
def _(spark, sf):
    return metrics.success_checks(score_metrics(spark, sf), "full", "random", "unrefined")


@query(
    "best_epoch",
    """select model, epoch, value from history
    qualify row_number() over (partition by model order by value desc, epoch) = 1""",
    ("history",),
)
def _(spark, sf):
    return metrics.best_epoch(fx.history(spark, sf), "val_acc")


@query(
    "lowest_epoch",
    """select model, epoch, value from history
    qualify row_number() over (partition by model order by value, epoch) = 1""",
    ("history",),
)
def _(spark, sf):
    return metrics.best_epoch(fx.history(spark, sf), "val_acc", "min")


@query(
    "calibration_error",
    """, b as (select least(floor(score * 10), 9) as bin, count(*) as n,
        abs(avg(score) - avg(cast(label as double))) as gap from scores where score is not null group by 1)
    select round(sum(n * gap) / sum(n), 6) as calibration_error, cast(sum(n) as bigint) as n from b""",
    ("scores",),
)
def _(spark, sf):
    return metrics.calibration_error(fx.scores(spark, sf), "score", "label")


@query(
    "group_share_lookup",
    """, t as (select product_category, count(*) as total from facts group by 1)
    select product_category, star_rating, count(*) as n, any_value(total) as total,
    round(count(*) / cast(any_value(total) as double), 6) as share
    from facts join t using (product_category) group by 1, 2""",
    ("facts",),
)
def _(spark, sf):
    cells = profile.rating_by_category(fx.review_facts(spark, sf))
    totals = cells.groupBy("product_category").agg(F.sum("n").alias("total"))
    joined = join_lookup(cells, totals, ["product_category"])
    return joined.withColumn("share", F.col("n") / F.col("total"))


_STATE_COLUMNS = ["star_rating", "review_body_words", "helpfulness_ratio", "review_headline"]


@query(
    "merged_profile",
    " union all ".join(
        f"""select product_category, '{c}' as "column", count(*) as n_rows, count({c}) as n, """
        + (
            f"""round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, round(cast(min({c}) as double), 6) as low,
            round(cast(max({c}) as double), 6) as high"""
            if c != "review_headline"
            else "cast(null as double) as mean, cast(null as double) as std, cast(null as double) as low, cast(null as double) as high"
        )
        + " from measured group by 1"
        for c in _STATE_COLUMNS
    ),
    ("measured",),
)
def _(spark, sf):
    """Three parts of the reviews, each summed up on its own, merged; the exact parts of the state."""
    rows = fx.measured(spark, sf)
    parts = [state.profile_state(rows.filter(F.col("review_id") % 3 == k), _STATE_COLUMNS, ["product_category"]) for k in range(3)]
    merged = state.merge_states(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["product_category"])
    std = F.when(F.col("n_numbers") > 1, F.sqrt(F.col("m2") / (F.col("n_numbers") - 1)))
    return merged.select("product_category", "column", "n_rows", "n", "mean", std.alias("std"), "low", "high")
