"""Edge cases, invariants and independence of the data layout."""

import itertools
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from revuelens.operators import (
    char_lm,
    density,
    filters,
    joins,
    metrics,
    prepare,
    profile,
    ranks,
    sampling,
    stats,
    text,
)

REVIEWS = (
    "review_id long, product_category string, star_rating int, review_headline string, review_body string, "
    "helpful_votes int, total_votes int, vine string, verified_purchase string, review_date string"
)


def review(i, **changes):
    row = dict(
        review_id=i, product_category="a", star_rating=5, review_headline="fine", review_body="one two three four five",
        helpful_votes=1, total_votes=2, vine="N", verified_purchase="Y", review_date="2015-01-01",
    )
    row.update(changes)
    return tuple(row.values())


def skewed(spark, n=4000, partitions=4):
    """A third of the rows share one key and most of those one value."""
    hot = F.col("id") % 3 == 0
    return spark.range(0, n, 1, partitions).select(
        "id",
        F.when(hot, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"),
        F.when(F.col("id") % 11 == 0, None)
        .when(hot & (F.col("id") % 2 == 0), 1.5)
        .otherwise(F.pmod(F.col("id") * 7919, F.lit(1000)) / 10.0 - 40)
        .alias("v"),
    )


def test_filters_treat_unknown_as_no(spark):
    rows = spark.createDataFrame(
        [review(1), review(2, total_votes=None), review(3, verified_purchase="N"),
         review(4, review_body=None), review(5, vine="Y"), review(6, vine=None, total_votes=0)],
        REVIEWS,
    )
    ids = lambda df: sorted(r[0] for r in df.select("review_id").collect())
    assert ids(filters.filter_reviews(rows, 1)) == [1, 5]
    assert ids(filters.filter_reviews(rows, 1, exclude_vine=True)) == [1]
    report = filters.retention_report(rows, filters.keep_conditions(1)).orderBy("step").collect()
    assert [(r["stage"], r["rows_before"], r["rows_after"]) for r in report] == [
        ("verified", 6, 5), ("voted", 5, 3), ("complete", 3, 2),
    ]


@pytest.mark.parametrize("partitions", [1, 8])
def test_quantiles_equal_numpy(spark, partitions):
    rows = skewed(spark, partitions=partitions)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: r["quantiles"] for r in ranks.exact_quantiles(rows, ["k"], "v", probs).collect()}
    pdf = rows.toPandas().dropna()
    assert set(got) == set(pdf["k"])
    for key, group in pdf.groupby("k"):
        assert np.allclose(got[key], np.quantile(group["v"], probs))


def test_quantiles_without_keys_and_extreme_values(spark):
    values = [0.0, -0.0, 1e-320, -1e300, 1e300, 5.0, 5.0, -3.5]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = ranks.exact_quantiles(rows, [], "v", [0.25, 0.5, 1.0]).first()["quantiles"]
    assert np.allclose(got, np.quantile(values, [0.25, 0.5, 1.0]))


def test_quantile_groups_with_null_key(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", 5.0)], "k string, v double")
    got = {r["k"]: r["quantiles"][0] for r in ranks.exact_quantiles(rows, ["k"], "v", [0.5]).collect()}
    assert got == {None: 2.0, "x": 5.0}


def test_sample_and_split_are_exact_and_repeatable(spark):
    rows = skewed(spark)
    sample = sampling.stratified_sample(rows, ["k"], 100, 1, "id")
    sizes = {r["k"]: r["n"] for r in sample.groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert set(sizes.values()) == {100}
    again = sampling.stratified_sample(rows.repartition(7), ["k"], 100, 1, "id")
    assert sample.exceptAll(again).isEmpty() and again.exceptAll(sample).isEmpty()
    whole = sampling.stratified_sample(rows, ["k"], 10**9, 1, "id")
    assert whole.count() == rows.count()

    split = sampling.stratified_split(rows, ["k"], (0.8, 0.1, 0.1), 1, "id")
    assert split.count() == rows.count() == split.select("id").distinct().count()
    for r in split.groupBy("k").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")]
    ).collect():
        assert r["train"] == math.floor(r["n"] * 0.8 + 0.5)
        assert r["train"] + r["val"] == math.floor(r["n"] * 0.9 + 0.5)


def test_split_of_tiny_strata(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, k string")
    got = sampling.stratified_split(rows, ["k"], (0.8, 0.1, 0.1), 1, "id").groupBy("k", "split").count().collect()
    assert sorted((r["k"], r["split"], r["count"]) for r in got) == [("a", "train", 1), ("b", "train", 2)]


def test_sample_n_and_top_n(spark):
    rows = skewed(spark)
    assert sampling.sample_n(rows, 37, 3, "id").count() == 37
    top = sampling.top_n_per_group(rows, ["k"], [F.desc("v"), "id"], 3, "id", parts=5)
    pdf = rows.toPandas().sort_values(["v", "id"], ascending=[False, True])
    wanted = set(pdf.groupby("k").head(3)["id"])
    assert {r["id"] for r in top.collect()} == wanted


def test_lookup_join_is_the_same_broadcast_or_not(spark):
    rows = skewed(spark, 500)
    lookup = rows.groupBy("k").agg(F.count("*").alias("n"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    small = joins.join_lookup(rows, lookup, ["k"]).collect()
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        large = joins.join_lookup(rows, lookup, ["k"]).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(small) == 500 and sorted(map(str, small)) == sorted(map(str, large))


def test_ranks_of_close_infinite_and_crowded_values(spark):
    rows = [(1, float(1_700_000_000_000 + (i * 7919) % 50_021)) for i in range(50_000)]
    rows += [(1, float("inf"))] * 3 + [(1, float("-inf"))] * 2 + [(1, float("nan")), (2, 5.0), (2, None)]
    counts = ranks.count_values(spark.createDataFrame(rows, "k int, x double"), ["k"], "x")
    ranked = ranks.cumulative_counts(counts, ["k"]).filter("k = 1").orderBy("value").collect()
    total = 0
    for r in ranked:
        total += r["n"]
        assert r["cum_n"] == total and r["total_n"] == 50_005
    assert ranked[0]["value"] == float("-inf") and ranked[-1]["value"] == float("inf")
    score = spark.createDataFrame([(1, float("inf")), (0, 1.0), (1, 1.0), (0, float("-inf"))], "label int, score double")
    assert stats.roc_auc(score).first()["auc"] == 0.875


def test_numbers_follow_the_alphabet_whatever_the_prefix(spark):
    values = [f"same-beginning-{i:05d}" for i in range(3000)] + ["a", "z", "\u00e9"]
    frame = spark.createDataFrame([(v,) for v in values + values + [None]], "v string")
    got = {r["v"]: r["n"] for r in ranks.number_distinct(frame, "v", "n").collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}


def test_nan_and_infinity_have_no_bin(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 1.0, float("nan"), float("inf"), None)], "v double")
    got = profile.histogram(rows, "v", 2).orderBy("bin").collect()
    assert [(r["lo"], r["n"]) for r in got] == [(0.0, 1), (0.5, 1)]


def test_counts_come_from_one_scan(spark, folder):
    spark.createDataFrame([(1, "train"), (5, "val")], "star_rating int, split string").write.parquet(folder + "/t")
    rows = spark.read.parquet(folder + "/t")
    shares = profile.rating_share(rows)
    assert shares._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 1
    # The total reads the exchange of the counts; no window gathers all groups in one task.
    for table in (profile.value_counts(rows, "split"), profile.split_report(rows), profile.strata_balance(rows.withColumn("product_category", F.col("split")))):
        table.collect()
        final = table._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "ReusedExchange" in table._jdf.queryExecution().executedPlan().toString(), final


def test_impute_median_then_default(spark):
    rows = spark.createDataFrame(
        [("a", 1, 0.2), ("a", 1, 0.6), ("a", 1, None), ("b", 1, None)],
        "product_category string, star_rating int, h double",
    )
    got = sorted((r["product_category"], r["h"]) for r in prepare.impute_by_group(rows, "h").collect())
    assert got == [("a", 0.2), ("a", pytest.approx(0.4)), ("a", 0.6), ("b", 0.0)]


def test_category_codes_are_alphabetical(spark):
    names = ["Books", "Apparel", "Boats", "b", "Ä", "Apparel"]
    codes = prepare.category_codes(spark.createDataFrame([(n,) for n in names], "product_category string"))
    assert {r[0]: r[1] for r in codes.collect()} == {n: i for i, n in enumerate(sorted(set(names)))}


def test_standardize(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "x double, c double")
    scaled = prepare.standardize(rows, {"x": "xs", "c": "cs"})
    mean, std, flat = scaled.agg(F.avg("xs"), F.stddev_pop("xs"), F.max(F.abs("cs"))).first()
    assert abs(mean) < 1e-12 and std == pytest.approx(1) and flat == 0


def test_prepare_keeps_schema_and_bounds(spark):
    rows = spark.createDataFrame(
        [review(i, star_rating=1 + i % 5, product_category="ab"[i % 2], total_votes=2 + i % 4) for i in range(200)]
        + [review(900, review_body="<b></b> <i> <u> <p> <q>"), review(901, review_headline="###")],
        REVIEWS,
    )
    out = prepare.prepare(rows, 1, 10, 5)
    assert out.groupBy("product_category", "star_rating").count().agg(F.max("count")).first()[0] == 10
    assert out.filter("review_id >= 900").count() == 0
    assert {"length_scaled", "helpfulness_scaled", "split", "category_encoded"} <= set(out.columns)


def test_monthly_trend_lists_quiet_months(spark):
    rows = spark.sql(
        "select date'2014-01-31' review_date, 4 star_rating union all select date'2014-04-02', 2 union all select null, 5"
    )
    got = [(str(r[0]), r[1], r[2]) for r in profile.monthly_trend(rows).orderBy("month").collect()]
    assert got == [
        ("2014-01-31", 1, 4.0), ("2014-02-28", 0, None), ("2014-03-31", 0, None), ("2014-04-30", 1, 2.0),
    ]


def test_histogram_and_kde_conserve_mass(spark):
    rows = skewed(spark).filter("v is not null")
    bins = profile.histogram(rows, "v", 17, ["k"])
    assert bins.agg(F.sum("n")).first()[0] == rows.count()
    single = profile.histogram(spark.createDataFrame([(3.0,)] * 4, "v double"), "v", 4).collect()
    assert [r["n"] for r in sorted(single, key=lambda r: r["bin"])] == [0, 0, 4, 0]
    curve = profile.kde(rows, ["k"], "v", 200).orderBy("k", "x").toPandas()
    for _, g in curve.groupby("k"):
        assert np.trapezoid(g["density"], g["x"]) == pytest.approx(1, abs=0.02)
    assert profile.kde(spark.createDataFrame([(3.0,)], "v double"), [], "v").count() == 0


def test_proportions_and_margins(spark):
    rows = spark.createDataFrame(
        [review(1, star_rating=1), review(2), review(3, product_category="b"), review(4, star_rating=None)], REVIEWS
    )
    for r in profile.rating_mix(rows).collect():
        assert sum(r[f"r{k}"] for k in range(1, 6)) == pytest.approx(1)
    table = {r["category"]: r["r_all"] for r in profile.crosstab_margins(rows).collect()}
    assert table == {"a": 2, "b": 1, "All": 3}
    assert [r["n"] for r in profile.rating_share(rows).orderBy("star_rating").collect()] == [1, 0, 0, 0, 2]


def test_auc_and_ks_with_ties(spark):
    pairs = [(0.1, 0), (0.4, 1), (0.4, 0), (0.4, 0), (0.8, 1), (0.9, 1)]
    rows = spark.createDataFrame(pairs, "score double, label int")
    wins = [1.0 if a > b else 0.5 if a == b else 0.0 for a, x in pairs if x for b, y in pairs if not y]
    assert stats.roc_auc(rows).first()["auc"] == pytest.approx(statistics.mean(wins))
    ks = stats.ks_two_sample(rows, "score", F.col("label") == 1).first()
    assert ks["statistic"] == pytest.approx(2 / 3) and ks["p_value"] == pytest.approx(_share_of_orders(3, 3, 6))
    same = stats.ks_two_sample(spark.range(100).withColumn("f", F.col("id") % 2 == 0), "id", F.col("f")).first()
    assert same["p_value"] == pytest.approx(1, abs=1e-6)
    assert stats.roc_auc(rows.filter("label = 1")).first()["auc"] is None


def _share_of_orders(n, m, reach):
    """Share of all orders of two samples whose largest gap, times both sizes, is at least ``reach``."""
    hits = total = 0
    for picked in itertools.combinations(range(n + m), n):
        x = most = 0
        for t in range(n + m):
            x += t in picked
            most = max(most, abs(x * m - (t + 1 - x) * n))
        total, hits = total + 1, hits + (most >= reach)
    return hits / total


def test_exact_p_by_counting_all_orders(spark):
    for n, m in ((1, 1), (1, 6), (4, 4), (5, 7), (7, 3), (6, 8)):
        for reach in range(n * m + 1):
            assert stats.walk_leaves(n, m, reach) == pytest.approx(_share_of_orders(n, m, reach), abs=1e-12), (n, m, reach)
    # Far out the chance is small and still right: all of one sample first, two orders in all.
    assert stats.walk_leaves(40, 60, 2400) == pytest.approx(2 / math.comb(100, 40), rel=1e-9)
    assert stats.walk_leaves(2000, 2000, 2000 * 80) == pytest.approx(2 * math.exp(-2 * 1.6), rel=0.05)
    none = stats.ks_two_sample(spark.range(5).withColumn("f", F.lit(True)), "id", F.col("f")).first()
    assert none["p_value"] is None and none["n_second"] == 0


def test_p_is_the_limits_beyond_the_exact_sizes(spark):
    rows = spark.range(1200).select((F.col("id") * 7 % 1201).alias("v"), (F.col("id") % 3 == 0).alias("f"))
    exact = stats.ks_two_sample(rows, "v", F.col("f")).first()["p_value"]
    assert stats.ks_two_sample(rows, "v", F.col("f"), exact_up_to=10).first()["p_value"] == pytest.approx(exact, abs=0.03)


def test_student_p_values(spark):
    def integrated(t, v):
        """The density summed beyond t, by the midpoint rule in a bounded variable."""
        edges = np.linspace(math.atan(t / math.sqrt(v)), math.pi / 2, 200_001)
        angle = (edges[1:] + edges[:-1]) / 2
        scale = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(math.pi)
        return 2 * scale * float((np.cos(angle) ** (v - 1)).sum()) * (edges[1] - edges[0])

    points = [(t, v) for v in (1, 2, 3, 4, 5, 10, 99, 100, 2000, 2001, 50_000) for t in (0.0, 0.3, 1.0, 2.2, 4.5)]
    rows = spark.createDataFrame(points, "t double, v int")
    for r in rows.withColumn("p", stats.student_two_sided(F.col("t"), F.col("v"))).collect():
        assert r["p"] == pytest.approx(integrated(r["t"], r["v"]), abs=1e-7), r
    far = spark.createDataFrame([(t, 4_000_000_000) for t in (0.3, 1.0, 4.5)], "t double, v long")
    for r in far.withColumn("p", stats.student_two_sided(F.col("t"), F.col("v"))).collect():
        assert r["p"] == pytest.approx(math.erfc(r["t"] / math.sqrt(2)), rel=1e-6)
    # A tabulated point.
    assert integrated(2.228139, 10) == pytest.approx(0.05, abs=1e-6)


def test_report_with_an_absent_class(spark):
    rows = spark.createDataFrame([(0, 0), (0, 2), (2, 2), (2, 0)], "label int, prediction int")
    report = {r["name"]: r for r in metrics.classification_report(rows, 5).collect()}
    assert set(report) == {"0", "2", "macro avg", "weighted avg"}
    assert report["macro avg"]["f1"] == pytest.approx(0.5)
    assert metrics.confusion_matrix(rows, 5).count() == 25
    patterns = [tuple(r) for r in metrics.misclass_patterns(rows, 10).collect()]
    assert patterns == [("1->3", 1), ("3->1", 1)]


def test_best_epoch_first_of_equals(spark):
    rows = spark.createDataFrame(
        [("m", 1, "acc", 0.5), ("m", 2, "acc", 0.7), ("m", 3, "acc", 0.7)],
        "model string, epoch int, metric string, value double",
    )
    assert tuple(metrics.best_epoch(rows, "acc").first()) == ("m", 2, 0.7)


QUALITY_FIELDS = "category string, star_rating int, gan_quality double"
QUALITY = [("Apparel", 1, 1.0), ("Apparel", 2, 0.8), ("Books", 1, 0.7), ("Books", 2, 0.7), ("Camera", 1, 1.0)]


def test_quality_tables(spark):
    rows = spark.createDataFrame(QUALITY, QUALITY_FIELDS)
    got = {r["category"]: (r["mean"], r["count"]) for r in metrics.quality_by(rows, ["category"]).collect()}
    assert got["Apparel"] == (pytest.approx(0.9), 2) and got["Books"] == (pytest.approx(0.7), 2)
    assert metrics.quality_gate(rows, 0.8).count() == 3


def test_char_model_prefers_seen_text(spark):
    train = spark.createDataFrame([(1, "abababab"), (5, "xyxyxyxy")], "star_rating int, t string")
    model = char_lm.fit_char_ngram(train, "t", 3)
    same = char_lm.char_perplexity(train, model, "t", 10, 3).collect()
    swapped = train.withColumn("star_rating", 6 - F.col("star_rating"))
    other = char_lm.char_perplexity(swapped, model, "t", 10, 3).collect()
    assert max(r["perplexity"] for r in same) < min(r["perplexity"] for r in other)
    assert all(r["perplexity"] == pytest.approx(10) for r in other)


def test_density_sums_to_one_and_samples_in_range(spark):
    rows = skewed(spark)
    model = density.fit_conditional_density(rows, ["k"], "v", 20)
    for r in model.groupBy("k").agg(F.sum("prob").alias("p")).collect():
        assert r["p"] == pytest.approx(1)
    drawn = density.sample_values(
        rows.select("id", "k"), model, ["k"], F.pmod(F.col("id") * 31, F.lit(100)) / 100.0, "s"
    )
    lo, hi, missing = drawn.agg(F.min("s"), F.max("s"), F.count_if(F.col("s").isNull())).first()
    assert missing == 0 and lo >= -40 and hi <= 60
    support = density.loglik_by(rows, model, ["k"], "v", ["k"], min_support=1000)
    assert {r["k"] for r in support.collect() if r["mean_loglik"] is not None} == {"hot"}


def test_sequences(spark):
    rows = spark.createDataFrame([(1, 5, "b a b zz"), (2, 5, "")], "review_id long, star_rating int, t string")
    vocab = text.word_vocabulary(rows, "t", 2)
    assert {r[0]: r[1] for r in vocab.collect()} == {"b": 2, "a": 3}
    ids = {r["review_id"]: r for r in text.token_ids(rows, "t", vocab, 5).collect()}
    assert ids[1]["input_ids"] == [2, 3, 2, 1, 0] and ids[1]["labels"] == [2, 3, 2, 1, -100]
    assert ids[2]["attention_mask"] == [0] * 5
    chars = text.char_vocab(rows, "t")
    encoded = text.encode_chars(rows.withColumn("t", F.lit("ab?z")), "t", chars)
    assert encoded.first()["encoded"] == [1, 2, 3]
    windows = text.char_windows(
        text.encode_chars(rows, "t", chars), 4, seed=1
    ).collect()
    assert len(windows) == 1 and windows[0]["x"][1:] == windows[0]["y"][:-1]


def test_sentiment_of_text_without_known_words(spark):
    rows = spark.createDataFrame([(1, "Good, GOOD bad"), (2, "x"), (3, None)], "review_id long, t string")
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -1.0)], "word string, valence double")
    got = {r["review_id"]: r["compound"] for r in text.lexicon_sentiment(rows, "t", lexicon).collect()}
    assert got[1] == pytest.approx(3 / math.sqrt(24)) and got[2] == 0 and got[3] == 0


def test_character_ids_are_made_a_run_at_a_time(monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = ["ab", None, "", "a?\U0001f600b", "zz", "b" * 50] * 3
    known = np.full(ord("b") + 1, -1, dtype=np.int32)
    known[[ord("a"), ord("b")]] = [0, 1]
    want = [None if t is None else ["ab".index(c) for c in t if c in "ab"] for t in texts]
    for limit in (1, 7, 1 << 20):
        monkeypatch.setattr(text, "SLICE_BYTES", limit)
        sizes = text.text_bytes(pa.array(texts))
        runs = list(text.row_runs(sizes, limit))
        assert [i for a, b in runs for i in range(a, b)] == list(range(len(texts)))
        assert all(b == a + 1 or sizes[a:b].sum() <= limit for a, b in runs)
        monkeypatch.setattr(text.row_runs, "__defaults__", (limit,))
        assert text._char_ids(pa.array(texts), known).to_pylist() == want
        assert text._char_ids(pa.array(texts).slice(2, 3), known).to_pylist() == want[2:5]
    assert text._char_ids(pa.array([], pa.string()), known).to_pylist() == []
    assert text._char_ids(pa.array(["ab"]), np.zeros(0, np.int32)).to_pylist() == [[]]
