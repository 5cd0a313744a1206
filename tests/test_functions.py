"""Hand-worked values of the column functions."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revuelens.functions import scalars, text, vectors


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return rows.select(column.alias("x")).first()["x"]


# Worked by hand: what goes in, what comes out.
CLEANED = [
    ("Plain words stay, as they are.", "plain words stay, as they are."),
    ("OLD\tlamp\n\nnew   shade", "old lamp new shade"),
    ("<p>Soft</p><br/>and <i class='x'>warm</i>", "soft and warm"),
    ("see https://shop.test/p?q=1#top now", "see now"),
    ("HTTPS://UPPER.TEST gone", "gone"),
    ("5* value @ $3 (really)", "5 value 3 really"),
    ("well-made; \u201cgood\u201d: isn't it?", "well-made; good : isn't it?"),
    ("caf\u00e9 \u6771\u4eac \u0663 na\u00efve_x", "caf\u00e9 \u6771\u4eac \u0663 na\u00efve_x"),
    ("\u2603 snow \U0001f600", "snow"),
    ("a < b and c > d", "a d"),
    ("a\u00a0b\u2003c\x1cd\x85e", "a b c d e"),
    ("", ""),
    (" \t ", ""),
]


def test_clean_text_by_hand(spark):
    rows = spark.createDataFrame(CLEANED, "raw string, wanted string")
    for row in rows.select("raw", "wanted", text.clean_text(F.col("raw")).alias("got")).collect():
        assert row["got"] == row["wanted"], row["raw"]


def test_clean_text_null_is_empty(spark):
    assert spark.sql("select cast(null as string) t").select(text.clean_text(F.col("t"))).first()[0] == ""


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aB\u00e9 \t\n\x0b\x1c\x85\u3000<>/!?.#http:_9\u0663\u00df'-\"", max_size=40), min_size=30, max_size=30))
def test_cleaned_text_keeps_its_promises(samples):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame([(s,) for s in samples], "t string")
    once = rows.select("t", text.clean_text(F.col("t")).alias("c"), text.word_count(F.col("t")).alias("n"))
    for row in once.withColumn("again", text.clean_text(F.col("c"))).collect():
        c = row["c"]
        assert row["again"] == c and c == c.lower() and c == " ".join(c.split())
        assert all(x.isalnum() or x in " _.,!?;:'-" for x in c)
        assert not any(w.startswith("http") and len(w) > 4 for w in c.split())
        assert row["n"] == len(row["t"].split())


def test_word_count_of_nothing(spark):
    assert one(spark, text.word_count(F.lit(""))) == 0
    assert one(spark, text.word_count(F.lit("  "))) == 0


def test_ngrams_of_short_text(spark):
    grams = text.ngrams(text.words(F.col("t")), 2)
    assert one(spark, grams, t="one") == []
    assert one(spark, grams, t="a b c") == ["a b", "b c"]


def test_char_grams_keep_code_points_whole(spark):
    assert one(spark, text.char_grams(F.col("t"), 2), t="a😀b\nc") == ["a😀", "😀b", "b\n", "\nc"]
    assert one(spark, text.char_grams(F.col("t"), 3), t="ab") == []


def test_clean_words_drops_stop_and_short(spark):
    words = text.clean_words(F.col("t"), ["the"])
    assert one(spark, words, t="The cat's it do-not 12 ÉTÉ") == ["cats", "donot"]


def test_prompt_and_target(spark):
    row = dict(product_category="Books", star_rating=4, review_headline="h" * 60, review_body="b" * 300)
    assert one(spark, text.prompt(), **row) == "generate review: category Books rating 4"
    assert one(spark, text.target(), **row) == "Headline: " + "h" * 50 + " Body: " + "b" * 200


def test_helpfulness_and_dates(spark):
    rows = spark.createDataFrame(
        [(1, 2, "2015-02-28"), (0, 0, "2015-02-30"), (None, 3, "x")],
        "helpful_votes int, total_votes int, review_date string",
    )
    got = rows.select(scalars.helpfulness().alias("h"), scalars.parse_date("review_date").alias("d")).collect()
    assert [r["h"] for r in got] == [0.5, None, None]
    assert [str(r["d"]) for r in got] == ["2015-02-28", "None", "None"]


def test_clip_keeps_null(spark):
    rows = spark.createDataFrame([(700,), (3,), (None,)], "w int")
    assert [r[0] for r in rows.select(scalars.clip_upper("w", 500)).collect()] == [500, 3, None]


def test_perplexity_is_capped(spark):
    assert math.isclose(one(spark, scalars.perplexity(F.lit(50.0))), math.exp(20))


def test_vector_functions(spark):
    row = dict(a=[3.0, 4.0], b=[4.0, 3.0], z=[0.0, 0.0])
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    assert math.isclose(one(spark, vectors.cosine(a, b), **row), 24 / 25)
    assert one(spark, vectors.cosine(a, z), **row) is None
    assert one(spark, vectors.l2(a), **row) == 5.0
    assert math.isclose(one(spark, vectors.l2_dist(a, b), **row), math.sqrt(2))
    assert one(spark, vectors.vec_mse(a, b), **row) == 1.0
    first, rest = vectors.vec_split(vectors.vec_concat(a, b), 2)
    assert one(spark, first, **row) == [3.0, 4.0] and one(spark, rest, **row) == [4.0, 3.0]
    assert one(spark, vectors.one_hot(F.lit(7), 3)) == [0.0, 0.0, 0.0]


def test_seeded_normals_look_normal(spark):
    rows = spark.range(400).select(F.explode(vectors.seeded_normals("id", 1, 25)).alias("x"))
    mean, std, n = rows.agg(F.avg("x"), F.stddev_samp("x"), F.count("*")).first()
    assert n == 10_000 and abs(mean) < 0.05 and abs(std - 1) < 0.05
