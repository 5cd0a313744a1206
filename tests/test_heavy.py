"""Top terms by summaries are those of counting everything."""

import pytest
from pyspark.sql import functions as F

from revuelens.operators import heavy, text


@pytest.fixture(scope="module")
def texts(spark):
    """Few frequent words, many rare ones; a hot group, a flat one, a tiny one, a null one and an empty one."""
    i = F.col("id")
    rare = F.concat(F.lit("r"), i.cast("string"))
    zipf = F.concat(F.lit("w"), F.floor(F.pow(F.lit(2.0), F.pmod(F.xxhash64(i), F.lit(900)) / 100.0)).cast("string"))
    group = F.when(i % 10 < 6, "hot").when(i % 10 < 9, "flat").when(i < 40, "tiny").when(i < 2000, "empty")
    words = F.when(group == "flat", F.concat_ws(" ", rare, F.concat(rare, F.lit("x")))).when(group == "empty", " ").otherwise(
        F.concat_ws(" ", zipf, zipf, rare, zipf)
    )
    return spark.range(0, 6000, 1, 5).select(group.alias("g"), words.alias("t")).unionByName(
        spark.createDataFrame([("hot", None), (None, None)], "g string, t string")
    )


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("sizes", [(64, 256), (1024,), heavy.SIZES])
@pytest.mark.parametrize("by", [["g"], []])
def test_same_rows_as_counting_all(texts, monkeypatch, sizes, by):
    monkeypatch.setattr(heavy, "SIZES", sizes)
    assert rows(heavy.frequent_ngrams(texts, "t", 1, 7, by)) == rows(text.top_ngrams(texts, "t", 1, 7, by))
    assert rows(heavy.frequent_ngrams(texts, "t", 2, 5, by)) == rows(text.top_ngrams(texts, "t", 2, 5, by))


def test_few_terms_are_left_to_count(texts):
    terms = texts.filter("g = 'hot'").select("g", F.explode(F.split("t", " ")).alias("term"))
    kept, untold = heavy.candidates(heavy.summarize(terms, ["g"], 1024), ["g"], 1024, 5)
    assert untold.count() == 0
    assert 5 <= kept.count() < 60 < 3000 < terms.distinct().count()
    # A summary too small for the question says so.
    assert heavy.candidates(heavy.summarize(terms, ["g"], 16), ["g"], 16, 15)[1].count() == 1


def test_vocabulary_is_the_counted_one(texts):
    found = heavy.frequent_vocabulary(texts, "t", 50)
    assert rows(found.drop("n")) == rows(text.word_vocabulary(texts, "t", 50))


def test_few_groups_are_summed_up_once(spark, monkeypatch):
    """No second pass over the terms, and the terms are made once in each."""
    monkeypatch.setattr(heavy, "SIZES", (8, 1024))
    made = []
    summarize = heavy.summarize
    monkeypatch.setattr(heavy, "summarize", lambda rows, by, size: made.append(rows) or summarize(rows, by, size))
    texts = [(i % 3, " ".join(f"w{i * j % 29}" for j in range(1, 30)) if i % 4 else None) for i in range(120)]
    rows = spark.createDataFrame(texts, "g int, t string")
    got = heavy.frequent_ngrams(rows, "t", 2, 5, ["g"]).collect()
    assert sorted(got) == sorted(text.top_ngrams(rows, "t", 2, 5, ["g"]).collect())
    assert len(made) == 1
    plan = made[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2  # tokens, and pairs of them
    monkeypatch.setattr(heavy, "HELD", 0)
    assert sorted(heavy.frequent_ngrams(rows, "t", 2, 5, ["g"]).collect()) == sorted(got)
    assert len(made) > 2
