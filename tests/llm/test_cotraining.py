import random

from revuelens.llm.cotraining import score_quality

DOCS = "doc_id long, text string, source string, lang string, n_chars long"


def corpus(n, seed=1):
    """Good texts are varied prose, bad ones repeat and shout; a source is mostly of one kind."""
    r = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        good = i % 4 != 0
        words = [f"w{r.randrange(3000)}" for _ in range(40)] if good else [r.choice(["BUY!!", "$$$", "###", f"X{r.randrange(9)}"]) for _ in range(40)]
        if r.random() < 0.1:
            words = [f"w{r.randrange(3000)}" for _ in range(3)]
        text = " ".join(words)
        source = f"s{r.randrange(5)}" if good == (r.random() < 0.85) else f"t{r.randrange(5)}"
        rows.append((i, text, source, "en", len(text)))
        truth[i] = int(good)
    return rows, truth


def test_held_out_accuracy_and_reruns(spark):
    rows, truth = corpus(1600)
    labels = [(i, truth[i]) for i in range(0, 1600, 10)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as t", "2 as score")
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {x.doc_id: x for x in score_quality(docs, table).collect()}
    assert len(got) == 1600
    held_out = [i for i in got if i % 10]
    right = lambda name: sum((getattr(got[i], name) >= 0.5) == truth[i] for i in held_out) / len(held_out)
    assert right("text_score") > 0.9 and right("meta_score") > 0.7 and right("score") >= right("text_score") - 0.01
    assert all(x.kept == (x.score >= 0.5) for x in got.values())
    again = score_quality(docs.repartition(7), table).collect()
    assert all(abs(got[x.doc_id].score - x.score) < 1e-9 for x in again)


def test_odd_rows(spark):
    rows, truth = corpus(200)
    odd = [(None, None, None, None, None), (900, "", "", "", -5), (901, "x " * 50_000, "s1", "en", 100_000), (901, "x", "s1", "en", 1)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    labels = [(i, truth[i]) for i in range(100)] + [(3, None), (None, 1), (5, 7), (99999, 1), (8, 1), (8, 0)]
    got = score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == 204 and all(0 <= x.score <= 1 for x in got)


def test_one_class_and_empty(spark):
    rows, _ = corpus(10)
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {x.score for x in score_quality(docs, labels).collect()} == {3 / 4}
    assert {x.score for x in score_quality(docs, labels.limit(0)).collect()} == {1 / 2}
    assert score_quality(docs.limit(0), labels).count() == 0
