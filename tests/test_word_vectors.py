"""Learned vectors: counts by hand, the factorisation against numpy, related words nearest."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revuelens.operators import vectors, word_vectors
from revuelens.operators.text import word_vocabulary

TEXTS = ["a b c a", "b", None, "", "a unknown b", "c c c"]
WORDS = {"a": 2, "b": 3, "c": 4}


@pytest.mark.parametrize("run", [2, 4096])
def test_pairs_by_hand(spark, monkeypatch, run):
    monkeypatch.setattr(word_vectors, "RUN", run)
    docs = spark.createDataFrame([(t,) for t in TEXTS], "t string").repartition(3)
    vocabulary = spark.createDataFrame(list(WORDS.items()), "word string, word_id int")
    want = Counter()
    for t in TEXTS:
        ws = (t or "").split()
        for x in range(len(ws)):
            for y in range(x + 1, min(x + 3, len(ws))):
                if ws[x] in WORDS and ws[y] in WORDS:
                    want[WORDS[ws[x]], WORDS[ws[y]]] += 1
                    want[WORDS[ws[y]], WORDS[ws[x]]] += 1
    got = {(r.i, r.j): r.n for r in word_vectors.co_occurrences(docs, "t", vocabulary, 2).collect()}
    assert got == want


def test_factors_are_those_of_numpy(spark):
    draw = np.random.default_rng(1)
    base = draw.normal(size=(60, 4))
    dense = np.clip(base @ base.T, 0, None)
    dense[dense < 0.3] = 0
    entries = [(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    matrix = spark.createDataFrame(entries, "i int, j int, x double").repartition(4)
    found, values = word_vectors.factorise(matrix, 5, seed=3, rounds=8)
    u, s, _ = np.linalg.svd(dense)
    assert np.allclose(values, s[:5], rtol=1e-3)
    rows = {r.j: r.v for r in found.collect()}
    ours = np.array([rows.get(i, [0.0] * 5) for i in range(60)])
    theirs = u[:, :5] * np.sqrt(s[:5])
    assert np.allclose(np.abs((ours * theirs).sum(axis=0)), s[:5], rtol=2e-2)
    again, _ = word_vectors.factorise(matrix.repartition(2), 5, seed=3, rounds=8)
    other = {r.j: r.v for r in again.collect()}
    assert all(np.allclose(rows[j], other[j], atol=1e-6) for j in rows)
    assert word_vectors.factorise(matrix.limit(0), 5)[0].count() == 0


def test_related_words_are_nearest(spark):
    draw = random.Random(4)
    themes = [[f"t{t}w{w}" for w in range(6)] for t in range(5)]
    texts = [(i, " ".join(draw.choice(themes[i % 5] + ["the", "of"]) for _ in range(30))) for i in range(400)]
    docs = spark.createDataFrame([*texts, (998, None), (999, "nothing known")], "review_id long, t string")
    found = word_vectors.learn_word_vectors(docs, "t", word_vocabulary(docs, "t", 32), 8)
    table = {r.word: np.array(r.vector) / np.linalg.norm(r.vector) for r in found.collect()}
    for theme in themes:
        for w in theme:
            near = max((x for x in table if x != w), key=lambda x: table[x] @ table[w])
            assert near in theme, (w, near)
    embedded = vectors.embed_text(docs, {"t": "v"}, 8, encoder=word_vectors.encoder(found))
    rows = {r.review_id: np.array(r.v) for r in embedded.collect()}
    assert not rows[998].any() and not rows[999].any()
    same = np.mean([rows[i] @ rows[i + 5] for i in range(200)])
    apart = np.mean([rows[i] @ rows[i + 1] for i in range(200)])
    assert same > 0.8 and apart < same - 0.5


def test_no_texts(spark):
    docs = spark.createDataFrame([(1, None)], "review_id long, t string")
    empty = word_vectors.learn_word_vectors(docs, "t", word_vocabulary(docs, "t", 5), 4)
    assert empty.count() == 0
    assert vectors.embed_text(docs, {"t": "v"}, 4, encoder=word_vectors.encoder(empty)).filter(F.exists("v", lambda x: x != 0)).count() == 0


def test_an_encoder_gets_few_long_texts_at_a_time(spark, tmp_path):
    from revuelens.operators import vectors

    seen = str(tmp_path / "seen")

    def encode(texts):
        with open(seen, "a") as log:
            log.write(f"{sum(map(len, texts))} {len(texts)}\n")
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.range(0, 40, 1, 1).select(
        F.col("id").alias("review_id"),
        F.when(F.col("id") % 10 != 9, F.repeat(F.lit("a "), 200_000)).alias("t"),
        F.lit("h").alias("h"),
    )
    got = vectors.embed_text(rows, {"t": "v", "h": "w"}, 2, encoder=encode).collect()
    assert [r["review_id"] for r in got] == list(range(40))
    assert all(r["v"] == [0.0 if r["review_id"] % 10 == 9 else 400_000.0, 1.0] and r["w"] == [1.0, 1.0] for r in got)
    assert max(int(line.split()[0]) for line in open(seen)) <= 1 << 20


def test_words_are_looked_up_a_run_at_a_time(monkeypatch):
    import pyarrow as pa

    from revuelens.operators import text

    monkeypatch.setattr(text, "WORD_RUN", 3)
    rows = pa.array([["a", "b"], None, [], ["c", "a", "a", "b"], ["c"], ["b", "b"]])
    runs = list(text._word_runs(rows, pa.array(["a", "b"])))
    assert len(runs) == 3 and [n for n, *_ in runs] == [3, 1, 2]
    found = text._listed_ids(rows, pa.array(["a", "b"]), np.array([5, 6, -1], dtype=np.int32))
    assert found.to_pylist() == [[5, 6], [], [], [-1, 5, 5, 6], [-1], [6, 6]]
    assert text._listed_ids(rows.slice(3, 2), pa.array(["a", "b"]), np.array([5, 6, -1], dtype=np.int32)).to_pylist() == [[-1, 5, 5, 6], [-1]]
