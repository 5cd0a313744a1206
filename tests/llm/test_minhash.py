import random
import re

import numpy as np
import pytest

from revuelens.llm import shingles
from revuelens.llm.common import connected_components
from revuelens.llm.minhash import least_overlap, near_duplicates

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, length, percent):
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        n = len(words)
        sets[doc_id] = {tuple(words[i : i + length]) for i in range(n - length + 1)} if n >= length else (
            {tuple(words)} if words else set()
        )
    ids, parent = sorted(sets), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {(d, len(sets[d]), root(d)) for d in ids}


def varied(seed, words, edits):
    r = random.Random(seed)
    out = list(words)
    for _ in range(edits):
        out[r.randrange(len(out))] = f"new{r.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("length,percent", [(3, 85), (5, 80)])
def test_against_all_pairs(spark, length, percent):
    r = random.Random(1)
    rows = []
    line = " ".join(f"common{i}" for i in range(25))
    for base in range(12):
        words = [f"b{base}w{r.randrange(300)}" for _ in range(40 + 30 * base)]
        rows += [varied(r.random(), words, k % 9) + "\n" + line for k in range(15)]
    # A chain: each is near the next, not near the one after it.
    chain = [f"c{i}" for i in range(200)]
    for k in range(8):
        chain[k * 12 : k * 12 + 6] = [f"x{k}y{j}" for j in range(6)]
        rows.append(" ".join(chain))
    rows += [f"{line} short {i}" for i in range(40)]
    rows += [None, "", " \t\n", "one", "ONE", "one two", "a b c", "A b\tC", "É b c", "é b c"]
    rows = list(enumerate(rows, start=3))
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as rep", "'v' as v")
    got = near_duplicates(docs.repartition(6), length, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    result = got.collect()
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in result} == brute(rows, length, percent)
    assert all(x.kept == (x.doc_id == x.component_id) for x in result)


def test_many_near_copies_and_exact_copies(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(i, varied(i, words, 3)) for i in range(600)] + [(1000 + i, " ".join(words)) for i in range(500)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in got} == brute(rows, 3, 85)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, None), (5, "a b c d e f"), (5, "a b c d e f"), (6, "q " * 60_000)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted(((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=str)
    assert found == [(-1, 0, None, True), (-1, 2, None, True), (5, 2, 5, True), (5, 2, 5, True), (6, 1, 6, True)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(60, 59), (3, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 61)}
    assert least_overlap(85) == 37


@pytest.mark.parametrize("length", [1, 3, 5])
def test_sets_of_long_texts_are_those_of_the_whole(monkeypatch, length):
    draw = random.Random(length)
    texts = [" ".join(draw.choice(["a", "bb", "c" * 90, "dd\n", "\t"]) for _ in range(400)), "x" * 900, " " * 900, "word " * 300]
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        bounds = np.array([0, len(data)])
        whole = shingles.shingle_sets(data, bounds, length)
        monkeypatch.setattr(shingles, "LONG", 120)
        parts = shingles.shingle_sets(data, bounds, length)
        assert len(list(shingles.word_parts(data, 1, length - 1))) > 3 or len(text.split()) < 2
        monkeypatch.undo()
        assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()
