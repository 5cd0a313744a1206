import math
import random

import numpy as np

from revuelens.llm import nndescent
from revuelens.llm.nndescent import _forest, near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold):
    """Links and components of distinct usable ids."""
    usable = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable[i] = (label, np.array(v, dtype=np.float32).astype(float))
    ids = sorted(usable)
    links, parent = dict.fromkeys(ids, 0), {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            (la, va), (lb, vb) = usable[a], usable[b]
            if la == lb and len(va) == len(vb) and va @ vb / math.sqrt((va @ va) * (vb @ vb)) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {(i, links.get(i, 0), root(i) if i in parent else i) for i, _, _ in rows}


def test_clusters_pairs_and_odd_vectors(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(900):
        rows.append((i, r.normal(size=16).astype(np.float32).tolist(), int(r.integers(3))))
    for i in range(60):
        base = np.array(rows[i * 3][1])
        rows.append((1000 + i, (base * 2 + r.normal(size=16) * 0.1).astype(np.float32).tolist(), rows[i * 3][2]))
    # A neighbourhood larger than any list and than a block of counting.
    base = r.normal(size=16) * 3
    rows += [(2000 + i, (base + r.normal(size=16) * 0.5).astype(np.float32).tolist(), 1) for i in range(330)]
    rows += [
        (3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [float("nan")] * 16, 1), (3004, [None] * 16, 1),
        (3005, [float("inf")] + [0.0] * 15, 1), (3006, rows[0][1], None), (3007, rows[0][1][:8], rows[0][2]), (3008, rows[0][1], rows[0][2]),
    ]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as a", "3 as component").repartition(5)
    got = near_duplicates(docs).collect()
    assert {(x.vec_id, x.n_links, x.component_id) for x in got} == brute(rows, 0.93)
    assert all(x.kept == (x.vec_id == x.component_id) for x in got)


def test_repeated_null_and_no_rows(spark):
    v = [1.0, 2.0]
    docs = spark.createDataFrame([(None, v, 1), (1, v, 1), (1, v, 1), (2, v, 1)], SCHEMA)
    got = sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in near_duplicates(docs).collect()), key=str)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, True)]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_rows_of_one_id_keep_their_own_links(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    docs = spark.createDataFrame([(1, v, 1), (1, w, 1), (2, w, 1), (3, v, 1), (1, w, 2)], SCHEMA)
    got = sorted((x.vec_id, x.n_links, x.component_id) for x in near_duplicates(docs).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_forest_ties_what_is_linked():
    linked = np.eye(6, dtype=bool)
    for a, b in ((0, 2), (2, 4), (1, 5), (4, 0)):
        linked[a, b] = linked[b, a] = True
    edges = _forest(linked)
    assert len(edges) == 3 and {frozenset(e) for e in edges} <= {frozenset(e) for e in ((0, 2), (2, 4), (0, 4), (1, 5))}


def answers(frame):
    return {(x.vec_id, x.n_links, x.component_id) for x in frame.collect()}


def test_dense_neighbourhoods_joined_by_one_weak_link(spark):
    r = np.random.default_rng(8)
    at = lambda degrees: np.array([math.cos(math.radians(degrees)), math.sin(math.radians(degrees))] + [0.0] * 14)
    near = lambda degrees: (at(degrees) + r.normal(size=16) * 0.003).astype(np.float32).tolist()
    rows = [(i, near(0.0), 1) for i in range(500)] + [(1000 + i, near(25.8), 1) for i in range(500)]
    rows += [(600, at(2.5).tolist(), 1), (1600, at(23.3).tolist(), 1)]
    want = brute(rows, 0.93)
    assert {c for _, _, c in want} == {0}
    assert answers(near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5))) == want


def test_one_group_of_copies_and_nothing_else(spark):
    r = np.random.default_rng(9)
    v, w = (r.normal(size=8).astype(np.float32) for _ in range(2))
    rows = [(i, v.tolist(), 1) for i in range(700)] + [(1000 + i, (w * 2.0 ** (i % 90 - 45)).tolist(), 2) for i in range(300)]
    want = {(i, 699, 0) for i in range(700)} | {(1000 + i, 299, 1000) for i in range(300)}
    assert answers(near_duplicates(spark.createDataFrame(rows, SCHEMA))) == want


def test_search_that_finds_too_little_is_followed_by_an_exact_one(spark, monkeypatch):
    first = nndescent.first_graph
    monkeypatch.setattr(nndescent, "first_graph", lambda *a: first(*a).filter("a < 300 and b < 300"))
    r = np.random.default_rng(10)
    base = r.normal(size=16) * 3
    rows = [(i, (base + r.normal(size=16) * 0.3).astype(np.float32).tolist(), 1) for i in range(300)]
    for i in range(150):
        v = r.normal(size=16)
        rows += [(1000 + 2 * i + j, (v + r.normal(size=16) * 0.03).astype(np.float32).tolist(), 1) for j in range(2)]
    assert answers(near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 0.93)


def test_recall_of_small_groups_is_not_hidden(spark):
    truth = spark.createDataFrame([(i, 100 + j) for i in range(3) for j in range(64)] + [(7, 8), (8, 7)], "a long, b long")
    found = spark.createDataFrame([(i, 0) for i in [*range(3), *range(100, 164)]], "id long, component long")
    assert nndescent.recall(truth, found) == 0.0
    assert nndescent.recall(truth.filter("a < 3"), found) == 1.0 and nndescent.recall(truth.limit(0), found) == 1.0
