import collections

import pytest

from revuelens.llm.mixing import cycled_weights, mix_sources, repeat_rows, word_size


def brute_targets(sizes, weights, epochs, total):
    """Clamp, share the excess by weight, repeat."""
    clamped = set()
    while True:
        free = [s for s in sizes if s not in clamped]
        left = total - sum(epochs * sizes[s] for s in clamped)
        unit = left / sum(weights[s] for s in free) if free else 0
        over = {s for s in free if unit * weights[s] >= epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in clamped else unit * weights[s] for s in sizes}
        clamped |= over


def test_targets_repeats_and_reruns(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 5}" if i % 11 else None) for i in range(2000)]
    rows += [(5000 + i, "a b c d", "tiny") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", word_size("text"))
    weights = cycled_weights(docs)
    given = {r.source: r.weight for r in weights.collect()}
    assert list(given.values()).count(3) == 2 and given[None] == 1
    mixed = mix_sources(docs, weights, 5).collect()
    sizes = collections.Counter()
    taken = collections.Counter()
    for r in mixed:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.repeats <= 3 and r.taken == r.repeats * r.size
    wanted = brute_targets(dict(sizes), given, 3, sum(sizes.values()))
    for r in mixed:
        assert r.target == pytest.approx(wanted[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= 7 + 0.01 * wanted[s]
    assert wanted["tiny"] == 3 * sizes["tiny"]
    again = mix_sources(docs.repartition(7), weights, 5).collect()
    assert sorted(map(str, mixed)) == sorted(map(str, again))


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "", "a"), (1, "x y", "a"), (1, "x y", "a"), (2, "z " * 5000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.selectExpr("*", "1 as target", "2 as bucket", "3 as weight")
    mixed = mix_sources(docs, cycled_weights(docs), 1)
    assert mixed.count() == 5 and mixed.columns.count("target") == 1
    assert {r.taken for r in mixed.filter("size = 0").collect()} == {0}
    copies = repeat_rows(mixed, docs.columns)
    assert copies.columns == docs.columns and copies.count() == sum(r.repeats for r in mixed.collect())
    empty = docs.limit(0)
    assert mix_sources(empty, cycled_weights(empty), 1).count() == 0


def test_all_sources_clamped_and_weightless(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c", "y")], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("x", 1.0)], "source string, weight double")
    got = {r.source: (r.target, r.taken) for r in mix_sources(docs, weights, 1, total=1000).collect()}
    assert got == {"x": (6.0, 6), "y": (0.0, 0)}


def test_targets_are_met_without_ids_and_with_repeated_ones(spark):
    rows = [(i if i % 2 else None if i % 4 else 7, f"w{i} " * (1 + i % 4), f"s{i % 2}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mix_sources(docs, cycled_weights(docs), 3).collect()
    taken, target = collections.Counter(), {}
    for r in mixed:
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s in target:
        assert abs(taken[s] - target[s]) <= 20
