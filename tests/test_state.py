"""Merged states say what one pass over all rows says."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from revuelens.operators import profile, state

COLUMNS = ["v", "far", "k", "t"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(6)
    data = [
        (None if i % 10 == 9 else ("hot" if i % 3 else "b"), float(x) if i % 7 else None, 1e9 + float(x), i % 50, f"t{i % 1500}" if i % 4 else None)
        for i, x in enumerate(np.exp(draw.normal(size=6000)))
    ]
    data += [("b", float("nan"), 1e9, None, "x"), ("none", None, None, None, None), ("one", 3.0, 4.0, 5, "six")]
    return spark.createDataFrame(data, "g string, v double, far double, k int, t string").withColumn("part", F.monotonically_increasing_id() % 5)


def said(df, by):
    return {(*[r[b] for b in by], r["column"]): r for r in df.collect()}


@pytest.mark.parametrize("by", [["g"], []])
def test_parts_merged_equal_one_pass(spark, folder, rows, by):
    for part in range(5):
        state.add_to_state(rows.filter(F.col("part") == part), folder + "/state", COLUMNS, by)
    state.compact_state(spark, folder + "/state", folder + "/compact", by)
    whole = said(state.summary(state.profile_state(rows, COLUMNS, by), by), by)
    merged = said(state.summary(state.read_state(spark, folder + "/state", by), by), by)
    compact = said(state.summary(state.read_state(spark, folder + "/compact", by), by), by)
    assert whole.keys() == merged.keys() == compact.keys()
    for key, r in whole.items():
        for other in (merged[key], compact[key]):
            for name in ("n", "nulls", "min", "max"):
                assert other[name] == r[name]
            for name in ("mean", "std"):
                assert other[name] == (None if r[name] is None else pytest.approx(r[name], rel=1e-6 if "far" in key else 1e-9))
    if not by:
        return
    exact = {tuple(r[b] for b in by): r for r in profile.describe(rows.filter(~F.isnan("v") | F.col("v").isNull()), by, "v").collect()}
    for key, r in merged.items():
        if key[-1] == "v":
            truth = exact[key[:-1]]
            assert r["n"] == truth["n"] and r["std"] == (truth["std"] and pytest.approx(truth["std"], rel=1e-9))


def test_sketches_keep_to_their_errors(rows):
    parts = [state.profile_state(rows.filter(F.col("part") == p), COLUMNS) for p in range(5)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    probs = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
    found = said(state.summary(state.merge_states(merged), (), probs), ())
    values = np.sort([r.v for r in rows.filter("v is not null and not isnan(v)").collect()])
    for p, q in zip(probs, found["v",]["quantiles"]):
        assert abs(np.searchsorted(values, q) / len(values) - p) <= 2 * state.RANK_ERROR
    distinct = rows.select("t").distinct().count() - 1
    assert abs(found["t",]["n_distinct"] / distinct - 1) <= 4 * state.DISTINCT_ERROR
    assert found["t",]["mean"] is None and found["t",]["quantiles"] is None


def test_nothing_to_say(rows):
    empty = state.merge_states(state.profile_state(rows.limit(0), COLUMNS, ["g"]), ["g"])
    assert state.summary(empty, ["g"]).count() == 0
