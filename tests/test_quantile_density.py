"""Density, distribution and inverse of quantile tables agree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from revuelens.operators import density
from revuelens.operators import quantile_density as qd

SCHEMA = "g string, v double"


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(4)
    heavy = np.exp(2 * draw.normal(size=3000))
    atoms = draw.choice([0.0, 0.5, 1.0, 2.5], p=[0.5, 0.3, 0.19, 0.01], size=400)
    data = [("heavy", float(x)) for x in heavy] + [("atoms", float(x)) for x in atoms]
    data += [("one", 7.0), (None, 1.0), (None, 3.0), ("atoms", None), ("atoms", float("nan")), ("heavy", float("inf")), ("none", None)]
    return spark.createDataFrame(data, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def model(rows):
    return qd.fit_quantile_density(rows, ["g"], "v", 16)


def test_mass_is_one_and_pieces_touch(model):
    for g in ("heavy", "atoms", "one", None):
        pieces = sorted((r for r in model.collect() if r.g == g), key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert sum(p.prob for p in pieces) == pytest.approx(1, abs=1e-12)
        assert [p.side for p in pieces] == [-1, *[0] * (len(pieces) - 2), 1]
        for a, b in zip(pieces[:-1], pieces[1:]):
            assert a.hi == pytest.approx(b.lo, abs=1e-12) and b.cum == pytest.approx(a.cum + a.prob) and a.hi > a.lo
    assert model.filter("g = 'none'").count() == 0


@pytest.mark.parametrize("g", ["heavy", "atoms", "one", None])
def test_inverse_and_density_agree_with_the_distribution(spark, model, g):
    us = [0.0, 1e-9, 1e-4, *np.linspace(0.003, 0.997, 199).tolist(), 1 - 1e-9]
    asked = spark.createDataFrame([(g, u) for u in us], "g string, u double")
    drawn = qd.draw_values(asked, model, ["g"], F.col("u"), "v")
    back = qd.cumulative(qd.log_density(drawn, model, ["g"], "v"), model, ["g"], "v").orderBy("u").collect()
    values = [r.v for r in back]
    assert values == sorted(values) and len(set(values)) == len(values)
    for r in back:
        assert r.cum_prob == pytest.approx(max(r.u, 2.0**-53), abs=1e-9)
    step = 1e-7
    near = spark.createDataFrame([(g, v + d, v, d) for v in values[3:-1:7] for d in (-step, step)], "g string, v double, at double, d double")
    ends = {(r.at, r.d): r.cum_prob for r in qd.cumulative(near, model, ["g"], "v").collect()}
    dens = {r.v: np.exp(r.log_density) for r in back}
    for v in values[3:-1:7]:
        assert (ends[v, step] - ends[v, -step]) / (2 * step) == pytest.approx(dens[v], rel=2e-2)


def test_atoms_and_tails_are_kept(spark, rows, model):
    def share(lo, hi):
        two = spark.createDataFrame([("atoms", lo), ("atoms", hi)], SCHEMA)
        a, b = (r.cum_prob for r in qd.cumulative(two, model, ["g"], "v").orderBy("v").collect())
        return b - a

    # Of a value that takes up several steps, what lies between its outermost quantiles.
    assert share(-0.01, 0.01) == pytest.approx(0.5, abs=0.07) and share(0.49, 0.51) == pytest.approx(0.3, abs=0.13)
    # A long tail in pieces of its own width is far likelier than on an even grid.
    held = rows.filter("g = 'heavy' and v < 1e9")
    even = density.fit_conditional_density(held, ["g"], "v", 16)
    ours = qd.log_density(held, model, ["g"], "v").agg(F.avg("log_density")).first()[0]
    theirs = density.log_density(held, even, ["g"], "v").agg(F.avg("log_density")).first()[0]
    assert ours > theirs + 1


def test_unseen_strata_and_values(spark, model):
    asked = spark.createDataFrame([("new", 1.0), ("heavy", None), ("heavy", float("nan")), ("heavy", 1e300), ("heavy", -5.0)], SCHEMA)
    got = [r.log_density for r in qd.log_density(asked, model, ["g"], "v").collect()]
    assert sum(x is None for x in got) == 3 and all(np.isfinite(x) for x in got if x is not None)
    assert qd.draw_values(asked.limit(1), model, ["g"], F.lit(0.5)).first()["value"] is None
    assert qd.fit_quantile_density(asked.limit(0), ["g"], "v").count() == 0
