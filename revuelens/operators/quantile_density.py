"""Conditional density of variable width: exact quantiles per stratum, joined by straight lines.

Each stratum has knots of its own at equal steps of probability, so that pieces are narrow
where values are dense and a heavy tail has pieces of its own width. A value that takes up
several quantiles is an atom: its mass lies on a narrow piece around it. Beyond the
outermost knots an exponential tail holds the mass that a new row has there. The
distribution is strictly increasing and continuous; density and inverse are its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revuelens.operators.joins import join_lookup
from revuelens.operators.ranks import exact_quantiles
from revuelens.session import materialize

ATOM = 1e-3  # width of an atom's piece, as a share of the stratum's range
LEFT, BODY, RIGHT = -1, 0, 1


def fit_quantile_density(df: DataFrame, by: Sequence[str], value: str, steps: int = 32) -> DataFrame:
    """One row per stratum and piece: ``piece``, ``side``, ``lo``, ``hi``, ``prob``, ``cum``, ``density``; stored.

    ``cum`` is the probability before the piece. A tail (``side`` -1 or 1) has its mass at the knot's
    end and falls off by the factor e over ``hi - lo``; ``density`` is that at the knot. Each tail
    holds 1 / (n + 2) of a stratum of n values. Infinite values, nulls and NaN have no part.
    """
    by = list(by)
    v = F.col(value).cast("double")
    usable = df.filter(F.abs(v) < float("inf"))
    probs = [i / steps for i in range(steps + 1)]
    found = exact_quantiles(usable, by, value, probs)
    spread = F.element_at("quantiles", -1) - F.element_at("quantiles", 1)
    knots = (
        found.select(*by, "n_values", spread.alias("_range"), F.posexplode("quantiles").alias("_i", "_v"))
        .groupBy(*by, "n_values", "_range", "_v")
        .agg((F.min("_i") / steps).alias("_from"), (F.max("_i") / steps).alias("_to"))
    )
    # Windows over the knots of one stratum, of which there are ``steps`` + 1 at most.
    order = W.partitionBy(*by).orderBy("_v")
    gaps = F.least(F.col("_v") - F.lag("_v").over(order), F.lead("_v").over(order) - F.col("_v"))
    room = F.when(F.col("_range") > 0, F.col("_range") * ATOM).otherwise(1.0)
    half = F.when(F.col("_to") > F.col("_from"), F.least(room / 2, F.coalesce(gaps / 4, room / 2))).otherwise(0.0)
    placed = knots.withColumn("_half", half).withColumn("_next", F.lead(F.struct("_v", "_half")).over(order))
    tail = 1 / (F.col("n_values") + 2.0)
    inner = 1 - 2 * tail
    step = F.when(F.col("_range") > 0, F.col("_range") / steps).otherwise(1.0)
    low, high = F.col("_v") - F.col("_half"), F.col("_v") + F.col("_half")

    def piece(when: Column, side: int, lo: Column, hi: Column, prob: Column, cum: Column) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(side).alias("side"), lo.alias("lo"), hi.alias("hi"), prob.alias("prob"), cum.alias("cum"),
                (prob / (hi - lo)).alias("density"),
            ),
        )

    pieces = F.array(
        piece(F.col("_from") == 0, LEFT, low - step, low, tail, F.lit(0.0)),
        piece(F.col("_half") > 0, BODY, low, high, (F.col("_to") - F.col("_from")) * inner, tail + F.col("_from") * inner),
        piece(
            F.col("_next").isNotNull(), BODY, high, F.col("_next._v") - F.col("_next._half"), F.lit(1 / steps) * inner,
            tail + F.col("_to") * inner,
        ),
        piece(F.col("_to") == 1, RIGHT, high, high + step, tail, 1 - tail),
    )
    listed = placed.select(*by, F.explode(F.filter(pieces, lambda p: p.isNotNull())).alias("_p")).select(*by, "_p.*")
    numbered = F.row_number().over(W.partitionBy(*by).orderBy("cum", "lo")) - 1
    return materialize(listed.withColumn("piece", numbered))


def _with_piece(df: DataFrame, model: DataFrame, by: Sequence[str], value: Column, edge: str) -> DataFrame:
    """``_at``, the last piece whose ``edge`` is not above the value; the first for values below all."""
    table = model.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("piece", "side", "lo", "hi", "prob", "cum"))).alias("_pieces"))
    joined = join_lookup(df.withColumn("_x", value), table, by, "left")
    start = F.element_at("_pieces", 1)
    found = F.aggregate("_pieces", start, lambda best, p: F.when(p[edge] <= F.col("_x"), p).otherwise(best))
    return joined.withColumn("_at", F.when(F.col("_pieces").isNotNull() & F.col("_x").isNotNull(), found)).drop("_pieces")


def _inside(at: str = "_at") -> Column:
    return (F.col("_x") - F.col(f"{at}.lo")) / (F.col(f"{at}.hi") - F.col(f"{at}.lo"))


def log_density(df: DataFrame, model: DataFrame, by: Sequence[str], value: str, name: str = "log_density") -> DataFrame:
    """Add the log density of each row's value; null for a null value or an unseen stratum."""
    v = F.col(value).cast("double")
    rows = _with_piece(df, model, by, F.when(~F.isnan(v), v), "lo")
    side = F.col("_at.side")
    # Below the first knot the left tail rises towards it, beyond the last the right one falls.
    fall = F.when(side == LEFT, F.least(_inside() - 1, F.lit(0.0))).when(side == RIGHT, -_inside()).otherwise(0.0)
    density = F.log(F.col("_at.prob") / (F.col("_at.hi") - F.col("_at.lo"))) + fall
    return rows.withColumn(name, density).drop("_x", "_at")


def cumulative(df: DataFrame, model: DataFrame, by: Sequence[str], value: str, name: str = "cum_prob") -> DataFrame:
    """Add the probability of a value no larger than each row's."""
    v = F.col(value).cast("double")
    rows = _with_piece(df, model, by, F.when(~F.isnan(v), v), "lo")
    side, prob = F.col("_at.side"), F.col("_at.prob")
    share = F.when(side == LEFT, F.exp(_inside() - 1)).when(side == RIGHT, 1 - F.exp(-_inside())).otherwise(_inside())
    return rows.withColumn(name, F.col("_at.cum") + prob * share).drop("_x", "_at")


def draw_values(df: DataFrame, model: DataFrame, by: Sequence[str], uniform: Column, name: str = "value") -> DataFrame:
    """Add the value whose ``cumulative`` is ``uniform``, a number in [0, 1); 0 itself counts as 2**-53."""
    rows = _with_piece(df, model, by, F.greatest(uniform, F.lit(2.0**-53)), "cum")
    side, width = F.col("_at.side"), F.col("_at.hi") - F.col("_at.lo")
    share = (F.col("_x") - F.col("_at.cum")) / F.col("_at.prob")
    drawn = (
        F.when(side == LEFT, F.col("_at.hi") + width * F.log(share))
        .when(side == RIGHT, F.col("_at.lo") - width * F.log1p(-share))
        .otherwise(F.col("_at.lo") + share * width)
    )
    return rows.withColumn(name, drawn).drop("_x", "_at")
