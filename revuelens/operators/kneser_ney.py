"""Interpolated Kneser-Ney over characters, per condition, as counted tables.

The highest order counts n-grams; each lower order counts the different characters that an
n-gram follows, so a character that only ever stands in one context is not taken for a likely
one elsewhere. A fixed discount goes from every seen continuation to the order below, down
to equal shares for all characters, the unknown one included. All orders come from one
table of n-gram counts; the texts are read once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revuelens.functions.scalars import perplexity
from revuelens.functions.text import char_grams
from revuelens.operators.joins import null_safe_join
from revuelens.session import materialize

DISCOUNT = 0.75


def fit_kneser_ney(df: DataFrame, text: str, n: int = 3, by: Sequence[str] = ("star_rating",)) -> DataFrame:
    """``order``, ``context``, ``next``, ``n``, ``n_types``; stored.

    A row with ``next`` is an n-gram: ``n`` counts its occurrences in the highest order, and
    below it the different characters before it. A row without ``next`` is a context: ``n`` sums
    that up, ``n_types`` counts the different characters that follow.
    """
    by = list(by)
    found = df.select(*by, F.explode(char_grams(F.col(text), n)).alias("_gram")).groupBy(*by, "_gram").agg(F.count("*").alias("n"))
    level = materialize(found)
    orders = []
    for order in range(n, 0, -1):
        counts = level.select(
            *by,
            F.lit(order).alias("order"),
            F.substring("_gram", 1, order - 1).alias("context"),
            F.substring("_gram", order, 1).alias("next"),
            "n",
            F.lit(None).cast("long").alias("n_types"),
        )
        contexts = counts.groupBy(*by, "order", "context").agg(F.sum("n").alias("n"), F.count("*").alias("n_types"))
        orders += [counts, contexts.withColumn("next", F.lit(None).cast("string"))]
        # A row per n-gram, so the rows of one suffix are the characters before it.
        shorter = F.expr(f"substring(_gram, 2, {order - 1})")
        level = level.groupBy(*by, shorter.alias("_gram")).agg(F.count("*").alias("n"))
    return materialize(reduce(DataFrame.unionByName, orders))


def with_probability(
    grams: DataFrame, model: DataFrame, vocab_size: int, n: int, by: Sequence[str], discount: float = DISCOUNT
) -> DataFrame:
    """Add ``probability`` of the last character of each ``_gram`` after those before it.

    ``grams`` has ``by`` and ``_gram``, one row each. Every order is an equi-join of the
    different n-grams with the model, never of characters.
    """
    by = list(by)
    rows, probability = grams, F.lit(1.0 / vocab_size)
    for order in range(1, n + 1):
        own = model.filter(F.col("order") == order)
        context, following = f"_context{order}", f"_next{order}"
        seen = own.filter("next is not null").select(
            *by, F.col("context").alias(context), F.col("next").alias(following), F.col("n").alias(f"_n{order}")
        )
        totals = own.filter("next is null").select(
            *by, F.col("context").alias(context), F.col("n").alias(f"_total{order}"), F.col("n_types").alias(f"_types{order}")
        )
        rows = rows.withColumn(context, F.substring("_gram", n - order + 1, order - 1)).withColumn(
            following, F.substring("_gram", n, 1)
        )
        rows = null_safe_join(rows, seen, [*by, context, following], "left")
        rows = null_safe_join(rows, totals, [*by, context], "left")
        probability = _interpolated(order, probability, discount)
        rows = rows.withColumn(f"_p{order}", probability).drop(context, following, f"_n{order}", f"_total{order}", f"_types{order}")
        probability = F.col(f"_p{order}")
    return rows.withColumn("probability", probability).drop(*[f"_p{i}" for i in range(1, n + 1)])


def _interpolated(order: int, below: Column, discount: float) -> Column:
    own = F.greatest(F.coalesce(F.col(f"_n{order}"), F.lit(0)) - discount, F.lit(0.0))
    passed_on = discount * F.col(f"_types{order}") * below
    return F.coalesce((own + passed_on) / F.col(f"_total{order}"), below)


def backoff_perplexity(
    df: DataFrame,
    model: DataFrame,
    text: str,
    vocab_size: int,
    n: int = 3,
    by: Sequence[str] = ("star_rating",),
    discount: float = DISCOUNT,
) -> DataFrame:
    """Mean negative log probability and perplexity of texts per condition.

    ``vocab_size`` is the number of characters that may follow, unknown ones included as one.
    A text's first ``n - 1`` characters are context only; null and shorter texts count for
    nothing. A condition without a model has equal shares.
    """
    by = list(by)
    grams = df.select(*by, F.explode(char_grams(F.col(text), n)).alias("_gram")).groupBy(*by, "_gram").agg(F.count("*").alias("n"))
    scored = with_probability(grams, model, vocab_size, n, by, discount)
    loss = F.sum(-F.log("probability") * F.col("n")) / F.sum("n")
    return scored.groupBy(*by).agg(F.sum("n").alias("n_chars"), loss.alias("loss"), perplexity(loss).alias("perplexity"))
