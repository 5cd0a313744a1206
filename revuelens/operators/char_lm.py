"""Character n-gram model per condition: counted, with add-k smoothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revuelens.functions.scalars import perplexity
from revuelens.functions.text import char_grams
from revuelens.operators.joins import null_safe_join
from revuelens.session import materialize


def count_grams(df: DataFrame, text: str, n: int, by: Sequence[str]) -> DataFrame:
    """Rows per (condition, context of n-1 characters, next character)."""
    return (
        df.select(*by, F.explode(char_grams(F.col(text), n)).alias("_gram"))
        .groupBy(*by, "_gram")
        .agg(F.count("*").alias("n"))
        .select(
            *by,
            F.substring("_gram", 1, n - 1).alias("context"),
            F.substring("_gram", n, 1).alias("next"),
            "n",
        )
    )


def fit_char_ngram(
    df: DataFrame, text: str, n: int = 3, by: Sequence[str] = ("star_rating",)
) -> DataFrame:
    """Counts of each continuation and of its context, stored for repeated use."""
    by = list(by)
    grams = count_grams(df, text, n, by)
    contexts = grams.groupBy(*by, "context").agg(F.sum("n").alias("n_context"))
    return materialize(null_safe_join(grams, contexts, [*by, "context"]))


def char_perplexity(
    df: DataFrame,
    model: DataFrame,
    text: str,
    vocab_size: int,
    n: int = 3,
    by: Sequence[str] = ("star_rating",),
    smoothing: float = 1.0,
) -> DataFrame:
    """Mean negative log probability and perplexity of texts per condition.

    ``vocab_size`` is the number of characters that may follow a context, unknown ones
    included. A text's first ``n - 1`` characters are context only and not scored.
    Texts are counted into distinct n-grams before they meet the model, so the
    join moves one row per n-gram and not one per character.
    """
    by = list(by)
    grams = count_grams(df, text, n, by)
    seen = null_safe_join(
        grams, model.select(*by, "context", "next", F.col("n").alias("_hits")), [*by, "context", "next"], "left"
    )
    contexts = model.select(*by, "context", "n_context").distinct()
    both = null_safe_join(seen, contexts, [*by, "context"], "left")
    hits = F.coalesce("_hits", F.lit(0)) + smoothing
    prob = hits / (F.coalesce("n_context", F.lit(0)) + smoothing * vocab_size)
    loss = F.sum(-F.log(prob) * F.col("n")) / F.sum("n")
    return both.groupBy(*by).agg(
        F.sum("n").alias("n_chars"), loss.alias("loss"), perplexity(loss).alias("perplexity")
    )
