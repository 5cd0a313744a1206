"""Exact top terms from mergeable summaries, without moving the terms that cannot be among them.

Each task sums its terms up in a summary of bounded size (Spark's frequent-items sketch,
of the Misra-Gries family); summaries are merged, so what is moved does not grow with the
number of different terms. The summary misses a term by at most ``ERROR`` of the rows
over its size. Terms that may be among the first ``k`` by that margin are then counted
exactly, in a second pass in which only they are kept. The result is complete where the
k-th count exceeds twice the error; a group in which it does not is summed up again in a
larger summary, and counted in full after that. Few groups have the larger one at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revuelens.functions.text import ngrams, tokens, words
from revuelens.operators.joins import null_safe_join
from revuelens.operators.sampling import top_n_per_group
from revuelens.session import materialize

# Fixed value: the sketch's error is this share of the rows over the size of its table.
ERROR = 3.5
SIZES = (1 << 14, 1 << 18)  # terms that a summary keeps, first and where that is too few
HELD = 1 << 21  # terms that the summaries of a task may keep for the larger size to come first
SENT = 100_000  # candidates that go to the tasks whole


def summarize(rows: DataFrame, by: Sequence[str], size: int) -> DataFrame:
    """Per group ``n_rows`` and ``summary``, the terms that stand out with their estimates."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.expr(f"approx_top_k(term, {size}, {size})").alias("summary"))


def candidates(summaries: DataFrame, by: Sequence[str], size: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(by, term) that may be among the first ``k``, and the groups for which that cannot be told.

    An estimate is never too low. A term that the summary leaves out has at most twice the
    error; one that it holds at most its estimate, so those well below the k-th are out. A
    summary of no more rows than it can keep terms is exact.
    """
    exact = F.col("n_rows") <= size
    error = F.when(exact, 0.0).otherwise(ERROR * F.col("n_rows") / size)
    at_least = F.get(F.transform("summary", lambda s: s["count"]), F.lit(k - 1)) - error
    judged = summaries.withColumn("_least", F.coalesce(at_least, F.lit(0.0)))
    judged = judged.withColumn("_told", exact | (F.col("_least") > 2 * error))
    listed = judged.filter("_told").select(*by, "_least", F.explode("summary").alias("_s"))
    kept = listed.filter(F.col("_s.count") >= F.col("_least")).select(*by, F.col("_s.item").alias("term"))
    return kept, judged.filter("not _told").select(*by)


def top_of_summaries(df: DataFrame, by: Sequence[str], terms: Column, k: int) -> DataFrame:
    """The ``k`` most frequent terms per group with their exact counts ``n``; equal counts in term order.

    The rows are those of counting every term. ``terms`` is an array column; null groups are
    groups, rows without terms count for nothing.
    """
    named = [f"_by{i}" for i in range(len(by))] or ["_by0"]
    groups = [F.col(c).alias(n) for c, n in zip(by, named, strict=False)] or [F.lit(0).alias("_by0")]
    source = df.select(*groups, terms.alias("_terms"))
    counts, rest = [], None

    def exploded(left: DataFrame | None) -> DataFrame:
        of = source if left is None else null_safe_join(source, left, named, "left_semi")
        # The outer form: of a plain one Spark infers a filter that makes the terms a second time.
        return of.select(*named, F.explode_outer("_terms").alias("term")).filter(F.col("term").isNotNull())

    # A pass makes all terms again, which costs more than a larger summary of few groups.
    n_groups = source.select(*named).distinct().count()
    for size in SIZES[-1:] if n_groups * SIZES[-1] <= HELD else SIZES:
        summaries = materialize(summarize(exploded(rest), named, size))
        kept, open_groups = candidates(summaries, named, size, k)
        kept = materialize(kept)
        # A count decides: a list of this length fits every task, a longer one is joined by its keys.
        kept = F.broadcast(kept) if kept.count() <= SENT else kept
        counts.append(_count(null_safe_join(exploded(rest), kept, [*named, "term"], "left_semi"), named))
        rest = materialize(open_groups)
        if not rest.take(1):
            break
    else:
        counts.append(_count(exploded(rest), named))
    counted = reduce(DataFrame.unionByName, counts)
    top = top_n_per_group(counted, named, [F.desc("n"), "term"], k, "term")
    return top.select(*[F.col(n).alias(c) for c, n in zip(by, named, strict=False)], "term", "n")


def _count(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by, "term").agg(F.count("*").alias("n"))


def frequent_ngrams(
    df: DataFrame, text: str, n: int, k: int, by: Sequence[str] = (), stop_words: Sequence[str] = ()
) -> DataFrame:
    """``text.top_ngrams`` by summaries, for texts whose different n-grams are too many to move."""
    return top_of_summaries(df, by, ngrams(tokens(F.col(text), stop_words), n), k)


def frequent_vocabulary(df: DataFrame, text: str, size: int, first_id: int = 2) -> DataFrame:
    """The ``size`` most frequent words and their ids, most frequent first."""
    top = top_of_summaries(df, [], words(F.lower(F.col(text))), size)
    order = W.orderBy(F.desc("n"), "term")
    return top.select(F.col("term").alias("word"), (F.row_number().over(order) + (first_id - 1)).alias("word_id"), "n")
