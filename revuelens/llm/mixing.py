"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revuelens.operators.ranks import number_distinct
from revuelens.session import materialize

# Fixed value: a word is a run of anything but blank and the five control white spaces.
WORD = r"[^\x20\x09-\x0D]+"
BUCKET_DIGITS = 3
WEIGHT_TYPE = T.DecimalType(28, 9)


def word_size(text: str) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _bucket(id_column: str, text: str, seed: int) -> Column:
    """Seeded place of a document in [0, 4096), by its id and text; a null id has a name of its own."""
    name = F.coalesce(F.col(id_column).cast("string"), F.lit("null"))
    body = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    digest = F.md5(F.concat(name, F.lit("#"), body, F.lit(f"#{seed}#mix")))
    return F.conv(F.substring(digest, 1, BUCKET_DIGITS), 16, 10).cast("int")


def water_level(sources: DataFrame, total: int | None, max_epochs: int) -> tuple[float, bool]:
    """Words per unit of weight once the excess of clamped sources is shared out again.

    ``sources`` has ``source_size`` and ``weight``, one row per source. Each round
    is one aggregation; only its four sums come to the driver, all exact, so reruns
    agree. The second value tells that every source is clamped.
    """
    cap = F.col("source_size") * max_epochs
    everything = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    aim = Fraction(total if total is not None else everything[0] or 0)
    weight = Fraction(everything[1] or 0)
    if weight == 0:
        return 0.0, False
    level, clamped = float(aim / weight), -1
    while True:
        over = (F.col("weight").cast("double") * F.lit(level)) >= cap
        row = sources.agg(
            F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))
        ).first()
        if row[2] == clamped:
            return level, False
        clamped = row[2]
        if not row[1]:
            return level, True
        level = max(0.0, float((aim - (row[0] or 0)) / Fraction(row[1])))


def plan_mix(
    docs: DataFrame,
    weights: DataFrame,
    seed: int,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
    max_epochs: int = 3,
    total: int | None = None,
) -> DataFrame:
    """Per source: ``source``, ``source_size``, ``target``, ``whole`` repetitions and ``cut``.

    A document is repeated ``whole`` times, and once more if its seeded bucket is
    below ``cut``. The cut is placed on word totals of 4,096 buckets per source, so
    a source of any size is counted before it is moved, and misses its target by
    half a bucket at most (a single document in a small source).
    """
    buckets = materialize(
        docs.select(
            F.col(source).alias("source"), _bucket(id_column, text, seed).alias("bucket"), word_size(text).alias("size")
        )
        .groupBy("source", "bucket")
        .agg(F.sum("size").alias("size"))
    )
    totals = buckets.groupBy("source").agg(F.sum("size").alias("source_size"))
    known = weights.select(F.col("source").alias("_source"), F.col("weight").cast(WEIGHT_TYPE).alias("weight"))
    sources = materialize(
        totals.join(known, F.col("source").eqNullSafe(F.col("_source")), "left").select(
            "source", "source_size", F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0)).cast(WEIGHT_TYPE).alias("weight")
        )
    )
    level, all_clamped = water_level(sources, total, max_epochs)
    cap = (F.col("source_size") * max_epochs).cast("double")
    share = F.when(F.col("weight") > 0, cap).otherwise(0.0) if all_clamped else F.least(
        cap, F.col("weight").cast("double") * F.lit(level)
    )
    aims = sources.select(F.col("source").alias("_s"), "source_size", share.alias("target")).withColumn(
        "whole",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"),
    )
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    placed = buckets.withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    extra = F.col("target") - F.col("whole") * F.col("source_size")
    taken = (F.col("whole") < max_epochs) & (extra > 0) & (F.col("_before") + F.col("size") / 2 <= extra)
    cuts = (
        placed.join(aims, F.col("source").eqNullSafe(F.col("_s")))
        .groupBy("source", "source_size", "target", "whole")
        .agg(F.coalesce(F.max(F.when(taken, F.col("bucket") + 1)), F.lit(0)).alias("cut"))
    )
    return materialize(cuts)


def mix_counts(
    docs: DataFrame,
    plan: DataFrame,
    seed: int,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target``, ``repeats`` and ``taken``.

    The plan has one row per source; Spark sends it to the documents while its
    measured size is within the session's broadcast limit and otherwise joins by
    source, splitting a hot one. Columns of these names are overwritten. Rows that agree in id and
    text share a draw, all others draw on their own, whether or not ids are null or repeat; a
    null source is a source; null and empty texts have size 0 and take nothing.
    """
    added = ["source_size", "target", "repeats", "taken"]
    sized = docs.drop(*added).withColumn("size", word_size(text)).withColumn("_mix_bucket", _bucket(id_column, text, seed))
    renamed = plan.select(*[F.col(c).alias(f"_mix_{c}") for c in ("source", "source_size", "target", "whole", "cut")])
    joined = sized.join(renamed, F.col(source).eqNullSafe(F.col("_mix_source")), "left")
    repeats = F.col("_mix_whole") + F.when(F.col("_mix_bucket") < F.col("_mix_cut"), 1).otherwise(0)
    return joined.select(
        *sized.drop("_mix_bucket").columns,
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        repeats.alias("repeats"),
        (repeats * F.col("size")).alias("taken"),
    )


def cycled_weights(docs: DataFrame, source: str = "source", cycle: int = 3) -> DataFrame:
    """Weights 1, 2, .., ``cycle`` over and over, for sources in code point order, null last.

    Names are numbered by range, so any number of sources will do.
    """
    names = materialize(docs.select(F.col(source).alias("source")).distinct())
    numbered = number_distinct(names, "source", "_n")
    last = names.filter("source is null").withColumn("_n", F.lit(numbered.count()))
    return numbered.unionByName(last).select("source", (F.col("_n") % cycle + 1).alias("weight"))


def mix_sources(docs: DataFrame, weights: DataFrame, seed: int, **options) -> DataFrame:
    """``plan_mix`` applied: every document with its repetitions (0: left out).

    ``weights`` has ``source`` and ``weight``; a source without a weight gets none.
    An empty table gives an empty result.
    """
    names = {k: v for k, v in options.items() if k in ("id_column", "text", "source")}
    return mix_counts(docs, plan_mix(docs, weights, seed, **options), seed, **names)


def repeat_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row ``repeats`` times, with ``columns`` only."""
    kept = mixed.filter("repeats > 0").select(*columns, F.expr("explode(array_repeat(0, repeats))").alias("_copy"))
    return kept.select(*columns)

