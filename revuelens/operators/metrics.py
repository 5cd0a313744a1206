"""Evaluation tables over predictions, scores, histories and generated reviews."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revuelens.operators.joins import join_lookup


def confusion_matrix(df: DataFrame, n_classes: int) -> DataFrame:
    """Count and row share of every (label, prediction) pair, empty pairs included."""
    counts = df.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    classes = df.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("label"))
    grid = classes.select(
        "label", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("prediction")
    )
    cells = grid.join(counts, ["label", "prediction"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )
    supports = cells.groupBy("label").agg(F.sum("n").alias("_support"))
    return cells.join(supports, "label").select(
        "label",
        "prediction",
        "n",
        F.coalesce(F.try_divide(F.col("n"), F.col("_support")), F.lit(0.0)).alias("row_share"),
    )


def _per_class(df: DataFrame, n_classes: int) -> DataFrame:
    """Support, hits, precision, recall and F1 of each class; 0 where undefined."""
    matrix = confusion_matrix(df, n_classes)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    actual = matrix.groupBy(F.col("label").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(hit).alias("hits")
    )
    predicted = matrix.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("_predicted"))
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("_predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hits"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(
        F.try_divide(2.0 * F.col("hits"), F.col("support") + F.col("_predicted")), F.lit(0.0)
    )
    return actual.join(predicted, "class").select(
        "class", "support", "hits", "_predicted",
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
    )


def classification_report(df: DataFrame, n_classes: int) -> DataFrame:
    """Precision, recall, F1, support per class, then macro and weighted rows.

    Classes that occur neither as label nor as prediction are left out.
    """
    classes = _per_class(df, n_classes).filter(F.col("support") + F.col("_predicted") > 0)
    parts = ["precision", "recall", "f1"]
    weight = F.sum("support")
    macro = classes.agg(*[F.avg(c).alias(c) for c in parts], weight.alias("support"))
    weighted = classes.agg(
        *[(F.sum(F.col(c) * F.col("support")) / weight).alias(c) for c in parts],
        weight.alias("support"),
    )
    rows = [
        classes.select(F.col("class").cast("string").alias("name"), *parts, "support"),
        macro.select(F.lit("macro avg").alias("name"), *parts, "support"),
        weighted.select(F.lit("weighted avg").alias("name"), *parts, "support"),
    ]
    return reduce(DataFrame.unionByName, rows)


def classification_metrics(
    df: DataFrame, n_classes: int, probability: str | None = None
) -> DataFrame:
    """Accuracy, macro F1 and, given class probabilities, mean log loss."""
    classes = _per_class(df, n_classes).filter(F.col("support") + F.col("_predicted") > 0)
    out = classes.agg(
        F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
    )
    if probability is None:
        return out
    p = F.get(F.col(probability), F.col("label"))
    loss = df.agg(F.avg(-F.log(F.greatest(p, F.lit(1e-15))))).scalar()
    return out.withColumn("loss", loss)


def misclass_patterns(df: DataFrame, k: int | None = None, offset: int = 1) -> DataFrame:
    """Counts of wrong ``true->predicted`` pairs; the ``k`` most frequent if given."""
    pattern = F.concat(
        (F.col("label") + offset).cast("string"), F.lit("->"), (F.col("prediction") + offset).cast("string")
    )
    counts = (
        df.filter(F.col("label") != F.col("prediction"))
        .groupBy(pattern.alias("pattern"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "pattern")
    )
    return counts if k is None else counts.limit(k)


def discriminator_accuracy(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of real rows scored above the threshold and of fake rows not above it."""
    above = (F.col("score") > threshold).cast("int")
    return df.agg(
        F.avg(F.when(F.col("label") == 1, above)).alias("acc_real"),
        F.avg(F.when(F.col("label") == 0, 1 - above)).alias("acc_fake"),
    )


def label_union(real: DataFrame, fake: DataFrame) -> DataFrame:
    """Both tables in one, labelled 1 for real and 0 for generated."""
    return real.withColumn("label", F.lit(1)).unionByName(fake.withColumn("label", F.lit(0)))


def quality_by(df: DataFrame, by: Sequence[str] = (), quality: str = "gan_quality") -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(quality).alias("mean"), F.stddev_samp(quality).alias("std"), F.count(quality).alias("count")
    )


def quality_gate(df: DataFrame, threshold: float, quality: str = "gan_quality") -> DataFrame:
    return df.filter(F.col(quality) >= threshold)


def metric_table(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per model from one-row tables; absent metrics are null."""
    named = [t.select(F.lit(name).alias("model"), "*") for name, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def metric_long(table: DataFrame) -> DataFrame:
    """(model, metric, value) rows of a metric table, without missing values."""
    metrics = [c for c in table.columns if c != "model"]
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics]
    return table.select("model", F.inline(F.array(*pairs))).filter(F.col("value").isNotNull())


def ablation_delta(metrics: DataFrame, base: str) -> DataFrame:
    """Each other model's metrics minus the base model's (long form)."""
    long = metric_long(metrics)
    reference = long.filter(F.col("model") == base).select("metric", F.col("value").alias("base_value"))
    variants = long.filter(F.col("model") != base)
    return join_lookup(variants, reference, ["metric"]).select(
        "model", "metric", "value", (F.col("value") - F.col("base_value")).alias("delta")
    )


def success_checks(metrics: DataFrame, full: str, random: str, unrefined: str) -> DataFrame:
    """The three comparisons an evaluation ends with, as named booleans."""

    def of(model: str, metric: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(metric)))

    whole = of(full, "coherence")
    one = metrics.agg(
        (whole > of(random, "coherence")).alias("_random"),
        (whole > of(unrefined, "coherence")).alias("_refined"),
        (of(full, "auc") > 0.5).alias("_auc"),
    )
    rows = [
        F.struct(F.lit(name).alias("check"), F.col(c).alias("passed"))
        for name, c in (
            ("full_above_random", "_random"),
            ("full_above_unrefined", "_refined"),
            ("auc_above_half", "_auc"),
        )
    ]
    return one.select(F.inline(F.array(*rows)))


def best_epoch(history: DataFrame, metric: str, mode: str = "max") -> DataFrame:
    """Best epoch and value of a metric per model; the first one among equals."""
    rows = history.filter((F.col("metric") == metric) & F.col("value").isNotNull())
    sign = 1.0 if mode == "max" else -1.0
    best = F.max(F.struct((F.col("value") * sign).alias("v"), (-F.col("epoch")).alias("e")))
    return rows.groupBy("model").agg(best.alias("_b")).select(
        "model", (-F.col("_b.e")).alias("epoch"), (F.col("_b.v") * sign).alias("value")
    )


def rating_sentiment_agreement(df: DataFrame, sentiment: str = "compound") -> DataFrame:
    """Share of rows whose sentiment sign fits the rating (<= 2, 3, >= 4)."""
    expected = F.when(F.col("star_rating") <= 2, -1).when(F.col("star_rating") >= 4, 1).otherwise(0)
    agrees = (F.signum(F.col(sentiment)).cast("int") == expected).cast("int")
    rated = df.filter(F.col("star_rating").isNotNull())
    return rated.agg(F.avg(agrees).alias("agreement"), F.count("*").alias("n"))


def calibration_error(
    df: DataFrame, predicted: str, actual: str, bins: int = 10
) -> DataFrame:
    """Row-weighted mean gap of predicted and actual means over equal bins of [0, 1]."""
    p = F.col(predicted).cast("double")
    slot = F.greatest(F.lit(0), F.least(F.floor(p * bins), F.lit(bins - 1))).cast("int")
    rows = df.filter(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    per_bin = rows.groupBy(slot.alias("_bin")).agg(
        F.count("*").alias("_n"), F.abs(F.avg(p) - F.avg(F.col(actual).cast("double"))).alias("_gap")
    )
    return per_bin.agg(
        (F.sum(F.col("_n") * F.col("_gap")) / F.sum("_n")).alias("calibration_error"),
        F.sum("_n").alias("n"),
    )
