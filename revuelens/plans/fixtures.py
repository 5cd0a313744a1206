"""The given tables seen as review tables, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revuelens.operators.filters import filter_length, filter_reviews
from revuelens.operators.metrics import label_union
from revuelens.operators.prepare import with_helpfulness, with_lengths
from revuelens.operators.vectors import attach_embeddings
from revuelens.session import spread

# Fixed values used by all catalogue queries.
SEED = 42
MIN_VOTES = 1
PER_STRATUM = 5000
VECTOR_WIDTH = 64

STOP_WORDS = [
    "and", "are", "auf", "avec", "con", "das", "dans", "de", "del", "den", "der", "des",
    "die", "el", "en", "et", "for", "in", "is", "la", "las", "le", "les", "los", "of",
    "para", "por", "pour", "que", "qui", "sur", "the", "to", "un", "una", "und", "une", "with",
]

LEXICON = [
    ("worthless", -2.5), ("the", 0.1), ("of", -0.1), ("le", 0.2), ("la", -0.2),
    ("der", 0.3), ("die", -0.4), ("el", 0.5), ("is", 0.7), ("und", -0.6),
]


# Tables of long texts and their keys.
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(rows, TEXT_KEYS[name]) if name in TEXT_KEYS else rows


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Raw reviews from documents, with nulls and bad dates planted."""
    d = F.col("doc_id")
    rating = (
        F.when(d % 97 == 96, F.lit(None))
        .when(d % 10 == 0, 1)
        .when(d % 10 == 1, 2)
        .when(d % 10 == 2, 3)
        .when((d % 10).isin(3, 4), 4)
        .otherwise(5)
    )
    day = F.date_add(F.lit("2014-01-01").cast("date"), ((d * 37) % 600).cast("int"))
    helpful = F.least((d * 7) % 23, (d * 5) % 19).cast("int")
    return table(spark, sf, "documents").select(
        d.alias("review_id"),
        F.col("lang").alias("product_category"),
        rating.cast("int").alias("star_rating"),
        F.when(d % 89 != 88, F.split_part("text", F.lit("\n"), F.lit(1))).alias("review_headline"),
        F.when(d % 101 != 100, F.col("text")).alias("review_body"),
        F.when(d % 53 != 52, helpful).alias("helpful_votes"),
        ((d * 7) % 23).cast("int").alias("total_votes"),
        F.when(d % 50 == 49, "Y").otherwise("N").alias("vine"),
        F.when(d % 7 == 6, "N").otherwise("Y").alias("verified_purchase"),
        F.when(d % 211 == 210, "not-a-date").otherwise(F.date_format(day, "yyyy-MM-dd")).alias("review_date"),
    )


def filtered(spark: SparkSession, sf: str) -> DataFrame:
    return with_helpfulness(filter_reviews(reviews(spark, sf), MIN_VOTES))


def measured(spark: SparkSession, sf: str) -> DataFrame:
    return with_lengths(filtered(spark, sf))


def banded(spark: SparkSession, sf: str) -> DataFrame:
    return filter_length(measured(spark, sf))


def review_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Large numeric review table from line items; ids are not unique."""
    quantity = F.col("l_quantity").cast("int")
    joined = table(spark, sf, "lineitem").join(
        table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    return with_helpfulness(
        joined.select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("review_id"),
            F.col("p_type").alias("product_category"),
            (1 + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3) % 5).cast("int").alias("star_rating"),
            quantity.alias("total_votes"),
            (F.col("l_partkey") % (quantity + 1)).cast("int").alias("helpful_votes"),
            F.when(F.col("l_returnflag") == "R", "N").otherwise("Y").alias("verified_purchase"),
            F.col("l_shipdate").cast("date").alias("review_date"),
            (F.floor("l_extendedprice") % 500).cast("int").alias("review_body_words"),
        )
    )


def review_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Body vector of each id and the next id's vector as headline vector."""
    vectors = table(spark, sf, "embeddings")
    size = vectors.agg(F.count("*")).scalar()
    heads = vectors.select(
        F.pmod(F.col("vec_id") - 1 + size, size).alias("vec_id"), F.col("embedding").alias("head_emb")
    )
    return attach_embeddings(
        vectors.select(
            F.col("vec_id").alias("review_id"),
            (F.col("label") % 5).cast("int").alias("category_encoded"),
            (1 + F.col("vec_id") % 5).cast("int").alias("star_rating"),
            "label",
            F.col("embedding").alias("body_emb"),
        ),
        heads.withColumnRenamed("vec_id", "review_id"),
    )


def planted_vectors(spark: SparkSession, sf: str, shift: float = 0.5) -> DataFrame:
    """``review_vectors`` with every tenth element raised according to the label."""

    def raised(vector):
        return F.transform(
            vector, lambda x, i: (x + F.when(i % 10 == F.col("label"), shift).otherwise(0.0)).cast("float")
        )

    return review_vectors(spark, sf).select(
        "review_id",
        "category_encoded",
        "star_rating",
        "label",
        raised(F.col("body_emb")).alias("body_emb"),
        raised(F.col("head_emb")).alias("head_emb"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    label = F.col("quality")
    prediction = (F.col("doc_id") % 3 > 0).cast("int")
    right = F.when(prediction == 1, 0.7).otherwise(0.4)
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"),
        label.alias("label"),
        prediction.alias("prediction"),
        F.array(1.0 - right, right).alias("probability"),
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        "event_type",
        (F.col("event_type") == "purchase").cast("int").alias("label"),
        F.round(F.col("value") / (F.col("value") + 100), 9).alias("score"),
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as real texts, benchmark items as generated ones."""
    return label_union(
        table(spark, sf, "documents").select("text"), table(spark, sf, "benchmark").select("text")
    )


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "word string, valence double")


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Mean event value per user group ("model") and hour ("epoch")."""
    return (
        table(spark, sf, "events")
        .groupBy(
            F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model"),
            F.hour("ts").alias("epoch"),
        )
        .agg(F.round(F.avg("value"), 6).alias("value"))
        .select("model", "epoch", F.lit("val_acc").alias("metric"), "value")
    )


def generated(spark: SparkSession, sf: str) -> DataFrame:
    """Generated-review shaped rows from conversations."""
    return table(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("role").alias("category"),
        (1 + F.col("conv_id") % 5).cast("int").alias("star_rating"),
        (F.pmod(F.length("text"), F.lit(101)) / 100.0).alias("gan_quality"),
        "text",
    )
