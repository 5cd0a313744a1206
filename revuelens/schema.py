"""One explicit schema per stage of a review table."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns every stage is built from.
RAW = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("product_category", T.StringType()),
        T.StructField("star_rating", T.IntegerType()),
        T.StructField("review_headline", T.StringType()),
        T.StructField("review_body", T.StringType()),
        T.StructField("helpful_votes", T.IntegerType()),
        T.StructField("total_votes", T.IntegerType()),
        T.StructField("vine", T.StringType()),
        T.StructField("verified_purchase", T.StringType()),
        T.StructField("review_date", T.StringType()),
    ]
)

CLEAN = T.StructType(
    RAW.fields
    + [
        T.StructField("helpfulness_ratio", T.DoubleType()),
        T.StructField("category_encoded", T.IntegerType()),
        T.StructField("clean_body", T.StringType()),
        T.StructField("clean_headline", T.StringType()),
        T.StructField("review_body_words", T.IntegerType()),
    ]
)

PREPARED = T.StructType(
    CLEAN.fields
    + [
        T.StructField("length_scaled", T.DoubleType()),
        T.StructField("helpfulness_scaled", T.DoubleType()),
        T.StructField("split", T.StringType()),
    ]
)

EMBEDDED = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("body_emb", T.ArrayType(T.FloatType())),
        T.StructField("head_emb", T.ArrayType(T.FloatType())),
    ]
)

RATINGS = [1, 2, 3, 4, 5]
