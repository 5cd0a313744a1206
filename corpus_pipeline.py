"""A corpus pipeline: language, near duplicates, benchmark leaks, mix, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. ``run`` writes every stage's rows to the shared folder, so that a
lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from revuelens.llm import decontamination, language, minhash, mixing, token_files
from revuelens.llm.common import table
from revuelens.session import materialize

SEED = 17
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is identified; a rejected row goes."""
    return language.keep_identified(docs, declared="lang", hosts=["source"])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): the smallest id."""
    return minhash.keep_representatives(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3, repeating, at most three epochs; repeated rows stand side by side."""
    counted = mixing.mix_sources(docs, mixing.cycled_weights(docs), SEED)
    return mixing.repeat_rows(counted, docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files, read back."""
    return token_files.encode_documents(spark, docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_leaks),
    ("mix", mixed),
    ("token_files", tokens),
]

# SQL has no trigram model, tokenizer or file format; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
