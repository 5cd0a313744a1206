"""Registered queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revuelens.llm import (
    cotraining,
    decontamination,
    language,
    merkle,
    minhash,
    mixing,
    nndescent,
    oracle,
    pieces,
    pii,
    spelling,
    suffixes,
    token_files,
    warc,
)
from revuelens.llm.common import table

SEED = 17
TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
PIECES_END = 2


def op1_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix_sources(docs, mixing.cycled_weights(docs), SEED)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "repeats")


def op2_warc_derivatives(spark: SparkSession, sf: str) -> DataFrame:
    records = warc.build_derivatives(spark, table(spark, sf, "pages"))
    return records.select(
        F.col("source_id").cast("long").alias("page_id"),
        F.col("type").alias("record_type"),
        "record_id",
        "refers_to",
        "target_uri",
        F.col("date").alias("warc_date"),
        "content_type",
        "block_digest",
        F.length("block").cast("long").alias("n_chars"),
        F.md5("block").alias("block_md5"),
    )


def op3_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"), length=3, percent=85)


def op4_cotraining(spark: SparkSession, sf: str) -> DataFrame:
    return cotraining.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op5_token_files(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return token_files.encode_documents(spark, docs, public_tokenizers.path(TOKENIZER))


def op6_nn_descent(spark: SparkSession, sf: str) -> DataFrame:
    return nndescent.near_duplicates(table(spark, sf, "embeddings"))


def op7_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf, "documents"), pii.train(pii.examples(spark)))


def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op9_language(spark: SparkSession, sf: str) -> DataFrame:
    """Documents declare a language and name a source; they have no address."""
    return language.identify(table(spark, sf, "documents"), declared="lang", hosts=["source"])


def language_of_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The same for pages, which have all evidence: markup, address suffix, domain and host."""
    suffix, domain, host = language.address_parts(F.col("url"))
    found = language.identify(
        table(spark, sf, "pages"),
        id_column="page_id",
        text=language.page_text(F.col("html")),
        declared=language.page_language(F.col("html")),
        suffix=suffix,
        hosts=[domain, host],
    )
    return found.withColumnRenamed("doc_id", "page_id")


def op10_repeated_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf, "documents"))


def op11_pieces(spark: SparkSession, sf: str) -> DataFrame:
    both_ways = pieces.encode_and_decode(table(spark, sf, "documents"), public_tokenizers.path(PIECES), PIECES_END)
    return both_ways.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(pieces.id_line("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    checked = merkle.verify_against(docs, {"text": merkle.without_line_ends()})
    return checked.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.digest(merkle.proof(F.col("steps"))).alias("proof_sha256"),
        "folded_root",
        "verified",
    )


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf, "documents"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_warc_derivatives": op2_warc_derivatives,
    "op3_minhash": op3_minhash,
    "op4_cotraining": op4_cotraining,
    "op5_token_files": op5_token_files,
    "op6_nn_descent": op6_nn_descent,
    "op7_personal_data": op7_personal_data,
    "op8_decontamination": op8_decontamination,
    "op9_language": op9_language,
    "op10_repeated_substrings": op10_repeated_substrings,
    "op11_pieces": op11_pieces,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_spelling_variants": op13_spelling_variants,
    "language_of_pages": language_of_pages,
    "pipeline": pipeline,
}

# The others have no SQL: models, files, digests of bytes, spans of a fitted chain.
ORACLES: dict[str, str] = {
    "op1_mix_sources": oracle.mix_sources(SEED),
    "op3_minhash": oracle.near_duplicates(3, 85),
    "op6_nn_descent": oracle.nearest_embeddings(0.93),
    "op12_merkle_manifest": oracle.merkle_manifest(),
    "op13_spelling_variants": oracle.spelling_variants(),
}
