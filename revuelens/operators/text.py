"""Term counts, sequences and lexicon scores over whole texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revuelens.functions.scalars import hex_uniform, seeded_hash
from revuelens.functions.text import (
    SPACE,
    clean_words,
    ngrams,
    prompt,
    target,
    tokens,
    word_count,
    words,
)
from revuelens.operators.joins import join_lookup
from revuelens.operators.ranks import number_distinct
from revuelens.operators.sampling import top_n_per_group
from revuelens.session import materialize


def _top_terms(df: DataFrame, by: Sequence[str], terms: Column, k: int) -> DataFrame:
    """The ``k`` most frequent terms per group; equal counts in term order."""
    counts = (
        df.select(*by, F.explode(terms).alias("term"))
        .groupBy(*by, "term")
        .agg(F.count("*").alias("n"))
    )
    keys = list(by)
    if not keys:
        counts, keys = counts.withColumn("_all", F.lit(0)), ["_all"]
    return top_n_per_group(counts, keys, [F.desc("n"), "term"], k, "term").drop("_all")


def top_ngrams(
    df: DataFrame,
    text: str,
    n: int,
    k: int,
    by: Sequence[str] = (),
    stop_words: Sequence[str] = (),
) -> DataFrame:
    """Most frequent word n-grams per group, stop words removed before pairing."""
    return _top_terms(df, by, ngrams(tokens(F.col(text), stop_words), n), k)


def top_words(
    df: DataFrame, text: str, k: int, by: Sequence[str] = (), stop_words: Sequence[str] = ()
) -> DataFrame:
    """Most frequent cleaned words per group: the table behind a word cloud."""
    return _top_terms(df, by, clean_words(F.col(text), stop_words), k)


def bigram_diversity(df: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    """Total and unique bigrams, their ratio, and mean words per text."""
    lowered = F.lower(F.col(text))
    bigrams = (
        df.select(*by, F.explode(ngrams(words(lowered), 2)).alias("bigram"))
        .groupBy(*by, "bigram")
        .agg(F.count("*").alias("n"))
        .groupBy(*by)
        .agg(F.sum("n").alias("total_bigrams"), F.count("*").alias("unique_bigrams"))
    )
    lengths = df.groupBy(*by).agg(F.avg(word_count(F.col(text))).alias("mean_words"))
    total = F.coalesce("total_bigrams", F.lit(0))
    unique = F.coalesce("unique_bigrams", F.lit(0))
    joined = (
        join_lookup(lengths, bigrams, by, "left")
        if by
        else lengths.withColumn("_all", F.lit(0))
        .join(bigrams.withColumn("_all", F.lit(0)), "_all", "left")
        .drop("_all")
    )
    return joined.select(
        *by,
        total.alias("total_bigrams"),
        unique.alias("unique_bigrams"),
        (unique / F.greatest(total, F.lit(1))).alias("diversity"),
        "mean_words",
    )


def seq2seq_pairs(df: DataFrame, headline: str = "review_headline", body: str = "review_body") -> DataFrame:
    """Request and reply text of every review."""
    return df.select("review_id", prompt().alias("source"), target(headline, body).alias("target"))


# Reserved token ids and the id that losses skip.
PAD, UNKNOWN, FIRST_TOKEN, IGNORED = 0, 1, 2, -100


def word_vocabulary(df: DataFrame, text: str, size: int) -> DataFrame:
    """The ``size`` most frequent words and their ids, most frequent first."""
    top = _top_terms(df, [], words(F.lower(F.col(text))), size)
    order = W.orderBy(F.desc("n"), "term")
    return top.select(
        F.col("term").alias("word"), (F.row_number().over(order) + (FIRST_TOKEN - 1)).alias("word_id")
    )


SLICE_BYTES = 1 << 20  # of text that a worker takes apart at a time


def row_runs(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` in all each, one row at least."""
    sizes = np.append(0, np.cumsum(sizes, dtype=np.int64))
    start = 0
    while start < len(sizes) - 1:
        stop = max(int(np.searchsorted(sizes, sizes[start] + limit, side="right")) - 1, start + 1)
        yield start, stop
        start = stop


def text_bytes(texts: pa.Array) -> np.ndarray:
    """Bytes of each text; null has none."""
    return pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64)


def release() -> None:
    """Give back what a worker process no longer uses; processes outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


SENT_BYTES = 32 << 20  # of a word table that goes to the tasks whole


def _small(table: DataFrame) -> bool:
    """Whether a word table, by its measured size, fits every task beside its work."""
    size = table.agg(F.sum(F.octet_length(F.col(table.columns[0])) + 24)).first()[0]
    return (size or 0) <= SENT_BYTES


def _word_places(rows: pa.Array, words_of: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row of every word of lists of words, and its place in a word list, -1 where it has none."""
    found = pc.index_in(rows.flatten(), value_set=words_of).fill_null(-1).to_numpy()
    row = np.repeat(np.arange(len(rows)), rows.value_lengths().fill_null(0).to_numpy())
    return row, found


WORD_RUN = 1 << 18  # words that are looked up at a time


def _word_runs(rows: pa.Array, words_of: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``_word_places`` of some rows at a time, and how many rows they are."""
    for start, stop in row_runs(rows.value_lengths().fill_null(0).to_numpy(), WORD_RUN):
        yield stop - start, *_word_places(rows.slice(start, stop - start), words_of)


def _listed_ids(rows: pa.Array, words_of: pa.Array, ids: np.ndarray) -> pa.Array:
    """Lists of ids in place of lists of words; the last id stands for words without one."""
    found, lengths = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for n, row, place in _word_runs(rows, words_of):
        found.append(ids[place])
        lengths.append(np.bincount(row, minlength=n))
    ends = np.cumsum(np.concatenate(lengths))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))


def token_ids(
    df: DataFrame, text: str, vocabulary: DataFrame, max_len: int, id_column: str = "review_id"
) -> DataFrame:
    """Padded word ids, attention mask and labels (padding ignored) of ``max_len``.

    A vocabulary of a size that fits goes to the tasks, where a batch of words is looked up
    at once; a larger one is joined by word. Rows that share an id stay apart either way.
    """
    first = F.slice(words(F.lower(F.col(text))), 1, max_len)
    listed = vocabulary.select("word", F.col("word_id").cast("int").alias("word_id"))
    if _small(listed):
        known = listed.toArrow()
        shared = df.sparkSession.sparkContext.broadcast(
            (known.column("word").combine_chunks(), np.append(known.column("word_id").to_numpy(), UNKNOWN).astype(np.int32))
        )

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def look_up(rows: pa.Array) -> pa.Array:
            return _listed_ids(rows, *shared.value)

        numbered = df.select(id_column, look_up(first).alias("_ids"))
    else:
        rows = materialize(df.select(id_column, first.alias("_words"), F.monotonically_increasing_id().alias("_row")))
        each = rows.select("_row", F.posexplode("_words").alias("_at", "word"))
        found = each.join(listed, "word", "left").groupBy("_row").agg(
            F.sort_array(F.collect_list(F.struct("_at", F.coalesce("word_id", F.lit(UNKNOWN)).alias("id")))).alias("_l")
        )
        numbered = rows.join(found, "_row", "left").select(
            id_column, F.coalesce(F.col("_l.id"), F.array().cast("array<int>")).alias("_ids")
        )
    used = F.size("_ids")
    fill = F.lit(max_len) - used
    return numbered.select(
        id_column,
        F.concat("_ids", F.array_repeat(F.lit(PAD), fill)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), fill)).alias("attention_mask"),
        F.concat("_ids", F.array_repeat(F.lit(IGNORED), fill)).alias("labels"),
    )


def char_vocab(df: DataFrame, text: str) -> DataFrame:
    """Distinct characters of a text column, numbered in code point order."""
    distinct = df.select(F.explode(F.array_distinct(F.split(F.col(text), ""))).alias("char"))
    return number_distinct(distinct.filter(F.length("char") > 0), "char", "char_id")


def _char_ids(texts: pa.Array, known: np.ndarray) -> pa.Array:
    """Ids of the known characters of each text, a run of texts at a time; null in, null out."""
    sizes = pc.utf8_length(texts).fill_null(0).to_numpy()
    flat, ends, used = np.empty(sizes.sum(), dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int32), 0
    for start, stop in row_runs(text_bytes(texts)):
        run = "".join(texts.slice(start, stop - start).fill_null("").to_pylist())
        points = np.frombuffer(run.encode("utf-32-le"), dtype="<u4")
        ids = np.append(known, np.int32(-1))[np.minimum(points, len(known))]
        before = np.append(0, np.cumsum(ids >= 0))
        ends[start + 1 : stop + 1] = used + before[np.cumsum(sizes[start:stop])]
        flat[used : used + before[-1]] = ids[ids >= 0]
        used += before[-1]
    absent = np.append(texts.is_null().to_numpy(zero_copy_only=False), False)
    return pa.ListArray.from_arrays(pa.array(ends, mask=absent if absent.any() else None), pa.array(flat[:used]))


def encode_chars(df: DataFrame, text: str, vocab: DataFrame) -> DataFrame:
    """Add ``encoded``: character ids of the text, unknown characters dropped.

    The vocabulary is bounded by the code points there are; it travels as one table
    of ids by code point, so a character costs one look-up.
    """
    rows = vocab.select("char", "char_id").toArrow()
    table = np.full(0x110000, -1, dtype=np.int32)
    table[[ord(c) for c in rows.column("char").to_pylist()]] = rows.column("char_id").to_numpy()
    shared = df.sparkSession.sparkContext.broadcast(table[: int(np.flatnonzero(table >= 0).max(initial=0)) + 1])

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                yield _char_ids(texts, shared.value)
        finally:
            release()

    return df.withColumn("encoded", encode(F.col(text)))


def char_windows(
    df: DataFrame, length: int, seed: int, id_column: str = "review_id", encoded: str = "encoded"
) -> DataFrame:
    """One seeded window per longer text, and the same window one step later."""
    room = F.size(encoded) - length
    offset = F.floor(hex_uniform(seeded_hash(id_column, seed)) * room).cast("int")
    return df.filter(F.size(encoded) > length).select(
        id_column,
        "star_rating",
        offset.alias("offset"),
        F.slice(encoded, offset + 1, length).alias("x"),
        F.slice(encoded, offset + 2, length).alias("y"),
    )


def lexicon_sentiment(
    df: DataFrame,
    text: str,
    lexicon: DataFrame,
    id_column: str = "review_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Sum of word valences per text, and that sum squashed to (-1, 1).

    ``lexicon`` has columns ``word`` and ``valence``. One of a size that fits goes to the tasks,
    where a batch of words is looked up at once; a larger one is joined by word. Each row is
    scored on its own, a null text as one without listed words. Negation and emphasis are not
    modelled.
    """
    listed = lexicon.filter(F.col("word").isNotNull()).groupBy("word").agg(F.coalesce(F.sum("valence"), F.lit(0.0)).alias("v"))
    lowered = F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"[^{SPACE}.,!?;:\"()]+"), 0)
    if _small(listed):
        known = listed.toArrow()
        shared = df.sparkSession.sparkContext.broadcast(
            (known.column("word").combine_chunks(), np.append(known.column("v").to_numpy(), 0.0).astype(np.float64))
        )

        @F.arrow_udf(T.DoubleType())
        def total(rows: pa.Array) -> pa.Array:
            words_of, valences = shared.value
            runs = _word_runs(rows, words_of)
            sums = [np.bincount(row, weights=valences[place], minlength=n) for n, row, place in runs]
            return pa.array(np.concatenate([np.zeros(0), *sums]))

        scored = df.select(id_column, *keep, total(lowered).alias("valence"))
    else:
        rows = materialize(df.select(id_column, *keep, lowered.alias("_words"), F.monotonically_increasing_id().alias("_row")))
        each = rows.select("_row", F.explode("_words").alias("word"))
        sums = each.join(listed, "word").groupBy("_row").agg(F.sum("v").alias("_v"))
        scored = rows.join(sums, "_row", "left").select(id_column, *keep, F.coalesce("_v", F.lit(0.0)).alias("valence"))
    # Fixed value: 15 normalises the sum.
    v = F.col("valence")
    return scored.withColumn("compound", v / F.sqrt(v * v + 15.0))


def sentiment_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("n"),
        F.avg("compound").alias("mean"),
        F.stddev_samp("compound").alias("std"),
    )
