"""Learned word vectors: positive pointwise mutual information, cut down by a randomised SVD.

Words near one another are counted as a sparse symmetric matrix of (i, j, n) rows. The
factorisation only ever multiplies that matrix with a tall table of a few dozen columns, a
join and a grouped sum; what reaches the driver are square matrices as wide as the
vectors, never one as wide as the vocabulary. ``encoder`` turns the result into text vectors
for ``vectors.embed_text``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revuelens.functions.text import words
from revuelens.functions.vectors import seeded_normals
from revuelens.operators.models import _affine
from revuelens.operators.text import SENT_BYTES, _listed_ids, _small, _word_places, release
from revuelens.session import materialize

RUN = 4096  # words of a text whose neighbours are paired at a time
EXTRA, ROUNDS = 8, 3  # columns beyond those asked for, and passes that sharpen them


def co_occurrences(df: DataFrame, text: str, vocabulary: DataFrame, window: int = 4) -> DataFrame:
    """``i``, ``j``, ``n``: how often the words of two ids stand at most ``window`` places apart, both ways; stored.

    Pairs of known words only are moved, summed up by task first. A long text is paired in
    runs that overlap by the window, so no pair is lost and no array grows with the text.
    """
    if not _small(vocabulary.select("word")):
        raise ValueError(f"a vocabulary of more than {SENT_BYTES} bytes does not go to the tasks; choose fewer words")
    known = vocabulary.select("word", F.col("word_id").cast("int").alias("word_id")).toArrow()
    shared = df.sparkSession.sparkContext.broadcast(
        (known.column("word").combine_chunks(), np.append(known.column("word_id").to_numpy(), -1).astype(np.int32))
    )

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def numbered(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for rows in batches:
                yield _listed_ids(rows, *shared.value)
        finally:
            release()

    ids = df.filter(F.col(text).isNotNull()).select(numbered(words(F.lower(F.col(text)))).alias("_w"))
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("_w") - 1, F.lit(0)), F.lit(RUN)))
    runs = ids.select("_w", starts.alias("_s")).select(F.expr(f"slice(_w, _s + 1, {RUN + window})").alias("_w"))
    apart = [
        F.expr(f"arrays_zip(slice(_w, 1, least({RUN}, size(_w) - {d})), slice(_w, {1 + d}, least({RUN}, size(_w) - {d})))")
        for d in range(1, window + 1)
    ]
    zipped = F.flatten(F.array(*[F.when(F.size("_w") > d, a).otherwise(F.array()) for d, a in enumerate(apart, 1)]))
    pairs = runs.select(F.explode(zipped).alias("_p")).select(F.col("_p.0").alias("a"), F.col("_p.1").alias("b"))
    counted = pairs.filter("a >= 0 and b >= 0").groupBy("a", "b").agg(F.count("*").alias("n"))
    both = counted.select(F.col("a").alias("i"), F.col("b").alias("j"), "n").unionByName(
        counted.select(F.col("b").alias("i"), F.col("a").alias("j"), "n")
    )
    return materialize(both.groupBy("i", "j").agg(F.sum("n").alias("n")))


def positive_information(counts: DataFrame) -> DataFrame:
    """``i``, ``j``, ``x``: the logarithm of how much likelier a pair is than chance has it, where that is positive; stored."""
    sums = materialize(counts.groupBy("i").agg(F.sum("n").alias("_n")))
    total = sums.agg(F.sum("_n")).first()[0] or 0
    joined = counts.join(sums, "i").join(sums.select(F.col("i").alias("j"), F.col("_n").alias("_m")), "j")
    x = F.log(F.col("n") * F.lit(float(total)) / F.col("_n") / F.col("_m"))
    return materialize(joined.select("i", "j", x.alias("x")).filter("x > 0"))


def _product(matrix: DataFrame, tall: DataFrame) -> DataFrame:
    """The matrix times a table of rows ``j``, ``v``; stored."""
    weighted = matrix.join(tall, "j").groupBy("i").agg(
        Summarizer.metrics("sum").summary(array_to_vector("v"), F.col("x")).alias("_s")
    )
    return materialize(weighted.select(F.col("i").alias("j"), vector_to_array("_s.sum").alias("v")))


def _gram(tall: DataFrame) -> np.ndarray:
    """Inner products of the columns; each task hands on one square of them."""

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total = rows.T @ rows if total is None else total + rows.T @ rows
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["g"])

    parts = tall.select("v").mapInArrow(squares, "g array<double>").collect()
    if not parts:
        return np.zeros((1, 1))
    flat = np.sum([np.array(r.g) for r in parts], axis=0)
    width = int(round(len(flat) ** 0.5))
    return flat.reshape(width, width)


def _turned(tall: DataFrame, matrix: np.ndarray) -> DataFrame:
    return tall.select("j", _affine(matrix, np.zeros(matrix.shape[1]))("v").alias("v"))


def factorise(matrix: DataFrame, size: int, seed: int = 0, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Rows ``j``, ``v`` of the ``size`` first left vectors, each times the root of its value; and the values.

    For a symmetric matrix. Columns that the matrix does not have are left out.
    """
    tall = matrix.select("j").distinct().select("j", seeded_normals("j", seed, size + EXTRA).alias("v"))
    values = np.zeros(0)
    for _ in range(rounds + 1):
        image = _product(matrix, tall)
        squares, axes = np.linalg.eigh(_gram(image))
        order = np.argsort(squares)[::-1]
        squares, axes = squares[order], axes[:, order]
        real = squares > max(squares[0], 0.0) * 1e-12
        squares, axes = squares[real], axes[:, real]
        if not len(squares):
            break
        axes = axes * np.where(axes.sum(axis=0) < 0, -1.0, 1.0)
        values = np.sqrt(squares)
        tall = _turned(image, axes / values)
    kept = values[:size]
    if not len(kept):
        return tall.limit(0), kept
    # The last image was of orthonormal columns, so its own values are those of the matrix.
    return materialize(_turned(image, axes[:, :size] / np.sqrt(kept))), kept


def learn_word_vectors(
    df: DataFrame, text: str, vocabulary: DataFrame, size: int = 32, window: int = 4, seed: int = 0
) -> DataFrame:
    """``word`` and ``vector`` of each word of ``vocabulary(word, word_id)`` that has neighbours; stored."""
    matrix = positive_information(co_occurrences(df, text, vocabulary, window))
    found, _ = factorise(matrix, size, seed)
    named = vocabulary.select("word", F.col("word_id").alias("j"))
    return materialize(named.join(found, "j").select("word", F.col("v").cast("array<float>").alias("vector")))


def encoder(vectors: DataFrame) -> Callable[[pd.Series], Sequence[Sequence[float]]]:
    """For ``embed_text``: the mean of a text's known words, of length one; a text without any is zero."""
    if not _small(vectors.select("word")):
        raise ValueError("too many words to send to the tasks")
    known = vectors.select("word", "vector").toArrow()
    words_of = known.column("word").combine_chunks()
    table = np.stack([np.asarray(v, dtype=np.float64) for v in known.column("vector").to_pylist()] or [np.zeros(1)])
    shared = vectors.sparkSession.sparkContext.broadcast((words_of, np.vstack([table, np.zeros(table.shape[1])])))

    def encode(texts: pd.Series) -> np.ndarray:
        known_words, rows_of = shared.value
        row, place = _word_places(pa.array([t.lower().split() for t in texts], pa.list_(pa.string())), known_words)
        out = np.zeros((len(texts), rows_of.shape[1]))
        np.add.at(out, row, rows_of[place])
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1.0)

    return encode
