"""Spelling variants: words of one edit apart, found by asymmetric chunks.

Of two words the shorter (either, at equal length) contributes two disjoint chunks, its
halves; the other contributes its positional grams. One edit leaves a half whole, and moves
it by one place at most: it is a prefix of the other word, or a suffix of it. Of all
positional grams only these two, cut for words of the own length and of one less, lie
where a chunk can be met, so only they are written. Words that meet in a list are verified.

A list of more than ``CROWDED`` words is not compared: the part that may hold the edit is
halved again, so that the key grows by a further chunk, until lists are short or one place
is left. Words that differ at one known place are all near; a longer word then names the
shorter one itself, by leaving that place out. No list is cut or dropped.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revuelens.llm.common import lean
from revuelens.session import materialize

# Letters of a word, and which occurrences are misspelt on purpose.
LETTERS = "A-Za-zÀ-ÿ"
MISSPELT_EVERY = 199
CROWDED = 64
PART = 1 << 20
HELD_BYTES = 1 << 25
KEY = ["length", "low", "high", "rest"]


def _parts(text: str) -> Iterator[str]:
    """Pieces of about a million code points that do not cut a run of letters."""
    run, start = re.compile(f"[{LETTERS}]+"), 0
    while len(text) - start > PART:
        inside = run.match(text, start + PART)
        stop = inside.end() if inside else start + PART
        yield text[start:stop]
        start = stop
    yield text[start:]


def _misspell(run: str, mark: int) -> str:
    place = mark % len(run)
    return run[:place] + run[place + 1 :]


def count_words(docs: DataFrame, min_length: int, misspelt_every: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Words and their occurrences ``n``, counted in each task before they are moved.

    A task holds at most ``HELD_BYTES`` of different words before it hands them on. A null
    text has no words; a null id reads as ``null``.
    """
    pattern = re.compile(f"[{LETTERS}]{{{min_length},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        held = 0
        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                if not value.is_valid:
                    continue
                start = zlib.crc32(f"{name.as_py() if name.is_valid else 'null'}:".encode())
                for part in _parts(value.as_py().encode().lower().decode()):
                    for run, n in Counter(pattern.findall(part)).items():
                        mark = zlib.crc32(run.encode(), start)
                        if mark % misspelt_every == 0:
                            run = _misspell(run, mark)
                            if len(run) < min_length:
                                continue
                        if run not in found:
                            held += 100 + 2 * len(run)
                        found[run] += n
                    if held > HELD_BYTES:
                        yield _counts(found)
                        found, held = Counter(), 0
        if found:
            yield _counts(found)

    rows = docs.select(F.col(id_column).cast("string").alias("_id"), F.col(text).alias("_text"))
    partial = rows.mapInArrow(lean(counted), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def _counts(found: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"]
    )


def _rest(length: Column, low: Column, high: Column) -> Column:
    """A word without the part between its first ``low`` code points and its last ``length - high``."""
    word = F.col("word")
    tail = length - high
    return F.concat(F.left(word, low), F.lit("\0"), F.when(tail > 0, F.right(word, tail)).otherwise(""))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row under both halves of the part that may hold the edit."""
    middle = F.expr("(low + high) div 2").cast("int")
    halves = F.array(
        F.struct(F.col("low"), middle.alias("high")),
        F.struct(middle.alias("low"), F.col("high")),
    )
    cut = rows.select("word", "longer", "length", F.explode(halves).alias("_half")).select(
        "word", "longer", "length", F.col("_half.low").alias("low"), F.col("_half.high").alias("high")
    )
    return cut.withColumn("rest", _rest(F.col("length"), F.col("low"), F.col("high")))


def _verified(rows: DataFrame) -> DataFrame:
    """Pairs of one list at distance one; both sides read the one exchange by key."""
    dealt = rows.repartition(*KEY)
    chunks = dealt.filter("not longer").select(*KEY, F.col("word").alias("a"))
    grams = dealt.select(*KEY, F.col("word").alias("b"), "longer")
    met = chunks.join(grams, KEY).filter("longer or a < b")
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b")


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of different words of a stored table that are one edit apart, each once.

    One count a round comes to the driver; there are as many rounds as the longest word
    of a crowded list has halvings.
    """
    n = F.length("word")
    roles = F.explode(F.array(F.struct(F.lit(False).alias("longer"), n.alias("length")),
                              F.struct(F.lit(True).alias("longer"), (n - 1).alias("length"))))
    start = words.select("word", roles.alias("_role")).select("word", "_role.*").filter("length > 0")
    entries = materialize(_halved(start.withColumn("low", F.lit(0)).withColumn("high", F.col("length"))))
    found = []
    while True:
        crowded = materialize(
            entries.groupBy(*KEY)
            .agg(F.count("*").alias("_n"), F.count(F.when(~F.col("longer"), 1)).alias("_chunks"))
            .filter(F.col("_n") > CROWDED)
            .select(*KEY, (F.col("_chunks") > 0).alias("_met"))
        )
        found.append(materialize(_verified(entries.join(crowded, KEY, "left_anti"))))
        if not crowded.take(1):
            break
        full = entries.join(crowded.filter("_met"), KEY).drop("_met")
        last = F.col("high") - F.col("low") <= 1
        found.append(materialize(_at_one_place(full.filter(last), words)))
        entries = materialize(_halved(full.filter(~last)))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def _at_one_place(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Near words of crowded lists whose one open place is known."""
    same = rows.filter("not longer").repartition(*KEY)
    replaced = same.select(*KEY, F.col("word").alias("a")).join(same.select(*KEY, F.col("word").alias("b")), KEY)
    without = [F.concat(F.left("word", F.col(c)), F.expr(f"substring(word, {c} + 2)")) for c in ("low", "high")]
    shorter = rows.filter("longer").select(F.col("word").alias("b"), F.explode(F.array_distinct(F.array(*without))).alias("a"))
    inserted = shorter.join(words.select(F.col("word").alias("a")), "a")
    return replaced.filter("a < b").select("a", "b").unionByName(inserted.select("a", "b"))


def follow_forms(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: the last word that is reached from each ``word`` with a ``form``.

    Every round doubles how far a word has been followed; a form's count is several times
    the word's, so rounds grow with the logarithm of the logarithm of the largest count.
    """
    ahead = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = materialize(
            ahead.join(further, "root", "left").select(
                "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")
            )
        )
        ahead = moved.drop("_moved")
        if not moved.filter("_moved").take(1):
            return ahead


def group_variants(
    docs: DataFrame,
    min_length: int = 6,
    min_count: int = 5,
    ratio: int = 5,
    misspelt_every: int = MISSPELT_EVERY,
    **columns: str,
) -> DataFrame:
    """Every frequent word with its standard ``form`` and the ``root`` that forms lead to.

    Words have ``min_length`` code points and ``min_count`` occurrences in the whole table,
    whatever other columns it holds. ``form`` is the near word of largest count (ties: the
    least), if that is ``ratio`` times the word's count, else null; ``n_near`` counts near
    words. An empty table, or one without such words, has no rows.
    """
    counted = count_words(docs, min_length, misspelt_every, **columns)
    words = materialize(counted.filter(F.col("n") >= min_count))
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("word").alias("b"), F.col("n").alias("_n"))
    best = (
        both.join(other, "b")
        .groupBy(F.col("a").alias("word"))
        .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("_n")).alias("_n"), "b")).alias("_best"))
    )
    strong = -F.col("_best._n") >= ratio * F.col("n")
    formed = materialize(
        words.join(best, "word", "left").select(
            "word",
            F.when(strong, F.col("_best.b")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(strong, -F.col("_best._n")).alias("form_n"),
        )
    )
    roots = follow_forms(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
