"""Language identification by Bayesian fusion of text, markup, address and host evidence."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revuelens.llm.common import lean, text_slices, utf8
from revuelens.llm.shingles import LOWER
from revuelens.session import materialize

BUCKETS = 4096  # hashed byte trigrams
ROWS_AT_ONCE = 512
PART = 2 << 20  # bytes of text whose trigrams are listed at a time
CELLS = 1 << 22  # of languages by buckets, or by rows, in one array of a task
HELD_BACK = 2048.0  # trigrams that a language's counts are held back by
FLOOR = 0.01  # share of the overall distribution below which no language falls
FULL_TEXT = 200  # trigrams whose evidence counts in full; a longer text counts as this many
SMOOTHING = 20.0  # rows that a parent's distribution weighs
MIN_CONFIDENCE = 0.5
# Letters as they are (A-Z in lower case), everything else in ASCII a blank.
_LETTERS = LOWER.copy()
_LETTERS[[i for i in range(128) if not chr(i).isalpha()]] = 0x20


def language_code(column: Column) -> Column:
    """Primary part of a declared code (``en-GB``: ``en``), null where it is none."""
    code = F.regexp_extract(F.lower(F.trim(column)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(code != "", code)


def trigrams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and row of every trigram whose middle is a letter, ``PART`` bytes of text at a time."""
    data, bounds = utf8(texts)
    alone = len(bounds) == 2
    rows = np.zeros(PART + 2, np.int64) if alone else np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for start in range(0, max(len(data) - 2, 0), PART):
        letters = _LETTERS[data[start : start + PART + 2]]
        wide = letters.astype(np.uint32)
        code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
        bucket = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
        row = rows[: len(letters)] if alone else rows[start : start + len(letters)]
        use = (letters[1:-1] != 0x20) & (row[:-2] == row[2:])
        yield bucket[use], row[:-2][use]


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start, stop in text_slices(batch):
        for at in range(start, stop, ROWS_AT_ONCE):
            yield batch.slice(at, min(ROWS_AT_ONCE, stop - at))


def fit_text_model(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Candidate languages, their trigram counts by bucket, and the floor of each bucket.

    ``rows`` has ``_id``, ``_text`` and ``_declared``. All rows that declare a
    language are counted and every code is a candidate; a task sums its rows first, and
    what comes to the driver is one count per language and bucket that occurs.
    """
    # A code has two or three letters, so this list is bounded.
    known = sorted(r[0] for r in rows.filter("_declared is not null").select("_declared").distinct().collect())
    place = {code: i for i, code in enumerate(known)}
    n_cells = len(place) * BUCKETS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(sums: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums)], ["cell", "n"])

        sums = np.zeros(n_cells if n_cells <= CELLS else 0, dtype=np.int64)
        for batch in batches:
            for piece in _pieces(batch):
                own = np.array([place[c] for c in piece.column(2).to_pylist()], dtype=np.int64)
                for bucket, row in trigrams(piece.column(1)):
                    cell = own[row] * BUCKETS + bucket
                    if len(sums):
                        sums += np.bincount(cell, minlength=len(sums))
                    else:
                        at, n = np.unique(cell, return_counts=True)
                        yield summed(n, at)
        at = np.flatnonzero(sums)
        yield summed(sums[at], at)

    counts = np.zeros((len(known), BUCKETS), dtype=np.float32)
    if known:
        cells = rows.filter("_declared is not null").mapInArrow(lean(count), "cell long, n long")
        found = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        at = found.column("cell").to_numpy()
        counts[at // BUCKETS, at % BUCKETS] = found.column("n").to_numpy()
    overall = counts.sum(axis=0, dtype=np.float64) + 0.5
    return known, counts, FLOOR * overall / overall.sum()


def score_texts(rows: DataFrame, known: list[str], counts: np.ndarray, floor: np.ndarray) -> DataFrame:
    """``rows`` without the text, with ``_grams`` and the log-likelihoods ``_ev``, less that of the floor.

    A trigram has the probability n / (total + HELD_BACK) + floor, so a code that few
    rows declare explains little beside the others. A row's own trigrams are taken out
    of the language that it declares.
    """
    totals = counts.sum(axis=1, dtype=np.float64)
    shared = rows.sparkSession.sparkContext.broadcast((counts, totals, floor))
    others = [c for c in rows.columns if c != "_text"]
    declared_at = rows.columns.index("_declared")
    n_languages = len(known)
    place = {code: i for i, code in enumerate(known)}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes, least = shared.value
        model = np.empty((BUCKETS, n_languages), dtype=np.float32)
        for i in range(n_languages):
            model[:, i] = np.log1p(held[i] / ((sizes[i] + HELD_BACK) * least))
        for batch in batches:
            for piece in _pieces(batch):
                n = piece.num_rows
                own = np.zeros(n * BUCKETS, dtype=np.int64)
                for bucket, row in trigrams(piece.column(1)):
                    own += np.bincount(row * BUCKETS + bucket, minlength=n * BUCKETS)
                own = own.reshape(n, BUCKETS)
                grams = own.sum(axis=1)
                evidence = (own.astype(np.float32) @ model).astype(np.float64)
                lang = np.array([place.get(c, -1) for c in piece.column(declared_at).to_pylist()], dtype=np.int64)
                at, b = np.nonzero(own * (lang >= 0)[:, None])
                of, mine = lang[at], own[at, b]
                rest = np.maximum(held[of, b] - mine, 0.0) / ((np.maximum(sizes[of] - grams[at], 0.0) + HELD_BACK) * least[b])
                without = np.bincount(at, mine * np.log1p(rest), minlength=n)
                named = np.flatnonzero(lang >= 0)
                evidence[named, lang[named]] = without[named]
                evidence *= np.minimum(1.0, FULL_TEXT / np.maximum(grams, 1))[:, None]
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * n_languages)
                columns = [piece.column(c) for c in others]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(grams, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(evidence.ravel()))],
                    [*others, "_grams", "_ev"],
                )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")
    return rows.mapInArrow(lean(score), f"{kept}, _grams long, _ev array<double>")


def _votes(scored: DataFrame, key: str) -> DataFrame:
    """Per value of ``key`` the languages that its texts speak for, and how many do."""
    each = scored.filter(F.col(key).isNotNull() & (F.col("_top") >= 0)).groupBy(key, "_top").agg(F.count("*").alias("n"))
    listed = each.groupBy(F.col(key).alias(f"{key}_key")).agg(F.collect_list(F.struct("_top", "n")).alias("l"))
    return listed.select(f"{key}_key", F.col("l._top").alias(f"{key}_langs"), F.col("l.n").alias(f"{key}_votes"))


def identify(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: Column | str = "text",
    declared: Column | str | None = None,
    suffix: Column | str | None = None,
    hosts: Sequence[Column | str] = (),
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """``doc_id``, ``lang``, ``confidence``, ``text_lang``, ``declared_lang``, ``n_grams``, ``kept``.

    Text likelihoods are trigram counts of all rows by declared language; every code
    that a row declares is a candidate, and the row's own trigrams are taken out. The
    language each text alone speaks for is counted per declared code, per address suffix and
    per level of ``hosts`` (widest first, e.g. domain, host); a level's distribution is
    smoothed by that of the level above, the widest by all rows, and a row's own
    vote is taken out. The logs add up to the posterior.

    A row without a letter trigram and any declared, suffix or host evidence, or
    whose best language stays below ``min_confidence``, is rejected (``kept``
    false); a null or empty text keeps the other evidence. Rows are judged one by
    one: repeated and null ids are returned as they come. If no row declares a
    language, none can be named and every row is rejected.
    """
    column = lambda c: F.col(c) if isinstance(c, str) else c
    absent = F.lit(None).cast("string")
    levels = [f"_host{i}" for i in range(len(hosts))]
    rows = docs.select(
        F.col(id_column).alias("_id"),
        column(text).cast("string").alias("_text"),
        (language_code(column(declared)) if declared is not None else absent).alias("_declared"),
        (column(suffix).cast("string") if suffix is not None else absent).alias("_suffix"),
        *[column(h).cast("string").alias(name) for h, name in zip(hosts, levels, strict=True)],
    )
    known, counts, floor = fit_text_model(rows)
    n = len(known)
    if not n:
        return rows.select(
            F.col("_id").alias("doc_id"), absent.alias("lang"), F.lit(0.0).alias("confidence"), absent.alias("text_lang"),
            F.col("_declared").alias("declared_lang"), F.lit(0).cast("long").alias("n_grams"), F.lit(False).alias("kept"),
        )
    top = F.when(F.col("_grams") > 0, F.array_position("_ev", F.array_max("_ev")).cast("int") - 1).otherwise(-1)
    scored = materialize(score_texts(rows, known, counts, floor).withColumn("_top", top))
    overall = np.zeros(n)
    for place, votes in scored.filter("_top >= 0").groupBy("_top").agg(F.count("*")).collect():
        overall[place] = votes
    keys = [k for k, given in (("_declared", declared is not None), ("_suffix", suffix is not None)) if given]
    joined = scored
    for key in (*keys, *levels):
        joined = joined.join(_votes(scored, key), F.col(key) == F.col(f"{key}_key"), "left").drop(f"{key}_key")
    fused = joined.mapInArrow(
        lean(_fusion(known, overall, keys, levels, min_confidence)),
        f"doc_id {rows.schema['_id'].dataType.simpleString()}, lang string, confidence double, text_lang string, "
        "declared_lang string, n_grams long, kept boolean",
    )
    return fused.select("doc_id", "lang", "confidence", "text_lang", "declared_lang", "n_grams", "kept")


def _fusion(known: list[str], overall: np.ndarray, keys: list[str], levels: list[str], min_confidence: float):
    """The posterior of each row, from its text and the votes of its values."""
    n, everything = len(known), overall.sum() or 1.0
    prior = (overall + SMOOTHING / n) / (everything + SMOOTHING)

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, CELLS // (4 * n))
            for at in range(0, batch.num_rows, step):
                yield piece(batch.slice(at, step))

    def piece(rows: pa.RecordBatch) -> pa.RecordBatch:
        m = rows.num_rows
        top, grams = rows.column("_top").to_numpy(), rows.column("_grams").to_numpy()
        total = rows.column("_ev").flatten().to_numpy().reshape(m, n).copy()
        told = np.flatnonzero(top >= 0)

        def votes(key: str) -> np.ndarray:
            """Votes of the row's value without its own; nulls give none."""
            listed = rows.column(f"{key}_votes")
            row = np.repeat(np.arange(m), listed.value_lengths().fill_null(0).to_numpy())
            out = np.zeros((m, n))
            out[row, rows.column(f"{key}_langs").flatten().to_numpy()] = listed.flatten().to_numpy()
            out[told, top[told]] = np.maximum(out[told, top[told]] - 1.0, 0.0)
            return out

        evident = grams > 0
        for key in keys:
            # log P(value | language), each language smoothed by the value's share of all rows.
            counts, has = votes(key), rows.column(key).is_valid().to_numpy(zero_copy_only=False)
            share = (counts.sum(axis=1, keepdims=True) + 1.0) / (everything + 1)
            total += np.log((counts + SMOOTHING * share) / (overall + SMOOTHING)) * has[:, None]
            evident |= has
        shares = np.broadcast_to(prior, (m, n))
        for key in levels:
            counts = votes(key)
            shares = (counts + SMOOTHING * shares) / (counts.sum(axis=1, keepdims=True) + SMOOTHING)
            evident |= rows.column(key).is_valid().to_numpy(zero_copy_only=False)
        total += np.log(shares)
        best = total.argmax(axis=1)
        confidence = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        names = pa.array(known, pa.string())
        return pa.RecordBatch.from_arrays(
            [
                rows.column("_id"), names.take(pa.array(best)), pa.array(confidence),
                names.take(pa.array(np.maximum(top, 0), mask=top < 0)), rows.column("_declared"), rows.column("_grams"),
                pa.array(evident & (confidence >= min_confidence)),
            ],
            ["doc_id", "lang", "confidence", "text_lang", "declared_lang", "n_grams", "kept"],
        )

    return fuse


# Markup that holds no text, and any other tag.
_MARKUP = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"


def page_text(html: Column) -> Column:
    return F.regexp_replace(html, _MARKUP, " ")


def page_language(html: Column) -> Column:
    """What the html element declares."""
    return F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3}\b[a-z0-9_-]*)", 1)


def address_parts(url: Column) -> tuple[Column, Column, Column]:
    """Suffix, domain (last two labels) and host of an address; null where there is none."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    labels = F.split(host, r"\.")
    last_two = F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(host)
    return F.element_at(labels, -1), last_two, host


def keep_identified(docs: DataFrame, declared: str, hosts: Sequence[str], id_column: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows that ``identify`` rejects, columns unchanged.

    The verdicts are narrow and meet the rows by id; an id is rejected if all its rows
    are. Rows without an id are judged as one.
    """
    found = identify(docs, id_column=id_column, declared=declared, hosts=hosts, **options)
    rejected = found.groupBy("doc_id").agg(F.max("kept").alias("any")).filter("not any").select(F.col("doc_id").alias("_gone"))
    # Stored, so that its size is known: few ids are sent to the texts, many meet them by id.
    rejected = materialize(rejected)
    return docs.join(rejected, F.col(id_column).eqNullSafe(F.col("_gone")), "left_anti")
