"""Quality by co-training: a classifier of the text and one of what is known about it teach each other."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revuelens.llm.common import seeded_sample, text_slices, utf8
from revuelens.llm.shingles import LOWER, SPACE, find_words, mixed, word_hashes
from revuelens.session import materialize

MAX_LABELLED = 20_000  # labelled rows that models are fitted and calibrated on at most, by seeded hash
HELD_OUT = 5  # every fifth of them calibrates instead
PSEUDO = 400  # pseudo-labels that a view hands over in a round, both classes together
CONFIDENT = 0.9
ROUNDS = 4
WORD_BUCKETS, SOURCE_BUCKETS, LANG_BUCKETS = 64, 32, 8

_KIND = np.zeros((7, 256), dtype=np.uint8)
_KIND[0, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[1, 65:91] = 1
_KIND[2, 48:58] = 1
_KIND[3, [i for i in range(33, 127) if not chr(i).isalnum()]] = 1
_KIND[4, [ord(c) for c in "#$%&*|<>{}[]=\\^~"]] = 1
_KIND[5, [ord(c) for c in ".!?"]] = 1
_KIND[6, 10] = 1


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    running = np.zeros(len(values) + 1)
    np.cumsum(values, out=running[1:])
    return running[bounds[1:]] - running[bounds[:-1]]


def text_view(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Shares of characters and words of each kind, repetition, and hashed word shares."""
    rows = len(bounds) - 1
    size = np.maximum(np.diff(bounds), 1)
    kinds = [_per_row(k[data], bounds) for k in _KIND]
    words = find_words(data, bounds)
    n = np.maximum(words.counts, 1)
    row_start = np.concatenate([[0], np.cumsum(words.counts)])
    length = (words.ends - words.starts).astype(np.float64)
    mean = _per_row(length, row_start) / n
    spread = np.sqrt(np.maximum(_per_row(length**2, row_start) / n - mean**2, 0))
    hashes = word_hashes(LOWER[data], words)

    def distinct(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, doc))
        v, d = values[order], doc[order]
        fresh = np.ones(len(v), dtype=bool)
        fresh[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
        return np.bincount(d[fresh], minlength=rows)

    pair = mixed(hashes[:-1] * np.uint64(3) + hashes[1:]) if len(hashes) > 1 else np.zeros(0, np.uint64)
    same = words.doc[1:] == words.doc[:-1]
    pairs = np.maximum(np.bincount(words.doc[1:][same], minlength=rows), 1)
    hard_space = _per_row(SPACE[data], bounds)
    columns = [
        np.log1p(words.counts),
        mean,
        spread,
        _per_row(length <= 3, row_start) / n,
        _per_row(length > 15, row_start) / n,
        distinct(hashes, words.doc) / n,
        distinct(pair[same], words.doc[1:][same]) / pairs,
        *[k / size for k in kinds],
        kinds[1] / np.maximum(kinds[0], 1),
        kinds[5] / n,
        hard_space / size,
        words.counts == 0,
    ]
    bucket = words.doc * WORD_BUCKETS + (hashes >> np.uint64(58)).astype(np.int64)
    shares = np.bincount(bucket, minlength=rows * WORD_BUCKETS).reshape(rows, WORD_BUCKETS) / n[:, None]
    return np.hstack([np.stack(columns, axis=1), np.sqrt(shares)]).astype(np.float32)


def meta_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Hashed source and language, and the declared length; missing values have a place of their own."""
    rows = len(source)
    out = np.zeros((rows, SOURCE_BUCKETS + LANG_BUCKETS + 3), dtype=np.float32)
    for i, (s, g) in enumerate(zip(source, lang, strict=True)):
        out[i, zlib.crc32(b"\0" if s is None else s.encode()) % SOURCE_BUCKETS] = 1
        out[i, SOURCE_BUCKETS + zlib.crc32(b"\0" if g is None else g.encode()) % LANG_BUCKETS] = 1
    size = np.array([-1 if c is None else max(c, 0) for c in n_chars], dtype=np.float64)
    out[:, -3] = np.log1p(np.maximum(size, 0))
    out[:, -2] = out[:, -3] ** 2
    out[:, -1] = size < 0
    return out


def views(docs: DataFrame, id_column: str, text: str, source: str, lang: str, n_chars: str) -> DataFrame:
    """``doc_id``, ``text_view`` and ``meta_view`` of every row, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch):
                piece = batch.slice(start, stop - start)
                content = text_view(*utf8(piece.column(1)))
                about = meta_view(*(piece.column(c).to_pylist() for c in (2, 3, 4)))
                yield pa.RecordBatch.from_arrays([piece.column(0), _lists(content), _lists(about)], ["doc_id", "t", "m"])

    narrow = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        F.col(source).cast("string").alias("source"),
        F.col(lang).cast("string").alias("lang"),
        F.col(n_chars).cast("long").alias("n_chars"),
    )
    return narrow.mapInArrow(run, "doc_id long, t array<float>, m array<float>")


def _lists(rows: np.ndarray) -> pa.Array:
    ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))


def _rows(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64)


@dataclass
class Logistic:
    """Standardised logistic regression; ``scale`` and ``shift`` calibrate its logit."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.spread, -8, 8)
        return self.scale * (x @ self.weights[1:] + self.weights[0]) + self.shift


def _newton(x: np.ndarray, y: np.ndarray, l2: float, rounds: int = 30) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), l2)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray) -> Logistic:
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    scaled = np.clip((x - mean) / spread, -8, 8)
    return Logistic(mean, spread, _newton(scaled, y, l2=5.0))


def calibrate(model: Logistic, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling on rows that the model was not fitted on."""
    if 0 < y.sum() < len(y):
        # Targets drawn in a little, so that a perfect separation stays finite.
        soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        shift, scale = _newton(model.logit(x)[:, None], soft, l2=1e-3)
        model.scale, model.shift = max(float(scale), 1e-3), float(shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _confident(rows: DataFrame, models: tuple[Logistic, Logistic], taken: set[int], wanted: tuple[int, int]):
    """The surest unlabelled rows of each view and class: (view, label, doc_id, x of the other view).

    Each task names its surest ids only; the views of the few chosen are fetched after.
    """
    shared = rows.sparkSession.sparkContext.broadcast((models, np.array(sorted(taken), dtype=np.int64)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, known = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            free = ~np.isin(ids, known)
            for view, model in enumerate(both):
                p = _sigmoid(model.logit(_rows(batch.column(1 + view))))
                for label in (0, 1):
                    sure = p if label else 1 - p
                    at = np.flatnonzero(free & (sure >= CONFIDENT))
                    at = at[np.lexsort((ids[at], -sure[at]))][: wanted[label]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(at), view)), pa.array(np.full(len(at), label)), pa.array(ids[at]), pa.array(sure[at]),
                        ],
                        ["view", "label", "doc_id", "p"],
                    )

    found = rows.select("doc_id", "t", "m").mapInArrow(pick, "view long, label long, doc_id long, p double")
    out = []
    for view in (0, 1):
        for label in (0, 1):
            top = found.filter((F.col("view") == view) & (F.col("label") == label))
            out += top.orderBy(F.desc("p"), "doc_id").limit(wanted[label]).collect()
    chosen = sorted({r.doc_id for r in out})
    seen = {}
    if chosen:
        seen = {r.doc_id: (r.t, r.m) for r in rows.filter(F.col("doc_id").isin(chosen)).select("doc_id", "t", "m").collect()}
    return [(r.view, r.label, r.doc_id, seen[r.doc_id][1 - r.view]) for r in out]


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    n_chars: str = "n_chars",
    label: str = "quality",
    seed: int = 11,
) -> DataFrame:
    """Per row ``doc_id``, ``text_score``, ``meta_score``, ``score``, ``kept`` (score of one half or more).

    Both views are fitted on the labelled sample. In each round either view labels
    the unlabelled rows it is surest of, in the proportion of the classes, and the
    other view learns them. At last each view's logit is calibrated on held-out
    labelled rows, and the two are added as independent evidence on one prior.

    An id with several labels has the majority's; labels other than 0 and 1, null
    and unknown ids count for nothing. Null and empty texts, sources and languages
    have places of their own in the views, a null or repeated id is scored row by
    row. Without labels of both classes every score is the smoothed share of good ones.
    """
    given = labels.filter(F.col(label).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(
        F.col(id_column).cast("long").alias("_id")
    ).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    seen = views(docs, id_column, text, source, lang, n_chars)
    rows = materialize(seen.join(given, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "t", "m", "y"))
    sample = seeded_sample(rows.filter("y is not null"), "doc_id", MAX_LABELLED, seed).toArrow()
    y = sample.column("y").to_numpy().astype(np.float64)
    if not 0 < y.sum() < len(y):
        share = F.lit((float(y.sum()) + 1) / (len(y) + 2))
        return rows.select(
            "doc_id", share.alias("text_score"), share.alias("meta_score"), share.alias("score"), (share >= 0.5).alias("kept")
        )
    x = (_rows(sample.column("t")), _rows(sample.column("m")))
    held = np.arange(len(y)) % HELD_OUT == 0
    if not 0 < y[~held].sum() < (~held).sum() or not 0 < y[held].sum() < held.sum():
        held[:] = False
    learnt = [([v[~held]], [y[~held]]) for v in x]
    rate = float(y.mean())
    wanted = (max(1, round(PSEUDO * (1 - rate))), max(1, round(PSEUDO * rate)))
    unlabelled, taken = rows.filter("y is null and doc_id is not null"), set()

    def fitted() -> tuple[Logistic, Logistic]:
        first, second = (fit_logistic(np.concatenate(a), np.concatenate(b)) for a, b in learnt)
        return first, second

    for _ in range(ROUNDS):
        models = fitted()
        for view, model in enumerate(models):
            calibrate(model, x[view][held] if held.any() else x[view], y[held] if held.any() else y)
        found = _confident(unlabelled, models, taken, wanted)
        said: dict[int, set[int]] = {}
        for _, label_, doc_id, _ in found:
            said.setdefault(doc_id, set()).add(label_)
        # Rows on which the views disagree teach nothing.
        agreed = [r for r in found if len(said[r[2]]) == 1]
        for view in (0, 1):
            mine = [r for r in agreed if r[0] == view]
            if mine:
                learnt[1 - view][0].append(np.array([r[3] for r in mine], dtype=np.float64))
                learnt[1 - view][1].append(np.array([r[1] for r in mine], dtype=np.float64))
        taken |= set(said)
        if not agreed:
            break
    models = fitted()
    for view, model in enumerate(models):
        calibrate(model, x[view][held] if held.any() else x[view], y[held] if held.any() else y)
    prior = float(np.log(rate / (1 - rate)))
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (m.logit(_rows(batch.column(1 + i))) for i, m in enumerate(shared.value))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(_sigmoid(z)) for z in (a, b, a + b - prior)]],
                    ["doc_id", "text_score", "meta_score", "score"],
                )

    scored = rows.select("doc_id", "t", "m").mapInArrow(
        score, "doc_id long, text_score double, meta_score double, score double"
    )
    return scored.withColumn("kept", F.col("score") >= 0.5)
