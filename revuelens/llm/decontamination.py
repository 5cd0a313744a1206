"""Benchmark decontamination: training passages as queries to a BM25 index of test items.

The index holds blocks of test items, bounded in size, one after the other; the corpus
is never indexed or shuffled. Per block of items, passages whose block maxima cannot
reach the threshold are left out at once, block-max WAND retrieves every item above
it for the others, and overlaps with the item's question and answer decide, or with the
whole item where no answer is given.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revuelens.llm.common import release, utf8
from revuelens.llm.shingles import LONG, LOWER, find_words, word_hashes, word_parts
from revuelens.session import materialize

K1, B = 1.2, 0.75
BLOCK, PART = 8, 2  # items per block of maxima, and per part of a block
RUN = 8  # words that hardly stand together by chance, common as they may be
ITEM_BYTES = 1 << 19  # words of test items in one broadcast index, as hashes
SLICE_BYTES = 1 << 20
LEAK = "array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double>>"
_LEAK_TYPE = pa.list_(
    pa.struct(
        [
            ("item_id", pa.int64()),
            ("score", pa.float64()),
            ("question_overlap", pa.float64()),
            ("answer_overlap", pa.float64()),
        ]
    )
)
# Words are runs of ASCII letters and digits (A-Z in lower case) and bytes beyond ASCII,
# so punctuation that is glued to a word does not hide it.
_WORDS = LOWER.copy()
_WORDS[[i for i in range(128) if not chr(i).isalnum()]] = 0x20
_LAST_SENTENCE = re.compile(r"(?s)(.*[.!?]\s+)(\S.*)")
_MARKED = re.compile(r"(?si)(.*?)\banswer\s*:\s*(.*)")


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: at ``Answer:``, else before the last sentence (none: no answer)."""
    found = _MARKED.fullmatch(text.strip()) or _LAST_SENTENCE.fullmatch(text.strip())
    return (found[1], found[2]) if found else (text, "")


def gives_answer(text: str) -> bool:
    """Whether the answer is marked; a last sentence is only taken for one."""
    return _MARKED.fullmatch(text.strip()) is not None


def _hashes(texts: list[str]) -> list[np.ndarray]:
    data, bounds = utf8(pa.array(texts, pa.string()))
    data = _WORDS[data]
    words = find_words(data, bounds)
    return np.split(word_hashes(data, words), np.cumsum(words.counts)[:-1])


def _grams(words: np.ndarray, n: int = 3) -> set[tuple[int, ...]]:
    """Runs of ``n`` words, or the whole where it is shorter."""
    listed = words.tolist()
    size = min(n, len(listed))
    return {tuple(listed[i : i + size]) for i in range(len(listed) - size + 1)} if size else set()


@dataclass
class Settings:
    threshold: float = 0.5  # share of the item's score with itself
    overlap: float = 0.6  # share of the question's and of the answer's word triples; of all where no answer is given
    passage: int = 0  # words of a passage; 0: twice the longest item


class ItemIndex:
    """Inverted index of one block of items; impacts are shares of the item's own score.

    Items are numbered by length, so that maxima of a block are close to its impacts.
    """

    def __init__(self, items, n_items: int, mean_length: float, frequency: dict[int, int], settings: Settings):
        """``items``: (id, question words, answer words, answer given) with words as hashes; the rest is over all items."""
        self.settings = settings
        items = sorted(items, key=lambda x: (len(x[1]) + len(x[2]), x[0]))
        self.ids = [x[0] for x in items]
        self.questions = [_grams(x[1]) for x in items]
        self.answers = [_grams(x[2]) for x in items]
        self.wholes = [None if x[3] else _grams(np.concatenate([x[1], x[2]])) for x in items]
        # Per triple what its words weigh, and longer runs: triples of common words alone prove nothing.
        idf = {t: math.log1p((n_items - n + 0.5) / (n + 0.5)) for t, n in frequency.items()}
        self.weights = [{g: sum(idf[t] for t in g) for g in w or ()} for w in self.wholes]
        self.runs = [None if x[3] else _grams(np.concatenate([x[1], x[2]]), RUN) for x in items]
        self.longest = max((len(x[1]) + len(x[2]) for x in items), default=1)
        self.stride = max(8, (settings.passage + 1) // 2 or self.longest)
        postings: dict[int, list[tuple[int, float]]] = {}
        for k, (_, question, answer, _) in enumerate(items):
            terms, counts = np.unique(np.concatenate([question, answer]), return_counts=True)
            norm = K1 * (1 - B + B * (len(question) + len(answer)) / mean_length)
            known = [frequency[t] for t in terms.tolist()]
            idf = np.log1p((n_items - np.array(known) + 0.5) / (np.array(known) + 0.5))
            impact = idf * counts * (K1 + 1) / (counts + norm)
            for t, share in zip(terms.tolist(), (impact / impact.sum()).tolist(), strict=True):
                postings.setdefault(t, []).append((k, share))
        self.vocabulary = np.array(sorted(postings), dtype=np.uint64)
        self.lists = [postings[t] for t in self.vocabulary.tolist()]
        self.items_of = [[k for k, _ in p] for p in self.lists]
        n_blocks = -(-len(items) // BLOCK) or 1
        self.block_max = np.zeros((len(self.lists), n_blocks), dtype=np.float64)
        for t, listed in enumerate(self.lists):
            for k, share in listed:
                self.block_max[t, k // BLOCK] = max(self.block_max[t, k // BLOCK], share)
        # Maxima of the parts of a block, for the blocks that a term occurs in; row 0 is empty.
        self.cell = np.zeros(self.block_max.shape, dtype=np.int32)
        used = np.nonzero(self.block_max)
        self.cell[used] = np.arange(1, len(used[0]) + 1)
        self.part_max = np.zeros((len(used[0]) + 1, BLOCK // PART), dtype=np.float64)
        for t, listed in enumerate(self.lists):
            for k, share in listed:
                cell, part = self.cell[t, k // BLOCK], k % BLOCK // PART
                self.part_max[cell, part] = max(self.part_max[cell, part], share)
        self.term_max = self.block_max.max(axis=1).tolist() if len(self.lists) else []
        # Frequent terms that together reach the threshold in no block never start a search.
        order = sorted(range(len(self.lists)), key=lambda t: -len(self.lists[t]))
        reached = np.cumsum(self.block_max[order], axis=0).max(axis=1) if order else np.zeros(0)
        self.starting = np.ones(len(self.lists), dtype=bool)
        self.starting[np.array(order, dtype=int)[: int(np.searchsorted(reached, settings.threshold - 1e-9))]] = False
        self.sieve = np.zeros(1 << 18, dtype=bool)
        self.sieve[(self.vocabulary & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for a word of no item."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.sieve[(hashes & np.uint64((1 << 18) - 1)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, hashes[maybe])
        at[at == len(self.vocabulary)] = 0
        hit = self.vocabulary[at] == hashes[maybe] if len(self.vocabulary) else np.zeros(len(maybe), bool)
        out[maybe[hit]] = at[hit]
        return out

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """Every item whose score with these distinct terms reaches the threshold."""
        aim, end, out = self.settings.threshold - 1e-9, len(self.ids), []
        cursors = [[self.items_of[t][0], 0, t] for t in terms]

        def move(cursor: list[int], item: int) -> None:
            listed = self.items_of[cursor[2]]
            cursor[1] = bisect.bisect_left(listed, item, cursor[1])
            cursor[0] = listed[cursor[1]] if cursor[1] < len(listed) else end

        while True:
            cursors = sorted(c for c in cursors if c[0] < end)
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += self.term_max[c[2]]
                if bound >= aim:
                    pivot = i
                    break
            if pivot < 0:
                return out
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.block_max[c[2], block] for c in cursors[: pivot + 1]) < aim:
                # Up to the next block or cursor no item can reach it.
                beyond = min((block + 1) * BLOCK, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end)
                for c in cursors[: pivot + 1]:
                    move(c, beyond)
            elif cursors[0][0] == item:
                score = sum(self.lists[c[2]][c[1]][1] for c in cursors[: pivot + 1])
                if score >= aim:
                    out.append((item, score))
                for c in cursors[: pivot + 1]:
                    move(c, item + 1)
            else:
                for c in cursors[: pivot + 1]:
                    move(c, item)

    def search(self, data: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, float, float, float]]]:
        """Verified (item id, best score, question overlap, answer overlap) of each row.

        A long text, which comes alone, is searched in parts that begin where passages do
        and share a stride, so each passage stands whole in one part.
        """
        if len(bounds) != 2 or len(data) <= LONG:
            return self._search(data, bounds)
        best: dict[int, tuple] = {}
        for part in word_parts(_WORDS[data], self.stride, self.stride):
            for leak in self._search(part, np.array([0, len(part)]))[0]:
                best[leak[0]] = max(best.get(leak[0], leak), leak)
        return [[best[k] for k in sorted(best)]]

    def _search(self, data: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, float, float, float]]]:
        found: list[dict[int, tuple[float, float, float]]] = [{} for _ in range(len(bounds) - 1)]
        if not len(data) or not self.lists:
            return [[] for _ in found]
        lower = _WORDS[data]
        words = find_words(lower, bounds)
        hashes = word_hashes(lower, words)
        terms = self.terms(hashes)
        row_start = np.concatenate([[0], np.cumsum(words.counts)])
        n_windows = -(-words.counts // self.stride)
        window_start = np.concatenate([[0], np.cumsum(n_windows)])
        hit = np.flatnonzero(terms >= 0)
        late = window_start[words.doc[hit]] + (hit - row_start[words.doc[hit]]) // self.stride
        # A word stands in the passage that begins in its own stride and in the one before.
        has_early = late > window_start[words.doc[hit]]
        window = np.concatenate([late, late[has_early] - 1])
        term = np.concatenate([terms[hit], terms[hit][has_early]])
        starts = np.zeros(window_start[-1], dtype=bool)
        starts[window[self.starting[term]]] = True
        chosen = starts[window]
        pairs = np.unique(window[chosen] * len(self.lists) + term[chosen])
        window, term = pairs // len(self.lists), pairs % len(self.lists)
        if not len(window):
            return [[] for _ in found]
        first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
        ends = np.append(first[1:], len(window))
        for i in self._reachable(term, first, ends).tolist():
            w = int(window[first[i]])
            doc = int(np.searchsorted(window_start, w, side="right")) - 1
            begin = row_start[doc] + (w - window_start[doc]) * self.stride
            grams = None
            for item, score in self.wand(term[first[i] : ends[i]].tolist()):
                if grams is None:
                    passage = hashes[begin : min(begin + 2 * self.stride, row_start[doc + 1])]
                    grams = {n: _grams(passage, n) for n in (1, 2, 3)}
                question = self._share(self.questions[item], grams)
                answer = self._share(self.answers[item], grams) if self.answers[item] else question
                if min(question, answer) >= self.settings.overlap or self._holds_whole(item, passage, grams):
                    found[doc][item] = max(found[doc].get(item, (0.0, 0.0, 0.0)), (score, question, answer))
        return [[(self.ids[k], *v) for k, v in sorted(x.items())] for x in found]

    def _holds_whole(self, item: int, passage: np.ndarray, grams: dict[int, set]) -> bool:
        """Whether an item without a given answer overlaps as a whole, and not by common words alone."""
        whole, aim = self.wholes[item], self.settings.overlap
        if not whole or self._share(whole, grams) < aim:
            return False
        weights, runs = self.weights[item], self.runs[item]
        have = grams[len(next(iter(whole)))]
        if sum(w for g, w in weights.items() if g in have) >= aim * sum(weights.values()):
            return True
        return self._share(runs, {n: _grams(passage, n) for n in {len(next(iter(runs)))}}) >= aim

    def _reachable(self, term: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Passages with a block, and a part of it, whose maxima add up to the threshold."""
        aim = self.settings.threshold - 1e-9
        bound = np.add.reduceat(self.block_max[term], first, axis=0)
        passage, block = np.nonzero(bound >= aim)
        if not len(passage):
            return passage
        size = ends[passage] - first[passage]
        begin = np.cumsum(size) - size
        entry = np.arange(int(size.sum())) - np.repeat(begin - first[passage], size)
        cells = self.cell[term[entry], np.repeat(block, size)]
        finer = np.add.reduceat(self.part_max[cells], begin, axis=0).max(axis=1)
        return np.unique(passage[finer >= aim])

    @staticmethod
    def _share(wanted: set[tuple[int, ...]], grams: dict[int, set]) -> float:
        return len(wanted & grams[len(next(iter(wanted)))]) / len(wanted) if wanted else 1.0


def build_indexes(items: DataFrame, settings: Settings, id_column: str = "item_id", text: str = "text"):
    """Indexes of blocks of items, each of at most ``ITEM_BYTES`` of text (or one item).

    Document frequencies and the mean length are over all items; Spark counts them and
    places the blocks. Items without words and without ids are left out: nothing can
    match them.
    """
    spark = items.sparkSession
    answer = F.col("answer").cast("string") if "answer" in items.columns else F.lit(None).cast("string")
    narrow = items.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"), answer.alias("answer"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [
                split_item(t) if a is None else (t, a)
                for t, a in zip(batch.column(1).fill_null("").to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            if parts:
                columns = [[x.view(np.int64) for x in _hashes([p[k] for p in parts])] for k in (0, 1)]
                given = [
                    a is not None or gives_answer(t)
                    for t, a in zip(batch.column(1).fill_null("").to_pylist(), batch.column(2).to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(c, pa.list_(pa.int64())) for c in columns], pa.array(given)], ["id", "q", "a", "given"]
                )

    words = materialize(
        narrow.filter("id is not null").mapInArrow(cut, "id long, q array<long>, a array<long>, given boolean").filter("size(q) + size(a) > 0")
    )
    both = F.concat("q", "a")
    n_items, mean_length = words.agg(F.count("*"), F.avg(F.size(both))).first()
    if not n_items:
        return []
    counts = materialize(words.select(F.explode(F.array_distinct(both)).alias("w")).groupBy("w").agg(F.count("*").alias("n")))
    blocks = max(1, math.ceil(words.agg(F.sum(F.size(both) * 8)).first()[0] / ITEM_BYTES))
    placed = materialize(words.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))) if blocks > 1 else words.withColumn("block", F.lit(0))
    out = []
    for k in range(blocks):
        block = placed.filter(F.col("block") == k)
        mine = block.select(F.explode(F.array_distinct(both)).alias("w")).distinct().join(counts, "w")
        frequency = {w & (2**64 - 1): n for w, n in mine.toPandas().itertuples(index=False)}
        rows = [
            (r.id, np.array(r.q, dtype=np.int64).view(np.uint64), np.array(r.a, dtype=np.int64).view(np.uint64), r.given)
            for r in block.collect()
        ]
        if rows:
            index = ItemIndex(rows, n_items, float(mean_length), frequency, settings)
            out.append(spark.sparkContext.broadcast(index))
    return out


def leaks(text: str, indexes) -> Column:
    """Array of verified test items of a text column; empty for a clean or null text."""

    def one(shared):
        @F.arrow_udf(LEAK)
        def search(texts: pa.Array) -> pa.Array:
            out: list = []
            sizes = np.cumsum([0, *[len(x.as_buffer()) if x.is_valid else 0 for x in texts]])
            start = 0
            while start < len(texts):
                stop = max(start + 1, int(np.searchsorted(sizes, sizes[start] + SLICE_BYTES, side="right")) - 1)
                out += shared.value.search(*utf8(texts.slice(start, stop - start)))
                start = stop
            release()
            names = ("item_id", "score", "question_overlap", "answer_overlap")
            return pa.array([[dict(zip(names, x, strict=True)) for x in row] for row in out], _LEAK_TYPE)

        return search(F.col(text))

    return F.concat(*[one(x) for x in indexes]) if indexes else F.from_json(F.lit("[]"), LEAK)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    settings: Settings | None = None,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id``, ``item_id``, ``score``, ``question_overlap``, ``answer_overlap`` of every leak.

    One row per (row of ``docs``, item), so a repeated row is reported again; a null
    id stays null. Clean, empty and null texts give no row.
    """
    indexes = build_indexes(items, settings or Settings())
    found = docs.select(F.col(id_column).alias("doc_id"), F.explode(leaks(text, indexes)).alias("leak"))
    return found.select("doc_id", "leak.*")


def drop_contaminated(docs: DataFrame, items: DataFrame, settings: Settings | None = None, text: str = "text") -> DataFrame:
    """``docs`` without rows that hold a test item; nothing is shuffled."""
    indexes = build_indexes(items, settings or Settings())
    return docs.withColumn("_leaks", leaks(text, indexes)).filter(F.size("_leaks") == 0).drop("_leaks")
