"""Removal of long repeated substrings by a sparse suffix array sorted in range buckets.

Every window of ``length`` bytes names an anchor inside it: the ``gram`` with the least
hash. Equal windows name the same place, so only suffixes at anchors are needed, one for
some sixty windows. A run is the windows of one document that share an anchor; its
context is the bytes they cover. Runs of a gram that occurs once are unique. Equal
contexts repeat as a whole and are counted, not sorted. The others are sorted:
sampled splitters deal the suffixes that begin at anchors out by their leading bytes, each
bucket sorts them by multikey quicksort, and neighbours tell which windows repeat.
Windows that reach a bucket's ends are compared across the boundaries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revuelens.llm.common import text_slices, utf8
from revuelens.llm.shingles import mixed, powers, prefix_sums, span_hashes
from revuelens.session import materialize

LENGTH, GRAM = 200, 50
CHUNK = 4 << 20  # bytes of a very long text looked at in one go
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 31) - 1)
NO_ID = -(1 << 63)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchor_runs(data: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """Row, first window, number of windows, way to the anchor, gram hash and context hash of each run."""
    n = len(data)
    if n < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    sums = prefix_sums(data)
    grams = mixed((sums[gram:] - sums[:-gram]) * powers(_BASE, n + 1)[: n - gram + 1])
    ordered = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_min(ordered, length - gram + 1) & _PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = row[: len(anchor)] == row[length - 1 :]
    cut = np.ones(len(anchor) + 1, dtype=bool)
    cut[1:-1] = (anchor[1:] != anchor[:-1]) | (row[1 : len(anchor)] != row[: len(anchor) - 1]) | (inside[1:] != inside[:-1])
    edges = np.flatnonzero(cut)
    first, stop = edges[:-1], edges[1:]
    first, stop = first[inside[first]], stop[inside[first]]
    away = anchor[first] - first
    context = span_hashes(sums, first, stop - 1 + length) ^ mixed(away.astype(np.uint64))
    return row[first], first - bounds[row[first]], stop - first, away, grams[anchor[first]], context


def _text_parts(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bytes, bounds and offset; a very long single text in overlapping parts."""
    data, bounds = utf8(texts)
    if len(texts) > 1 or len(data) <= CHUNK:
        yield data, bounds, 0
        return
    for at in range(0, len(data) - length + 1, CHUNK):
        part = data[at : at + CHUNK + length - 1]
        yield part, np.array([0, len(part)]), at


def _row_hash(texts: pa.Array) -> np.ndarray:
    """128-bit digests that tell rows of one id apart; equal rows may share all they get."""
    digests = [hashlib.blake2b((t or "").encode(), digest_size=16).digest() for t in texts.to_pylist()]
    return np.array(digests, dtype=object)


def find_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``doc``, ``tag``, ``place``, ``gram``, ``context``; ``place`` packs first window, windows, way to the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch):
                piece = batch.slice(start, stop - start)
                ids = piece.column(0).to_numpy()
                tag = _row_hash(piece.column(1))
                for data, bounds, offset in _text_parts(piece.column(1), length):
                    row, first, n, away, grams, context = anchor_runs(data, bounds, length, gram)
                    place = ((first + offset) << 16) | (n << 8) | away
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[row]), pa.array(tag[row], pa.binary()),
                            *[pa.array(x) for x in (place, grams.view(np.int64), context.view(np.int64))],
                        ],
                        ["doc", "tag", "place", "gram", "context"],
                    )

    return docs.mapInArrow(run, "doc long, tag binary, place long, gram long, context long")


def _unpacked(place):
    """First window, windows, way to the anchor."""
    return place >> 16, (place >> 8) & 0xFF, place & 0xFF


def _merged(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint maximal (start, end) rows."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.ones(len(spans), dtype=bool)
    fresh[1:] = spans[1:, 0] > reach[:-1]
    ends = reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(spans) - 1)]
    return np.stack([spans[fresh, 0], ends], axis=1)


def _result(raw: bytes, spans: np.ndarray) -> tuple[int, int, int, str]:
    digest, at = hashlib.sha256(), 0
    for a, b in spans.tolist():
        digest.update(raw[at:a])
        at = b
    digest.update(raw[at:])
    return len(raw), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), digest.hexdigest()


_STATE = pa.schema(
    [
        ("doc", pa.int64()), ("tag", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
        ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("packed", pa.binary()), ("known", pa.list_(pa.int64())),
        ("first", pa.int64()), ("n", pa.int64()), ("away", pa.int64()), ("single", pa.bool_()), ("bytes", pa.binary()),
    ]
)
_STATE_DDL = (
    "doc long, tag binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, packed binary, "
    "known array<long>, first long, n long, away long, single boolean, bytes binary"
)


def _look_up(docs: DataFrame, lists: DataFrame, length: int) -> DataFrame:
    """Documents with all their runs decided get their result; the others and contested contexts go on.

    ``lists`` has per (doc, tag) the places that ``repeated`` and those whose context
    is ``contested`` (as ``single`` or as one of several).
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for start, stop in text_slices(batch):
                piece = batch.slice(start, stop - start)
                packed = [squeeze.compress((t or "").encode()) for t in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(_row_hash(piece.column(1)), pa.binary()), pa.array(packed, pa.binary())],
                    ["doc", "tag", "packed"],
                )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            rows, size = [], 0
            for doc, tag, packed, repeated, contested in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = expand.decompress(packed)
                first, n, _ = _unpacked(np.array(repeated or [], dtype=np.int64))
                spans = _merged(np.stack([first, first + n - 1 + length], axis=1))
                waiting = False
                for item in contested or []:
                    first, n, away = _unpacked(item["place"])
                    waiting |= item["single"]
                    piece = raw[first : first + n - 1 + length]
                    rows.append((doc, tag, *[None] * 6, first, n, away, item["single"], piece))
                    size += len(piece)
                if waiting:
                    rows.append((doc, tag, len(raw), None, None, None, packed, spans.ravel().tolist(), *[None] * 5))
                    size += len(packed)
                else:
                    rows.append((doc, tag, *_result(raw, spans), *[None] * 7))
                if size > 4 << 20 or len(rows) > 5000:
                    yield _state(rows)
                    rows, size = [], 0
            if rows:
                yield _state(rows)

    packed = docs.mapInArrow(pack, "doc long, tag binary, packed binary")
    joined = packed.join(lists.hint("shuffle_hash"), ["doc", "tag"], "left")
    return joined.select("doc", "tag", "packed", "repeated", "contested").mapInArrow(finish, _STATE_DDL)


def _state(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _STATE, strict=True)], schema=_STATE
    )


# ---- one bucket ------------------------------------------------------------------


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long strings, given as rows of big-endian words, and common bytes with the one before.

    Level by level: strings that agree so far are sorted by their next word and
    parted where it changes; those left alone are done.
    """
    n, n_words = words.shape
    order = np.arange(n)
    common = np.full(n, 8 * n_words, dtype=np.int64)
    if n:
        common[0] = 0
    group = np.zeros(n, dtype=np.int64)
    active = np.arange(n) if n > 1 else np.zeros(0, np.int64)
    for level in range(n_words):
        if not len(active):
            break
        key = words[order[active], level]
        by = np.lexsort((key, group[active]))
        order[active] = order[active[by]]
        key, own = key[by], group[active]
        same_group = own[1:] == own[:-1]
        parted = same_group & (key[1:] != key[:-1])
        differ = key[1:][parted] ^ key[:-1][parted]
        leading = sum((differ < (np.uint64(1) << np.uint64(8 * j))).astype(np.int64) for j in range(1, 8))
        common[active[1:][parted]] = 8 * level + leading
        starts = np.ones(len(active), dtype=bool)
        starts[1:] = ~same_group | parted
        at = np.flatnonzero(starts)
        sizes = np.diff(np.append(at, len(active)))
        group[active] = active[at].repeat(sizes)
        active = active[(sizes > 1).repeat(sizes)]
    return order, common


def _word_rows(strings: list[bytes], width: int) -> np.ndarray:
    whole = -(-width // 8) * 8
    joined = b"".join(s.ljust(whole, b"\0") for s in strings)
    return np.frombuffer(joined, dtype=">u8").reshape(len(strings), whole // 8).astype(np.uint64)


def compare_windows(contexts: list[bytes], away: np.ndarray, n: np.ndarray, length: int, gram: int):
    """Which windows stand in another context too, by context and place before its anchor.

    A window is a left part that ends and a right part that begins at the anchor.
    Strings sorted by either part and cut where neighbours share less than its
    length number the equal ones; windows with both numbers equal are equal.
    Returns matrices: windows found again; numbers of equal windows (-1: no window);
    and windows whose right, or left, part is that of the first or last string in
    order, so that a bucket before or after may hold them as well.
    """
    size = len(contexts)
    right = [c[a:] for c, a in zip(contexts, away.tolist(), strict=True)]
    left = [c[:a][::-1] for c, a in zip(contexts, away.tolist(), strict=True)]
    right_order, right_common = multikey_sort(_word_rows(right, length))
    left_order, left_common = multikey_sort(_word_rows(left, max(8, length - gram)))

    def numbers(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
        out = np.empty(size, dtype=np.int64)
        out[order] = np.cumsum(common < depth)
        return out

    found, right_end, left_end = (np.zeros((size, length - gram + 1), dtype=bool) for _ in range(3))
    number = np.full((size, length - gram + 1), -1, dtype=np.int32)
    for before in range(length - gram + 1):
        has = np.flatnonzero((before <= away) & (before > away - n))
        if not len(has):
            continue
        r = numbers(right_order, right_common, length - before)
        f = numbers(left_order, left_common, before)
        _, place, times = np.unique(r[has] * (size + 1) + f[has], return_inverse=True, return_counts=True)
        found[has, before] = times[place] > 1
        number[has, before] = place
        right_end[has, before] = (r[has] == r.min()) | (r[has] == r.max())
        left_end[has, before] = (f[has] == f.min()) | (f[has] == f.max())
    return found, number, right_end, left_end


_CONTEXT = [("doc", pa.int64()), ("tag", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("away", pa.int64()), ("single", pa.bool_()), ("bytes", pa.binary())]
_CONTEXT_DDL = "doc long, tag binary, first long, n long, away long, single boolean, bytes binary"
_FOUND = pa.schema([*_CONTEXT, ("a", pa.int64()), ("b", pa.int64()), ("open", pa.binary()), ("known", pa.binary()), ("h", pa.binary())])
_FOUND_DDL = f"{_CONTEXT_DDL}, a long, b long, open binary, known binary, h binary"


class _Bucket:
    """The contexts of one bucket and what comparing them shows."""

    def __init__(self, batches: Iterator[pa.RecordBatch], length: int, gram: int):
        held = [b for b in batches if b.num_rows]
        self.rows = pa.Table.from_batches(held) if held else None
        if self.rows is None:
            return
        self.doc, self.first, self.n, self.away = (self.rows.column(c).to_numpy() for c in ("doc", "first", "n", "away"))
        self.tag = self.rows.column("tag").to_pylist()
        self.single = self.rows.column("single").to_numpy(zero_copy_only=False)
        self.contexts = self.rows.column("bytes").to_pylist()
        self.length, self.width = length, length - gram + 1
        self.found, self.number, self.right_end, self.left_end = compare_windows(self.contexts, self.away, self.n, length, gram)

    def masks(self, name: str) -> np.ndarray:
        raw = np.frombuffer(b"".join(self.rows.column(name).to_pylist()), dtype=np.uint8)
        return np.unpackbits(raw.reshape(len(self.doc), -1), axis=1)[:, : self.width].astype(bool)

    def spans(self, windows: np.ndarray) -> list[dict]:
        out = []
        for i in np.flatnonzero(self.single & windows.any(axis=1)).tolist():
            start = np.sort(self.first[i] + self.away[i] - np.flatnonzero(windows[i]))
            for a, b in _merged(np.stack([start, start + self.length], axis=1)).tolist():
                out.append({"doc": int(self.doc[i]), "tag": self.tag[i], "a": a, "b": b})
        return out


def _found(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 5000):
        part = rows[at : at + 5000]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in part], f.type) for f in _FOUND], schema=_FOUND)


def _sort_buckets(contested: DataFrame, length: int, gram: int) -> DataFrame:
    """Repeated spans of single contexts, found in buckets of suffixes in order.

    Contexts with windows whose right part reaches an end of their bucket come
    back as well, with these windows ``open`` and those known to repeat.
    """

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Bucket(batches, length, gram)
        if bucket.rows is None:
            return
        out = bucket.spans(bucket.found)
        known = bucket.found | ((bucket.number >= 0) & ~bucket.single[:, None])
        for i in np.flatnonzero(bucket.right_end.any(axis=1)).tolist():
            row = {n: bucket.rows.column(n)[i].as_py() for n, _ in _CONTEXT}
            out.append(row | {"open": np.packbits(bucket.right_end[i]).tobytes(), "known": np.packbits(known[i]).tobytes()})
        yield from _found(out)

    return contested.repartitionByRange(*_by_right(), "doc", "first").mapInArrow(sort, _FOUND_DDL)


def _across_boundaries(opened: DataFrame, length: int, gram: int) -> DataFrame:
    """Open windows compared across buckets: spans, and with ``h`` windows still to compare.

    The contexts are dealt out again, now by the bytes before their anchors. Windows
    that meet here are settled, and so are those whose left part reaches no end of
    its bucket; only windows that reach an end in both orders are left.
    """

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Bucket(batches, length, gram)
        if bucket.rows is None:
            return
        wanted, known = bucket.masks("open"), bucket.masks("known")
        out = bucket.spans(wanted & bucket.found & ~known)
        known |= bucket.found
        # Equal windows of a bucket are all known by now; one of them stands for them.
        told: set[tuple[int, int]] = set()
        for i, before in zip(*(x.tolist() for x in np.nonzero(wanted & bucket.left_end)), strict=True):
            window = (before, int(bucket.number[i, before]))
            if window in told:
                continue
            told.add(window)
            at = int(bucket.away[i]) - before
            start = int(bucket.first[i]) + at
            digest = hashlib.blake2b(bucket.contexts[i][at : at + length], digest_size=16).digest()
            doc = None if known[i, before] else int(bucket.doc[i])
            out.append({"doc": doc, "tag": bucket.tag[i], "a": start, "b": start + length, "h": digest})
        yield from _found(out)

    left, right = _by_right()[::-1]
    return opened.repartitionByRange(left, right, "doc", "first").mapInArrow(sort, _FOUND_DDL)


def _by_right() -> list:
    """Order by the bytes from the anchor on, then by those before it, backwards."""
    return [F.expr("substring(bytes, away + 1)"), F.reverse(F.hex(F.expr("substring(bytes, 1, away)")))]


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM
) -> DataFrame:
    """Per row ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere
    else, in the same document or another; overlaps count and all strings are judged on
    the input. A null text is empty; a null id is kept as null. Rows that repeat are
    each other's copies. ``gram`` and ``length - gram`` must be below 256.
    """
    if not 0 < gram <= length or length - gram > 250:
        raise ValueError("the gram must fit the length, and be at most 250 shorter")
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID))
    narrow = docs.select(key.alias("doc"), F.col(text).alias("text"))
    runs = find_runs(narrow, length, gram)
    # Stored, so that the join has both sides to itself and can split a hot gram.
    common = materialize(runs.groupBy("gram").agg(F.count("*").alias("k")).filter("k > 1").select("gram"))
    hits = materialize(runs.join(common, "gram"))
    contexts = materialize(
        hits.groupBy("gram", "context").agg(F.count("*").alias("k"), F.min(F.struct("doc", "tag", "place")).alias("one"))
    )
    several = materialize(contexts.groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1").select("gram"))
    contested = contexts.join(several, "gram").select(
        "one.doc", F.col("one.tag").alias("tag"), F.col("one.place").alias("place"), (F.col("k") == 1).alias("single")
    )
    repeated = hits.join(contexts.filter("k > 1").select("gram", "context"), ["gram", "context"]).select("doc", "tag", "place")
    both = repeated.select("doc", "tag", "place", F.lit(None).cast("boolean").alias("single")).unionByName(
        contested.select("doc", "tag", "place", "single")
    )
    # Rows of one id and one text have one name and the same places, which are listed once.
    lists = both.groupBy("doc", "tag").agg(
        F.collect_set(F.when(F.col("single").isNull(), F.col("place"))).alias("repeated"),
        F.collect_set(F.when(F.col("single").isNotNull(), F.struct("place", "single"))).alias("contested"),
    )
    state = materialize(_look_up(narrow, lists, length))
    decided = state.filter("kept_sha256 is not null").select("doc", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    waiting = state.filter("packed is not null").select("doc", "tag", "packed", "known")
    sorted_out = materialize(
        _sort_buckets(
            state.filter("bytes is not null").select("doc", "tag", "first", "n", "away", "single", "bytes"), length, gram
        )
    )
    again = materialize(_across_boundaries(sorted_out.filter("open is not null"), length, gram))
    edge = again.filter("h is not null")
    across = edge.join(edge.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h"), "h").filter("doc is not null")
    parts = [sorted_out.filter("a is not null"), again.filter("h is null"), across]
    spans = reduce(DataFrame.unionByName, [p.select("doc", "tag", "a", "b") for p in parts])
    per_doc = spans.groupBy("doc", "tag").agg(F.flatten(F.collect_set(F.array("a", "b"))).alias("more"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc, packed, known, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = np.array((known or []) + (more or []), dtype=np.int64).reshape(-1, 2)
                rows.append((doc, *_result(expand.decompress(packed), _merged(spans))))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in zip(*rows, strict=True)], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                )

    late = (
        waiting.join(per_doc.hint("shuffle_hash"), ["doc", "tag"], "left")
        .select("doc", "packed", "known", "more")
        .mapInArrow(finish, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )
    return decided.unionByName(late).select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )
