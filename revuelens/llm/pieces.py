"""SentencePiece ids of whole texts and back, by tables of distinct marked words.

No piece of the vocabulary crosses a whitespace marker, and none holds a newline with
anything else, so a text falls into chunks that are segmented on their own: a run of
markers, or a newline, with what follows. Each run of rows makes a table of its distinct
chunks; the library segments every chunk of the table once, and ids are joined back by the
chunks' positions. Decoding cuts ids before pieces that begin with a marker, and before newlines, and does the same.
The library works on runs of chunks, a newline before each, which falls out as an id of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revuelens.llm.common import lean, text_slices

MARKER = "▁"
TABLE_BYTES = 2 << 20  # of text that one table serves
PART = 1 << 20  # code points of a long text that are cut at a time
RUN = 4000  # chunks that the library works on at a time
_CHUNK = re.compile(r"\n[^ \n]*| +[^ \n]*")
_CHUNK_START = re.compile(r"(?<! ) |\n")


def _parts(text: str) -> Iterator[str]:
    """A long text in pieces that begin where a chunk does."""
    start = 0
    while len(text) - start > PART:
        found = _CHUNK_START.search(text, start + PART)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def _gather(values: np.ndarray, bounds: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The entries ``codes`` of a flat table, one after the other."""
    sizes = (bounds[1:] - bounds[:-1])[codes]
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(bounds[codes] - (ends - sizes), sizes)]


def _joined(
    ids: np.ndarray, bounds: np.ndarray, codes: np.ndarray, edges: np.ndarray, end_id: int | None
) -> tuple[np.ndarray, np.ndarray]:
    """Ids joined back by the places of their chunks, an end after each text where given; and the texts' bounds."""
    joined = _gather(ids, bounds, codes)
    ends = np.append(0, np.cumsum((bounds[1:] - bounds[:-1])[codes]))[edges]
    if end_id is not None:
        joined = np.insert(joined, ends[1:], end_id)
        ends = ends + np.arange(len(ends))
    return joined, ends


class Pieces:
    """A vocabulary whose pieces keep to the chunks; any other is refused."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARKER in p.lstrip(MARKER) or ("\n" in p and p != "\n") for p in pieces):
            raise ValueError("pieces cross whitespace markers or newlines")
        self.newline = self.model.encode("\n")[-1]
        if self.model.decode([self.newline]) != "\n":
            raise ValueError("the vocabulary has no id for a newline")
        self.begins = np.array([p.startswith(MARKER) for p in pieces])

    def segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, end to end, and each chunk's bounds."""
        flat, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for at in range(0, len(chunks), RUN):
            run = chunks[at : at + RUN]
            fenced = np.array([c[0] != "\n" for c in run])
            # The first id is the marker that the library puts in front.
            text = "".join([f"\n{c}" if f else c for c, f in zip(run, fenced.tolist(), strict=True)])
            ids = np.array(self.model.encode(text), dtype=np.int32)[1:]
            starts = np.flatnonzero(ids == self.newline)
            if len(starts) != len(run):
                raise AssertionError("a newline is part of a piece")
            flat.append(np.delete(ids, starts[fenced]))
            sizes.append(np.diff(np.append(starts, len(ids))) - fenced)
        return np.concatenate(flat), np.cumsum(np.concatenate(sizes))

    def texts_of(self, chunks: list[bytes]) -> list[str]:
        """The text of each chunk of ids."""
        out: list[str] = []
        fence = np.int32(self.newline).tobytes()
        for at in range(0, len(chunks), RUN):
            run = chunks[at : at + RUN]
            raw = b"".join([c if c.startswith(fence) else fence + c for c in run])
            texts = self.model.decode(np.frombuffer(raw, np.int32).tolist()).split("\n")[1:]
            out += [f"\n{t}" if c.startswith(fence) else t for c, t in zip(run, texts, strict=True)]
        return out

    def cut(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The table of distinct chunks, the place in it of every chunk, and each text's bounds in those."""
        table: dict[str, int] = {}
        codes = [np.zeros(0, np.int32)]
        counts = np.zeros(len(texts) + 1, dtype=np.int64)
        for row, text in enumerate(texts):
            if not text:
                continue
            for part in _parts(" " + text.replace(MARKER, " ")):
                words = _CHUNK.findall(part)
                for w in set(words).difference(table):
                    table[w] = len(table)
                codes.append(np.fromiter(map(table.__getitem__, words), np.int32, len(words)))
                counts[row + 1] += len(words)
        return list(table), np.concatenate(codes), np.cumsum(counts)

    def encode(self, texts: list[str | None], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and each text's bounds, by one table of chunks."""
        table, codes, edges = self.cut(texts)
        return _joined(*self.segment(table), codes, edges, end_id)

    def round_trip(self, texts: list[str | None], end_id: int | None) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """``encode``, and the texts that the ids stand for: each chunk's ids are decoded once."""
        table, codes, edges = self.cut(texts)
        ids, bounds = self.segment(table)
        raw, spots = ids.tobytes(), (bounds * ids.itemsize).tolist()
        known = self.texts_of([raw[a:b] for a, b in zip(spots[:-1], spots[1:], strict=True)])
        parts, at = list(map(known.__getitem__, codes.tolist())), edges.tolist()
        # The first chunk has the marker that is put in front of a text.
        decoded = ["".join(parts[a:b])[1:] for a, b in zip(at[:-1], at[1:], strict=True)]
        return *_joined(ids, bounds, codes, edges, end_id), decoded

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of rows of ids, by one table of chunks of ids."""
        starts = self.begins[ids] | (ids == self.newline)
        starts[bounds[:-1][bounds[:-1] < len(ids)]] = True
        cuts = np.flatnonzero(starts)
        raw, edges = ids.tobytes(), np.append(cuts, len(ids)) * ids.itemsize
        spots = edges.tolist()
        chunks = [raw[a:b] for a, b in zip(spots[:-1], spots[1:], strict=True)]
        distinct = list(set(chunks))
        known = dict(zip(distinct, self.texts_of(distinct), strict=True))
        parts = list(map(known.__getitem__, chunks))
        out, row_at = [], np.searchsorted(cuts, bounds).tolist()
        for a, b, first in zip(row_at[:-1], row_at[1:], bounds[:-1].tolist(), strict=True):
            text = "".join(parts[a:b])
            # The marker that encoding put in front is no part of the text.
            out.append(text[1:] if b > a and self.begins[ids[first]] else text)
        return out


def encode_texts(
    docs: DataFrame, model: str, end_id: int | None = None, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id_column`` and ``ids`` of each row's whole text, ``end_id`` at the end where given.

    Null and empty texts have no ids but the end. Only the two named columns are read; rows
    keep their place and move nowhere, so repeated ids stay apart. A task holds one
    table of at most ``TABLE_BYTES`` of text, or of one longer text, at a time and keeps nothing.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            for start, stop in text_slices(batch, limit=TABLE_BYTES):
                rows = batch.slice(start, stop - start)
                ids, bounds = pieces.encode(rows.column(1).to_pylist(), end_id)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column(0), lists], [id_column, "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(lean(encode), f"`{id_column}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """All columns of ``encoded`` and ``decoded``, the text of each row's ids (null: empty).

    For ids that the model's encoding gives, with control ids at the end.
    """
    names = [*encoded.columns, "decoded"]
    place = encoded.columns.index(ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            sizes = np.append(0, np.cumsum(batch.column(place).value_lengths().fill_null(0).to_numpy()))
            start = 0
            while start < batch.num_rows:
                limit = sizes[start] + TABLE_BYTES // 2
                stop = max(start + 1, int(np.searchsorted(sizes, limit, side="right")) - 1)
                rows = batch.slice(start, stop - start)
                flat = rows.column(place).flatten().cast(pa.int32()).to_numpy()
                texts = pieces.decode(flat, (sizes[start : stop + 1] - sizes[start]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names)
                start = stop

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(lean(decode), f"{kinds}, decoded string")


def encode_and_decode(
    docs: DataFrame, model: str, end_id: int | None, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id_column``, ``ids`` with the end, and ``decoded``, the text of those ids, from one table of chunks.

    The rows of ``decode_ids`` over ``encode_texts``, worked out in one pass.
    """

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            for start, stop in text_slices(batch, limit=TABLE_BYTES):
                rows = batch.slice(start, stop - start)
                ids, bounds, decoded = pieces.round_trip(rows.column(1).to_pylist(), end_id)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                columns = [rows.column(0), lists, pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [id_column, "ids", "decoded"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(lean(both), f"`{id_column}` {kind}, ids array<int>, decoded string")


def id_line(ids: str = "ids") -> Column:
    """Decimal ids with single blanks between them."""
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), " ")
