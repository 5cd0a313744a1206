"""Token ids in seekable files of independent zstandard frames.

File: data frames (little-endian ids of whole documents), one index frame
(document ids, frame numbers, offsets, lengths), then the seek table of the public
zstandard seekable format: a skippable frame with the compressed size, content size
and checksum (low 32 bits of xxh64 of the content) of every frame before it.
A reader fetches the last bytes, the index, and only the frames it needs.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revuelens.llm.common import lean
from revuelens.session import materialize, work_dir

# Magic numbers of the seekable format.
SKIPPABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_BYTES = 1 << 19
# Bytes of remembered words, of each kind, in a task, and of those that a worker process keeps for the next.
CACHED_BYTES, KEPT_BYTES = 128 << 20, 64 << 20
WORD_BYTES = 150  # of a remembered word beside its letters and ids
RUN_WORDS = 4000
# How a byte-level vocabulary writes a blank and a newline.
BLANK, NEWLINE = "\u0120", "\u010a"
ROWS_AT_ONCE = 256
NO_ID = np.iinfo(np.int64).min


class WordEncoder:
    """Byte-level BPE ids of whole texts, encoded by the tokenizers library.

    A text whose white space is single blanks and newlines between other characters
    is cut there, since such a cut is always one between pre-tokens; each distinct
    piece is encoded once and remembered. Any other text is encoded in one go.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.inner: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.held = {id(self.inner): 0, id(self.first): 0}
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        vocabulary = self.tokenizer.get_vocab()
        self.blank_first = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.blank_first[[i for t, i in vocabulary.items() if t.startswith(BLANK)]] = True
        self.newline = vocabulary[NEWLINE]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.dtype) for x in found]

    def _learn(self, known: dict[str, bytes], words: set[str], lead: str) -> list[str]:
        """Encode new words in runs; a run's ids fall apart where the lead stands.

        With a blank, an id whose token begins with one begins a word; without, words
        are parted by newlines and their one id.
        """
        new = list(words.difference(known))
        for at in range(0, len(new), RUN_WORDS):
            run = new[at : at + RUN_WORDS]
            ids = self._encode([lead + " ".join(run) if lead else "\n".join(run)])[0]
            marks = np.flatnonzero(self.blank_first[ids] if lead else ids == self.newline)
            bounds = np.append(marks if lead else np.append(-1, marks), len(ids))
            if len(bounds) != len(run) + 1:
                raise AssertionError("a cut between words is no cut between tokens")
            raw, step = ids.tobytes(), 0 if lead else 1
            at_byte = (bounds * self.width).tolist()
            skip = step * self.width
            for w, x, y in zip(run, at_byte[:-1], at_byte[1:], strict=True):
                known[w] = raw[x + skip : y]
        size = WORD_BYTES * len(new) + 2 * sum(map(len, new)) + sum(map(len, map(known.__getitem__, new)))
        if self.held[id(known)] + size > CACHED_BYTES:
            return new
        self.held[id(known)] += size
        return []

    def forget(self) -> None:
        """Keep the words met first, which are the frequent ones, up to about ``KEPT_BYTES`` of each kind."""
        for known in (self.inner, self.first):
            held = self.held[id(known)]
            if held > KEPT_BYTES:
                kept = dict(islice(known.items(), len(known) * KEPT_BYTES // held))
                known.clear()
                known.update(kept)
                self.held[id(known)] = KEPT_BYTES

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes of the encoder's width."""
        cut: list[list[list[str]] | None] = []
        inner: set[str] = set()
        first: set[str] = set()
        for t in texts:
            if not t or t.replace("\n", " ").split(" ") != t.split():
                cut.append(None)
                continue
            lines = [line.split(" ") for line in t.split("\n")]
            for words in lines:
                first.add(words[0])
                inner.update(words[1:])
            cut.append(lines)
        # A full cache keeps what it has; words beyond it are forgotten with their texts.
        passing = [(self.inner, self._learn(self.inner, inner, " ")), (self.first, self._learn(self.first, first, ""))]
        whole = iter(self._encode([t for t, lines in zip(texts, cut, strict=True) if lines is None]))
        out, get = [], self.inner.__getitem__
        newline = np.array([self.newline], dtype=self.dtype).tobytes()
        for lines in cut:
            if lines is None:
                out.append(next(whole).tobytes())
            else:
                out.append(newline.join(self.first[ws[0]] + b"".join(map(get, ws[1:])) for ws in lines))
        for known, new in passing:
            for w in new:
                del known[w]
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process; what it remembers between tasks is bounded."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class FrameWriter:
    """Writes one file; holds one frame and the index, never the whole file."""

    def __init__(self, sink, width: int, frame_bytes: int = FRAME_BYTES):
        self.sink, self.width, self.frame_bytes = sink, width, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.buffer = bytearray()
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []
        self.n_tokens = 0

    def _frame(self, content: bytes) -> None:
        packed = self.compressor.compress(content)
        self.sink.write(packed)
        self.frames.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.buffer and len(self.buffer) + len(ids) > self.frame_bytes:
            self._frame(bytes(self.buffer))
            self.buffer.clear()
        n = len(ids) // self.width
        key = NO_ID if doc_id is None else doc_id
        self.index.append((key, len(self.frames), len(self.buffer) // self.width, n))
        self.buffer += ids
        self.n_tokens += n

    def close(self) -> None:
        if self.buffer:
            self._frame(bytes(self.buffer))
        head = struct.pack("<IQ", self.width, len(self.index))
        self._frame(head + np.array(self.index, dtype="<i8").reshape(-1, 4).T.tobytes())
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), WITH_CHECKSUMS, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)


class FrameReader:
    """Random access to a file; frames are fetched and checked one by one."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & WITH_CHECKSUMS:
            raise ValueError("not a seekable token file")
        table = self._at(size - 9 - 12 * n, 12 * n)
        self.frames = np.frombuffer(table, dtype="<u4").reshape(-1, 3)
        ends = np.cumsum(self.frames[:, 0], dtype=np.int64)
        self.starts = ends - self.frames[:, 0]
        raw = self.frame(n - 1)
        self.width, count = struct.unpack_from("<IQ", raw)
        self.dtype = np.dtype(f"<u{self.width}")
        self.doc_ids, self.frame_of, self.offsets, self.lengths = np.frombuffer(
            raw, dtype="<i8", offset=12, count=4 * count
        ).reshape(4, -1)

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        packed, size, checksum = (int(x) for x in self.frames[k])
        content = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), packed), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return content

    def rows(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(document id, ids) of the wanted row numbers, or all; each frame is read once."""
        chosen = range(len(self.doc_ids)) if wanted is None else sorted(wanted)
        held, content = -1, b""
        for i in chosen:
            if self.frame_of[i] != held and self.lengths[i]:
                held, content = int(self.frame_of[i]), self.frame(int(self.frame_of[i]))
            at, n = int(self.offsets[i]) * self.width, int(self.lengths[i])
            key = int(self.doc_ids[i])
            yield None if key == NO_ID else key, np.frombuffer(content, dtype=self.dtype, offset=at if n else 0, count=n)

    def find(self, doc_ids: Iterable[int]) -> Iterator[tuple[int | None, np.ndarray]]:
        """The documents with these ids, decompressing only their frames."""
        return self.rows(np.flatnonzero(np.isin(self.doc_ids, np.fromiter(doc_ids, dtype=np.int64))).tolist())


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    id_column: str = "doc_id",
    text: str = "text",
    frame_bytes: int = FRAME_BYTES,
) -> DataFrame:
    """Encode whole texts and write them in ascending id order; returns the files.

    Rows are dealt out by ranges of (id, hash of the text), so a repeated id is split
    as well, and each task streams its range into one file. Result: ``part``,
    ``path``, ``n_docs``, ``n_tokens``. A null text is empty; a null id comes first.
    A file is written under a name of its own attempt, and only files of tasks that
    succeeded are listed, so a repeated task does no harm.
    """
    run_folder = f"{folder.rstrip('/')}/tokens-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        end = np.array([end_id], dtype=bpe.dtype).tobytes()
        task = TaskContext.get()
        part = task.partitionId()
        files, place = pafs.FileSystem.from_uri(run_folder)
        files.create_dir(place, recursive=True)
        name = f"part-{part:06d}-{task.taskAttemptId()}.tok"
        writer, sink = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                piece = batch.slice(at, ROWS_AT_ONCE)
                if writer is None:
                    sink = files.open_output_stream(f"{place}/{name}")
                    writer = FrameWriter(sink, bpe.width, frame_bytes)
                ids = piece.column(0).to_pylist()
                texts = [t or "" for t in piece.column(1).to_pylist()]
                for doc_id, encoded in zip(ids, bpe.encode(texts), strict=True):
                    writer.add(doc_id, encoded + end)
        bpe.forget()
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict(
                {
                    "part": [part],
                    "path": [f"{run_folder}/{name}"],
                    "n_docs": [len(writer.index)],
                    "n_tokens": [writer.n_tokens],
                },
                schema=pa.schema(
                    [("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]
                ),
            )

    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    ordered = narrow.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    return materialize(ordered.mapInArrow(lean(write), "part int, path string, n_docs long, n_tokens long"))


def read_tokens(files: DataFrame) -> DataFrame:
    """Every document of the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    ``start`` counts the ids of all documents before it. Files are few (one per
    task of the writer), so their running total is one small window.
    """
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    placed = files.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = pafs.FileSystem.from_uri(path)
                with store.open_input_file(place) as source:
                    rows = []
                    for doc_id, ids in FrameReader(source).rows():
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    spread = placed.repartition(max(1, files.count()))
    return spread.mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0, **options) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    return read_tokens(write_tokens(docs, work_dir(spark), tokenizer, end_id, **options))
