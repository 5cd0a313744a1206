"""Review lines as a Spark data source: byte ranges, fields counted on raw bytes, early stop.

A file is read in ranges that begin and end at line ends; the tabs of a whole block are found
at once, and only wanted fields are copied out, so no row passes through a Python loop
unless one of its fields is quoted. Rules are those of the tab-separated reader of pandas:
lines end with ``\\n``, ``\\r\\n`` or ``\\r``, blank lines are passed over, a quote opens a field only
at its start, short lines are padded, and the texts in ``MISSING`` are null.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Texts that stand for no value.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
BLOCK = 4 << 20
TAB, NEWLINE, QUOTE = 9, 10, 34
_NUMBER = r"^\s*[+-]?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?\s*$"


class LineRange(NamedTuple):
    """Lines of a file that begin in ``start`` to ``stop``; ``stop`` is null up to the end."""

    path: str
    names: list[str]
    start: int
    stop: int | None


class Ranges(InputPartition):
    """What one task reads: a range of a large file, or several small files."""

    def __init__(self, ranges: list[LineRange]):
        super().__init__(None)
        self.ranges = ranges


def _parsed(line: bytes) -> list[bytes]:
    """Fields of a line with quotes; one that is not closed ends with the line."""
    return [f.encode() for f in next(csv.reader([line.decode("utf-8", "replace")], delimiter="\t"), [""])]


def split_fields(block: bytes, wanted: Sequence[int | None], n_names: int, drop_long: bool) -> tuple[list[pa.Array], int]:
    """The wanted fields (by place, null: absent) of all lines of a block that ends with a line end."""
    data = np.frombuffer(block, dtype=np.uint8)
    ends = np.flatnonzero((data == TAB) | (data == NEWLINE))
    last = np.flatnonzero(data[ends] == NEWLINE)
    first = np.append(0, last[:-1] + 1)
    counts = last - first + 1
    starts = np.append(0, ends[:-1] + 1)
    opens = np.zeros(len(ends), dtype=bool)
    filled = starts < ends
    opens[filled] = data[starts[filled]] == QUOTE
    quoted = np.add.reduceat(opens, first) > 0 if len(first) else np.zeros(0, dtype=bool)
    # Blank lines: one field of nothing but blanks.
    lone = np.flatnonzero(counts == 1)
    blank = np.zeros(len(counts), dtype=bool)
    blank[lone] = [not block[a:b].strip(b" \t") for a, b in zip(starts[first[lone]].tolist(), ends[first[lone]].tolist(), strict=True)]
    special = {i: _parsed(block[starts[first[i]] : ends[last[i]]]) for i in np.flatnonzero(quoted).tolist()}
    counts[list(special)] = [len(f) for f in special.values()]
    kept = ~blank & (counts <= n_names) if drop_long else ~blank
    rows = np.flatnonzero(kept)
    # All fields as one array over the block itself; each value still holds its separator.
    offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
    fields = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(block)])
    out = []
    parsed = [i for i in special if kept[i]]
    at_parsed = np.searchsorted(rows, parsed)
    for place in wanted:
        if place is None:
            out.append(pa.nulls(len(rows), pa.large_binary()))
            continue
        plain = pc.binary_slice(fields.take(pa.array(first[rows] + place, mask=counts[rows] <= place)), 0, -1)
        if parsed:
            instead = [special[i][place] if len(special[i]) > place else None for i in parsed]
            mask = np.zeros(len(rows), dtype=bool)
            mask[at_parsed] = True
            plain = pc.replace_with_mask(plain, pa.array(mask), pa.array(instead, pa.large_binary()))
        out.append(plain)
    return out, len(rows)


def typed(values: pa.Array, kind: pa.DataType, missing: pa.Array) -> pa.Array:
    """Texts as strings or numbers; a word in a number column, or a fraction in a whole one, is null."""
    try:
        text = values.cast(pa.large_string())
    except pa.ArrowInvalid:
        text = pa.array([v and v.decode("utf-8", "replace") for v in values.to_pylist()], pa.large_string())
    text = pc.if_else(pc.is_in(text, missing), pa.scalar(None, pa.large_string()), text)
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return text.cast(kind)
    number = pc.if_else(pc.match_substring_regex(text, _NUMBER), pc.ascii_trim_whitespace(text), None)
    number = pc.if_else(pc.starts_with(number, "+"), pc.utf8_slice_codeunits(number, 1, None), number).cast(pa.float64())
    if pa.types.is_floating(kind):
        return number.cast(kind)
    most = float(2 ** (kind.bit_width - 1) - 1)
    whole = pc.and_(pc.equal(pc.floor(number), number), pc.less_equal(pc.abs(number), most))
    return pc.if_else(whole, number, None).cast(kind)


class LineReader(DataSourceReader):
    """Reads byte ranges of files whose headers are known; all settings come as one JSON option."""

    def __init__(self, schema: StructType, settings: dict):
        self.settings = settings
        self.columns = [f.name for f in schema.fields]
        self.schema = to_arrow_schema(schema)

    def partitions(self) -> Sequence[Ranges]:
        """Ranges of equal size, small files together; a file that is compressed, capped or of many-line fields is one."""
        s, out, held, filled = self.settings, [], [], 0
        for path, size, names in s["files"]:
            whole = s["max_rows"] is not None or s["multi_line"] or _codec(path)
            step = max(1, size if whole else min(size, s["range_bytes"]))
            for start in range(0, max(size, 1), step):
                if held and filled + step > s["range_bytes"]:
                    out.append(Ranges(held))
                    held, filled = [], 0
                held.append(LineRange(path, names, start, None if whole else min(start + step, size)))
                # Opening a file costs about as much as reading some more of it.
                filled += step + (s["range_bytes"] >> 5)
        return [*out, Ranges(held)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for part in partition.ranges:
            yield from self._read(part)

    def _read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        s = self.settings
        missing = pa.array(s["missing"], pa.large_string())
        place = {n: i for i, n in reversed(list(enumerate(partition.names)))}
        wanted = [place.get(c) for c in self.columns]
        left = s["max_rows"]
        for columns, n in self._columns(partition, wanted):
            if left is not None:
                columns, n = [c.slice(0, left) for c in columns], min(n, left)
                left -= n
            if n:
                arrays = [typed(c, f.type, missing) for c, f in zip(columns, self.schema, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)
            if left == 0:
                return

    def _columns(self, partition: LineRange, wanted: list[int | None]) -> Iterator[tuple[list[pa.Array], int]]:
        s = self.settings
        if s["multi_line"]:
            yield from _multi_line(partition, wanted, s["drop_long"])
            return
        skip = partition.start == 0
        for block in line_blocks(partition, s["max_rows"]):
            if skip:
                # The header is the first line of the file.
                block, skip = block[block.index(b"\n") + 1 :], False
            if block:
                yield split_fields(block, wanted, len(partition.names), s["drop_long"])


def _codec(path: str) -> str | None:
    return "gzip" if path.endswith(".gz") else "bz2" if path.endswith(".bz2") else None


def _open(path: str):
    files, place = pafs.FileSystem.from_uri(path)
    codec = _codec(path)
    return files.open_input_stream(place, compression=codec) if codec else files.open_input_file(place)


def line_blocks(partition: LineRange, max_rows: int | None = None) -> Iterator[bytes]:
    """Whole lines that begin in the range, in blocks; a capped read begins with small ones."""
    size = min(BLOCK, 1 << 16) if max_rows is not None else BLOCK
    with _open(partition.path) as source:
        at, held = partition.start, b""
        if at:
            # The line that runs into the range belongs to the one before.
            source.seek(at - 1)
            while True:
                raw = source.read(size)
                cut = raw.find(b"\n")
                if cut >= 0 or not raw:
                    break
                at += len(raw)
            if not raw or (partition.stop is not None and at + cut >= partition.stop):
                return
            held, at = raw[cut + 1 :], at - 1 + len(raw)
            start = at - len(held)
        else:
            start = 0
        while True:
            # ``held`` is what begins at ``start``; lines that begin at ``stop`` or later are another range's.
            ended = False
            if partition.stop is not None and start + len(held) >= partition.stop:
                end = held.find(b"\n", max(0, partition.stop - 1 - start))
                if end >= 0:
                    held, ended = held[: end + 1], True
            cut = held.rfind(b"\n") + 1
            if cut:
                yield held[:cut].replace(b"\r\n", b"\n").replace(b"\r", b"\n")
                start, held = start + cut, held[cut:]
            if ended:
                return
            raw = source.read(size)
            if not raw:
                if held:
                    yield held.replace(b"\r\n", b"\n").replace(b"\r", b"\n").rstrip(b"\n") + b"\n"
                return
            held += raw
            size = min(BLOCK, size * 2)


def _multi_line(partition: LineRange, wanted: list[int | None], drop_long: bool) -> Iterator[tuple[list[pa.Array], int]]:
    """A whole file whose quoted fields may hold line ends and tabs, one record at a time."""
    csv.field_size_limit(1 << 31)
    with _open(partition.path) as source:
        text = io.TextIOWrapper(source, encoding="utf-8", errors="replace", newline="")
        held: list[list[bytes | None]] = []
        records = csv.reader(text, delimiter="\t")
        next(records, None)
        n_bytes = 0
        for fields in records:
            if not fields or (len(fields) == 1 and not fields[0].strip(" \t")):
                continue
            if drop_long and len(fields) > len(partition.names):
                continue
            row = [fields[p].encode() if p is not None and p < len(fields) else None for p in wanted]
            held.append(row)
            n_bytes += sum(len(v) for v in row if v)
            if n_bytes > BLOCK or len(held) == 10_000:
                yield _turned(held, len(wanted)), len(held)
                held, n_bytes = [], 0
        if held:
            yield _turned(held, len(wanted)), len(held)


def _turned(rows: list[list[bytes | None]], width: int) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], pa.large_binary()) for i in range(width)]


class ReviewLines(DataSource):
    """``spark.read.format("review_lines")``; ``sources.reviews.scan_reviews`` fills its option."""

    @classmethod
    def name(cls) -> str:
        return "review_lines"

    def reader(self, schema: StructType) -> LineReader:
        return LineReader(schema, json.loads(self.options["settings"]))


def file_uri(path: str) -> str:
    """Hadoop writes ``file:/x``; both forms name the same file."""
    return re.sub(r"^file:/(?=[^/])", "file:///", path)
