"""Personal data: fixed patterns, and a linear-chain CRF over word shapes that adds spans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revuelens.llm.common import text_slices, utf8
from revuelens.llm.shingles import find_words

KINDS = ("email", "ip", "card", "phone")
MAX_EXAMPLES = 5000  # labelled rows that the model is fitted on at most, smallest texts' hashes first

# The base patterns. Possessive and look-behind forms only save retries.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every ``@`` in turn with the run before it, back to the last match."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by kind and start, in code points."""
    out: list[Span] = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return out


# ---- word shapes -----------------------------------------------------------------

_CLASSES = np.zeros((6, 256), dtype=np.uint8)
_CLASSES[0, [ord(c) for c in "0123456789"]] = 1
_CLASSES[1, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASSES[2, ord("@")] = 1
_CLASSES[3, ord(".")] = 1
_CLASSES[4, [ord(c) for c in "-()"]] = 1
_CLASSES[5, [ord(c) for c in "+"]] = 1
N_SHAPES = 5 * 3 * 2 * 4 * 2 * 2 * 4
N_TAGS = 1 + len(KINDS)


def word_shapes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Shape number of each word: how many digits, letters, dots; which marks."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    digits, letters, at, dots, marks, plus = (
        np.minimum(np.add.reduceat(c[data], starts, dtype=np.int32), 99) for c in _CLASSES
    )
    n_digits = np.searchsorted([0, 3, 7, 12], digits)  # 0, 1-3, 4-7, 8-12, more
    n_letters = np.searchsorted([0, 2], letters)
    n_dots = np.minimum(dots, 3)
    first = data[starts]
    opening = np.select([first == ord("+"), first == ord("("), first == ord("0")], [1, 2, 3], 0)
    shape = n_digits
    for value, base in ((n_letters, 3), (at > 0, 2), (n_dots, 4), (marks > 0, 2), (plus > 0, 2), (opening, 4)):
        shape = shape * base + value
    return shape.astype(np.int64)


def shape_features() -> np.ndarray:
    """One 0/1 row per shape: its parts one by one, and the shape as a whole by number of digits and dots."""
    numbers = np.arange(N_SHAPES)
    columns, rest, parts = [], numbers, []
    for base in (4, 2, 2, 4, 2, 3, 5):
        parts.append(rest % base)
        columns += [rest % base == v for v in range(base)]
        rest = rest // base
    digits, dots, letters = parts[6], parts[3], parts[5]
    columns += [(digits == d) & (dots == k) for d in range(5) for k in range(4)]
    columns += [(digits == d) & (letters == k) for d in range(5) for k in range(3)]
    return np.stack(columns, axis=1).astype(np.float64)


# ---- the chain -------------------------------------------------------------------


@dataclass
class Chain:
    """Scores of a word's, its left and its right neighbour's shape, and of tag changes.

    The last row of each table stands for the outside of a line.
    """

    own: np.ndarray
    left: np.ndarray
    right: np.ndarray
    change: np.ndarray

    def emissions(self, shapes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        before = np.where(first, N_SHAPES, np.roll(shapes, 1))
        after = np.where(last, N_SHAPES, np.roll(shapes, -1))
        return self.own[shapes] + self.left[before] + self.right[after]

    def decode(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best tags of every line, by Viterbi in batches.

        Where the outside tag leads by more than two changes can repay, it stands in
        every best path; lines are parted there, which leaves few words to decode.
        """
        tags = np.zeros(len(scores), dtype=np.int64)
        swing = float(self.change.max() - self.change.min())
        sure = scores[:, 0] - scores[:, 1:].max(axis=1) > 2 * swing if len(scores) else np.zeros(0, bool)
        at = np.flatnonzero(~sure)
        if not len(at):
            return tags
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (np.diff(at) > 1) | first[at[1:]]
        run = np.cumsum(fresh) - 1
        begin = np.flatnonzero(fresh)
        length = np.diff(np.append(begin, len(at)))
        # A run that follows or meets a sure word in its line changes from or to the outside tag.
        lead = ~first[at[begin]]
        stop = at[begin + length - 1] + 1
        trail = (stop < len(scores)) & ~np.append(first, True)[stop]
        order = np.argsort(length, kind="stable")
        for chunk in np.array_split(order, max(1, len(order) // 4096)):
            longest = int(length[chunk].max())
            n = len(chunk)
            score = np.where(lead[chunk, None], self.change[0], 0.0) + scores[at[begin[chunk]]]
            back = np.zeros((longest, n, N_TAGS), dtype=np.int8)
            ends = np.where(trail[chunk, None], self.change[:, 0], 0.0)
            final = np.zeros(n, dtype=np.int64)
            done = length[chunk] == 1
            final[done] = (score + ends)[done].argmax(axis=1)
            for t in range(1, longest):
                live = length[chunk] > t
                step = score[live][:, :, None] + self.change[None]
                back[t, live] = step.argmax(axis=1)
                score[live] = step.max(axis=1) + scores[at[begin[chunk][live] + t]]
                done = length[chunk] == t + 1
                final[done] = (score + ends)[done].argmax(axis=1)
            for t in range(longest - 1, -1, -1):
                live = length[chunk] > t
                tags[at[begin[chunk][live] + t]] = final[live]
                if t:
                    final[live] = back[t, live, final[live]]
        del run
        return tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit_chain(lines: list[tuple[np.ndarray, np.ndarray]], rounds: int = 400, l2: float = 0.02) -> Chain:
    """Maximum likelihood by gradient steps with momentum; lines are (shapes, tags)."""
    features = shape_features()
    n_features = features.shape[1]
    outside = np.zeros(n_features + 1)
    outside[-1] = 1
    table = np.vstack([np.hstack([features, np.zeros((N_SHAPES, 1))]), outside])
    longest, n = max(len(s) for s, _ in lines), len(lines)
    shapes = np.full((n, longest + 2), N_SHAPES)
    tags = np.zeros((n, longest), dtype=np.int64)
    live = np.zeros((n, longest))
    for i, (s, t) in enumerate(lines):
        shapes[i, 1 : len(s) + 1], tags[i, : len(s)], live[i, : len(s)] = s, t, 1
    x = np.concatenate([table[shapes[:, 1:-1]], table[shapes[:, :-2]], table[shapes[:, 2:]]], axis=2)
    y = np.eye(N_TAGS)[tags] * live[:, :, None]
    width = x.shape[2]
    weights, change = np.zeros((width, N_TAGS)), np.zeros((N_TAGS, N_TAGS))
    speed_w, speed_c = np.zeros_like(weights), np.zeros_like(change)
    pairs = np.einsum("ntk,ntl->kl", y[:, :-1], y[:, 1:])
    for _ in range(rounds):
        e = x @ weights
        alpha, beta = np.zeros((longest, n, N_TAGS)), np.zeros((longest, n, N_TAGS))
        alpha[0] = e[:, 0]
        for t in range(1, longest):
            step = _log_sum(alpha[t - 1][:, :, None] + change[None], 1) + e[:, t]
            alpha[t] = np.where(live[:, t, None] > 0, step, alpha[t - 1])
        for t in range(longest - 2, -1, -1):
            step = _log_sum(change[None] + (e[:, t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(live[:, t + 1, None] > 0, step, beta[t + 1])
        whole = _log_sum(alpha[-1], 1)
        p = np.exp(np.moveaxis(alpha + beta, 0, 1) - whole[:, None, None]) * live[:, :, None]
        grad_w = np.einsum("ntf,ntk->fk", x, y - p) / n - l2 * weights / 10
        expected = np.zeros_like(change)
        for t in range(1, longest):
            joint = alpha[t - 1][:, :, None] + change[None] + (e[:, t] + beta[t])[:, None, :] - whole[:, None, None]
            expected += (np.exp(joint) * live[:, t, None, None]).sum(axis=0)
        grad_c = (pairs - expected) / n - l2 * change
        speed_w = 0.9 * speed_w + 0.2 * grad_w
        speed_c = 0.9 * speed_c + 0.2 * grad_c
        weights += speed_w
        change += speed_c
    own, left, right = (table @ w for w in np.split(weights, 3))
    return Chain(own, left, right, change)


# Labelled lines: [kind|what it is]. Plain numbers, codes and dates are labelled by being left out.
EXAMPLES = """
Write to [email|anna.lee@example.org] before Monday
Contact [email|j_smith+news@mail.example.net] or call [phone|+44 20 7946 0958] today
You can reach me at [email|bob@example.co] after six
mail [email|info@example.com]
Questions go to [email|help.desk-2@support.example.info] please
Her phone is [phone|+1 (202) 555-0143] and the fax is broken
Call [phone|(202) 555-0187] for a table
Call us on [phone|020 7946 0321] between nine and five
Tel [phone|0161 496 0845] or visit
ring [phone|+49 30 901820] now
My number is [phone|202-555-0119] thanks
The office line [phone|+33 1 99 00 12 34] is busy
dial [phone|(415) 555-2671] again
reach him under [phone|+1-415-555-0132] any time
phone [phone|(028) 9018 0123]
The server at [ip|192.0.2.17] is down
ping [ip|198.51.100.240] twice
a login from [ip|203.0.113.5] was refused
Host [ip|10.0.0.1] and host [ip|10.0.0.254] answer
blocked [ip|172.16.254.1]
Card [card|4111 1111 1111 1111] was charged
pay with [card|5500000000000004] if you must
the card number [card|4012-8888-8888-1881] has expired
it says [card|371449635398431] on the front
charged to [card|6011 0009 9013 9424] again
The meeting is on 12.05.2021 in room 14
We sold 1200 units for 35.50 each
Version 2.10.3 came out in 2019
Chapter 7 has 45 pages and 12 figures
The total is 1,204,350 in the year 2020
See section 3.2.1 of the report
order 4483920 was sent on 2021-03-04
In 1998 there were 300 of them
the price rose by 4.5 per cent to 99.99
token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
key 24be64439e3e49cf46b2d7c90f3602a3
id 550e8400-e29b-41d4-a716-446655440000 was not found
serial AB12-9944-ZX and batch 20210307
It was the best of times, it was the worst of times.
She said that the house (the old one) was sold - at last.
well-known and half-baked ideas, all of them
Follow @someone or write @ the office
the sum of 12 and 30 is 42
WHY ARE WE SHOUTING!! ABOUT THIS!!
one | two | three | four
etc. and so on... and on
hello### world*** and&&& more%%% of$$$ this
elle est là, déjà vu, à côté du café
der Mann mit dem großen Hut, über die Straße
pages 12-15 and 18 - 20 of volume 3
call 911 or 112 in an emergency
1234567 people came, 89 left
the ratio was 3.14159265 or so
A+ and C++ are not grades +1
(see above) (or below) (1) (2) (3)
"""
_LABEL = re.compile(r"\[(email|ip|card|phone)\|([^\]]*)\]")


def read_example(line: str) -> tuple[str, list[Span]]:
    """Text and spans of a marked-up line."""
    out, spans, at = "", [], 0
    for m in _LABEL.finditer(line):
        out += line[at : m.start()]
        spans.append((KINDS.index(m[1]), len(out), len(out) + len(m[2])))
        out += m[2]
        at = m.end()
    return out + line[at:], spans


def examples(spark) -> DataFrame:
    """The labelled table that comes with the operator: one marked-up ``line`` per row."""
    return spark.createDataFrame([(x,) for x in EXAMPLES.strip().split("\n")], "line string")


def train(labelled: DataFrame) -> Chain:
    """Fit on the ``line`` column of a labelled table, ``MAX_EXAMPLES`` rows at most."""
    rows = labelled.filter("line is not null").select("line").orderBy(F.xxhash64("line"), "line").limit(MAX_EXAMPLES)
    lines = []
    for (line,) in rows.collect():
        text, spans = read_example(line)
        data, bounds = utf8(pa.array([text]))
        words = find_words(data, bounds)
        if not len(words.starts):
            continue
        tags = np.zeros(len(words.starts), dtype=np.int64)
        for kind, start, end in spans:
            a, b = len(text[:start].encode()), len(text[:end].encode())
            tags[(words.starts < b) & (words.ends > a)] = 1 + kind
        lines.append((word_shapes(data, words.starts), tags))
    if not lines:
        raise ValueError("no labelled line")
    return fit_chain(lines)


_EDGE = ".,;:!?\"'*#%$&|<>[]{}="


def chain_spans(chain: Chain, data: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Spans of each row by the chain, in bytes of the row: runs of words with one tag in one line."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(bounds) - 1)]
    words = find_words(data, bounds)
    if not len(words.starts):
        return out
    newline = np.concatenate([[0], np.cumsum(data == 0x0A)])
    line = newline[words.starts]
    first = np.ones(len(line), dtype=bool)
    first[1:] = (line[1:] != line[:-1]) | (words.doc[1:] != words.doc[:-1])
    last = np.append(first[1:], True)
    shapes = word_shapes(data, words.starts)
    tags = chain.decode(chain.emissions(shapes, first, last), first)
    at = np.flatnonzero(tags)
    if not len(at):
        return out
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (np.diff(at) > 1) | (tags[at[1:]] != tags[at[:-1]]) | first[at[1:]]
    begins = at[fresh]
    ends = at[np.append(np.flatnonzero(fresh)[1:] - 1, len(at) - 1)]
    for i, j in zip(begins.tolist(), ends.tolist(), strict=True):
        doc = int(words.doc[i])
        a, b = int(words.starts[i]), int(words.ends[j])
        raw = data[a:b].tobytes()
        cut = raw.rstrip(_EDGE.encode())
        a, b = a + len(cut) - len(cut.lstrip(_EDGE.encode())), a + len(cut)
        if b > a and plausible(int(tags[i]) - 1, data[a:b].tobytes()):
            out[doc].append((int(tags[i]) - 1, a - int(bounds[doc]), b - int(bounds[doc])))
    return out


def plausible(kind: int, raw: bytes) -> bool:
    """What a span of each kind must hold to be told from other numbers."""
    digits = sum(48 <= c < 58 for c in raw)
    return (b"@" in raw and b"." in raw, raw.count(b".") == 3 and digits >= 4, 13 <= digits <= 19, 7 <= digits <= 15)[kind]


def find_personal_data(docs: DataFrame, chain: Chain, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, base counts ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans``.

    The patterns' spans stay as they are; the chain's are added where they overlap
    none of them. Offsets are code points of the whole text. A null text is empty, a
    row without spans has the digest of the empty string and empty ``spans``; null
    and repeated ids are returned row by row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch):
                piece = batch.slice(start, stop - start)
                texts = [t or "" for t in piece.column(1).to_pylist()]
                added = chain_spans(shared.value, *utf8(piece.column(1)))
                rows = []
                for t, more in zip(texts, added, strict=True):
                    base = base_spans(t)
                    joined = _listed(base)
                    spans = list(base)
                    if more:
                        raw = t.encode("utf-8", "surrogatepass")
                        for kind, a, b in more:
                            x = len(raw[:a].decode("utf-8", "surrogatepass"))
                            y = x + len(raw[a:b].decode("utf-8", "surrogatepass"))
                            if all(y <= s or e <= x for _, s, e in base):
                                spans.append((kind, x, y))
                    counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                    rows.append((*counts, hashlib.sha256(joined.encode()).hexdigest(), _listed(sorted(spans))))
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), *[c.cast(pa.int64()) for c in columns[:4]], *columns[4:]],
                    ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
                )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    kind = docs.schema[id_column].dataType.simpleString()
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
