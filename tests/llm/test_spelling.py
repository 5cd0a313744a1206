import random
import re
import zlib
from collections import Counter

import pytest

from revuelens.llm import spelling


def spelt(rows, every):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            mark = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if mark % every == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(words):
    near = {w: [x for x in words if x != w and abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in words}
    best = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: b if b and words[b] >= 5 * words[w] else None for w, b in best.items()}
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), form[w] and words[form[w]]))
    return out


def grouped(spark, rows, every):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, word string").repartition(3)
    found = spelling.group_variants(docs, misspelt_every=every)
    return {tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def many_words():
    """Words with common halves, several edits of each, and letters beyond ASCII."""
    draw = random.Random(5)
    stems = ["commonword", "commonwards", "größeren", "aaaaaaaa", "abababab", "MixedCase"]
    words = set(stems)
    for stem in stems * 12:
        at, letter = draw.randrange(len(stem) + 1), draw.choice("abcxyzé÷")
        words |= {stem[:at] + letter + stem[at:], stem[:at] + letter + stem[at + 1 :], stem[:at] + stem[at + 1 :]}
    words |= {f"prefix{a}{b}" for a in "abcdefgh" for b in "abcdefgh"}
    rows, counts = [], {w: draw.choice([5, 6, 30, 200]) for w in sorted(words)}
    bag = [w for w, n in counts.items() for _ in range(n)]
    draw.shuffle(bag)
    for i in range(0, len(bag), 97):
        rows.append((i, " ".join(bag[i : i + 97])))
    return rows


@pytest.mark.parametrize("crowded", [2, 64])
def test_against_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(spelling, "CROWDED", crowded)
    rows = many_words() + [(None, "commonword, nulls-id"), (4, None), (5, ""), (6, "tiny a 12 _"), (6, "commonword " * 7)]
    for every in (199, 7):
        words = spelt(rows, every)
        got = grouped(spark, rows, every)
        assert got == expected(words)
        assert any(r[1] for r in got) and any(r[1] and r[2] != r[1] for r in got)


def test_long_texts_and_long_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PART", 1000)
    long = "x" * 5_000
    rows = [(i, "middle " * 20_000 + f" {long} {long[:-1]}y {long}z") for i in range(5)]
    got = grouped(spark, rows, 199)
    assert got == expected(spelt(rows, 199))
    assert (long, None, long, 5, 2, None) in got


def test_nothing_to_group(spark):
    assert grouped(spark, [], 199) == set()
    assert grouped(spark, [(1, None), (2, "seldom words only")], 199) == set()
