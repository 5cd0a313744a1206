import hashlib
import random

import numpy as np
import pytest

from revuelens.llm import suffixes
from revuelens.llm.suffixes import multikey_sort, remove_repeats


def brute(rows, length):
    seen = {}
    for k, (_, text) in enumerate(rows):
        raw = (text or "").encode()
        for s in range(len(raw) - length + 1):
            seen.setdefault(raw[s : s + length], []).append((k, s))
    gone = [np.zeros(len((t or "").encode()), dtype=bool) for _, t in rows]
    for places in seen.values():
        if len(places) > 1:
            for k, s in places:
                gone[k][s : s + length] = True
    out = []
    for (doc_id, text), g in zip(rows, gone, strict=True):
        raw = (text or "").encode()
        runs = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if len(g) else 0
        kept = bytes(b for b, x in zip(raw, g, strict=True) if not x)
        out.append((doc_id, len(raw), int(g.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, length, gram, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as doc", "2 as place")
    got = remove_repeats(docs.repartition(parts), length=length, gram=gram).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(r.randrange(5, 30))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(r.randrange(1, 5)):
            parts.append(" ".join(word() for _ in range(r.randrange(1, 40))))
            if r.random() < 0.5:
                p = r.choice(passages)
                a = r.randrange(len(p) // 2)
                parts.append(p[a : a + r.randrange(len(p))])
        rows.append((i, " ".join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (7, rows[7][1]), (8, rows[9][1]), (None, rows[4][1]), (202, None), (203, "")]
    rows += [(204, "x" * 300), (205, "ab" * 100 + "q" + "ab" * 30), (206, "short")]
    assert result(spark, rows, 24, 9) == brute(rows, 24)


@pytest.fixture()
def many_buckets(spark):
    """Small buckets that adaptive execution does not put together."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_hot_passage_spans_several_buckets(spark, many_buckets):
    r = random.Random(3)
    passage = "".join(r.choice("abcdefgh ") for _ in range(90))
    rows = [(i, "".join(r.choice("ijklmnop") for _ in range(60)) + passage[r.randrange(30) :] + str(i)) for i in range(400)]
    rows += [(1000 + i, f"{'tail' * (i % 3)}{passage}{i % 7}{passage[:i]}") for i in range(40)]
    assert result(spark, rows, 40, 12, 8) == brute(rows, 40)


def test_very_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 500)
    r = random.Random(4)
    text = "".join(r.choice("abcdefg") for _ in range(4000))
    rows = [(1, text[:3000] + text[1000:1900] + text[3000:]), (2, text[480:520]), (3, "z" * 700)]
    assert result(spark, rows, 30, 10) == brute(rows, 30)


def test_production_lengths(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(r.choice(words) for _ in range(150))) for i in range(40)]
    rows += [(100 + i, rows[i][1][100:500] + " and " + rows[i + 1][1][:199]) for i in range(10)]
    rows += [(200, rows[0][1][10:210]), (201, rows[30][1][10:209])]
    assert result(spark, rows, 200, 50) == brute(rows, 200)


def test_multikey_sort():
    r = np.random.default_rng(0)
    rows = r.integers(0, 3, size=(500, 24)).astype(np.uint8)
    order, common = multikey_sort(rows.copy().view(">u8").astype(np.uint64))
    listed = [rows[i].tobytes() for i in order]
    assert listed == sorted(x.tobytes() for x in rows)
    for i in range(1, 500):
        a, b = listed[i - 1], listed[i]
        assert common[i] == next((j for j in range(24) if a[j] != b[j]), 24)


def test_empty_table_and_settings(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(empty, length=400, gram=50)


def test_equal_rows_list_their_places_once(spark):
    """Rows of one id and one text: the list of a name does not grow with their number."""
    import time

    text = " ".join(f"word{i}" for i in range(300))
    took = []
    for n in (100, 800):
        docs = spark.createDataFrame([(None, text)] * n + [(1, text[:900])], "doc_id long, text string").repartition(4)
        start = time.time()
        got = {(r.doc_id, r.n_bytes, r.n_removed) for r in remove_repeats(docs).collect()}
        took.append(time.time() - start)
        assert got == {(None, len(text), len(text)), (1, 900, 900)}
    assert took[1] < 4 * took[0] + 5


def test_many_rows_without_an_id(spark):
    """So many that a short digest would take some of them for the same row."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    shared = [" ".join(word() for _ in range(9)) for _ in range(8)]
    rows = [(None, " ".join([word() for _ in range(r.randrange(3, 12))] + [r.choice(shared)] + [word(), word()])) for _ in range(1500)]
    assert result(spark, rows, 24, 9) == brute(rows, 24)
