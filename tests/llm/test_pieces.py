import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from revuelens.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "   ", "\n", "\n\n a", "a  b ", "a \n b", "▁x", "x▁▁ y▁", "\x00a", "é漢🙂", "a\tb\r\n;\r", "</s> <s>", "￾  "]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def drawn():
    draw = random.Random(3)
    return ["".join(draw.choice(" ▁\n\tabcé漢🙂<>s/0;\r\x01�") for _ in range(draw.randrange(1, 40))) for _ in range(3000)]


@pytest.mark.parametrize("part", [7, 1 << 20])
def test_same_as_the_library(model, monkeypatch, part):
    monkeypatch.setattr(pieces, "PART", part)
    monkeypatch.setattr(pieces, "RUN", 50)
    texts = [*ODD, *drawn(), "word " * 20_000 + "end", "x" * 5_000]
    own = pieces.Pieces(PATH)
    ids, bounds = own.encode(texts, 2)
    got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [[*model.encode(t or ""), 2] for t in texts]
    assert own.decode(ids, bounds) == [model.decode(x) for x in got]
    again, edges, decoded = own.round_trip(texts, 2)
    assert again.tolist() == ids.tolist() and edges.tolist() == bounds.tolist()
    assert decoded == [model.decode(x) for x in got]
    assert own.encode([], 2)[1].tolist() == [0] and own.decode(np.zeros(0, np.int32), np.zeros(1, np.int64)) == []


def test_each_distinct_chunk_once(monkeypatch):
    own, seen = pieces.Pieces(PATH), []
    monkeypatch.setattr(own, "segment", lambda chunks, f=own.segment: (seen.extend(chunks), f(chunks))[1])
    own.encode(["the cat the dog", "the cat\nthe"], None)
    assert sorted(seen) == ["\nthe", " cat", " dog", " the"]


def test_query_shape(spark, model, monkeypatch):
    rows = [(i % 40 if i % 9 else None, ODD[i % len(ODD)] if i % 2 else f"text {i} " * i) for i in range(120)]
    docs = spark.createDataFrame([(*r, [1], "x") for r in rows], "doc_id long, text string, ids array<int>, decoded string")
    found = pieces.encode_and_decode(docs.repartition(3), PATH, 2).collect()
    want = [(i, [*model.encode(t or ""), 2]) for i, t in rows]
    assert sorted(map(str, ((r.doc_id, list(r.ids), r.decoded) for r in found))) == sorted(
        str((i, ids, model.decode(ids))) for i, ids in want
    )
    twice = pieces.decode_ids(pieces.encode_texts(docs, PATH, 2), PATH).collect()
    assert sorted(map(str, twice)) == sorted(map(str, found))
    line = pieces.encode_texts(docs, PATH).select(pieces.id_line().alias("line")).collect()
    assert sorted(r.line for r in line) == sorted(" ".join(map(str, ids[:-1])) for _, ids in want)
    assert pieces.encode_and_decode(docs.limit(0), PATH, 2).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in pieces.decode_ids(nothing, PATH).collect()] == ["", ""]
