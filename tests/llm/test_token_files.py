import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
import zstandard
from tokenizers import Tokenizer

from revuelens.llm.token_files import FrameReader, WordEncoder, encode_documents, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None,
    "",
    "a  b",
    " lead",
    "tail \n",
    "x\n\ny",
    "tab\tand space",
    "it's don't 'll I've",
    "<|endoftext|> is text",
    "Ünï 漢字 🙂 12345 a1b2 !!!\nnext line.\nThird",
    "\n",
    "word " * 30_000 + "end",
]


def plain(text):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_word_cuts_do_not_change_ids():
    encoder = WordEncoder(PATH)
    texts = [t or "" for t in ODD]
    got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)]
    assert got == [plain(t) for t in texts]


def test_what_is_remembered_is_bounded(monkeypatch):
    from revuelens.llm import token_files

    monkeypatch.setattr(token_files, "CACHED_BYTES", 40_000)
    monkeypatch.setattr(token_files, "KEPT_BYTES", 4_000)
    encoder = WordEncoder(PATH)
    for k in range(5):
        texts = [f"again word{k}x{i} and more{i}" for i in range(60)]
        got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)]
        assert got == [plain(t) for t in texts]
        assert max(encoder.held.values()) <= 40_000 and len(encoder.inner) < 260
    encoder.forget()
    assert max(encoder.held.values()) <= 4_000 and 5 < len(encoder.inner) < 40
    assert np.frombuffer(encoder.encode(texts)[0], encoder.dtype).tolist() == plain(texts[0])


def test_round_trip(spark):
    rows = [(i * 3 % 101, ODD[i % len(ODD)]) for i in range(101)] + [(7, "again"), (7, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as start").repartition(5)
    got = sorted(encode_documents(spark, docs, PATH, frame_bytes=4096).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *sorted(r[0] for r in rows if r[0] is not None)]
    at = 0
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(doc_id, []).append(text)
    for r in got:
        assert r.start == at
        at += r.n_tokens
        options = [np.array([*plain(t), 0], dtype="<u4").tobytes() for t in texts[r.doc_id]]
        assert (r.n_tokens, r.ids_crc32) in [(len(o) // 4, zlib.crc32(o)) for o in options]


def test_requested_documents_and_checksums(spark, folder):
    docs = spark.createDataFrame([(i, f"document {i} " * 50) for i in range(200)], "doc_id long, text string")
    path = write_tokens(docs.coalesce(1), folder, PATH, 0, frame_bytes=2000).orderBy("part").first().path
    files, place = pafs.FileSystem.from_uri(path)
    with files.open_input_file(place) as source:
        raw = source.read()
    reader = FrameReader(_Source(raw))
    wanted = [int(reader.doc_ids[3]), int(reader.doc_ids[-1])]
    read = reader.source.n_read
    found = dict((k, v.tolist()) for k, v in reader.find(wanted))
    assert found == {k: [*plain(f"document {k} " * 50), 0] for k in wanted}
    assert reader.source.n_read - read < len(raw) / 4
    # Any zstandard decoder reads the frames one after the other and skips the table.
    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True)
    assert len(stream.read()) == int(reader.frames[:, 1].sum())
    broken = bytearray(raw)
    broken[20] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(FrameReader(_Source(bytes(broken))).rows())


def test_empty_table(spark):
    assert encode_documents(spark, spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


class _Source(io.BytesIO):
    def __init__(self, raw):
        super().__init__(raw)
        self.n, self.n_read = len(raw), 0

    def size(self):
        return self.n

    def read(self, n=-1):
        out = super().read(n)
        self.n_read += len(out)
        return out
