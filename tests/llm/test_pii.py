import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from revuelens.llm import pii
from revuelens.llm.common import utf8
from revuelens.llm.pii import Chain, base_spans, chain_spans, examples, find_personal_data, read_example, train

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2:
                double = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
                if not 16 <= len(digits) <= 19 or sum(d - 9 if d > 9 else d for d in double) % 10:
                    continue
            if kind == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_are_those_of_the_plain_patterns():
    r = random.Random(2)
    for _ in range(4000):
        text = "".join(r.choice(["a", "é", "@", ".", "-", "+", " ", "(", ")", "1", "22", "255", "256", "4111111111111111", "\n"]) for _ in range(r.randrange(40)))
        assert base_spans(text) == plain_spans(text), text


def test_viterbi_parts_at_sure_words_without_a_change():
    r = np.random.default_rng(1)
    change = r.normal(size=(pii.N_TAGS, pii.N_TAGS))
    chain = Chain(*(np.zeros((pii.N_SHAPES + 1, pii.N_TAGS)) for _ in range(3)), change)
    for _ in range(60):
        n = int(r.integers(1, 30))
        scores = r.normal(size=(n, pii.N_TAGS)) * 2
        scores[r.random(n) < 0.4, 0] += 40
        first = r.random(n) < 0.2
        first[0] = True
        wanted = []
        for line in np.split(np.arange(n), np.flatnonzero(first)[1:]):
            best = scores[line[0]]
            back = []
            for t in line[1:]:
                step = best[:, None] + change
                back.append(step.argmax(axis=0))
                best = step.max(axis=0) + scores[t]
            path = [int(best.argmax())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            wanted += path[::-1]
        assert chain.decode(scores, first).tolist() == wanted


def test_training_and_held_out_lines(spark):
    chain = train(examples(spark))
    held_out = [
        "please phone (613) 555-0199 soon",
        "write to kim.o@lists.example.org or so",
        "her amex is [card|378282246310005] she said",
        "call [phone|(212) 555-0175] now",
        "It has 1500 words on 12 pages, see 4.2.1",
        "the year 2022 and 350 people",
        "hash 3f786850e387550fdab836ed7e6dc881de23001b here",
        "Nothing to see, just words - and more words.",
    ]
    held_out[0] = "please phone [phone|(613) 555-0199] soon"
    held_out[1] = "write to [email|kim.o@lists.example.org] or so"
    for line in held_out:
        text, spans = read_example(line)
        data, bounds = utf8(pa.array([text]))
        assert chain_spans(chain, data, bounds)[0] == spans, line


def test_result_rows(spark):
    texts = [
        None, "", "plain words only", "é mail bob@example.com, then (202) 555-0187 or +1 202 555 0143.",
        "IP 10.0.0.1 999.1.1.1 card 4111-1111-1111-1111\nnext 378282246310005 line", "w " * 50_000 + "x@y.zz",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as n_ip")
    got = find_personal_data(docs, train(examples(spark))).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[4 if r.doc_id is None else r.doc_id] or ""
        base = plain_spans(text)
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in base) for j in range(4)]
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert set(filter(None, listed.split(","))) <= set(filter(None, r.spans.split(",")))
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), int(s[1])))
    by_id = {r.doc_id: r.spans for r in got}
    a = texts[3].index("(202)")
    assert f"phone:{a}:{a + 14}" in by_id[3].split(",") and by_id[2] == ""
    a = texts[4].index("3782")
    assert f"card:{a}:{a + 15}" in by_id[4].split(",")
    assert find_personal_data(docs.limit(0), train(examples(spark))).count() == 0


def test_bad_labels(spark):
    with pytest.raises(ValueError):
        train(spark.createDataFrame([(None,), ("",)], "line string"))
