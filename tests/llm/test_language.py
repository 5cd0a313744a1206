import random

import pytest
from pyspark.sql import functions as F

from revuelens.llm.language import address_parts, identify, keep_identified, language_code, page_language, page_text

WORDS = {
    "en": "the and that with have this from they would there their what about which when make like time just know".split(),
    "de": "der und nicht dass eine sich auch werden schon über wenn aber durch zwischen jedoch gegenüber möglich".split(),
    "fr": "les des une est que dans pour qui avec sur être avoir même très où déjà après depuis jusque".split(),
}


def say(r, lang, n):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = []
    for i in range(900):
        lang = ("en", "en", "de", "fr")[i % 4]
        declared = lang if r.random() < 0.85 else r.choice(["en", "de", "fr", None, "xx-bad-code", "zz"])
        host = f"{lang if r.random() < 0.9 else 'en'}{i % 3}.site"
        out.append((i, say(r, lang, r.randrange(6, 60)), declared, host, lang))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, truth string"


def test_text_wins_over_wrong_declarations(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "0.5 as confidence", "1 as kept")
    got = identify(docs, declared="lang", hosts=["source"]).collect()
    truth = {r[0]: r[4] for r in rows}
    assert sum(x.lang == truth[x.doc_id] for x in got) >= 0.99 * len(rows)
    assert all(x.kept for x in got if x.lang == truth[x.doc_id] and x.n_grams > 50)
    again = identify(docs.repartition(9), declared="lang", hosts=["source"]).collect()
    assert {(x.doc_id, x.lang, round(x.confidence, 9)) for x in got} == {(x.doc_id, x.lang, round(x.confidence, 9)) for x in again}


def test_other_evidence_speaks_where_the_text_is_silent(spark, rows):
    odd = [
        (2000, "", "de", None, ""), (2001, None, None, "fr1.site", ""), (2002, None, None, None, ""), (2003, "12 !! 99", None, None, ""),
        (None, "the and that with", "en", None, ""), (2004, "the and that with", "en", None, ""), (2004, "the and that with", "en", None, ""),
        (2005, say(random.Random(1), "de", 40_000), None, None, ""),
    ]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    got = {}
    for x in identify(docs, declared="lang", hosts=["source"]).collect():
        got.setdefault(x.doc_id, []).append(x)
    assert got[2000][0].lang == "de" and got[2001][0].lang == "fr" and got[2005][0].lang == "de"
    assert not got[2002][0].kept and not got[2003][0].kept and got[2005][0].kept
    assert len(got[2004]) == 2 and len(got[None]) == 1 and got[None][0].kept
    kept = keep_identified(docs, declared="lang", hosts=["source"])
    assert kept.columns == docs.columns
    gone = {r[0] for r in rows + odd} - {x.doc_id for x in kept.collect()}
    assert {2002, 2003} <= gone and all(not x.kept for i in gone for x in got[i])


def test_fusion_by_hand(spark):
    """Two languages, no text: priors smoothed from level to level, own vote taken out."""
    texts = [(i, "aaaa bbbb aaab" if i % 2 else "xyxy yxyx xxyy", "aa" if i % 2 else "xy", "d1", f"h{i % 2}") for i in range(40)]
    silent = [(100, None, None, "d1", "h1"), (101, None, None, "d9", "h9"), (102, None, "aa", None, None)]
    docs = spark.createDataFrame(texts + silent, "doc_id long, text string, lang string, domain string, host string")
    got = {x.doc_id: x for x in identify(docs, declared="lang", hosts=["domain", "host"]).collect()}
    overall = (20 + 10) / (40 + 20)
    domain = (20 + 20 * overall) / (40 + 20)
    host = (20 + 20 * domain) / (20 + 20)
    assert got[100].lang == "aa" and got[100].confidence == pytest.approx(host)
    assert got[101].confidence == pytest.approx(0.5)
    share = (20 + 1) / 41
    like = [(20 + 20 * share) / 40, 20 * share / 40]
    assert got[102].confidence == pytest.approx(like[0] / sum(like))


def test_pages(spark):
    html = "<!doctype html><html class=x lang='de-AT'><script>var a='<p>the</p>'</script><body>Hallo<b>!</b></body></html>"
    docs = spark.createDataFrame([(html, "https://a.b.example.at/x?y#z"), (None, None), ("", "::no url"), ("x", "http://host/")], "h string, u string")
    suffix, domain, host = address_parts(F.col("u"))
    got = docs.select(language_code(page_language(F.col("h"))), page_text(F.col("h")), suffix, domain, host).collect()
    assert got[0][0] == "de" and got[0][1].split() == ["Hallo", "!"] and tuple(got[0][2:]) == ("at", "example.at", "a.b.example.at")
    assert tuple(got[1]) == (None,) * 5 and got[2][2] is None and tuple(got[3][2:]) == ("host", "host", "host")


def test_empty_and_undeclared(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert identify(empty, declared="lang", hosts=["source"]).count() == 0
    undeclared = spark.createDataFrame([(1, "the and", None, "s", "")], SCHEMA)
    assert [(x.lang, x.kept) for x in identify(undeclared, declared="lang").collect()] == [(None, False)]


def test_rare_language_is_named_and_rare_mistakes_are_not(spark, rows):
    r = random.Random(6)
    words = "sztuka przez książka wszystko dlaczego który jednak żadnych więcej człowiek zawsze dziękuję".split()
    many = [(i, say(r, l, 20), l, "s", l) for i in range(12_000) for l in [("en", "de", "fr")[i % 3]]]
    rare = [(20_000 + i, " ".join(r.choice(words) for _ in range(25)), "pl", "s", "pl") for i in range(4)]
    wrong = [(30_000 + i, say(r, "en", 25), code, "s", "en") for i, code in enumerate(["zz", "qq", "qq", "pl"])]
    got = {x.doc_id: x for x in identify(spark.createDataFrame(many + rare + wrong, SCHEMA), declared="lang", hosts=["source"]).collect()}
    assert all(got[x[0]].lang == x[4] and got[x[0]].kept for x in rare + wrong)
    assert sum(got[x[0]].lang == x[4] for x in many) >= 0.999 * len(many)


def test_thousands_of_codes(spark):
    codes = [a + b + c for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghijkl"]
    docs = spark.createDataFrame([(i, "the and that with", c, "s", "") for i, c in enumerate(codes)], SCHEMA)
    assert identify(docs, declared="lang", hosts=["source"]).count() == len(codes)


def test_trigrams_of_a_long_text_in_parts(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from revuelens.llm import language

    def counted(texts):
        total = np.zeros(len(texts) * language.BUCKETS, dtype=np.int64)
        for bucket, row in language.trigrams(pa.array(texts, pa.string())):
            total += np.bincount(row * language.BUCKETS + bucket, minlength=len(total))
        return total

    texts = ["", None, "ab", "Ünï 漢字 words, and more words. " * 50, "x"]
    whole = [counted(texts), counted(texts[3:4])]
    monkeypatch.setattr(language, "PART", 17)
    assert (counted(texts) == whole[0]).all() and (counted(texts[3:4]) == whole[1]).all()
    assert whole[0].sum() == whole[1].sum() > 1000
