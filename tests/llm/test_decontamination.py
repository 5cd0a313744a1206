import random
import re

from revuelens.llm import decontamination, shingles
from revuelens.llm.decontamination import Settings, drop_contaminated, find_leaks, split_item

WORD = re.compile("[a-z0-9]+")
ITEM = "item_id long, text string"


def sentences(r, n):
    return " ".join(r.choice(["the", "of", "and", f"w{r.randrange(4000)}"]) for _ in range(n))


def items(seed=3, n=60):
    r = random.Random(seed)
    return [(i, f"{sentences(r, 10 + i % 30).capitalize()}. {sentences(r, 6 + i % 5).capitalize()}.") for i in range(n)]


def brute(rows, tests, overlap):
    """Every item whose question and answer triples stand in the text."""

    def grams(words, n=3):
        k = min(n, len(words))
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()

    out = set()
    for doc_id, text in rows:
        words = WORD.findall((text or "").lower())
        have = {k: grams(words, k) for k in (1, 2, 3)}
        for item_id, item in tests:
            parts = [g for g in (grams(WORD.findall(p.lower())) for p in split_item(item)) if g]
            if parts and all(len(g & have[len(next(iter(g)))]) >= overlap * len(g) for g in parts):
                out.add((doc_id, item_id))
    return out


def test_finds_what_brute_force_finds(spark):
    r = random.Random(9)
    tests = items()
    rows = []
    for d in range(300):
        text = sentences(r, r.randrange(1, 400)).split(" ")
        if d % 3 == 0:
            at = r.randrange(len(text) + 1)
            text[at:at] = (tests[r.randrange(60)][1].upper() + "***").split(" ")
        if d % 9 == 0:
            text += tests[r.randrange(60)][1].split(" ")[:4]
        rows.append((d, " ".join(text)))
    rows += [(400, None), (401, ""), (402, sentences(r, 60_000) + " " + tests[0][1]), (403, tests[1][1]), (403, tests[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as item_id")
    found = find_leaks(docs.repartition(4), spark.createDataFrame(tests, ITEM)).collect()
    pairs = {(x.doc_id, x.item_id) for x in found}
    planted = {(d, i) for d, t in rows for i, q in tests if q.lower().rstrip(".") in (t or "").lower()}
    assert planted <= pairs <= brute(rows, tests, 0.6) and len(planted) > 100
    assert sum(x.doc_id == 403 for x in found) == 2
    clean = drop_contaminated(docs, spark.createDataFrame(tests, ITEM))
    assert clean.columns == docs.columns
    assert {x.doc_id for x in clean.collect()} == {d for d, _ in rows} - {x.doc_id for x in found}


def test_wand_retrieves_all_above_the_threshold(spark):
    index = decontamination.build_indexes(spark.createDataFrame(items(), ITEM), Settings(threshold=0.15))[0].value
    r = random.Random(4)
    for _ in range(200):
        terms = sorted(r.sample(range(len(index.lists)), 40))
        full = {}
        for t in terms:
            for k, share in index.lists[t]:
                full[k] = full.get(k, 0) + share
        wanted = {k for k, s in full.items() if s >= 0.15 - 1e-9}
        assert {k for k, _ in index.wand(terms)} == wanted


def test_several_blocks_of_items_answer_alike(spark, monkeypatch):
    tests = items()
    docs = spark.createDataFrame([(i, f"lead {t} tail") for i, t in tests], "doc_id long, text string")
    one = {tuple(r) for r in find_leaks(docs, spark.createDataFrame(tests, ITEM)).collect()}
    monkeypatch.setattr(decontamination, "ITEM_BYTES", 2000)
    several = {tuple(r) for r in find_leaks(docs, spark.createDataFrame(tests, ITEM)).collect()}
    assert {x[:2] for x in one} == {x[:2] for x in several} == {(i, i) for i, _ in tests}


def test_odd_items(spark):
    docs = spark.createDataFrame([(1, "what is it answer: forty two"), (2, "other")], "doc_id long, text string")
    assert find_leaks(docs, spark.createDataFrame([], ITEM)).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (1, None), (2, ""), (3, "What is it Answer: forty two")], ITEM)
    assert [(r.doc_id, r.item_id) for r in find_leaks(docs, odd).collect()] == [(1, 3)]
    given = spark.createDataFrame([(1, "what is it", "forty two")], ITEM + ", answer string")
    assert [r.doc_id for r in find_leaks(docs, given).collect()] == [1]
    assert split_item("Who? Me.") == ("Who? ", "Me.") and split_item("one") == ("one", "")


def test_plain_passage_without_its_last_sentence(spark):
    body = "rivers carry silt to the delta where farmers plant rice in early spring and harvest late"
    tests = [(1, f"{body}. Nobody knows."), (2, "Who wrote the long poem about seven winters in the north? Answer: one Ada Quill Marsh")]
    docs = [(1, f"lead {body} tail"), (2, f"{body}. Everybody sleeps."), (3, "who wrote the long poem about seven winters in the north"), (4, body[:30])]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    given = spark.createDataFrame([(3, body, "nobody knows it")], ITEM + ", answer string")
    assert {(r.doc_id, r.item_id) for r in find_leaks(docs, spark.createDataFrame(tests, ITEM)).collect()} == {(1, 1), (2, 1)}
    assert find_leaks(docs, given).count() == 0
    assert {r.doc_id for r in drop_contaminated(docs, spark.createDataFrame(tests, ITEM)).collect()} == {3, 4}


def test_long_text_in_parts_leaks_what_the_whole_does(spark, monkeypatch):
    r = random.Random(12)
    tests = items()
    texts = []
    for i in range(6):
        pieces = [sentences(r, r.randrange(5, 60)) for _ in range(40)]
        for item in r.sample(tests, 8):
            pieces.insert(r.randrange(len(pieces)), item[1])
        texts.append((i, ", ".join(pieces)))
    bench = spark.createDataFrame(tests, ITEM)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    index = decontamination.build_indexes(bench, Settings())[0].value
    for _, text in texts:
        raw = decontamination.np.frombuffer(text.encode(), "u1")
        bounds = decontamination.np.array([0, len(raw)])
        whole = [sorted(x) for x in index.search(raw, bounds)]
        monkeypatch.setattr(decontamination, "LONG", 1500)
        monkeypatch.setattr(shingles, "LONG", 1500)
        assert len(list(shingles.word_parts(raw, index.stride, index.stride))) > 2
        parts = [sorted(x) for x in index.search(raw, bounds)]
        monkeypatch.undo()
        assert [x[0] for x in whole[0]] == [x[0] for x in parts[0]] and len(whole[0]) >= 8
        assert all(abs(a - b) < 1e-9 for x, y in zip(whole[0], parts[0]) for a, b in zip(x, y))
    assert find_leaks(docs, bench).count() >= 48
