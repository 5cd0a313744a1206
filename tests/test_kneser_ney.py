"""The back-off model: by hand, as a distribution, and against add-k on held-out texts."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from revuelens.operators import char_lm, kneser_ney

TEXTS = ["abracadabra", "banana", "abba", "cab", "ab", "", None, "bandana"]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(1 + i % 2 if i != 7 else None, t) for i, t in enumerate(TEXTS)]
    return kneser_ney.fit_kneser_ney(spark.createDataFrame(rows, "g int, t string").repartition(3), "t", 3, ["g"])


def by_hand(texts, gram, size, discount=0.75):
    """Orders built from sets of n-grams, one probability at a time."""
    top = Counter(t[i : i + 3] for t in texts for i in range(len(t) - 2))
    kinds = {3: top}
    for n in (2, 1):
        before = defaultdict(set)
        for g in kinds[n + 1]:
            before[g[1:]].add(g[0])
        kinds[n] = Counter({g: len(s) for g, s in before.items()})

    def p(n):
        if n == 0:
            return 1 / size
        context = gram[3 - n : 2]
        follow = {g: c for g, c in kinds[n].items() if g[:-1] == context}
        if not follow:
            return p(n - 1)
        total = sum(follow.values())
        return max(follow.get(gram[3 - n :], 0) - discount, 0) / total + discount * len(follow) / total * p(n - 1)

    return p(3)


def test_probabilities_by_hand_that_sum_to_one(spark, model):
    letters = "abcdnr?"
    grams = [(g, "".join(x)) for g in (1, 2, None, 9) for x in itertools.product(letters, repeat=3)]
    rows = spark.createDataFrame(grams, "g int, _gram string").repartition(4)
    got = {(r.g, r._gram): r.probability for r in kneser_ney.with_probability(rows, model, len(letters), 3, ["g"]).collect()}
    assert len(got) == len(grams)
    for g, place in ((1, 0), (2, 1)):
        texts = [t for i, t in enumerate(TEXTS) if t and i % 2 == place and i != 7]
        for (group, gram), p in got.items():
            if group == g:
                assert p == pytest.approx(by_hand(texts, gram, len(letters)), abs=1e-12), gram
    assert got[None, "xyz".replace("x", "b").replace("y", "a").replace("z", "n")] == pytest.approx(by_hand(["bandana"], "ban", 7))
    assert got[9, "abc"] == pytest.approx(1 / 7)
    for g in (1, 2, None, 9):
        for context in itertools.product(letters, repeat=2):
            assert sum(got[g, "".join(context) + c] for c in letters) == pytest.approx(1, abs=1e-12)


def test_held_out_texts_are_less_surprising_than_with_add_k(spark):
    draw = random.Random(2)
    words = ["".join(draw.choice("aeioulnrst") for _ in range(draw.randrange(3, 8))) for _ in range(300)]
    texts = [(1, " ".join(draw.choice(words) for _ in range(12))) for _ in range(300)]
    train = spark.createDataFrame(texts[:200], "g int, t string")
    held = spark.createDataFrame(texts[200:], "g int, t string")
    size = 12
    smooth = kneser_ney.backoff_perplexity(held, kneser_ney.fit_kneser_ney(train, "t", 5, ["g"]), "t", size, 5, ["g"]).first()
    plain = char_lm.char_perplexity(held, char_lm.fit_char_ngram(train, "t", 5, ["g"]), "t", size, 5, ["g"]).first()
    assert smooth["n_chars"] == plain["n_chars"] and smooth["perplexity"] < 0.95 * plain["perplexity"]


def test_nothing_to_score(spark, model):
    none = spark.createDataFrame([(1, None), (1, "ab")], "g int, t string")
    assert kneser_ney.backoff_perplexity(none, model, "t", 7, 3, ["g"]).count() == 0
    empty = kneser_ney.fit_kneser_ney(none.filter(F.lit(False)), "t", 3, ["g"])
    row = kneser_ney.backoff_perplexity(spark.createDataFrame([(1, "abc")], "g int, t string"), empty, "t", 8, 3, ["g"]).first()
    assert row["perplexity"] == pytest.approx(8)
