"""Deobfuscation against all paths of small lattices, the character model against plain counts, scores against held-out labels."""

from __future__ import annotations

import itertools
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbra.llm import toxicity as tox
from umbra.llm.queries import queries

INSULTS = ("blorgo", "snarfle", "quibnut", "drozzet")


def cheapest(stretch: str, cost) -> float:
    """Bits of the best reading, by trying every choice at every character."""
    best = [float("inf")]

    def walk(k: int, word: str, read: bool, bits: float) -> None:
        code = lambda c: ord(c) - 96 if "a" <= c <= "z" else 27
        end = lambda w: cost[tuple([0] * max(0, 3 - len(w)) + [code(c) for c in w[-3:]] + [0])] if w else 0.0
        if k == len(stretch):
            best[0] = min(best[0], bits + end(word))
            return
        ch = stretch[k]
        step = lambda c, price: walk(k + 1, word + c, True, bits + price + cost[tuple([0] * max(0, 3 - len(word)) + [code(x) for x in word[-3:]] + [code(c)])])
        looks = tox.LOOKS.get(ch, "")
        if ch.isalpha():
            step(ch, 0.0)
        else:
            for x in looks:
                step(x, tox.SWAP)
            walk(k + 1, "", False, bits + end(word) + (tox.BREAK if looks else 0.0))
            if not looks and not ch.isdigit():
                walk(k + 1, word, False, bits + tox.DROP)
        if read and k and ch == stretch[k - 1]:
            walk(k + 1, word, True, bits + tox.REPEAT)

    walk(0, "", False, 0.0)
    return best[0]


def price(stretch: str, plain: str, cost) -> float:
    """The least bits at which `stretch` can be read as exactly `plain`."""
    found = [float("inf")]
    code = lambda c: ord(c) - 96 if "a" <= c <= "z" else 27

    def walk(k: int, out: str, word: str, read: bool, bits: float) -> None:
        at = lambda w, c: cost[tuple([0] * max(0, 3 - len(w)) + [code(x) for x in w[-3:]] + [c])]
        if not plain.startswith(out) or bits >= found[0]:
            return
        if k == len(stretch):
            if out == plain:
                found[0] = min(found[0], bits + (at(word, 0) if word else 0.0))
            return
        ch = stretch[k]
        looks = tox.LOOKS.get(ch, "")
        if ch.isalpha():
            walk(k + 1, out + ch, word + ch, True, bits + at(word, code(ch)))
        else:
            for x in looks:
                walk(k + 1, out + x, word + x, True, bits + tox.SWAP + at(word, code(x)))
            walk(k + 1, out + " " * bool(word), "", False, bits + (at(word, 0) if word else 0.0) + (tox.BREAK if looks else 0.0))
            if not looks and not ch.isdigit():
                walk(k + 1, out, word, False, bits + tox.DROP)
        if read and k and ch == stretch[k - 1]:
            walk(k + 1, out, word, True, bits + tox.REPEAT)

    walk(0, "", "", False, 0.0)
    return found[0]


def test_viterbi_equals_the_best_of_all_paths():
    rng = random.Random(4)
    for _ in range(250):
        table = np.random.default_rng(rng.randrange(10**6)).uniform(0.1, 9.0, (28,) * 4)
        letters = "".join(ch * rng.choice((1, 1, 2)) for ch in rng.choices("abcé", k=6))
        stretch = letters if rng.random() < 0.4 else "".join(rng.choice("abié10!.-_ $5") for _ in range(rng.randint(1, 8)))
        plain = tox.restored(stretch, table.ravel())
        assert price(stretch, plain, table) == pytest.approx(cheapest(stretch, table)), stretch


def test_grams_and_costs_equal_plain_counts(spark):
    texts = ["The THE then x", "", None, "é-été 日本 a1b", "ab" * 50]
    want: Counter = Counter()
    for t in texts:
        word = ""
        for c in [*(t or ""), " "]:
            code = ord(c.lower()) - 96 if "a" <= c.lower() <= "z" else 27 if ord(c) > 127 else 0
            if code or word:
                want[(*[0] * max(0, 3 - len(word)), *[ord(x) - 96 if "a" <= x <= "z" else 27 for x in word[-3:]], code)] += 1
            word = word + c.lower() if code else ""
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, gram int").repartition(3)
    got = {r.gram: r.n for r in tox.letter_counts(df).collect()}
    assert got == {((a * 28 + b) * 28 + c) * 28 + d: n for (a, b, c, d), n in want.items()}
    cost = tox.letter_costs(tox.letter_counts(df).toPandas()).reshape((28,) * 4)
    assert np.allclose((2.0**-cost).sum(-1), 1.0)


def disguised(word: str, rng: random.Random) -> str:
    k = rng.randrange(4)
    i = rng.randrange(len(word))
    return [word.translate(str.maketrans("aeiost", "4310$7")), " ".join(word), word[:i] + word[i] * 3 + word[i + 1 :], ".".join(word)][k]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    syllables = ["ta", "re", "mi", "lo", "den", "sha", "ku", "ver", "ing", "pol"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    rows = []
    for i in range(600):
        words = [rng.choice([word(), word(), word(), rng.choice("aeious")]) for _ in range(rng.randint(20, 60))]
        toxic = i % 5 == 0
        if toxic:
            hidden = i % 15 == 0
            for _ in range(3):
                w = rng.choice(INSULTS)
                words.insert(rng.randrange(len(words)), disguised(w, rng) if hidden else w)
        rows.append((i, " ".join(words), int(toxic), "z", 5.0))
    rows += [(1000 + k, "ta re mi " + "ku lo den " * 9 + "x" * k, 0, None, None) for k in range(30)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic int, lang string, score double").repartition(4)


def test_disguised_words_count_and_other_columns_stay(spark, corpus):
    model = tox.trained(corpus.where("doc_id % 3 <> 1"), corpus.select("doc_id", "toxic"), corpus)
    got = tox.score(corpus.where("doc_id % 3 = 1"), model).collect()
    assert all(r.predicted == r.toxic for r in got) and len(got) > 200 and any(r.toxic for r in got if r.doc_id % 15 == 10 or r.doc_id % 5 == 0)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "1" * 50), (4, "a " * 3000), (5, "b l 0 r g o"), (5, "b l 0 r g o"), (6, "we met a SNARRRFLE!!")], "doc_id bigint, text string")
    scores = [(r.doc_id, r.score, r.predicted) for r in tox.score(odd, model).orderBy("doc_id").collect()]
    assert scores[0][1] == scores[1][1] < 0.3 and scores[4] == scores[5] and [s[2] for s in scores] == [0, 0, 0, 0, 1, 1, 1]
    assert tox.score(odd.limit(0), model).collect() == []


def test_copies_count_about_once(spark, corpus):
    """A clean phrase in a hundred copies of one toxic text isn't toxic by itself."""
    copies = spark.createDataFrame([(5000 + k, f"blorgo wazzum feln plumbic {'re ' * (k % 3)}", 1) for k in range(100)], "doc_id bigint, text string, toxic int")
    all_rows = corpus.select("doc_id", "text", "toxic").unionByName(copies)
    model = tox.trained(all_rows, all_rows.select("doc_id", "toxic"), all_rows)
    assert list(model.scores(iter(["ta re wazzum feln plumbic mi", "ta re blorgo mi"]))) [0] < tox.THRESHOLD < list(model.scores(iter(["ta blorgo mi"])))[0]


def test_without_labels_nothing_is_toxic(spark, corpus):
    for labels in (corpus.select("doc_id", "toxic").limit(0), corpus.select("doc_id", F.lit(None).cast("int").alias("toxic")), corpus.select("doc_id", F.lit(0).alias("toxic"))):
        got = tox.score(corpus.limit(5), tox.trained(corpus, labels, corpus)).collect()
        assert [r.score for r in got] == [0.0] * 5


def test_long_stretches_take_linear_time():
    cost = np.random.default_rng(1).uniform(1, 9, 28**4).tolist()
    begin = time.time()
    assert len(tox.restored("id10t5" * 20_000, cost)) > 50_000
    assert time.time() - begin < 30


def test_query_over_the_table(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = queries()["op12_toxicity"](spark, d)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.toxic is not None]
    clean = [r for r in held if not r.toxic]
    caught = [r for r in held if r.toxic and r.predicted]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean) and len(caught) >= 0.6 * sum(r.toxic for r in held)
