"""Periodic runs against a plain search of every period."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from umbra.llm import runs
from umbra.llm.queries import queries


def plain_runs(x: list) -> list[runs.Run]:
    best: dict[tuple[int, int], int] = {}
    for p in range(1, len(x) // 4 + 1):
        i = 0
        while i + p < len(x):
            s = i
            while i + p < len(x) and x[i] == x[i + p]:
                i += 1
            if i > s and i + p - s >= max(6, 4 * p):
                best.setdefault((s, i + p), p)
            i += 1
    return sorted(runs.Run(s, e - s, p) for (s, e), p in best.items())


def plain_row(doc_id: int | None, text: str | None) -> tuple:
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-Fraction(r.length, r.period), r.start, r.period), default=None)
    dropped = {i for r in found for i in range(r.start + r.period, r.start + r.length)}
    digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    four = (None,) * 4 if best is None else (*best, 1000 * best.length // best.period)
    return (doc_id, len(found), *four, digest("".join(f"{r.start},{r.length},{r.period}\n" for r in found)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_runs_equal_a_search_of_every_period():
    rng = random.Random(3)
    for _ in range(3000):
        n, kinds = rng.randint(0, 70), rng.choice([1, 2, 3, 5])
        x = [rng.randrange(kinds) for _ in range(n)]
        if n > 8 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 9)
            x = [x[i] if i < a else x[min(a + (i - a) % p, n - 1)] for i in range(n)]
        assert runs.runs(runs.interned([b"%d" % v for v in x])) == plain_runs(x), x


def test_runs_of_all_fibonacci_words_and_of_squares_of_squares():
    a, b = "x", "xy"
    for _ in range(9):
        a, b = b, b + a
        for text in (b, b * 4, "z" + b * 5 + "z", (b * 4 + "q") * 4):
            x = list(text[:900])
            assert runs.runs(runs.interned([c.encode() for c in x])) == plain_runs(x)


def test_long_texts_of_one_word_and_of_one_long_period():
    assert runs.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert runs.runs(np.arange(100_000) % 997) == [(0, 100_000, 997)]
    assert runs.runs(np.arange(100_000) % 30_000) == []


def test_query_equals_plain_version_on_awkward_rows(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a", "a " * 5, "a " * 6, "a b " * 4, "a b " * 3 + "a", "x a b a b a b a b y", "é é " * 6, "a\x0ba\x0ca\ra\ta a a", "\x1ca " * 8, "q " + "to be or not " * 7 + "to be a a a a a a a"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    rows = [(i, t, "en", "other") for i, t in enumerate(texts)] + [(None, "b " * 9, None, None), (3, "a", None, None), (3, "a", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, period string").repartition(5)
    got = [tuple(r) for r in runs.query(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=str) == sorted((plain_row(i, t) for i, t, *_ in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows) > 5
    assert runs.query(df.limit(0)).collect() == []


def test_detect_keeps_other_columns(spark):
    df = spark.createDataFrame([("go " * 7 + "on", 1, "x"), (None, 2, "y")], "text string, start int, runs string")
    got = {r.start: r for r in runs.detect(df).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 7, 1)] and got[1].collapsed == "go on" and got[2].runs == [] and got[2].collapsed == ""


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_over_the_table(spark, sf):
    got = {r.doc_id: tuple(r) for r in queries()["op13_runs"](spark, f"/root/testdata/{sf}").collect()}
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    small = [d for d in docs if len(d.text or "") < 4000]
    assert len(got) == len(docs) and len(small) > 100
    assert all(got[d.doc_id] == plain_row(d.doc_id, d.text) for d in small)
