"""Toxicity: disguised words are read back through a noisy channel, then the restored text is scored.

A stretch that may be disguised (digits and signs among letters, repeated letters, letters set apart) is a lattice: each character
may stand for itself, for a letter that it looks like, for nothing (a repetition, a separator), or end a word. Viterbi's algorithm
finds the cheapest path, under the prices below and a character model of four letters, exactly and at any length. The model counts
the letters of all documents. Plain words have one path and stay; what is restored is scored beside what was there.

Scoring goes by words and beginnings of words of four to six letters that tell the labels apart (a likelihood ratio). A document's
score is that of a logistic model over those it has, or the share of documents labelled 1 among those with its worst one, whichever is
higher; the share counts alone only for what documents labelled 0 all but never have. Both are fitted on about `SAMPLE` labelled documents, those with the smallest hash; near copies there count about once: of
those that agree in the least hash of their words, one stays, for each of three hashes in turn. Everything else covers all documents.

Null text: as the empty text; both get the score of a text without any of these words. No labelled documents: score 0. Several labels
of one document: the highest. Equal rows get equal scores; very long texts are read whole. Columns named like the results are replaced.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Generic, TypeVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.llm.common import small_batches, written

#: Codes of the character model: 0 ends a word, 1 to 26 are letters, 27 is any other letter.
CODES, OTHER = 28, 27
#: What a character can stand for besides itself.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Prices in bits: a sign read as a letter, a sign that ends a word, a separator or a repeated character left out.
SWAP, BREAK, DROP, REPEAT = 2.0, 4.0, 1.0, 1.0
#: About how many labelled documents the classifier is fitted on.
SAMPLE = 20_000
#: Features at most, documents labelled toxic that have one at least, its likelihood ratio (G squared) at least.
FEATURES, LEAST_DOCS, LEAST_RATIO = 2048, 3, 15.0
BEGINNINGS = (4, 5, 6)
#: The fit: weight of the squared weights against the sum of losses, steps; documents of average kind added to a feature's share.
RIDGE, STEPS, PRIOR = 0.1, 1500, 5.0
#: The share counts alone for features with this part of documents labelled 0 at most.
ALONE = 0.01
THRESHOLD = 0.7
#: Known tokens that a worker keeps.
KNOWN = 1 << 18

LETTERS = re.compile(r"[^\W\d_]+")
TWICE = re.compile(r"([^\W\d_])\1")
APART = re.compile(r"(?<!\S)\S{1,2}(?:\s+\S{1,2}(?!\S)){2,}")
AROUND, AFTER = "\"'(¿*[{<#%&~^", ".,;:?!\"')…]}>*#%&~^"
Item = TypeVar("Item")
_CODE = bytes(c - 96 if 97 <= c <= 122 else c - 64 if 65 <= c <= 90 else OTHER if c >= 0xC2 else 0 for c in range(256))
_INNER = bytes(range(0x80, 0xC0))


def grams(text: str) -> np.ndarray:
    """Each letter or end of a word with the three letters of its word before it, as one number."""
    x = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_CODE, _INNER), np.uint8).astype(np.int64)
    x = np.concatenate((np.zeros(3, np.int64), x, [0]))
    one = x[2:-1]
    two = np.where(one == 0, 0, x[1:-2])
    three = np.where(two == 0, 0, x[:-3])
    found = ((three * CODES + two) * CODES + one) * CODES + x[3:]
    return found[found > 0]


def letter_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n) over all texts: at most 28 ** 4 rows at any size of the corpus."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CODES**4, np.int64)
        for b in batches:
            for text in b.column(0):
                found, k = np.unique(grams(text.as_py() or ""), return_counts=True)
                n[found] += k
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["gram", "n"])

    return small_batches(docs.select(text_col)).mapInArrow(each, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def letter_costs(counts: pd.DataFrame) -> np.ndarray:
    """Bits of each code after each three, by interpolation with shorter contexts (Witten and Bell)."""
    n = np.zeros(CODES**4)
    n[counts["gram"].to_numpy(np.int64)] = counts["n"].to_numpy(np.float64)
    n = n.reshape((CODES,) * 4)
    p = np.full(CODES, 1.0 / CODES)
    for order in range(4):
        c = n.sum(axis=tuple(range(3 - order)))
        kinds, total = (c > 0).sum(-1, keepdims=True), c.sum(-1, keepdims=True)
        p = (c + np.maximum(kinds, 1) * p) / (total + np.maximum(kinds, 1))
    return -np.log2(p).ravel()


def _undoubled(word: str, forks: list[int], cost: list[float] | np.ndarray) -> str:
    """As `restored`, for letters whose repetitions lie four or more apart: what stays of one has no part in the next one's choice."""
    c = [0, 0, 0, *(ord(ch) - 96 if "a" <= ch <= "z" else OTHER for ch in word), 0]
    gone = []
    for fork in forks:
        f = fork + 3
        x, y, z, same = c[f - 3], c[f - 2], c[f - 1], c[f]
        keep, drop = cost[((x * CODES + y) * CODES + z) * CODES + same], REPEAT
        long, short = [y, z, same], [x, y, z]
        for code in c[f + 1 : f + 4]:
            keep += cost[((long[-3] * CODES + long[-2]) * CODES + long[-1]) * CODES + code]
            drop += cost[((short[-3] * CODES + short[-2]) * CODES + short[-1]) * CODES + code]
            long.append(code)
            short.append(code)
        if drop < keep:
            gone.append(fork)
    for fork in reversed(gone):
        word = word[:fork] + word[fork + 1 :]
    return word


def restored(stretch: str, cost: list[float] | np.ndarray) -> str:
    """The likeliest plain reading of a stretch in lower case, by Viterbi's algorithm. A state is the last three letters of the word so
    far, with whether the character before was read as a letter, so that its repetition can be left out."""
    square = CODES * CODES
    # By 2 * last three letters + (1: read as a letter): bits and path.
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    before = ""
    forks = [k for k, ch in enumerate(stretch) if not ch.isalpha() or (k and ch == stretch[k - 1])]
    if stretch.isalpha() and all(b - a > 3 for a, b in itertools.pairwise(forks)):
        return _undoubled(stretch, forks, cost)
    at, n = 0, len(stretch)
    for fork in (*forks, n):
        # Up to the next fork each state has one way on. A single state's bits decide nothing any more: it takes the rest as it is.
        while at < fork:
            if len(states) == 1:
                ((key, (_, path)),) = states.items()
                last = key >> 1
                for ch in stretch[max(at, fork - 3) : fork]:
                    last = last % square * CODES + (ord(ch) - 96 if "a" <= ch <= "z" else OTHER)
                states = {last * 2 + 1: (0.0, (path, stretch[at:fork]))}
                at = fork
                break
            ch = stretch[at]
            code = ord(ch) - 96 if "a" <= ch <= "z" else OTHER
            now: dict[int, tuple[float, tuple | None]] = {}
            for key, (bits, path) in states.items():
                last = key >> 1
                to = (last % square * CODES + code) * 2 + 1
                bits += cost[last * CODES + code]
                held = now.get(to)
                if held is None or bits < held[0]:
                    now[to] = (bits, (path, ch))
            states = now
            at += 1
        if fork == n:
            break
        ch, before = stretch[fork], stretch[fork - 1] if fork else ""
        code = 0 if not ch.isalpha() else ord(ch) - 96 if "a" <= ch <= "z" else OTHER
        looks = "" if code else LOOKS.get(ch, "")
        ways: list[tuple[int, float, tuple | None]] = []
        for key, (bits, path) in states.items():
            last = key >> 1
            if code:
                ways.append(((last % square * CODES + code) * 2 + 1, bits + cost[last * CODES + code], (path, ch)))
            else:
                for x in looks:
                    k = ord(x) - 96
                    ways.append(((last % square * CODES + k) * 2 + 1, bits + SWAP + cost[last * CODES + k], (path, x)))
                end = bits + (cost[last * CODES] if last else 0.0)
                ways.append((0, end + (BREAK if looks else 0.0), (path, " ") if last else path))
                if not looks and not ch.isdigit():
                    ways.append((last * 2, bits + DROP, path))
            if key & 1 and ch == before:
                ways.append((key, bits + REPEAT, path))
        now = {}
        for to, bits, path in ways:
            held = now.get(to)
            if held is None or bits < held[0]:
                now[to] = (bits, path)
        states = now
        at = fork + 1
    _, path = min(((b + (cost[(key >> 1) * CODES] if key > 1 else 0.0), p) for key, (b, p) in states.items()), key=lambda x: x[0])
    out: list[str] = []
    while path is not None:
        path, ch = path
        out.append(ch)
    return "".join(reversed(out))


def readings(plain: str) -> list[str]:
    """The words of a restored stretch, and all of it as one word."""
    words = plain.split()
    return [*words, "".join(words)] if len(words) > 1 else words


def of_token(token: str, cost: list[float]) -> tuple[str, ...]:
    """The words of a token without white space: those that stand there, and those that it may stand for."""
    if token.isalpha() and not TWICE.search(token):
        return (token,)
    words = LETTERS.findall(token)
    core = token.lstrip(AROUND).rstrip(AFTER)
    if words and (not core.isalpha() or TWICE.search(core)):
        words += readings(restored(core, cost))
    return tuple(dict.fromkeys(words))


def features(words: Iterable[str]) -> set[str]:
    """Whole words, with a space at the end, and beginnings of longer ones."""
    found = {w[:k] for w in words for k in BEGINNINGS if len(w) > k}
    found.update(w + " " for w in words)
    return found


@dataclass
class Reader(Generic[Item]):
    """What `make` makes of a text's words, token by token; what it made of a token is kept for the next text."""

    cost: list[float]
    make: Callable[[tuple[str, ...]], tuple[Item, ...]]
    known: dict[str, tuple[Item, ...]] = field(default_factory=dict)

    def read(self, text: str | None) -> set[Item]:
        low = (text or "").lower()
        found: set[Item] = set()
        known = self.known
        for token in set(low.split()):
            made = known.get(token)
            if made is None:
                made = self.make(of_token(token, self.cost))
                if len(known) >= KNOWN:
                    known.clear()
                known[token] = made
            if made:
                found.update(made)
        for m in APART.finditer(low):
            found.update(self.make(tuple(readings(restored(re.sub(r"\s+", " ", m.group()), self.cost)))))
        return found


@dataclass
class Model:
    cost: np.ndarray
    #: What each feature adds in the logistic model, and its share of documents labelled 1.
    weights: dict[str, tuple[float, float]]
    bias: float

    def scores(self, texts: Iterator[str | None]) -> Iterator[float]:
        # A word without the first four characters of any feature has none.
        heads, weights = {f[: BEGINNINGS[0]] for f in self.weights}, self.weights

        def hits(words: tuple[str, ...]) -> tuple[str, ...]:
            some = [w for w in words if (w + " ")[: BEGINNINGS[0]] in heads]
            return tuple(f for f in features(some) if f in weights) if some else ()

        reader = Reader(self.cost.tolist(), hits)
        for text in texts:
            found = [weights[f] for f in sorted(reader.read(text))]
            logit = self.bias + math.fsum(w for w, _ in found)
            yield max(1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, logit)))), *(share for _, share in found), 0.0)


def sampled(docs: DataFrame, labels: DataFrame, label_col: str, text_col: str, id_col: str, most: int) -> DataFrame:
    """(text, label) of about `most` labelled documents, those with the smallest hash of the id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("label"))
    share = min(1.0, most / max(1, known.count()))
    chosen = written(known.where(F.xxhash64("__id").cast("double") / float(1 << 64) + 0.5 <= share), "labelled")
    # Twice the sample is the bound; should chance exceed it, Spark chooses the join by itself.
    small = F.broadcast(chosen) if chosen.count() <= 2 * most else chosen
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(small, "__id").select("text", "label")


def ratio(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """G squared of a feature in `a` of `n` and in `b` of `m` documents, negative where it is rarer in the first."""
    cells = [(a, n), (n - a, n), (b, m), (m - b, m)]
    both = [a + b, n + m - a - b]
    total = np.zeros(len(a))
    for k, (seen, size) in enumerate(cells):
        expected = both[k % 2] * size / (n + m)
        total += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-300)), 0.0)
    return np.where(a * m > b * n, total, -total)


def fitted(rows: list[tuple[int, list[int]]], size: int) -> tuple[np.ndarray, float]:
    """Weights, none below 0, and bias of a logistic model over present features, by accelerated gradient steps."""
    y = np.array([r[0] for r in rows], np.float64)
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    col = np.array([c for r in rows for c in r[1]], np.int64)
    n = max(1, len(rows))
    w, b = np.zeros(size), math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    v, c = w.copy(), b
    widest = max([1, *(len(r[1]) for r in rows)])
    often = np.bincount(col, minlength=size) if len(col) else np.zeros(size)
    # A bound on the curvature, feature by feature: its documents' features all move together at worst.
    rate = 1.0 / (0.25 * widest * often / n + RIDGE / n)
    rate_b = 1.0 / (0.25 * (widest + 1))
    for k in range(STEPS):
        p = 1.0 / (1.0 + np.exp(-(c + np.bincount(doc, v[col], len(rows)))))
        g = np.bincount(col, (p - y)[doc], size) / n + RIDGE / n * v
        w2, b2 = np.maximum(v - rate * g, 0.0), c - rate_b * float((p - y).mean())
        step = k / (k + 3)
        v, c = w2 + step * (w2 - w), b2 + step * (b2 - b)
        w, b = w2, b2
    return w, b


def trained(docs: DataFrame, labels: DataFrame, corpus: DataFrame, label_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id", most: int = SAMPLE) -> Model:
    """A model from the labelled ones of `docs`; letters are counted over all of `corpus`."""
    cost = letter_costs(letter_counts(corpus, text_col).toPandas())
    send = docs.sparkSession.sparkContext.broadcast(cost)
    sample = sampled(docs, labels, label_col, text_col, id_col, most)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(send.value.tolist(), lambda words: words)
        for b in batches:
            words = [sorted(reader.read(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(words, pa.list_(pa.string()))], ["label", "words"])

    texts = written(small_batches(sample.select("label", "text")).mapInArrow(read, "label int, words array<string>"), "words")
    for seed in range(3):
        least = F.array_min(F.transform("words", lambda w, k=seed: F.xxhash64(w, F.lit(k))))
        first = F.struct(F.xxhash64("words"), "label", "words")
        texts = texts.groupBy(F.coalesce(least, F.lit(0)).alias("h")).agg(F.min(first).alias("f")).select("h", "f.label", "f.words")
    texts = written(texts, "texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for b in batches:
            for label, words in zip(b.column("label"), b.column("words"), strict=True):
                seen[label.as_py() > 0].update(features(words.as_py()))
        names = [*seen[0], *(f for f in seen[1] if f not in seen[0])]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in (seen[1], seen[0]))], ["feature", "a", "b"])

    sizes = {bool(r.toxic): r.n for r in texts.groupBy((F.col("label") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n, m = sizes.get(True, 0), sizes.get(False, 0)
    if not n:
        return Model(cost, {}, -math.inf)
    counts = small_batches(texts).mapInArrow(count, "feature string, a bigint, b bigint").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))

    @F.pandas_udf(T.DoubleType())
    def telling(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.round(ratio(a.to_numpy(np.float64), b.to_numpy(np.float64), n, m), 9))

    best = counts.where(F.col("a") >= LEAST_DOCS).withColumn("g", telling("a", "b")).where(F.col("g") >= LEAST_RATIO).orderBy(F.desc("g"), "feature").limit(FEATURES)
    top = best.select("feature", "a", "b").collect()
    chosen, shares = [r.feature for r in top], [(r.a + PRIOR * n / (n + m)) / (r.a + r.b + PRIOR) if r.b <= ALONE * r.a else 0.0 for r in top]
    at = {f: k for k, f in enumerate(chosen)}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(at[f] for f in features(w.as_py()) if f in at) for w in b.column("words")]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("label"), pa.array(found, pa.list_(pa.int32()))], ["h", "label", "found"])

    rows = small_batches(texts.select("h", "label", "words")).mapInArrow(hits, "h bigint, label int, found array<int>").orderBy("h").collect()
    weights, bias = fitted([(int(r.label > 0), r.found) for r in rows], len(chosen))
    return Model(cost, dict(zip(chosen, zip(weights.tolist(), shares, strict=True), strict=True)), bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds `score`, how likely label 1 is, and `predicted`."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    ready = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One after the other, so that a worker's reader is made once.
        texts: list[str | None] = []

        def feed() -> Iterator[str | None]:
            while True:
                yield texts.pop()

        scores = held.value.scores(feed())
        for b in batches:
            out = []
            for t in b.column(len(keep)):
                texts.append(t.as_py())
                out.append(round(next(scores), 6))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(out, pa.float64())], [*keep, "score"])

    schema = T.StructType([*ready.schema.fields[: len(keep)], T.StructField("score", T.DoubleType())])
    return small_batches(ready).mapInArrow(each, schema).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 3 == 1


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = trained(docs, labels.where(~held_out(F.col("doc_id"))), docs)
    marked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return score(marked, model).select("doc_id", "held_out", "score", "predicted")
