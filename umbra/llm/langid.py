"""Language identification by prediction by partial matching over bytes.

Each language has a tree of contexts of up to three bytes with counts of the byte that follows. A byte is coded in the longest
context known; where it is new there, an escape goes to the next shorter context, without the bytes already ruled out (method
C with exclusion), down to all bytes alike. Counts are frozen after training, so the cost of a byte depends on the three before
it only. A language's tables hold what it has seen: costs of its own runs of four, and for each context what an escape from it costs and
what then divides the counts of the next shorter one, from which any other cost follows. A text's code length is the sum of the costs of its
runs. The shortest code names the language.

Training reads whole texts of at most `TRAIN_DOCS` documents of each language, those with the smallest hash. All languages that
occur are learned. As many as fit `MODEL_BYTES` together are broadcast; where all languages need more, the texts are scored once for each group of
them, one group after the other, and the groups' best ones are compared: as a language's tables don't depend on the others, passes grow
with the number of languages. Scoring reads every text in full.

Null text, or one without a letter: `und`, score 0. Empty training set: `und`. Ties go to the first language by code point.
Very long texts are scored a megabyte at a time.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbra.llm.common import small_batches, written

ORDER = 3
#: The bound of the training sample, documents a language.
TRAIN_DOCS = 400
#: How many times TRAIN_DOCS are sorted to find the smallest hashes; the sketch errs by 5 %, chance by less.
OVERDRAW = 4
#: Languages whose tables of one row each are broadcast.
BROADCAST_LANGS = 100_000
#: Bytes of the table of one group of languages.
MODEL_BYTES = 1 << 27
CHUNK = 1 << 20
#: Costs of runs that a worker keeps.
CACHE_BYTES = 1 << 25
UNKNOWN = "und"


def symbols(text: bytes) -> np.ndarray:
    """A letter's byte in lower case, 1 to 255; all else is 0, and runs of 0 are one."""
    codes = _CLASS[np.frombuffer(text, np.uint8)]
    return codes[(codes != 0) | (np.concatenate(([1], codes[:-1])) != 0)]


_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = _CLASS[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLASS[0x80:] = np.arange(0x80, 0x100)


def _grams(codes: np.ndarray) -> np.ndarray:
    """Each symbol with the three before it, as one number of four bytes; before the text stand zeros."""
    padded = np.concatenate((np.zeros(ORDER, np.int64), codes))
    return (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]


def sample(docs: DataFrame, lang_col: str, text_col: str, id_col: str, most: int = TRAIN_DOCS) -> DataFrame:
    """(lang, text) of at most `most` documents a language: those with the smallest hash of id and text; repeated rows count as one.

    How many hashes a language has, by a sketch, tells below which value about OVERDRAW times as many lie as are wanted; only those
    are sorted, so no task gets a language's documents, however many tasks there are.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    place = F.xxhash64(F.col(id_col), F.col(text_col))
    places = written(known.select(F.col(lang_col).alias("__lang"), place.alias("__place")), "places")
    sizes = _checked(places.groupBy("__lang").agg(F.approx_count_distinct("__place").alias("__size")), "sizes")
    low = (F.col("__place").cast("double") / float(1 << 64) + 0.5) * F.col("__size") <= OVERDRAW * most
    lowest = places.join(sizes, "__lang").where(low).select("__lang", "__place").distinct()
    first = W.partitionBy("__lang").orderBy("__place")
    chosen = lowest.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= most)
    edges = _checked(chosen.groupBy("__lang").agg(F.max("__place").alias("__edge")), "edges")
    return known.join(edges, (F.col(lang_col) == F.col("__lang")) & (place <= F.col("__edge"))).select(F.col("__lang").alias("lang"), F.col(text_col).alias("text"))


def _checked(by_lang: DataFrame, name: str) -> DataFrame:
    """A table of one row a language, to be broadcast if its count is small, which is checked; else the join shuffles."""
    table = written(by_lang, name)
    return F.broadcast(table) if table.count() <= BROADCAST_LANGS else table


def counted(sampled: DataFrame) -> DataFrame:
    """(lang, gram, n): counts of each symbol with its context, four bytes as a number."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                grams, n = np.unique(np.concatenate([_grams(symbols(t.encode("utf-8", "surrogatepass"))) for t in texts]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})

    return small_batches(sampled).mapInPandas(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


#: What a language's tables take: bytes of a run of four, of a context of three, of a run of three, and of each pair of symbols.
RUN4, CONTEXT3, RUN3, PAIR = 16, 24, 16, 32


def _grouped(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their n."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, n, len(found))


class Language:
    """Costs in one language of runs of four symbols, each run a number of base `size`."""

    def __init__(self, runs: np.ndarray, n: np.ndarray, size: int) -> None:
        self.size = a = size
        self.runs, n4 = _grouped(runs, n)
        self.contexts, at3 = np.unique(self.runs // a, return_inverse=True)
        total3, kinds3 = np.bincount(at3, n4), np.bincount(at3)
        self.cost = -np.log2(n4 / (total3 + kinds3)[at3])
        self.runs3, self.n3 = _grouped(self.runs % a**3, n4)
        pairs, n2 = _grouped(self.runs3 % a**2, self.n3)
        self.n2 = np.zeros(a * a)
        self.n2[pairs] = n2
        self.n1 = np.bincount(pairs % a, n2, a)
        context2, context1 = self.runs3 // a, pairs // a
        total2, kinds2 = np.bincount(context2, self.n3, a * a), np.bincount(context2, minlength=a * a)
        total1, kinds1 = np.bincount(context1, n2, a), np.bincount(context1, minlength=a)
        total0, kinds0 = self.n1.sum(), int((self.n1 > 0).sum())
        # What a context has seen its shorter ones have seen too, so each escape leaves out just what the context before it had.
        of3 = self.n3[np.searchsorted(self.runs3, self.runs % a**3)]
        shorter = self.contexts % (a * a)
        self.after3 = self._after(total2[shorter] - np.bincount(at3, of3), kinds2[shorter] - kinds3)
        self.escape3 = -np.log2(kinds3 / (total3 + kinds3))
        self.after0 = self._after(total2, kinds2)
        every = np.arange(a * a)
        self.after2 = self._after(total1[every % a] - np.bincount(context2, self.n2[self.runs3 % (a * a)], a * a), kinds1[every % a] - kinds2)
        self.known2 = kinds2 > 0
        self.new1 = self._after(total1, kinds1)
        self.after1 = self._after(total0 - np.bincount(context1, self.n1[pairs % a], a), kinds0 - kinds1)
        self.known1 = kinds1 > 0
        self.new0 = self._after(np.array([total0]), np.array([kinds0]))
        self.last = math.log2(max(a - kinds0, 1))

    @staticmethod
    def _after(total: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What divides the counts that are left, and the bits of an escape from them; no bits where none are left."""
        some = total > 0
        whole = np.where(some, total + kinds, 1.0)
        return whole, np.where(some, -np.log2(np.where(some, kinds, 1) / whole), 0.0)

    def costs(self, runs: np.ndarray) -> np.ndarray:
        """Bits of each run's last symbol behind its first three."""
        a = self.size
        if not len(self.runs):
            return np.full(len(runs), math.log2(a))

        def place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return at, keys[at] == wanted

        at4, own4 = place(self.runs, runs)
        at3, own3 = place(self.contexts, runs // a)
        at_n3, has3 = place(self.runs3, runs % a**3)
        symbol, context2 = runs % a, runs // a % (a * a)
        context1 = context2 % a
        escaped = np.where(own3, self.escape3[at3], 0.0)
        with np.errstate(divide="ignore"):
            whole = np.where(own3, self.after3[0][at3], self.after0[0][context2])
            bits2 = escaped - np.log2(self.n3[at_n3] / whole)
            escaped = escaped + np.where(own3, self.after3[1][at3], self.after0[1][context2])
            known2 = self.known2[context2]
            n2 = self.n2[context1 * a + symbol]
            bits1 = escaped - np.log2(n2 / np.where(known2, self.after2[0][context2], self.new1[0][context1]))
            escaped = escaped + np.where(known2, self.after2[1][context2], self.new1[1][context1])
            known1 = self.known1[context1]
            n1 = self.n1[symbol]
            bits0 = escaped - np.log2(n1 / np.where(known1, self.after1[0][context1], self.new0[0][0]))
            escaped = escaped + np.where(known1, self.after1[1][context1], self.new0[1][0])
        shorter = np.where(has3, bits2, np.where(n2 > 0, bits1, np.where(n1 > 0, bits0, escaped + self.last)))
        return np.where(own4, self.cost[at4], shorter)


class Model:
    """Code lengths in each of some languages.

    counts: (lang, gram, n). seen: all symbols of the training set, if these are the counts of some of its languages.
    """

    def __init__(self, counts: pd.DataFrame, seen: np.ndarray | None = None) -> None:
        self.langs = sorted(counts["lang"].unique())
        grams = counts["gram"].to_numpy(np.int64)
        parts = np.stack([(grams >> s) & 255 for s in (24, 16, 8, 0)], 1)
        seen = np.unique(np.concatenate(([0], parts.ravel() if seen is None else seen)))
        self.size = a = len(seen) + 1  # the last symbol stands for all bytes that training never saw
        self.code = np.full(256, a - 1, np.int64)
        self.code[seen] = np.arange(len(seen))
        p = self.code[parts]
        runs, n = ((p[:, 0] * a + p[:, 1]) * a + p[:, 2]) * a + p[:, 3], counts["n"].to_numpy(np.float64)
        own = counts.groupby("lang").indices
        self.languages = [Language(runs[own[x]], n[own[x]], a) for x in self.langs]
        self._forget()

    def _forget(self) -> None:
        self.known, self.table = np.zeros(0, np.int64), np.zeros((0, len(self.langs)), np.float32)

    def costs(self, runs: np.ndarray) -> np.ndarray:
        """(run, language): costs of distinct runs. Those looked up stay for the next texts, up to CACHE_BYTES."""
        at = np.searchsorted(self.known, runs)
        new = runs[(at >= len(self.known)) | (self.known[np.minimum(at, max(len(self.known) - 1, 0))] != runs)] if len(self.known) else runs
        if len(new):
            if (len(self.known) + len(new)) * len(self.langs) * 4 > CACHE_BYTES:
                self._forget()
                new = runs
            rows = np.stack([x.costs(new) for x in self.languages], 1).astype(np.float32)
            keys = np.concatenate((self.known, new))
            order = np.argsort(keys, kind="stable")
            self.known, self.table = keys[order], np.concatenate((self.table, rows))[order]
            at = np.searchsorted(self.known, runs)
        return self.table[at]

    def lengths(self, texts: list[str]) -> np.ndarray:
        """(text, language): code lengths in bits. Texts go together up to CHUNK symbols; longer ones a chunk at a time."""
        total = np.zeros((len(texts), len(self.langs)))
        held: list[np.ndarray] = []
        owner: list[int] = []

        def done() -> None:
            found, distinct = pd.factorize(np.concatenate(held))
            order = np.argsort(distinct)
            costs = np.empty((len(distinct), len(self.langs)), np.float32)
            costs[order] = self.costs(distinct[order])
            whose = np.repeat(np.array(owner), [len(h) for h in held])
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(whose, costs[found, k], len(texts))
            held.clear()
            owner.clear()

        size, a = 0, self.size
        for i, text in enumerate(texts):
            codes = self.code[symbols(text.encode("utf-8", "surrogatepass"))]
            padded = np.concatenate((np.full(ORDER, self.code[0]), codes))
            for lo in range(0, len(codes), CHUNK):
                x = padded[lo : lo + CHUNK + ORDER]
                held.append(((x[:-3] * a + x[1:-2]) * a + x[2:-1]) * a + x[3:])
                owner.append(i)
                size += len(held[-1])
                if size >= CHUNK:
                    done()
                    size = 0
        if held:
            done()
        return total


class Models:
    """The models of all languages, in groups whose tables take `MODEL_BYTES` at most each; a group's counts come to the driver when it is made."""

    def __init__(self, counts: DataFrame, most_bytes: int = MODEL_BYTES) -> None:
        self.counts = counts
        parts = F.array(*[F.shiftright("gram", s).bitwiseAND(F.lit(255)) for s in (24, 16, 8, 0)])
        seen = counts.select(F.explode(parts).alias("s")).distinct().collect()
        self.seen = np.array(sorted(int(r.s) for r in seen), np.int64)
        runs3 = F.col("gram").bitwiseAND(F.lit((1 << 24) - 1))
        sizes = counts.groupBy("lang").agg(F.count("*").alias("runs"), F.count_distinct(F.shiftright("gram", 8)).alias("contexts"), F.count_distinct(runs3).alias("runs3")).orderBy("lang").collect()
        a = len(self.seen) + 2
        self.groups: list[list[str]] = []
        taken = 0
        for r in sizes:
            own = r.runs * RUN4 + r.contexts * CONTEXT3 + r.runs3 * RUN3 + a * a * PAIR
            taken += own
            if not self.groups or taken > most_bytes:
                self.groups.append([])
                taken = own
            self.groups[-1].append(r.lang)

    def model(self, group: list[str]) -> Model:
        return Model(self.counts.where(F.col("lang").isin(group)).toPandas(), self.seen)


def trained(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", most: int = TRAIN_DOCS, most_bytes: int = MODEL_BYTES) -> Models:
    return Models(written(counted(sample(docs, lang_col, text_col, id_col, most)), "counts"), most_bytes)


def _scored(ready: DataFrame, held: Broadcast, text_col: str) -> DataFrame:
    """`ready` without the text, with `__lang`, the best language of a model, `__bits`, its code length, and `__sum`, all languages'
    likelihoods as a multiple of its; null for a text without letters."""
    rest = [c for c in ready.columns if c not in (text_col, "__letters")]
    kept = ready.select(*[F.col(f"`{c}`") for c in rest])
    schema = kept.schema.add("__lang", "string").add("__bits", "double").add("__sum", "double")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            langs, lengths, sums = [], [], []
            letters = b.column("__letters").to_pylist()
            found = iter(m.lengths([t.as_py() for t, x in zip(b.column("__text"), letters, strict=True) if x]))
            for x in letters:
                bits = next(found) if x else None
                best = None if bits is None else int(bits.argmin())
                langs.append(None if best is None else m.langs[best])
                lengths.append(None if best is None else float(bits[best]))
                sums.append(None if best is None else float(np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum()))
            out = [b.column(b.schema.names.index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*out, pa.array(langs, pa.string()), pa.array(lengths, pa.float64()), pa.array(sums, pa.float64())], [*rest, "__lang", "__bits", "__sum"])

    # The text goes by a name of its own, as the documents' column of that name may be kept too.
    return small_batches(ready).mapInArrow(each, schema)


def predict(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """Adds `lang_pred` and `score`, the share of the best language if code lengths are taken as likelihoods."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if not models.groups:
        return docs.select(*[F.col(f"`{c}`") for c in keep]).withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    names, text = [F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`")
    ready = docs.select(*names, text.alias("__text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    send = docs.sparkSession.sparkContext.broadcast
    if len(models.groups) == 1:
        best = _scored(ready, send(models.model(models.groups[0])), "__text")
    else:
        # Written with a number for each row, by which the groups' results meet again.
        table = written(ready.withColumn("__row", F.monotonically_increasing_id()), "texts")
        # One group after the other: its model leaves the driver and the executors when its results are written.
        scored = []
        for g in models.groups:
            held = send(models.model(g))
            scored.append(written(_scored(table.select("__row", "__text", "__letters"), held, "__text"), "scored"))
            held.destroy()
        first = F.min(F.when(F.col("__bits").isNotNull(), F.struct("__bits", "__lang")))
        together = functools.reduce(DataFrame.unionByName, scored)
        least = together.groupBy("__row").agg(first.alias("b"), F.collect_list(F.struct("__bits", "__sum")).alias("all"))
        # One element a group of languages.
        total = F.aggregate("all", F.lit(0.0), lambda n, x: n + x["__sum"] * F.pow(F.lit(2.0), F.greatest(F.col("b.__bits") - x["__bits"], F.lit(-1000.0))))
        best = table.drop("__text", "__letters").join(least, "__row").select(*names, F.col("b.__lang").alias("__lang"), total.alias("__sum"))
    return best.select(*names, F.coalesce("__lang", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(1.0 / F.col("__sum"), F.lit(0.0)).alias("score"))


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4 == 2


def query(docs: DataFrame) -> DataFrame:
    models = trained(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), models).select("doc_id", "held_out", "lang_pred", F.round("score", 6).alias("score"))
