"""Quality rules: measures of each document, and lines that recur across the documents of a host.

Lines are normalised (lower case, digit runs to 0, white space to single spaces) and hashed. For each host the documents
that hold a line are counted; lines above the limit are boilerplate and count as removed, and a document that they leave
too little of is rejected. Exact copies of one document aren't several: distinct whole texts are counted, apart from white space.

Null and empty texts have no words and fail. A null host is a host of its own. Equal rows get equal results each. Very long texts are read
whole, one at a time. Columns of `keep` named like a measure are an error; `accepted` returns all columns as they were.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.llm.common import small_batches, written

#: A line is above the limit if it stands in more distinct documents of its host than this, however many the host has.
LEAST_DOCS = 20
#: What must be left of a document without such lines: words, and a share of its words.
LEFT_WORDS, LEFT_SHARE = 10, 0.3
MIN_WORDS, MAX_REPEATED = 10, 20
WINDOW = 5

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
DIGITS = re.compile(r"[0-9]+")
LINE = "array<struct<hash:bigint,words:bigint>>"
MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
TEXTS = "whole bigint"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a run of `window` words found twice or more."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    # Runs get numbers, one word longer at a time; pairs of numbers stay below n * n.
    run = ids
    for k in range(1, window):
        pairs = run[: n - k] * len(seen) + ids[k:]
        _, run = np.unique(pairs, return_inverse=True)
    twice = np.bincount(run)[run] > 1
    ends = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(ends, at, 1)
    np.add.at(ends, at + window, -1)
    return int((np.cumsum(ends[:n]) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, list[tuple[int, int]], int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (hash, words) of distinct lines, the hash of the whole text's words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    weights: dict[int, int] = {}
    for line in lines:
        flat = " ".join(DIGITS.sub("0", line.lower()).split())
        h = xxhash.xxh64_intdigest(flat.encode("utf-8", "surrogatepass")) - (1 << 63)
        weights[h] = weights.get(h, 0) + len(line.encode("utf-8", "surrogatepass").split())
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        list(weights.items()),
        xxhash.xxh64_intdigest(b" ".join(words)) - (1 << 63),
    )


def measured(docs: DataFrame, text_col: str, host_col: str, keep: list[str]) -> DataFrame:
    """`keep`, row (a number), host, the measures, the lines and the texts' hashes: computed once, written."""
    read = docs.select(*keep, F.monotonically_increasing_id().alias("row"), F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")).alias("host"), F.col(text_col).alias("__text"))
    passed = read.drop("__text").schema

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [measure(t) for t in b.pop("__text")]
            for i, c in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")):
                b[c] = np.array([x[i] for x in done], np.int64)
            b["lines"] = [[{"hash": h, "words": w} for h, w in x[5]] for x in done]
            b["whole"] = np.array([x[6] for x in done], np.int64)
            yield b

    out = T.StructType([*passed.fields, *T.StructType.fromDDL(f"{MEASURES}, lines {LINE}, {TEXTS}").fields])
    return written(small_batches(read).mapInPandas(each, out), "measured")


def judged(docs: DataFrame, text_col: str = "text", host_col: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, the measures, removed_words, base_failed and kept: one row a document."""
    table = measured(docs, text_col, host_col, list(keep))
    lines = table.select("row", "host", "whole", F.explode("lines").alias("line")).select("row", "host", "whole", "line.*")
    # How many distinct texts hold a line; what one task has seen of a line is counted before it moves.
    held = lines.select("host", "hash", "whole").distinct()
    above = held.groupBy("host", "hash").count().where(F.col("count") > LEAST_DOCS).select("host", "hash")
    removed = lines.join(written(above, "above"), ["host", "hash"]).groupBy("row").agg(F.sum("words").alias("removed"))
    left = F.col("n_words") - F.col("removed_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    whole = table.drop("lines", "whole").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed", F.lit(0)))
    judged_rows = whole.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (left >= LEFT_WORDS) & (left >= F.lit(LEFT_SHARE) * F.col("n_words")))
    return judged_rows.drop("row", "host", "removed")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that are kept, unchanged."""
    marked = docs.withColumns({"__hash": F.xxhash64(text_col, host_col)})
    verdicts = judged(marked, text_col, host_col, (id_col, "__hash"))
    gone = verdicts.where(~F.col("kept")).select(F.col(id_col).alias("__id"), F.col("__hash").alias("__gone")).distinct()
    return marked.join(gone, marked[id_col].eqNullSafe(gone["__id"]) & (marked["__hash"] == gone["__gone"]), "left_anti").drop("__hash")


def query(docs: DataFrame) -> DataFrame:
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")
