"""Periodic runs: stretches of words that repeat with a period, found by divide and conquer (Main and Lorentz).

Words become numbers. A stretch is halved; a run over the middle has two whole periods on one side of it at least (runs have four),
so Z-functions that start at the middle tell how far each period goes on to the left and to the right. What touches an end of the
stretch and would go on beyond it was found whole at a level above. Of several periods of one interval the smallest stays.

Only words that can lie in a run are searched: each occurs four times or more in its text, and each run of three words within a
run three times or more. That follows from a run's four periods and six words, so nothing is lost, and ordinary prose
leaves little to search.

Null text: no words. Empty text: no words, no runs. Very long texts: as any other; time grows with n log n. Equal rows
get equal results each, ties are settled by start and period. Empty tables give empty tables. Columns named like the results
are replaced by them; other columns stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from umbra.llm.common import small_batches

#: A run has this many periods at least, and this many words.
PERIODS, LEAST = 4, 6
#: Up to so many periods at a middle are followed one by one.
FEW = 4
FOUND = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Run(NamedTuple):
    start: int
    length: int
    period: int


def interned(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def z_function(s: list[int]) -> np.ndarray:
    """How many items from each place on equal those from the first on; 0 at the first itself."""
    n = len(s)
    z = [0] * n
    lo = hi = 0
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return np.array(z, np.int64)


def _stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Where runs can lie: maximal intervals of words that pass both counts."""
    n = len(ids)
    if n < LEAST:
        return []
    often = np.bincount(ids)[ids] >= PERIODS
    whole = np.flatnonzero(often[:-2] & often[1:-1] & often[2:])
    if len(whole) < LEAST - 2:
        return []
    size = int(ids.max()) + 1
    _, two = np.unique(ids[whole] * size + ids[whole + 1], return_inverse=True)
    _, three, n_three = np.unique(two * size + ids[whole + 2], return_inverse=True, return_counts=True)
    at = whole[n_three[three] >= PERIODS - 1]
    inside = np.zeros(n + 2, np.int8)
    for k in range(3):
        inside[at + k + 1] = 1
    edges = np.diff(inside)
    found = zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True)
    return [(a, b) for a, b in found if b - a >= LEAST]


def _matched(x: np.ndarray, at: int, period: int) -> int:
    """How many items from `at` on equal those a period earlier."""
    other = np.flatnonzero(x[at:] != x[at - period : len(x) - period])
    return int(other[0]) if len(other) else len(x) - at


def _crossing(x: np.ndarray, mid: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, period) of the repetitions over `mid` with two periods on its left side, then on its right side."""
    n, out = len(x), []
    for seq, m, turned in ((x, mid, False), (x[::-1], n - mid, True)):
        # From the middle backwards: how far words equal those a period earlier.
        period = np.arange(1, m // 2 + 1)
        if not (seq[m - 1 - period] == seq[m - 1]).any():
            continue
        behind = z_function(seq[:m][::-1].tolist())[period]
        far = behind >= period
        p, b = period[far], behind[far] + period[far]
        # From the middle on: a few periods are compared as they are, many by one more Z-function.
        if len(p) <= FEW:
            f = np.array([_matched(seq, m, k) for k in p.tolist()], np.int64)
        else:
            ahead = seq[m:].tolist()
            f = z_function([*ahead, -1, *seq[m - int(p[-1]) :].tolist()])[len(ahead) + 1 + int(p[-1]) - p]
        fits = b + f >= np.maximum(LEAST, PERIODS * p)
        p, b, f = p[fits], b[fits], f[fits]
        out.append((mid - f, mid + b, p) if turned else (mid - b, mid + f, p))
    return out


def runs(ids: np.ndarray) -> list[Run]:
    """All runs by start, then period."""
    n = len(ids)
    best: dict[tuple[int, int], int] = {}
    todo = _stretches(ids)
    while todo:
        lo, hi = todo.pop()
        kinds = len(set(ids[lo:hi].tolist()))
        # In a run, all words but those of a period stand there before: five or more.
        if hi - lo - kinds < LEAST - 1:
            continue
        mid = (lo + hi) // 2
        one = np.array([[lo], [hi], [1]])
        for start, end, period in [one - [[lo], [lo], [0]]] if kinds == 1 else _crossing(ids[lo:hi], mid - lo):
            start, end = start + lo, end + lo
            open_left = (start > 0) & (ids[np.maximum(start - 1, 0)] == ids[start - 1 + period])
            open_right = (end < n) & (ids[np.minimum(end, n - 1)] == ids[end - period])
            whole = ~(open_left | open_right)
            for s, e, p in zip(start[whole].tolist(), end[whole].tolist(), period[whole].tolist(), strict=True):
                if p < best.get((s, e), n):
                    best[s, e] = p
        if kinds > 1:
            todo += [(a, b) for a, b in ((lo, mid), (mid, hi)) if b - a >= LEAST]
    return sorted(Run(s, e - s, p) for (s, e), p in best.items())


def kept_words(n: int, found: list[Run]) -> np.ndarray:
    """Which words stay when each run is cut down to its first period."""
    ends = np.zeros(n + 1, np.int64)
    for r in found:
        ends[r.start + r.period] += 1
        ends[r.start + r.length] -= 1
    return np.cumsum(ends[:n]) == 0


def strongest(found: list[Run]) -> Run | None:
    """The run with most periods; ties: the smallest start, then period."""
    return max(found, key=lambda r: (Fraction(r.length, r.period), -r.start, -r.period), default=None)


def looped(words: list[bytes], loop_from: int, loop_period: int) -> list[bytes]:
    """The words up to a place, then those from there on, `loop_period` of them over and over, at the same length in all."""
    tail = len(words) - loop_from
    return [*words[:loop_from], *(words[loop_from + i % loop_period] for i in range(tail))]


def _detected(docs: DataFrame, text: Column, columns: dict[str, tuple[str, Callable]], loop: Column, keep: list[str]) -> DataFrame:
    """`keep` of `docs` with columns made from (words, runs): name to (type, function). Where `loop` isn't null, its text is looped first."""
    names = [c for c in keep if c not in columns]
    ready = docs.select(*[F.col(f"`{c}`") for c in names], text.alias("__text"), loop.cast("bigint").alias("__loop"))
    made = T.StructType.fromDDL(", ".join(f"{k} {t}" for k, (t, _) in columns.items()))
    types = to_arrow_schema(made)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list[object]] = []
            for t, g in zip(b.column("__text"), b.column("__loop"), strict=True):
                words, g = (t.as_py() or "").encode("utf-8", "surrogatepass").split(), g.as_py()
                if words and g is not None:
                    a = g % len(words)
                    words = looped(words, a, 1 + (len(words) - a) // (3 + g % 8))
                found = runs(interned(words))
                rows.append([make(words, found) for _, make in columns.values()])
            new = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *new], [*names, *columns])

    return small_batches(ready).mapInArrow(each, T.StructType([*ready.schema.fields[: len(names)], *made.fields]))


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds `runs`, all of a text's, and `collapsed`, the text's words with each run cut down to its first period."""
    columns = {
        "runs": (RUNS, lambda words, found: [r._asdict() for r in found]),
        "collapsed": ("string", lambda words, found: b" ".join(w for w, k in zip(words, kept_words(len(words), found), strict=True) if k).decode("utf-8", "surrogatepass")),
    }
    return _detected(docs, F.col(f"`{text_col}`"), columns, F.lit(None), docs.columns)


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def digests(docs: DataFrame, text: Column, loop: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds the columns of FOUND: the number of runs, the strongest one, and hashes of the runs and of the collapsed text."""
    best = lambda f: lambda words, found: None if not found else f(strongest(found))
    make = [
        lambda words, found: len(found),
        best(lambda r: r.start),
        best(lambda r: r.length),
        best(lambda r: r.period),
        best(lambda r: 1000 * r.length // r.period),
        lambda words, found: _hex("".join(f"{r.start},{r.length},{r.period}\n" for r in found).encode()),
        lambda words, found: _hex(b" ".join(w for w, k in zip(words, kept_words(len(words), found), strict=True) if k)),
    ]
    columns = {f.name: (f.dataType.simpleString(), m) for f, m in zip(T.StructType.fromDDL(FOUND).fields, make, strict=True)}
    return _detected(docs, text, columns, F.lit(None) if loop is None else loop, docs.columns if keep is None else keep)


def query(docs: DataFrame) -> DataFrame:
    """Texts of ids whose crc32 ends in 0 are looped first, as the contract has it; a null id is looped no more than others."""
    h = F.crc32(F.col("doc_id").cast("string"))
    loop = F.when(h % 10 == 0, F.floor(h / 10).cast("bigint"))
    return digests(docs, F.col("text"), loop, ["doc_id"])
