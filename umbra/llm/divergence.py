"""Source divergence: how the sources of a language differ in their words, and by which words each stands out.

Terms are counted for each language and source where the texts are read, terms of too few documents of their language go, and shares
become whole billionths. Languages are cut into blocks of terms; a task turns a block's rows into dense int64 tiles, terms by sources,
and adds up the differences of all pairs of sources by broadcasting one tile against the other. Tasks return a matrix of partial
sums and the best terms of each source; sums and heaps are merged by Spark. Sources are cut into blocks too, so a tile is bounded
in both directions, and the number of a language's parts follows its number of terms.

Null text, language or source: read as the empty string. Empty texts have no terms; their group still counts. A language without kept
terms has pairs of value 0. Equal rows count as often as they occur. Ties are settled by the item. Very long texts: as any other.
Empty tables give no rows. Columns other than the three named don't matter.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbra.llm.common import ASCII_UPPER, small_batches, written

#: A term is kept if this many documents of its language hold it.
LEAST_DOCS = 30
SCALE, SMOOTH = 1_000_000_000, 5
TOP = 50
#: Terms of a part of a language, terms of a tile, sources of a block, bytes that a broadcast difference takes.
PART_TERMS, TILE_TERMS, BLOCK, DIFFERENCE_BYTES = 8192, 256, 512, 1 << 23
#: Entries that a task counts before it hands them on.
HELD = 1 << 18

COUNTED = "lang string, source string, term string, n bigint, docs bigint"
SCORED = "kind string, lang string, source string, item string, value bigint"
#: ASCII letters in lower case, other ASCII to spaces, the bytes of all other characters as they are.
TERM_BYTES = bytes(c if c >= 0x80 else c | 0x20 if chr(c).isalpha() else 0x20 for c in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): partial counts of terms and of the documents that hold them, made where the texts are read."""
    read = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def batch(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            k = len(n)
            columns = [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for b in batches:
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(2)), b.column(2), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                words = terms(text.as_py())
                n.update(words)
                docs.update(set(words))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from batch(held)
                held = {}
        yield from batch(held)

    return small_batches(read).mapInArrow(each, COUNTED)


def share(n: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (n + 5) / (total + 5 * kinds)), in decimals, so that no count is too large; null without kept terms."""
    over = (n + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    under = (total + SMOOTH * kinds).cast("decimal(20,0)")
    return 1 + F.when(kinds > 0, F.call_function("div", over, under)).cast("bigint")


class _Tiles:
    """The sums of a pair of source blocks of a language, and the best terms of its sources."""

    def __init__(self, key: tuple[str, int, int], block: int) -> None:
        (self.lang, self.b, self.c), self.block = key, block
        self.names: list[str] = []
        self.heaps: dict[int, list[tuple[int, str]]] = {}

    def head(self, number: np.ndarray, p: np.ndarray, names: list[str]) -> None:
        """The sources' numbers, the share of a term that they don't have, and names. Each part begins with the same ones."""
        order = np.argsort(number)
        self.number, self.rest = number[order], p[order]
        if not self.names:
            self.names = [names[k] for k in order]
            self.first, self.second = self.number // self.block == self.b, self.number // self.block == self.c
            self.sums = np.zeros((int(self.first.sum()), int(self.second.sum())), np.int64)

    def add(self, row: np.ndarray, number: np.ndarray, p: np.ndarray, names: list[str], q: np.ndarray) -> None:
        """Cells (row, number, p) of a few terms, whose names and shares in the language are `names` and `q`."""
        at = np.searchsorted(self.number, number)
        tile = np.tile(self.rest, (len(q), 1))
        tile[row, at] = p
        left, right = tile[:, self.first], tile[:, self.second]
        step = max(1, DIFFERENCE_BYTES // (8 * max(1, right.size)))
        for k in range(0, left.shape[1], step):
            self.sums[k : k + step] += np.abs(left[:, k : k + step, None] - right[:, None, :]).sum(0)
        if self.b == self.c:
            value = p - q[row]
            low = np.array([self.heaps[k][-1][0] if len(self.heaps.get(k, ())) == TOP else 0 for k in range(len(self.number))])
            new: dict[int, list[tuple[int, str]]] = {}
            for k in np.flatnonzero((value > 0) & (-value <= np.where(low == 0, -1, low)[at])).tolist():
                new.setdefault(int(at[k]), []).append((-int(value[k]), names[row[k]]))
            for k, found in new.items():
                self.heaps[k] = heapq.nsmallest(TOP, [*self.heaps.get(k, ()), *found])

    def results(self) -> Iterator[pa.RecordBatch]:
        first, second = np.flatnonzero(self.first).tolist(), np.flatnonzero(self.second).tolist()
        for i, sums in zip(first, self.sums.tolist(), strict=True):
            rows = [("pair", self.lang, self.names[i], self.names[j], v) for j, v in zip(second, sums, strict=True) if i != j]
            if self.b != self.c:
                rows += [(kind, lang, item, source, v) for kind, lang, source, item, v in rows]
            rows += [("term", self.lang, self.names[i], t, -v) for v, t in self.heaps.get(i, ())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.string()] * 4, pa.int64()), strict=True)] if rows else [pa.array([], t) for t in (*[pa.string()] * 4, pa.int64())], ["kind", "lang", "source", "item", "value"])


def _summed(batches: Iterator[pa.RecordBatch], block: int, tile_terms: int) -> Iterator[pa.RecordBatch]:
    """Rows (lang, b, c, part, term, q, cells) in this order: sums and best terms for each (lang, b, c) in this task."""
    tiles: _Tiles | None = None
    for b in batches:
        lang, first, second, term = (b.column(k).to_pylist() for k in ("lang", "b", "c", "term"))
        q = b.column("q").to_numpy(zero_copy_only=False)
        cells = b.column("cells")
        ends = cells.offsets.to_numpy()
        flat = cells.values
        number, p, name = (flat.field(k) for k in range(3))
        number, p = number.to_numpy(zero_copy_only=False), p.to_numpy(zero_copy_only=False)
        # A term row goes into one tile with those after it, up to the next head, and `tile_terms` at most.
        k, rows = 0, b.num_rows
        while k < rows:
            key = (lang[k], first[k], second[k])
            if tiles is None or (tiles.lang, tiles.b, tiles.c) != key:
                if tiles is not None:
                    yield from tiles.results()
                tiles = _Tiles(key, block)
            if term[k] is None:
                lo, hi = int(ends[k]), int(ends[k + 1])
                tiles.head(number[lo:hi], p[lo:hi], name[lo:hi].to_pylist())
                k += 1
                continue
            to = k
            while to < rows and to - k < tile_terms and term[to] is not None and (lang[to], first[to], second[to]) == key:
                to += 1
            lo, hi = int(ends[k]), int(ends[to])
            row = np.repeat(np.arange(to - k), np.diff(ends[k : to + 1]))
            tiles.add(row, number[lo:hi], p[lo:hi].astype(np.int64), term[k:to], q[k:to].astype(np.int64))
            k = to
    if tiles is not None:
        yield from tiles.results()


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, block: int = BLOCK, part_terms: int = PART_TERMS, tile_terms: int = TILE_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows, the distance to each other source, and `term` rows, what a source has more of."""
    partial = counted(docs, text_col, lang_col, source_col).repartition("lang", "term")
    term = W.partitionBy("lang", "term")
    total = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    seen = total.withColumns({"held": F.sum("docs").over(term), "in_lang": F.sum("n").over(term), "at": F.row_number().over(term.orderBy("source"))})
    kept = written(seen.where(F.col("held") >= least_docs).select("lang", "source", "term", "n", "in_lang", "at"), "kept")

    pairs = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    by_lang = kept.groupBy("lang").agg(F.sum(F.when(F.col("at") == 1, 1).otherwise(0)).alias("kinds"), F.sum("n").alias("lang_total"))
    joined = pairs.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0)
    lang = W.partitionBy("lang")
    # A language's sources, as many as its matrix has rows.
    numbered = joined.withColumns({"number": F.row_number().over(lang.orderBy("source")) - 1, "sources": F.count("*").over(lang)})
    blocks = F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / block).cast("int"))
    own = F.floor(F.col("number") / block).cast("int")
    met = F.transform(blocks, lambda b: F.struct(F.least(b, own).alias("b"), F.greatest(b, own).alias("c")))
    groups = written(numbered.withColumns({"met": met, "parts": F.greatest(F.lit(1), F.ceil(F.col("kinds") / part_terms)).cast("int")}), "groups")

    key = ["lang", "b", "c", "part"]
    heads = groups.select("lang", F.explode("met").alias("m"), "source", "number", "total", "kinds", F.sequence(F.lit(0), F.col("parts") - 1).alias("all"))
    heads = heads.select("lang", "m.b", "m.c", F.explode("all").alias("part"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("bigint").alias("q"), "number", F.coalesce(share(F.lit(0).cast("bigint"), F.col("total"), F.col("kinds")), F.lit(0)).alias("p"), "source")
    cells = kept.join(groups, ["lang", "source"]).select(
        "lang",
        F.explode("met").alias("m"),
        F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("part"),
        "term",
        share(F.col("in_lang"), F.col("lang_total"), F.col("kinds")).alias("q"),
        "number",
        share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"),
        F.lit(None).cast("string").alias("source"),
    )
    dealt = heads.unionByName(cells.select("lang", "m.b", "m.c", "part", "term", "q", "number", "p", "source")).repartition(*key)
    rows = dealt.groupBy(*key, "term").agg(F.first("q").alias("q"), F.collect_list(F.struct("number", "p", "source")).alias("cells"))
    scored = written(small_batches(rows.sortWithinPartitions(*key, "term").select(*key, "term", "q", "cells")).mapInArrow(lambda batches: _summed(batches, block, tile_terms), SCORED), "scored")

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    between = scored.where("kind = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    best = scored.where("kind = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    columns = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", "value", "rank"]
    return between.select(*columns("pair")).unionByName(best.select(*columns("term")))


query = audit

ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, '{ASCII_UPPER}', '{ASCII_UPPER.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
gn AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
ln AS (SELECT lang, sum(n) AS n FROM c GROUP BY lang),
q AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (sum(c.n) + {SMOOTH})) // (any_value(ln.n) + {SMOOTH} * any_value(v.v)) AS q FROM c JOIN ln USING (lang) JOIN v USING (lang) GROUP BY lang, term),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {SMOOTH})) // (coalesce(gn.n, 0) + {SMOOTH} * v.v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
best AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
u AS (SELECT * FROM pairs UNION ALL SELECT * FROM best),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
