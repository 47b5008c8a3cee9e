"""Mixing sources to target weights, to the word, without replacement beyond whole passes.

Each source has a target of words. Whole passes over it are taken as they are; the rest is drawn. Documents are dealt over
output shards by hash, so each source has a block of so many words in each shard, and a splitting tree deals the exact
number to draw: at each node a hypergeometric draw decides how much falls to the left half of the shards, the remainder to
the right, down to single shards. In its shard each source's documents are in a random order (by hash); the first ones up to
the quota are taken, the one at the quota's edge in part. So draws are disjoint, sums are exact, and no order over all is needed.
Where documents must stay whole, each shard's edge is taken or left, and what that is too much or too little goes to the next shard.

Null text: size 0. A null source is a source of its own, after all others. Equal rows share one place in the order and split
what falls on it evenly, rounded down. No documents: no rows. Very long texts are documents like any other. Reruns give the same mix: all chance comes from hashes and seeds.
Other columns come through whatever their names; `n_chars`, where there is one, is counted anew for a text that is cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbra.llm.common import words_by, written

WHITE = r"[\x20\x09-\x0D]"
WEIGHTS, SHARE, CAP = (3.0, 1.0, 2.0), 1.5, 2.0
SEED = 7
#: Words for one shard, and least and most shards.
SHARD_WORDS, SHARDS = 1 << 22, (64, 1 << 16)
#: Numpy's sampler takes fewer words than this; above, the same law is drawn from by `drawn_above`.
NUMPY_MOST = 10**9


def size_of(text: Column) -> Column:
    return F.size(words_by(F.coalesce(text, F.lit("")), WHITE)).cast("bigint")


def _log_ratio(a: int, d: int) -> tuple[float, int]:
    """log((a + d)! / a!) less d * log(a + 1), and a + 1; by Stirling's series where that is exact to the last digits."""
    b = a + 1
    if b + min(d, 0) < 64:
        return math.lgamma(b + d) - math.lgamma(b) - d * math.log(b), b
    series = lambda x: 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return (b + d - 0.5) * math.log1p(d / b) - d + series(b + d) - series(b), b


def drawn_above(left: int, right: int, want: int, rng: np.random.Generator) -> int:
    """How many of `want` words, drawn without replacement, come from the left: a hypergeometric draw for any sizes.

    Ratio of uniforms with Stadlober's hat, 2 sqrt(2/e) and 3 - 2 sqrt(3/e) wide. The law is compared with its value at the mode: the
    logarithms that are large cancel as one quotient of whole numbers, so nothing is lost at 10^12 words or more.
    """
    n = left + right
    mode = (want + 1) * (left + 1) // (n + 2)
    mean = want * left / n
    wide = math.sqrt(mean * (right / n) * ((n - want) / (n - 1)) + 0.5) * 2 * math.sqrt(2 / math.e) + 3 - 2 * math.sqrt(3 / math.e)
    low, high = max(0, want - right), min(left, want)

    def log_law(d: int) -> float:
        up, x = _log_ratio(mode, d)
        up2, y = _log_ratio(right - want + mode, d)
        down, v = _log_ratio(left - mode, -d)
        down2, w = _log_ratio(want - mode, -d)
        return -(up + up2 + down + down2) + d * math.log1p((v * w - x * y) / (x * y))

    while True:
        u, v = 1.0 - rng.random(), rng.random()
        got = mode + math.floor(mean - mode + 0.5 + wide * (v - 0.5) / u)
        if low <= got <= high and 2 * math.log(u) <= log_law(got - mode):
            return got


def split(sizes: np.ndarray, draw: int, seed: tuple[int, ...]) -> np.ndarray:
    """How much of `draw` falls to each block, as if words were drawn one by one without replacement."""
    out = np.zeros(len(sizes), np.int64)
    upto = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    nodes = [(0, len(sizes), int(draw))]
    while nodes:
        lo, hi, want = nodes.pop()
        if hi - lo == 1:
            out[lo] = want
            continue
        if not want or want == upto[hi] - upto[lo]:
            out[lo:hi] = sizes[lo:hi] if want else 0
            continue
        mid = (lo + hi) // 2
        left, right = int(upto[mid] - upto[lo]), int(upto[hi] - upto[mid])
        rng = np.random.default_rng([*seed, lo, hi])
        if not left or not right:
            got = min(left, want)
        elif left + right < NUMPY_MOST:
            got = int(rng.hypergeometric(left, right, want))
        else:
            got = drawn_above(left, right, want, rng)
        nodes += [(lo, mid, got), (mid, hi, want - got)]
    return out


def targets(by_source: DataFrame, weights: Iterable[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, none above `cap` times its source.

    The level L at which sum(min(cap * size, L * weight)) is all words of the mix: with sources sorted by cap / weight and the
    first ones capped, it is the largest of (all - caps before) / (weights from here on). One row a source.
    """
    weights = list(weights)
    no = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    known = by_source.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (no + 1).cast("int"))).withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    levels = known.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every)).withColumn("level", (F.col("total") - before) / rest)
    return levels.withColumn("level", F.max("level").over(every)).select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """Of a document: where it stands in its shard's order, and a number for its shard."""
    return F.xxhash64(F.lit(SEED), F.col(id_col), F.col(text_col)), F.xxhash64(F.lit(SEED + 1), F.col(id_col))


def cuts(sized: DataFrame) -> DataFrame:
    """(source, shard, passes, source_size, target, edge, part, edge_size, edge_rows): from rows (source, shard, place, size) of a written table.

    Whole passes, the place where the draw in this shard ends, and how much of each row at that place is taken; a null edge: all are.
    """
    by_shard = written(sized.groupBy("source", "shard").agg(F.sum("size").alias("n")), "shards")
    aims = targets(by_shard.groupBy("source").agg(F.sum("n").alias("source_size")))
    want = F.round("target").cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0).cast("bigint")
    aims = aims.withColumn("passes", passes).withColumn("draw", want - F.col("passes") * F.col("source_size"))
    both = by_shard.alias("b").join(aims.alias("a"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("b.source", "b.shard", "b.n", "a.source_size", "a.target", "a.passes", "a.draw")

    def deal(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("shard")
        name = b["source"].iloc[0]
        seed = (SEED, xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass")) if isinstance(name, str) else 1 << 33)
        return b.assign(quota=split(b["n"].to_numpy(np.int64), int(b["draw"].iloc[0]), seed))

    quotas = written(both.groupBy("source").applyInPandas(deal, "source string, shard int, n bigint, source_size bigint, target double, passes bigint, draw bigint, quota bigint"), "quotas")
    places = sized.groupBy("source", "shard", "place").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    upto = W.partitionBy("source", "shard").orderBy("place")
    run = places.withColumn("upto", F.sum("size").over(upto)).alias("p")
    q = quotas.alias("q")
    at = run.join(q, F.col("p.source").eqNullSafe(F.col("q.source")) & (F.col("p.shard") == F.col("q.shard"))).where((F.col("upto") > F.col("quota")) & (F.col("upto") - F.col("size") <= F.col("quota")))
    edges = at.select(F.col("p.source").alias("s"), F.col("p.shard").alias("h"), F.col("place").alias("edge"), F.floor((F.col("quota") - F.col("upto") + F.col("size")) / F.col("rows")).cast("bigint").alias("part"), (F.col("size") / F.col("rows")).cast("bigint").alias("edge_size"), F.col("rows").alias("edge_rows"))
    return quotas.join(edges, quotas["source"].eqNullSafe(edges["s"]) & (quotas["shard"] == edges["h"]), "left").select("source", "shard", "passes", "source_size", "target", "edge", "part", "edge_size", "edge_rows")


def take_or_leave(parts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of a source's edges to take whole, shard by shard, so that the words taken stay within half a document of the parts."""
    out, over = np.zeros(len(parts), bool), 0
    for k, (part, size) in enumerate(zip(parts.tolist(), sizes.tolist(), strict=True)):
        over += part
        if 2 * over >= size:
            out[k], over = True, over - size
    return out


def whole_edges(cut: DataFrame) -> DataFrame:
    """`cut` with each edge taken whole or left. Rows at one place are taken or left together."""
    cut = written(cut, "cuts")
    known = "source string, shard int, edge_rows bigint, part bigint, edge_size bigint"

    def settle(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("shard")
        rows, size = b["edge_rows"].to_numpy(np.int64), b["edge_size"].to_numpy(np.int64)
        return b.assign(part=np.where(take_or_leave(b["part"].to_numpy(np.int64) * rows, size * rows), size, 0))

    settled = cut.where("edge IS NOT NULL").select("source", "shard", "edge_rows", "part", "edge_size").groupBy("source").applyInPandas(settle, known)
    c, e = cut.drop("part").alias("c"), settled.select(F.col("source").alias("s"), F.col("shard").alias("h"), "part").alias("e")
    return c.join(e, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")), "left").drop("s", "h")


def drawn(size: Column, place: Column, edge: Column, part: Column) -> Column:
    """Words drawn of a row beyond whole passes."""
    return F.when(edge.isNull() | (place < edge), size).when(place == edge, F.least(part, size)).otherwise(0).cast("bigint")


def planned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, int]:
    """A written table (id, source, size, place, shard) of all documents, their cuts, and the number of shards."""
    place, number = keyed(docs, id_col, text_col)
    base = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size"), place.alias("place"), number.alias("number")), "sizes")
    words = base.agg(F.sum("size")).first()[0] or 0
    shards = 1 << int(np.ceil(np.log2(min(max(words / SHARD_WORDS, SHARDS[0]), SHARDS[1]))))
    sized = base.withColumn("shard", F.pmod("number", F.lit(shards)).cast("int")).drop("number")
    return sized, cuts(sized), shards


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole_docs: bool = False) -> DataFrame:
    """The mix itself: the columns of `docs`, a row for each whole pass and one for a draw, in shuffled shards.

    A document drawn in part keeps its first words, joined by spaces; with `whole_docs` none is drawn in part, and each source's
    target is met to within a document. Documents without words take none and are not in it.
    """
    _, cut, shards = planned(docs, id_col, text_col, source_col)
    if whole_docs:
        cut = whole_edges(cut)
    place, number = keyed(docs, id_col, text_col)
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), place.alias("place"), F.pmod(number, F.lit(shards)).cast("int").alias("shard"), size_of(F.col(text_col)).alias("size"))
    here, c = marked.where("size > 0").alias("here"), cut.alias("c")
    rows = here.join(c, F.col(f"here.d.`{source_col}`").cast("string").eqNullSafe(F.col("c.source")) & (F.col("here.shard") == F.col("c.shard")))
    draw = drawn(F.col("size"), F.col("place"), F.col("edge"), F.col("part"))
    copies = F.concat(F.array_repeat("size", F.col("passes").cast("int")), F.when(draw > 0, F.array(draw)).otherwise(F.array().cast("array<bigint>")))
    each = rows.select("d", "size", "here.shard", "place", F.posexplode(copies).alias("copy", "words"))
    whole, text = F.col("words") == F.col("size"), F.col(f"d.`{text_col}`")
    cut_text = F.when(whole, text).otherwise(F.array_join(F.slice(words_by(text, WHITE), F.lit(1), F.col("words").cast("int")), " "))
    shuffled = each.withColumn("cut", cut_text).repartition("shard").sortWithinPartitions("shard", F.xxhash64("place", "copy"))

    def column(name: str) -> Column:
        old = F.col(f"d.`{name}`")
        if name == text_col:
            return F.col("cut").alias(name)
        return (F.when(whole, old).otherwise(F.length("cut").cast(docs.schema[name].dataType)) if name == "n_chars" else old).alias(name)

    return shuffled.select(*[column(x) for x in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    sized, cut, _ = planned(docs)
    s, c = sized.alias("s"), cut.alias("c")
    both = s.join(c, F.col("s.source").eqNullSafe(F.col("c.source")) & (F.col("s.shard") == F.col("c.shard")))
    return both.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("passes") * F.col("size") + drawn(F.col("size"), F.col("place"), F.col("edge"), F.col("part"))).alias("taken"))
