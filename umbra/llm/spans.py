"""Places of regular-expression matches, in code points, by SQL functions alone."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,value:string,score:double>"


@dataclass(frozen=True)
class Rule:
    """One kind of span.

    pattern: Java pattern, its matches are the proposals, leftmost and not overlapping.
    near: cheap exact condition that any text with a match meets; spares the others the pattern.
    confirm: condition on the matched text; failing matches are dropped.
    score: from the matched text, the `around` characters before it and those after it, to a score from 0 to 1.
    """

    kind: str
    pattern: str
    near: Callable[[Column], Column] | None = None
    confirm: Callable[[Column], Column] | None = None
    score: Callable[[Column, Column, Column], Column] | None = None
    least: float = 0.0
    around: int = 48


def running(values: Column, kind: str, combine: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """Running results of an associative function over an array of longs, each with its own value: `combine(so far, value)`.
    `values` is a column of its own, not an expression, as it's read once for each chunk.

    A fold that appends copies its array at each step. So the array is cut into about as many chunks as a chunk has elements; only
    a chunk, and the list of chunks, are folded: n elements cost n^1.5 copied longs, a second for a million.
    """
    base = F.lit(zero).cast("bigint")

    def fold(xs: Column) -> Column:
        first = F.struct(base.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(xs, first, lambda a, x: F.struct(combine(a["at"], x).alias("at"), F.array_append(a["out"], combine(a["at"], x)).alias("out")))["out"]

    side = F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1))
    chunks = F.transform(F.sequence(F.lit(0), side - 1), lambda k: fold(F.slice(values, k * side + 1, side)))
    ends = fold(F.transform(chunks, lambda c: F.when(F.size(c) > 0, F.element_at(c, -1)).otherwise(base)))
    whole = F.flatten(F.zip_with(chunks, F.concat(F.array(base), F.slice(ends, F.lit(1), side - 1)), lambda c, before: F.transform(c, lambda x: combine(before, x))))
    return F.when(F.size(values) <= 32, fold(values)).otherwise(whole).cast(kind)


#: Matches of its kind before and after a match that count as its surroundings.
SIDE = 5


def with_spans(docs: DataFrame, text_col: str, rules: Sequence[Rule], out: str) -> DataFrame:
    """Adds `out`: array of spans (start, rank, end, kind, value, score), sorted by start and then by the order of `rules`.

    A null text has no spans. Each rule runs its pattern once over texts that may match, and a second time over
    those that do, for the gaps between matches. What stands around a match comes from the gaps and matches next to it, so
    no step counts characters from the text's start; time grows with the text, whatever the number of matches.
    """
    text, none = F.col(text_col), F.array().cast(f"array<{SPAN}>")
    names = [F.col(f"`{c}`") for c in docs.columns]
    tag = f"__{out}"
    found = docs.select(
        *names,
        *[F.when(text.isNotNull() & (r.near(text) if r.near else F.lit(True)), F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))).alias(f"{tag}_m{i}") for i, r in enumerate(rules)],
    )
    col = lambda c, i: F.col(f"{tag}_{c}{i}")
    split = found.select(*[F.col(f"`{c}`") for c in found.columns], *[F.when(F.size(col("m", i)) > 0, F.split(text, r.pattern, -1)).alias(f"{tag}_p{i}") for i, r in enumerate(rules)])
    # Lengths of each match and what lies before it; their running sums are where matches end.
    measured = split.select("*", *[F.when(F.size(col("m", i)) > 0, F.zip_with(F.slice(col("p", i), F.lit(1), F.size(col("m", i))), col("m", i), lambda p, m: F.length(p).cast("bigint") + F.length(m))).alias(f"{tag}_d{i}") for i in range(len(rules))])
    placed = measured.select(
        *[F.col(f"`{c}`") for c in found.columns],
        *[F.when(F.size(col("d", i)) > 0, F.zip_with(running(col("d", i), "array<bigint>", lambda a, x: a + x), col("m", i), lambda end, m: end - F.length(m))).alias(f"{tag}_s{i}") for i in range(len(rules))],
        *[F.when(F.size(col("m", i)) > 0, x).alias(f"{tag}_{c}{i}") for i, r in enumerate(rules) if r.score for c, x in zip("th", _around(col("p", i), col("m", i), r.around), strict=True)],
    )

    def spans(i: int, r: Rule) -> Column:
        pairs = F.transform(F.arrays_zip(col("m", i).alias("m"), col("s", i).alias("s")), lambda p, k: F.struct(p["m"].alias("m"), p["s"].alias("s"), k.alias("k")))
        if r.confirm:
            pairs = F.filter(pairs, lambda p: r.confirm(p["m"]))

        def score(p: Column) -> Column:
            if not r.score:
                return F.lit(1.0)
            k, size = p["k"], F.lit(r.around)
            before = F.right(F.array_join(F.slice(col("t", i), F.greatest(2 * k - 2 * SIDE, F.lit(0)) + 1, F.least(2 * k, F.lit(2 * SIDE)) + 1), ""), size)
            after = F.left(F.array_join(F.slice(col("h", i), 2 * k + 2, F.lit(2 * SIDE + 1)), ""), size)
            return r.score(p["m"], before, after)

        made = F.transform(pairs, lambda p: F.struct(p["s"].alias("start"), F.lit(i).alias("rank"), (p["s"] + F.length(p["m"])).alias("end"), F.lit(r.kind).alias("kind"), p["m"].alias("value"), score(p).alias("score"))).cast(f"array<{SPAN}>")
        if r.least > 0:
            made = F.filter(made, lambda x: x["score"] >= r.least)
        # Every column that a function of elements reads is named here once more, so that no step is copied into that function.
        ready = (F.size(col("s", i)) > 0) & (F.size(col("m", i)) > 0)
        if r.score:
            ready = ready & (F.size(col("t", i)) > 0) & (F.size(col("h", i)) > 0)
        return F.when(ready, made).otherwise(none)

    every = F.array_sort(F.flatten(F.array(*[spans(i, r) for i, r in enumerate(rules)])))
    return placed.select(*names, every.alias(out))


def _around(pieces: Column, found: Column, around: int) -> tuple[Column, Column]:
    """The ends of gap, match, gap, match … up to the last match, and the heads of match, gap, match, gap … up to the last gap."""
    size = F.lit(around)
    pairs = lambda a, b: F.flatten(F.zip_with(a, b, lambda x, y: F.array(x, y)))
    tails = F.transform(pairs(F.slice(pieces, F.lit(1), F.size(found)), found), lambda x: F.right(x, size))
    heads = F.transform(pairs(found, F.slice(pieces, F.lit(2), F.size(found))), lambda x: F.left(x, size))
    return tails, heads


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, kinds: Sequence[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


#: Code points in a block of a text that is cut up.
CUT = 4096


def blocks(text: Column) -> Column:
    """A text as an array of blocks of CUT code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))


def piece(of: str, a: Column, b: Column) -> Column:
    """The code points from a to b (longs, end exclusive) of a text by the column of its blocks: found by number, not by counting from the start."""
    block = lambda k: F.get(F.col(of), k.cast("int"))
    i, j = F.floor(a / CUT), F.floor((b - 1) / CUT)
    x, y = (a % CUT).cast("int") + 1, ((b - 1) % CUT).cast("int") + 1
    between = F.array_join(F.slice(of, (i + 2).cast("int"), F.greatest(j - i - 1, F.lit(0)).cast("int")), "")
    return F.when(b <= a, F.lit("")).when(i == j, F.substring(block(i), x, (b - a).cast("int"))).otherwise(F.concat(F.substring(block(i), x, F.lit(CUT)), between, F.substring(block(j), F.lit(1), y)))


def masked(df: DataFrame, text_col: str, spans_col: str, mask: Callable[[Column], Column]) -> DataFrame:
    """`df` with the text's spans replaced; overlapping spans merge into the first one's mask. Texts without spans stay as they are."""
    names = [F.col(f"`{c}`") for c in df.columns]
    spans, some = F.col(f"`{spans_col}`"), F.size(f"`{spans_col}`") > 0
    cut = df.select(
        *names,
        F.when(some, blocks(F.col(f"`{text_col}`"))).alias("__blocks"),
        F.when(some, F.length(f"`{text_col}`").cast("bigint")).alias("__n"),
        F.when(some, F.transform(spans, lambda s: s["end"])).alias("__ends"),
    ).withColumn("__upto", F.when(F.size("__ends") > 0, running(F.col("__ends"), "array<bigint>", lambda a, x: F.greatest(a, x))))
    # Of each span: where the text before it starts, the farthest end of spans before it.
    seen = F.zip_with(spans, F.concat(F.array(F.lit(0).cast("bigint")), F.slice("__upto", F.lit(1), F.size(spans) - 1)), lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    marked = cut.select("*", F.when(F.size("__upto") > 0, F.filter(seen, lambda x: x["s"]["start"] >= x["e"])).alias("__fresh"))
    body = F.array_join(F.transform("__fresh", lambda x: F.concat(piece("__blocks", x["e"], x["s"]["start"]), mask(x["s"]))), "")
    done = F.when((F.size("__fresh") > 0) & (F.size("__blocks") > 0), F.concat(body, piece("__blocks", F.element_at("__upto", -1), F.col("__n")))).otherwise(F.col(f"`{text_col}`"))
    return marked.select(*[done.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])
