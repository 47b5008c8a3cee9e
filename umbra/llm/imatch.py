"""I-Match fingerprints: of a text's terms those within a band of inverse document frequency, distinct and sorted, hashed for
several random subsets of the lexicon. Built-in SQL functions only.

Terms are words (runs of letters and digits, lower case), known by their 64-bit hash. The band has terms that stand in at least
`RAREST` of all documents. A document has so many distinct terms on average, so the band has at most that number / RAREST terms,
whatever the size of the corpus: some 300,000 for pages of 150 distinct words. It is one array of sorted lists, by the leading
bits of the hash, and reaches the tasks as the result of a subquery.

The first part of a fingerprint hashes all of the text's terms in the band. Part (r, l) hashes those whose hash under r ends
in l zero bits, for six hashes and subsets of an eighth of the lexicon down to 1/4096: large subsets tell copies from near
copies, small ones still agree when half of a text is new. Likeness is the share of the parts
that are equal, of those for which either text has terms; 1 if neither has any.

Null and empty texts have no terms: an empty fingerprint part each. Equal texts have equal fingerprints. Very long texts: as any
other. A null id stands before all others, rows of one id follow each other by a hash of the text. Empty tables give empty tables. Only the id and the
text are read, so other columns and their names don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbra.llm.common import words_by

#: Leading bits of a term's hash that name its list in the band.
LIST_BITS = 16
#: The band, as shares of all documents: rarer terms are names and slips, more frequent ones carry no content.
RAREST, COMMONEST = 0.0005, 0.25
LARGEST, SMALLEST = 3, 12
HASHES = 6
#: Documents in one range of the query that finds each one's successor, and ranges at most.
RANGE_ROWS, RANGES = 2000, 1 << 14


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    words = words_by(F.lower(text), r"[^\p{L}\p{N}]")
    return F.transform(F.array_distinct(words), lambda w: F.xxhash64(w))


def band(docs: DataFrame, text_col: str = "text") -> Column:
    """A scalar subquery: the terms inside the band, as an array of 2^LIST_BITS sorted lists."""
    read = docs.select(F.coalesce(text_col, F.lit("")).alias("t"))
    frequency = read.select(F.explode(terms(F.col("t"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = read.agg(F.count("*").alias("n"))
    total = n.scalar()
    inside = frequency.where((F.col("df") >= F.greatest(F.lit(2.0), total * F.lit(RAREST))) & (F.col("df") <= F.greatest(F.lit(2.0), total * F.lit(COMMONEST))))
    lists = inside.groupBy(_list_of(F.col("term")).alias("no")).agg(F.array_sort(F.collect_list("term")).alias("terms"))
    every = docs.sparkSession.range(1 << LIST_BITS).select(F.col("id").cast("int").alias("no"), F.array().cast("array<bigint>").alias("terms"))
    full = lists.unionByName(every).groupBy("no").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "terms"))), lambda x: x["terms"])).scalar()


def _list_of(term: Column) -> Column:
    return F.shiftrightunsigned(term, 64 - LIST_BITS).cast("int")


def in_band(found: Column, lists: Column) -> Column:
    """The terms inside the band, sorted."""
    return F.array_sort(F.filter(found, lambda t: F.array_contains(F.get(lists, _list_of(t)), t)))


def _spread(r: int) -> Callable[[Column], Column]:
    return lambda t: F.struct(t.alias("t"), F.pmod(F.xxhash64(t, F.lit(r)), F.lit(2 << SMALLEST)).alias("h"))


def _digest(found: Column) -> Column:
    return F.when(F.size(found) > 0, F.lower(F.right(F.lpad(F.hex(F.xxhash64(found)), 16, "0"), F.lit(8)))).otherwise(F.lit(""))


def _divides(by: int) -> Callable[[Column], Column]:
    return lambda x: x["h"] % by == 0


def with_fingerprint(df: DataFrame, text_col: str, bits: Column, out: str) -> DataFrame:
    """Adds `out`, an array of strings of 8 hex digits, or '' for a subset without terms of the text."""
    names = [F.col(f"`{c}`") for c in df.columns]
    # The subquery gets a name first: it may not stand inside a function of an array's elements.
    now = df.select(*names, bits.alias("__band")).select(*names, in_band(terms(F.coalesce(text_col, F.lit(""))), F.col("__band")).alias("__t"))
    whole = _digest(F.col("__t")).alias("__whole")
    first = [F.filter(F.transform("__t", _spread(r)), _divides(1 << LARGEST)).alias(f"__l{r}_{LARGEST}") for r in range(HASHES)]
    now = now.select(*names, whole, *first)
    # Each level filters the one before it, so all levels together cost about two passes over the first.
    for level in range(LARGEST, SMALLEST + 1):
        now = now.select(
            *names,
            "__whole",
            *[f"__p{r}_{k}" for r in range(HASHES) for k in range(LARGEST, level)],
            *[_digest(F.col(f"__l{r}_{level}.t")).alias(f"__p{r}_{level}") for r in range(HASHES)],
            *[F.filter(f"__l{r}_{level}", _divides(2 << level)).alias(f"__l{r}_{level + 1}") for r in range(HASHES)],
        )
    parts = [F.col(f"__p{r}_{k}") for r in range(HASHES) for k in range(LARGEST, SMALLEST + 1)]
    return now.select(*names, F.array("__whole", *parts).alias(out))


def likeness(a: Column, b: Column) -> Column:
    pairs = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: (p["x"] != "") | (p["y"] != ""))
    equal = F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))
    return F.when(F.size(pairs) == 0, F.lit(1.0)).otherwise(equal / F.size(pairs))


def with_next(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Adds `next_<c>`: `c` of the following row by `order` (a long, a null one first; equal ones by `__tie`), of the first
    row after the last.

    Quantiles of `order` cut the rows into ranges of a few thousand; a value that fills several ranges, such as null, is dealt over
    them by `__tie`, a hash. The first row of each range also goes to the range before it, where it only serves as the last one's
    successor. The data shuffle once, and no task sees more than its range. What the driver sees are quantiles and first rows,
    RANGES at most.
    """
    keyed = df.withColumn("__o", F.coalesce(F.col(order).cast("bigint"), F.lit(-(1 << 63))))
    places = keyed.select("__o", "__tie")
    count = places.count()
    ranges = max(1, min(RANGES, -(-count // RANGE_ROWS)))
    share = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    edges = (places.agg(F.percentile_approx("__o", share, 100 * ranges)).first()[0] or []) if ranges > 1 else []
    ranged = keyed.withColumn("__range", _range_of(F.col("__o"), F.col("__tie"), edges))
    heads = sorted(tuple(r) for r in ranged.groupBy("__range").agg(F.min(F.struct("__o", "__tie")).alias("h")).select("__range", "h.__o", "h.__tie").collect())
    before = {no: heads[k - 1][0] for k, (no, _, _) in enumerate(heads)}
    table = df.sparkSession.createDataFrame([(no, o, tie, before[no]) for no, o, tie in heads], "__range int, __ho bigint, __ht bigint, __before int")
    first = (F.col("__o") == F.col("__ho")) & (F.col("__tie") == F.col("__ht"))
    own, also = F.struct(F.col("__range").alias("range"), F.lit(0).alias("extra")), F.struct(F.col("__before").alias("range"), F.lit(1).alias("extra"))
    # RANGES rows at most.
    dealt = ranged.join(F.broadcast(table), "__range").select(*[F.col(f"`{c}`") for c in df.columns], "__o", F.explode(F.when(first, F.array(own, also)).otherwise(F.array(own))).alias("__at"))
    following = W.partitionBy("__at.range").orderBy("__at.extra", "__o", "__tie")
    seen = dealt.select(*[F.col(f"`{c}`") for c in df.columns], F.col("__at.extra").alias("__extra"), *[F.lead(c).over(following).alias(f"next_{c}") for c in columns])
    return seen.where("__extra = 0").drop("__extra")


def _range_of(value: Column, tie: Column, edges: list[int]) -> Column:
    """The number of the range that holds a row: edges below its value, and of those equal to it a share by its tie."""
    if not edges:
        return F.lit(0)
    side = max(1, round(len(edges) ** 0.5))
    chunks = [edges[k : k + side] for k in range(0, len(edges), side)]
    longs = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])

    def below(than: Callable[[Column, Column], Column]) -> Column:
        # Chunks whose last edge is below are below as a whole; of the next one, its edges are looked at.
        whole = F.size(F.filter(longs([c[-1] for c in chunks]), lambda e: than(e, value)))
        rest = F.slice(longs(edges), whole * side + 1, F.lit(side))
        return whole * side - F.greatest(whole * side - len(edges), F.lit(0)) + F.size(F.filter(rest, lambda e: than(e, value)))

    low, high = below(lambda e, v: e < v), below(lambda e, v: e <= v)
    share = tie.cast("double") / float(1 << 64) + 0.5
    spread = F.greatest(high - low - 1, F.lit(0))
    return F.when(high == low, low).otherwise(F.least(low + 1 + F.floor(share * (spread + 1)), high)).cast("int")


def edited(text: Column, following: Column) -> Column:
    """The text whose last half, rounded down, gave way to as much of the head of the following one."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def query(docs: DataFrame) -> DataFrame:
    bits = band(docs)
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("__tie"))
    marked = with_fingerprint(read, "text", bits, "parts")
    paired = with_next(marked, "doc_id", ["text", "parts"]).select("doc_id", "text", "parts", "next_parts", edited(F.col("text"), F.col("next_text")).alias("edited"))
    digests = paired.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "parts", "next_parts", "edited", F.sha2("edited", 256).alias("edited_sha256"))
    both = with_fingerprint(digests, "edited", bits, "edited_parts")
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.array_join("parts", "-").alias("fingerprint"),
        F.array_join("edited_parts", "-").alias("edited_fingerprint"),
        F.round(likeness(F.col("parts"), F.col("edited_parts")), 6).alias("near_edited"),
        F.round(likeness(F.col("parts"), F.col("next_parts")), 6).alias("near_next"),
    )
