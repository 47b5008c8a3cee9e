"""Secrets: known shapes, and strings whose characters are too evenly spread to be words. Built-in SQL functions only.

A candidate string gets the Shannon entropy of a window of `WIDTH` characters slid along it. The counts of the window's characters
are kept as the window moves, five bits each: one count goes down, one goes up, and so the window's sum of c*log2(c) changes by
two looked-up steps; time is linear in the string. What entropy is too high depends on the string's class of characters.

Null text: no spans. Empty text: no spans. Very long texts and strings: as any other. Equal rows get equal spans each; spans that begin
together are listed by kind. Empty tables give empty tables. Other columns pass through untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.spans import Rule, count_kind, listed, masked, of_kinds, with_spans

BASE = ("assign", "access", "hex")
WIDTH = 20

ASSIGN = r"(?:(?i)(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: A candidate has a digit and letters within one unbroken run.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"

#: Least entropy in bits a character, by what characters the string has.
FLOORS = {"hex": 3.0, "lower": 3.5, "mixed": 3.7}
def _counted_up(run: str, least: int) -> str:
    """A pattern of the run's beginnings of `least` characters or more."""
    return run[:least] + "(?:" + "(?:".join(run[least:]) + ")?" * len(run[least:])


#: Pieces that make no secret: placeholders and counted-up characters. They are cut out, and what is left is scored.
PIECES = rf"(?i)example|sample|dummy|placeholder|changeme|x{{6,}}|0{{8,}}|{_counted_up('1234567890', 7)}|{_counted_up('abcdefghijklmnopqrstuvwxyz', 6)}"
#: Whole strings that look random and are none: UUIDs, numbers.
ALLOWED = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[0-9+/_=-]+$"
#: Names and paths: parts of one case, the first letter aside, each with up to four digits behind; a quarter digits at most.
PART = r"(?:[A-Z]?[a-z]{1,14}|[A-Z]{1,14})?[0-9]{0,4}"
NAMED = rf"^{PART}(?:[-_/]+{PART})+$"
#: Digests named as such.
ALLOWED_NEAR = r"(?i)(?:sha-?(?:1|256|512)|md5|digest|integrity|checksum|commit)[\"':=\x20-]*$"


#: Characters with a count of their own; all others share the count before the first.
COUNTED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
#: Bits of a count, and counts in a long.
BITS, PER_LONG = 5, 12


def window_entropy(value: Column, width: int = WIDTH) -> Column:
    """The highest Shannon entropy, in bits a character, of any `width` characters in a row (31 at most); 0 for shorter strings."""
    if not 1 < width < 1 << BITS:
        raise ValueError("a window has 2 to 31 characters")
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 2)])
    cost = lambda c: F.element_at(table, c.cast("int") + 1)
    longs = len(COUNTED) // PER_LONG + 1
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(COUNTED), c))
    left = F.concat(F.array_repeat(F.lit(-1), width), codes)
    steps = F.zip_with(codes, F.slice(left, F.lit(1), F.length(value)), lambda came, gone: F.struct(came.alias("came"), gone.alias("gone")))
    ones = F.array(*[F.lit(1 << BITS * k).cast("bigint") for k in range(PER_LONG)])
    one = lambda code: F.get(ones, F.pmod(code, F.lit(PER_LONG)))
    place = lambda code: F.call_function("div", code, F.lit(PER_LONG)).cast("int")
    number = lambda counts, code: F.call_function("div", F.get(counts, place(code)), one(code)) % (1 << BITS)
    changed = lambda counts, code, by: F.transform(counts, lambda x, k: F.when(k == place(code), x + by * one(code)).otherwise(x))

    def move(a: Column, s: Column) -> Column:
        gone, came = s["gone"], s["came"]
        full = gone >= 0
        kept = F.when(full, changed(a["counts"], gone, -1)).otherwise(a["counts"])
        less = F.when(full, number(a["counts"], gone)).otherwise(F.lit(1))
        more = number(a["counts"], came) - F.when(gone == came, 1).otherwise(0)
        total = a["sum"] + F.when(full, cost(less - 1) - cost(less)).otherwise(0.0) + (cost(more + 1) - cost(more))
        n = a["n"] + 1
        return F.struct(n.alias("n"), total.alias("sum"), F.when(n >= width, F.least(a["low"], total)).otherwise(a["low"]).alias("low"), changed(kept, came, 1).alias("counts"))

    first = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.lit(float(width * width)).alias("low"), F.array_repeat(F.lit(0).cast("bigint"), longs).alias("counts"))
    bits = F.aggregate(steps, first, move, lambda a: F.lit(math.log2(width)) - a["low"] / F.lit(float(width)))
    return F.when(F.length(value) >= width, F.round(bits, 6)).otherwise(F.lit(0.0))


def _score(value: Column, before: Column, after: Column) -> Column:
    """0 for what the allow-list has; else how far the entropy of what it leaves lies above the floor of its class, from 0.5 on."""
    digits = F.length(F.regexp_replace(value, "[^0-9]+", ""))
    allowed = value.rlike(ALLOWED) | (value.rlike(NAMED) & (4 * digits <= F.length(value))) | before.rlike(ALLOWED_NEAR)
    left = F.when(allowed, F.lit("")).otherwise(F.regexp_replace(value, PIECES, ""))
    floor = lambda x: F.when(x.rlike("^[0-9a-fA-F]+$"), F.lit(FLOORS["hex"])).when(x.rlike("[a-z]") & x.rlike("[A-Z]"), F.lit(FLOORS["mixed"])).otherwise(F.lit(FLOORS["lower"]))
    # One element, so that what is left is cut and the entropy worked out once.
    bits = F.transform(F.array(left), lambda x: F.struct(window_entropy(x).alias("bits"), floor(x).alias("floor"), x.rlike("[A-Za-z]").alias("letters")))
    above = F.transform(bits, lambda m: F.when(~m["letters"] | (m["bits"] < m["floor"]), F.lit(0.0)).otherwise(F.least(F.lit(1.0), 0.5 + (m["bits"] - m["floor"]) / 2)))
    return F.get(above, F.lit(0))


def rules(least: float = 0.5) -> list[Rule]:
    return [
        Rule("assign", ASSIGN, lambda t: t.rlike(r"[:=]"), lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12),
        Rule("access", ACCESS, lambda t: t.contains("AKIA")),
        Rule("hex", HEX),
        Rule("entropy", CANDIDATE, lambda t: t.rlike("[0-9]"), None, _score, least),
    ]


def find(docs: DataFrame, text_col: str = "text", out: str = "secrets", least: float = 0.5) -> DataFrame:
    """Adds `out`, the spans of secrets; those found by entropy alone reach the score `least`."""
    return with_spans(docs, text_col, rules(least), out)


def redact(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents with each secret replaced by `[SECRET]`; other columns as they were, `n_chars`, if there, counted anew."""
    found = find(docs, text_col, "__secrets", least)
    clean = masked(found, text_col, "__secrets", lambda s: F.lit("[SECRET]"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size("__secrets") > 0, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    found = find(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return found.select(
        "doc_id",
        *[count_kind(F.col("secrets"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(listed(of_kinds(F.col("secrets"), BASE)), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )
