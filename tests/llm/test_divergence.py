"""The source audit against plain Python on awkward rows, at several block sizes, and against its SQL on a table."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from umbra.llm import divergence
from umbra.llm.queries import oracle_sql, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows: list[tuple], least: int) -> list[tuple]:
    count: dict[tuple, Counter] = defaultdict(Counter)
    held: dict[str, Counter] = defaultdict(Counter)
    for text, lang, source in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = TERM.findall(low)
        count[lang or "", source or ""].update(found)
        held[lang or ""].update(set(found))
    out = []
    for lang, own in held.items():
        kept = sorted(t for t, k in own.items() if k >= least)
        sources = sorted(s for x, s in count if x == lang)
        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])

        def shares(c: Counter, kept: list = kept) -> list[int]:
            n = sum(c[t] for t in kept)
            return [1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept]

        p, q = {s: shares(count[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o) for o in sources if o != s]
            best = [(a - b, t) for a, b, t in zip(p[s], q, kept, strict=True) if count[lang, s][t] and a > b]
            for part, found in (("pair", pairs), ("term", best)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1]))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ranked if part == "pair" else ranked[:50])]
    return sorted(out)


def awkward() -> list[tuple]:
    rng = random.Random(2)
    words = ["The", "the", "a", "Ünder", "ünder", "b9c", "x_y", "don't", "日本", "K", "K"] + [f"w{k}q{'z' * k}" for k in range(70)]
    rows = []
    for _ in range(400):
        lang, source = rng.choice(["en", "de", "", None]), rng.choice(["s1", "s2", "s3", "s4", "s5", "", None])
        rows.append((" ".join(rng.choices(words[: rng.randint(5, 80)], k=rng.randint(0, 60))), lang, source))
    return rows + [(None, "en", "s1"), ("", "only", "one"), ("none kept", "two", "b"), (None, "two", None), ("the " * 5000, "en", "s2")] + rows[:3] * 2


@pytest.mark.parametrize(("block", "part_terms", "tile_terms"), [(512, 8192, 256), (2, 7, 3), (1, 1, 1)])
def test_audit_equals_plain_version(spark, block, part_terms, tile_terms):
    rows = awkward()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(6)
    got = divergence.audit(df, least_docs=12, block=block, part_terms=part_terms, tile_terms=tile_terms).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 12)
    assert max(r.rank for r in got if r.part == "term") == 50


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_shares_are_exact_beyond_doubles(spark):
    n, total, kinds = 987_654_321_987, 12_345_678_901_234, 77_777_777
    got = spark.range(1).select(divergence.share(*(divergence.F.lit(x).cast("bigint") for x in (n, total, kinds))).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * kinds)


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in queries()["op11_divergence"](spark, d).collect())
    con = duckdb.connect()
    con.register("documents", spark.read.parquet(f"{d}/documents.parquet").toPandas())
    assert got == sorted(con.execute(oracle_sql()["op11_divergence"]).fetchall()) and len(got) > 100
