"""Records that lack something: what is asked elsewhere, and from which source each field is filled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.sky import num

#: Neighbours fainter than a star by more than this don't matter.
NEIGHBOUR_MAG = 5.0


def routed(events: DataFrame, g_max: Column, flags: Column, all_stars: Column, enabled: Column) -> DataFrame:
    """Adds route and why: whether an event's star (mag) is looked up in an online archive for neighbours and flags.

    g_max: how deep the local catalog goes, null without one; flags: whether it has the stars' flags; all_stars: whether it has all stars, also those
    of bad quality. A complete catalog serves by itself as far as neighbours that matter lie within it.
    """
    complete = g_max.isNotNull() & F.coalesce(flags, F.lit(False)) & F.coalesce(all_stars, F.lit(False))
    deep = F.coalesce(F.col("mag") + NEIGHBOUR_MAG <= g_max, F.lit(False))
    why = (
        F.when(~F.coalesce(enabled, F.lit(True)), "switched off")
        .when(complete & deep, "covered by the local catalog")
        .when(complete, "neighbours beyond the local catalog")
        .when(g_max.isNull(), "no local catalog")
        .when(~F.coalesce(flags, F.lit(False)), "no flags in the local catalog")
        .otherwise("bad-quality stars are left out of the local catalog")
    )
    return events.withColumn("why", why).withColumn("route", F.when(F.col("why").isin("switched off", "covered by the local catalog"), "local").otherwise("archive"))


@dataclass(frozen=True)
class Source:
    """Where fields can come from: a table with at most one row for each value of `keys`, and the records' expressions for those."""

    table: DataFrame
    keys: Mapping[str, Column]


def blank(c: Column) -> Column:
    """Null, empty, or what exports write for nothing."""
    return c.isNull() | F.trim(c.cast("string")).isin("", "nan", "NaN", "none")


def filled(records: DataFrame, sources: Mapping[str, Source], chains: Mapping[str, Sequence[tuple[str, Column]]]) -> DataFrame:
    """`records` with their blank fields filled, and for each field of `chains` a column `<field>_from`: `own`, the first link of its chain that has a
    value, or null.

    chains: for each field its links in order, each a name and an expression over the records' columns and, as `<source>.<column>`, those of the
    source of that name. Records that lack none of the fields are split off and meet no source; the others join each source once.
    """
    fields = list(chains)
    lacking = blank(F.col(fields[0]))
    for f in fields[1:]:
        lacking = lacking | blank(F.col(f))
    whole = records.where(~lacking).withColumns({f"{f}_from": F.lit("own") for f in fields})
    todo = records.where(lacking)
    for name, source in sources.items():
        held = source.table.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(source.keys)], F.struct(*[c for c in source.table.columns if c not in source.keys]).alias(name))
        keyed = todo.withColumns({f"__r{i}": x for i, x in enumerate(source.keys.values())})
        on = F.col("__k0") == F.col("__r0")
        for i in range(1, len(source.keys)):
            on = on & (F.col(f"__k{i}") == F.col(f"__r{i}"))
        todo = keyed.join(held, on, "left").drop(*[f"__{t}{i}" for t in "kr" for i in range(len(source.keys))])
    values, origins = {}, {}
    for f, links in chains.items():
        value, origin = F.when(~blank(F.col(f)), F.col(f)), F.when(~blank(F.col(f)), F.lit("own"))
        for name, x in links:
            value, origin = value.when(~blank(x), x), origin.when(~blank(x), F.lit(name))
        values[f], origins[f"{f}_from"] = value.cast(records.schema[f].dataType), origin
    # All from the records as they were: a filled field is no source for the next one.
    rest = [F.col(c) for c in records.columns if c not in chains]
    done = todo.select(*rest, *[x.alias(c) for c, x in (values | origins).items()])
    return whole.unionByName(done)


def combined_magnitude(star: Column, body: Column) -> Column:
    """Of star and body together; the star's alone without the body's."""
    both = -2.5 * F.log10(F.pow(num(10), -0.4 * star) + F.pow(num(10), -0.4 * body))
    return F.coalesce(both, star)
