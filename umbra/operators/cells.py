"""Spatial joins on the sky: an equi-join on cells, then the exact test.

A nested loop over all pairs is what a bare distance condition plans as. Here each point of the left side is placed into every
cell that its circle can touch, the right side into its own cell; the cell is the join key, so the join shuffles both sides by
cell (or broadcasts the smaller one, if Spark finds it small), and adaptive execution splits crowded cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import sky
from umbra.functions.constants import CELL_DEG
from umbra.functions.sky import num


def touched_cells(df: DataFrame, ra: Column, dec: Column, radius: Column, size: Column | float, out: str = "cell") -> DataFrame:
    """A row for each cell that a circle (degrees) can touch: rows of declination first, in each row the columns that the circle's
    width there covers; all columns of a row that reaches a pole."""
    rows, cols = (F.round(n / num(size)).cast("bigint") for n in (180.0, 360.0))
    clip = lambda x, hi: F.least(F.greatest(x, F.lit(0)), hi)
    first, last = clip(F.floor((dec - radius + 90.0) / size), rows - 1), clip(F.floor((dec + radius + 90.0) / size), rows - 1)
    edge = F.least(F.abs(dec) + radius, num(90))
    # The circle's largest half width in right ascension: sin(width) = sin(radius) / cos(dec).
    sine = F.sin(F.radians(radius)) / F.cos(F.radians(dec))
    width = F.when((edge >= 90.0) | (sine >= 1.0), num(180)).otherwise(F.degrees(F.asin(F.least(sine, num(1)))) + 1e-9)
    whole = width >= 180.0 - size
    west, east = F.when(whole, F.lit(0)).otherwise(F.floor((ra - width) / size)), F.when(whole, cols - 1).otherwise(F.floor((ra + width) / size))
    spread = df.select("*", F.explode(F.sequence(first, last)).alias("__row"), west.alias("__west"), east.alias("__east"))
    # pmod may place a column twice only if the span is over a full turn, which `whole` rules out.
    return spread.select("*", F.explode(F.sequence("__west", "__east")).alias("__col")).withColumn(out, (F.col("__row") * cols + F.pmod("__col", cols)).cast("bigint")).drop("__row", "__col", "__west", "__east")


def size_for(radius_deg: float, least: float = CELL_DEG) -> float:
    """The size of cells that a circle touches a few of: about its radius, a whole number of them from pole to pole."""
    return 180.0 / max(1, math.floor(180.0 / max(radius_deg, least)))


def cell_join(left: DataFrame, right: DataFrame, radius: Column | float, size: float, left_at: tuple[str, str] = ("ra", "dec"), right_at: tuple[str, str] = ("star_ra", "star_dec"), spread_right: bool = False, left_u: tuple[str, ...] = (), right_u: tuple[str, ...] = ()) -> DataFrame:
    """Pairs within `radius` degrees (a number or a column of the left side); column names of the sides must differ. left_u names the left side's directions,
    if it has them; right_u are names for the right side's, if they are wanted.

    One side is spread over all cells that its circles touch, the other has one row each: the left one is spread, or, where it is the larger one,
    the right one. Then circles of other radii have cells of other sizes, twice as large each time, and the right side stands in those
    that occur, a few times in each; so a few wide circles cost the others nothing.
    """
    sized = left.withColumn("__radius", num(radius))
    a, b = sky.direction(F.col(left_at[0]), F.col(left_at[1])), sky.direction(F.col(right_at[0]), F.col(right_at[1]))
    # Directions and the limit are worked out once for each row, not for each pair: the join tests plain sums.
    of_left = ({} if left_u else {"__ax": a.x, "__ay": a.y, "__az": a.z}) | {"__limit": F.pow(2 * F.sin(F.radians("__radius") / 2), num(2))}
    of_right = {"__bx": b.x, "__by": b.y, "__bz": b.z}
    if spread_right:
        one, two = by_levels(sized, right, isinstance(radius, Column), num(radius), size, left_at, right_at)
    else:
        one = touched_cells(sized, F.col(left_at[0]), F.col(left_at[1]), F.col("__radius"), size, "__cell")
        two = right.withColumn("__own", sky.cell_of(F.col(right_at[0]), F.col(right_at[1]), size))
    gap = [F.col(l) - F.col(r) for l, r in zip(left_u or ("__ax", "__ay", "__az"), ("__bx", "__by", "__bz"), strict=True)]
    within = gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2] <= F.col("__limit")
    near = unfolded(one.withColumns(of_left).drop("__radius")).join(two.withColumns(of_right), (F.col("__cell") == F.col("__own")) & within)
    named = near.withColumnsRenamed(dict(zip(("__bx", "__by", "__bz"), right_u, strict=True))) if right_u else near
    return named.drop("__cell", "__own", "__limit", *[f"__{side}{c}" for side in "ab" for c in "xyz"])


#: Levels of cells, and the bits of a key that hold the cell within a level.
LEVELS, LEVEL_BITS = 16, 48


def by_levels(sized: DataFrame, right: DataFrame, varied: bool, radius: Column, size: float, left_at: tuple[str, str], right_at: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """The left side (with __radius) with __cell, its own cell of the level of its radius, and the right side with __own, for each level that occurs the cells
    that a circle of the widest radius there touches."""
    sizes = [size_for(size * 2**k) for k in range(LEVELS)]
    at = lambda k: F.get(F.array(*[F.lit(x) for x in sizes]), k)
    level = F.least(F.greatest(F.ceil(F.log2(F.col("__radius") / size)), F.lit(0)), F.lit(LEVELS - 1)).cast("int") if varied else F.lit(0)
    levelled = sized.withColumn("__level", level)
    here = sky.cell_of(F.col(left_at[0]), F.col(left_at[1]), F.col("__step") if varied else sizes[0])
    stepped = levelled.withColumn("__step", at(F.col("__level"))) if varied else levelled
    one = stepped.withColumn("__cell", F.shiftleft(F.coalesce("__level", F.lit(0)).cast("bigint"), LEVEL_BITS) + here).drop("__level", "__step")
    if varied:
        widest = levelled.groupBy("__level").agg(F.max("__radius").alias("r")).agg(F.collect_list(F.struct(F.col("__level").alias("level"), "r"))).scalar()
    else:
        widest = F.array(F.struct(F.lit(0).alias("level"), radius.alias("r")))
    levels = right.withColumn("__l", F.explode(widest)).select("*", F.col("__l.level").alias("__level"), F.col("__l.r").alias("__r"), at(F.col("__l.level")).alias("__size")).drop("__l")
    spread = touched_cells(levels, F.col(right_at[0]), F.col(right_at[1]), F.col("__r"), F.col("__size"), "__c")
    return one, spread.withColumn("__own", F.shiftleft(F.col("__level").cast("bigint"), LEVEL_BITS) + F.col("__c")).drop("__c", "__level", "__r", "__size")


def unfolded(rows: DataFrame) -> DataFrame:
    """Rows that were unfolded from fewer ones, for a join. Spark takes their size for that of the rows before they unfolded, and would gather and send
    them to all tasks as a small table; joined by sorting, they stay where they are shuffled to."""
    return rows.hint("merge")


def together(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key before they unfold: what they unfold to may then be grouped by that key, and further columns, where it stands, and only the rows
    themselves are shuffled."""
    return rows.repartition(*keys)


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: float) -> DataFrame:
    """Pairs whose closed intervals touch. Both sides are placed into buckets of `width`; a pair counts in the first bucket that it
    shares, so it comes once."""
    spread = lambda df, span, out: df.withColumn(out, F.explode(F.sequence(F.floor(F.col(span[0]) / width).cast("bigint"), F.floor(F.col(span[1]) / width).cast("bigint"))))
    a, b = spread(left, left_span, "__a"), spread(right, right_span, "__b")
    touch = (F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(right_span[0]) <= F.col(left_span[1]))
    first = F.floor(F.greatest(F.col(left_span[0]), F.col(right_span[0])) / width).cast("bigint")
    return unfolded(a).join(b, (F.col("__a") == F.col("__b")) & touch & (F.col("__a") == first)).drop("__a", "__b")


def widest_radius(limit: Column, distance: Column) -> Column:
    """Degrees of the circle within which a chord times distance stays below a limit."""
    return F.degrees(2 * F.asin(F.least(limit / (2 * distance), num(1)))) * (1 + 1e-9) + math.ulp(1.0)
