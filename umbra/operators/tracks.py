"""Analytics along a body's path: rows (number, j, et, u, distance) in a fixed step of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from umbra.functions import earth, sky
from umbra.functions.constants import AU_KM
from umbra.functions.sky import Vec, num
from umbra.operators import shadow

U = ("ux", "uy", "uz")


def path() -> WindowSpec:
    """A body's samples in order."""
    return W.partitionBy("number").orderBy("j")


def u_of(prefix: str = "") -> Vec:
    return Vec(*(F.col(prefix + c) for c in U))


def with_directions(samples: DataFrame) -> DataFrame:
    """Adds ux, uy, uz and distance_km."""
    u = sky.direction(F.col("ra"), F.col("dec"))
    return samples.withColumns({"ux": u.x, "uy": u.y, "uz": u.z, "distance_km": F.col("delta_au") * AU_KM})


def neighbour(c: str, by: int) -> Column:
    return (F.lag(c, 1) if by < 0 else F.lead(c, 1)).over(path())


def with_neighbours(samples: DataFrame) -> DataFrame:
    """Adds the directions and distances of the samples before (`p_`) and after (`n_`), null at the ends. Done before any join, so
    a test for a minimum needs no look at other rows."""
    cols = [*U, "distance_km"]
    return samples.withColumns({f"p_{c}": neighbour(c, -1) for c in cols} | {f"n_{c}": neighbour(c, 1) for c in cols})


def with_speed(samples: DataFrame, step_s: float) -> DataFrame:
    """Adds the shadow's speed over the fundamental plane in km/s; the first sample has the second one's."""
    before = Vec(*(neighbour(c, -1) for c in U))
    own = u_of().minus(before).norm() / step_s * F.col("distance_km")
    raw = samples.withColumn("__v", own)
    return raw.withColumn("speed_kms", F.coalesce("__v", F.lead("__v").over(path()))).drop("__v")


def with_visibility(samples: DataFrame, lat: Column, lon: Column, min_alt: float, max_sun_alt: float) -> DataFrame:
    """Adds vis: whether a body (ux, uy, uz at et) stands above an altitude at a place while the Sun is below another."""
    jd = shadow.jd_of(F.col("et"))
    angle = earth.earth_turn(jd) + F.radians(lon)
    phi = F.radians(lat)
    named = samples.withColumns({"__zx": F.cos(phi) * F.cos(angle), "__zy": F.cos(phi) * F.sin(angle), "__zz": F.sin(phi)})
    up = Vec(F.col("__zx"), F.col("__zy"), F.col("__zz"))
    least, most = F.sin(F.radians(num(min_alt))), F.sin(F.radians(num(max_sun_alt)))
    return named.withColumn("vis", (up.dot(u_of()) > least) & (up.dot(shadow.sun_direction(jd)) < most)).drop("__zx", "__zy", "__zz")


def dilated(samples: DataFrame, flag: str) -> DataFrame:
    """`flag`, true also one sample before and after."""
    near = path().rowsBetween(-1, 1)
    return samples.withColumn(flag, F.max(flag).over(near))


def with_running_count(samples: DataFrame, flag: str, out: str) -> DataFrame:
    """How many samples up to this one have `flag`; a range's count is a difference of two."""
    return samples.withColumn(out, F.sum(F.col(flag).cast("int")).over(path().rowsBetween(W.unboundedPreceding, 0)))


def arc(a: Vec, b: Vec) -> Column:
    """Degrees between two directions, by the chord."""
    half = a.minus(b).norm() / 2
    return F.when(half.isNotNull(), F.degrees(2 * F.asin(F.least(half, num(1)))))


def strip(samples: DataFrame, margin_km: Column, pad_arcsec: Column | float) -> DataFrame:
    """(number, path_deg, area_deg2): length of each path and the area of the strip around it."""
    width = F.degrees(margin_km / F.col("distance_km")) + num(pad_arcsec) / 3600.0
    wide = samples.withColumn("__w", width)
    following = Vec(*(neighbour(c, 1) for c in U))
    legs = wide.withColumns({"__arc": arc(u_of(), following), "__both": F.col("__w") + neighbour("__w", 1)})
    return legs.groupBy("number").agg(F.sum("__arc").alias("path_deg"), F.sum(F.col("__arc") * F.col("__both")).alias("area_deg2"))


def resampled(samples: DataFrame, spacing_deg: float) -> DataFrame:
    """The samples kept when a path is thinned to one for each `spacing_deg` of arc, and the last one. Adds arc_deg."""
    before = Vec(*(neighbour(c, -1) for c in U))
    along = samples.withColumn("__leg", F.coalesce(arc(u_of(), before), num(0))).withColumn("arc_deg", F.sum("__leg").over(path().rowsBetween(W.unboundedPreceding, 0)))
    bucket = F.floor(F.col("arc_deg") / spacing_deg)
    marked = along.withColumn("__b", bucket).withColumn("__keep", F.coalesce(F.col("__b") != F.lag("__b").over(path()), F.lit(True)) | F.lead("j").over(path()).isNull())
    return marked.where("__keep").drop("__leg", "__b", "__keep")


def half_steps(samples: DataFrame) -> DataFrame:
    """Adds half_step_km: half the way to the farther neighbour, by direction and distance."""
    here = u_of().times(F.col("distance_km"))
    to = lambda by: here.minus(Vec(*(neighbour(f"__{c}", by) for c in U))).norm()
    placed = samples.withColumns({f"__{c}": F.col(c) * F.col("distance_km") for c in U})
    return placed.withColumn("half_step_km", 0.5 * F.greatest(F.coalesce(to(-1), num(0)), F.coalesce(to(1), num(0)))).drop(*[f"__{c}" for c in U])


def unwrapped(df: DataFrame, lon: str, by: list[str], order: list[str], out: str) -> DataFrame:
    """`lon` without its jumps over the date line: a running sum of full turns."""
    w = W.partitionBy(*by).orderBy(*order)
    jump = F.col(lon) - F.lag(lon).over(w)
    turns = F.when(jump > 180.0, -360.0).when(jump < -180.0, 360.0).otherwise(0.0)
    return df.withColumn("__t", turns).withColumn(out, F.col(lon) + F.sum("__t").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__t")


def widest_gap(df: DataFrame, by: list[str], lon: str) -> DataFrame:
    """(by…, west, width): the shortest arc of longitudes that holds all of a group, opposite to the widest gap between neighbours.

    A group's longitudes are sorted over one window; ties go to the first gap.
    """
    w = W.partitionBy(*by).orderBy(lon)
    all_of = W.partitionBy(*by)
    following = F.coalesce(F.lead(lon).over(w), F.min(lon).over(all_of) + 360.0)
    after = F.coalesce(F.lead(lon).over(w), F.min(lon).over(all_of))
    gaps = df.select(*by, F.col(lon).alias("__lon"), (following - F.col(lon)).alias("gap"), after.alias("west"))
    best = gaps.groupBy(*by).agg(F.max_by(F.struct("gap", "west"), F.struct("gap", -F.col("__lon"))).alias("b"))
    return best.select(*by, F.col("b.west").alias("west"), (360.0 - F.col("b.gap")).alias("width"))
