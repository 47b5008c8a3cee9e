"""The Earth as the star sees it: day side and land clipped at the limb, the axis' course, and the geometry that bends light. Lengths in Earth
radii where not said otherwise; x points east, y north, in the plane through the Earth's centre."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbra.functions import earth, sky
from umbra.functions.constants import AU_KM, EARTH_KM, LIGHT_KM_S
from umbra.functions.sky import Vec, num
from umbra.operators.ephemeris import beside
from umbra.operators.shadow import _columns, _vec, _with_axes, jd_of, plane_at, sun_direction, turned

MAS = 180 / math.pi * 3.6e6


def day_polygon(events: DataFrame, n: int = 24) -> DataFrame:
    """(event_id, k, x, y): the outline of the part of the visible disc where the Sun is up: n + 1 points of the limb, then n + 1 of the terminator.

    Two great circles, of the star's and the Sun's horizon, cross at two opposite points; the outline goes from one to the other along the limb's sunny
    half and back along the terminator's visible half. Star and Sun in line or opposite give a whole disc or one without area.
    """
    named = _columns(_with_axes(events), "l", sun_direction(jd_of(F.col("et"))))
    s, light = _vec("s"), _vec("l")
    normal = s.cross(light)
    size = normal.norm()
    corner = Vec(*(F.when(size > 1e-9, a / size).otherwise(b) for a, b in zip(normal, _vec("e"), strict=True)))
    cornered = _columns(named, "p", corner)
    p = _vec("p")
    turned_ = _columns(_columns(cornered, "m", p.cross(s)), "t", light.cross(p))
    rows = turned_.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2 * n + 1))))
    angle = num(math.pi / n) * (F.col("k") % (n + 1))
    back = F.when(F.col("k") > n, -1.0).otherwise(1.0)
    side = Vec(*(F.when(F.col("k") > n, a).otherwise(b) for a, b in zip(_vec("t"), _vec("m"), strict=True)))
    v = _columns(rows.withColumns({"__c": F.cos(angle) * back, "__b": F.sin(angle)}), "g", side)
    point = _vec("p").times(F.col("__c")).plus(_vec("g").times(F.col("__b")))
    return v.select("event_id", "k", point.dot(_vec("e")).alias("x"), point.dot(_vec("n")).alias("y"))


def clipped(pairs: DataFrame, polygons: DataFrame) -> DataFrame:
    """Polygons on the ground as they show on each view's disc, clipped at the limb: rows (view, poly, kind, at, x, y, to_x, to_y).

    pairs: view, poly, et, ra, dec. polygons: poly, seq, lat, lon: corners, counterclockwise as seen from above, the last one meets the first. `coast` rows
    are straight pieces of the outline on the disc, in the order of `at`; `limb` rows go along its rim, counterclockwise, from where an
    outline passes behind the Earth to where the next one (by angle) comes forth. Together they close; a polygon that isn't seen has no rows,
    nor has one that holds the whole disc.
    """
    ground = Vec(*(c / EARTH_KM for c in earth.earth_fixed(F.col("lat"), F.col("lon"), num(0)))).unit()
    corners = _columns(polygons.select("poly", "seq", "lat", "lon"), "f", ground).drop("lat", "lon")
    seen = _with_axes(pairs).withColumn("__spin", -earth.earth_turn(jd_of(F.col("et")))).join(corners, "poly")
    placed = _columns(seen, "c", turned(_vec("f"), F.col("__spin")))
    flat = placed.select("view", "poly", "seq", _vec("c").dot(_vec("e")).alias("x"), _vec("c").dot(_vec("n")).alias("y"), _vec("c").dot(_vec("s")).alias("z"))
    ring = W.partitionBy("view", "poly").orderBy("seq")
    whole = ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    following = {f"n{c}": F.coalesce(F.lead(c).over(ring), F.first(c).over(whole)) for c in "xyz"}
    edges = flat.withColumns(following)
    here, there = F.col("z") >= 0, F.col("nz") >= 0
    # Where an edge crosses the limb: between its ends, by their depths, out to the rim.
    share = F.col("z") / (F.col("z") - F.col("nz"))
    cut = edges.withColumns({"cx": F.col("x") + share * (F.col("nx") - F.col("x")), "cy": F.col("y") + share * (F.col("ny") - F.col("y"))})
    rim = F.sqrt(F.col("cx") ** 2 + F.col("cy") ** 2)
    crossed = cut.withColumns({"rx": F.col("cx") / rim, "ry": F.col("cy") / rim})
    step = F.when(here & there, F.struct(F.col("x"), F.col("y"), F.col("nx").alias("to_x"), F.col("ny").alias("to_y")))
    step = step.when(here, F.struct(F.col("x"), F.col("y"), F.col("rx").alias("to_x"), F.col("ry").alias("to_y")))
    step = step.when(there, F.struct(F.col("rx").alias("x"), F.col("ry").alias("y"), F.col("nx").alias("to_x"), F.col("ny").alias("to_y")))
    coast = crossed.withColumn("__s", step).where(F.col("__s").isNotNull()).select("view", "poly", F.lit("coast").alias("kind"), F.col("seq").cast("double").alias("at"), "__s.*")
    points = crossed.where(here != there).select("view", "poly", here.alias("leaves"), "rx", "ry", F.atan2("ry", "rx").alias("at"))
    around = W.partitionBy("view", "poly").orderBy("at")
    every = around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    joined = points.withColumns({f"to_{c}": F.coalesce(F.lead(f"r{c}").over(around), F.first(f"r{c}").over(every)) for c in "xy"})
    limb = joined.where("leaves").select("view", "poly", F.lit("limb").alias("kind"), "at", F.col("rx").alias("x"), F.col("ry").alias("y"), "to_x", "to_y")
    return coast.unionByName(limb)


def visible_area(pieces: DataFrame) -> DataFrame:
    """(view, poly, area, corners, arcs): what clipped polygons cover of the disc, whose own area is pi: half the cross products of the straight pieces and
    half the angles of the arcs."""
    turn_ = F.atan2("to_y", "to_x") - F.atan2("y", "x")
    arc = turn_ - F.floor(turn_ / (2 * math.pi)) * (2 * math.pi)
    part = F.when(F.col("kind") == "limb", arc / 2).otherwise((F.col("x") * F.col("to_y") - F.col("y") * F.col("to_x")) / 2)
    return pieces.groupBy("view", "poly").agg(F.sum(part).alias("area"), F.sum((F.col("kind") == "coast").cast("int")).alias("corners"), F.sum((F.col("kind") == "limb").cast("int")).alias("arcs"))


def axis_course(events: DataFrame, reach: float = 1.6, step_s: float = 20.0) -> DataFrame:
    """(event_id, et, t, minute, x_km, y_km): the axis' course over the disc, at steps of `step_s` and at whole minutes besides: from `reach` Earth radii
    before the event's et to as far behind it at the event's speed; minute is true at whole ones."""
    speed = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2)
    span = events.withColumn("__span", reach * EARTH_KM / speed)
    first, last = F.col("et") - F.col("__span"), F.col("et") + F.col("__span")
    steps = F.transform(F.sequence(F.lit(0), F.ceil(2 * F.col("__span") / step_s).cast("int") - 1), lambda k: first + k * num(step_s))
    minutes = F.transform(F.sequence(F.floor(first / 60) + 1, F.floor(last / 60)), lambda m: m * num(60))
    both = F.array_sort(F.array_distinct(F.concat(steps, minutes)))
    rows = span.withColumn("t", F.explode(both))
    px, py = plane_at(F.col("t"))
    return rows.select("event_id", "et", "t", (F.col("t") % 60 == 0).alias("minute"), px.alias("x_km"), py.alias("y_km"))


def facts(dist_km: Column, speed_kms: Column, radius_km: Column, sigma_km: Column) -> dict[str, Column]:
    """What a globe's margin says: a milliarcsecond in km, a km and a milliarcsecond in seconds, the body's diameter and error in milliarcseconds, its
    horizontal parallax in arcseconds, its distance in AU."""
    km_per_mas = dist_km / MAS
    return {
        "km_per_mas": km_per_mas,
        "s_per_km": 1 / speed_kms,
        "s_per_mas": km_per_mas / speed_kms,
        "diameter_mas": 2 * radius_km / km_per_mas,
        "sigma_mas": sigma_km / km_per_mas,
        "parallax_arcsec": F.degrees(F.asin(EARTH_KM / dist_km)) * 3600.0,
        "dist_au": dist_km / AU_KM,
    }


def system(rays: DataFrame, deflectors: DataFrame, inner: int = 59, outer: int = 79, key: str = "day") -> tuple[DataFrame, DataFrame]:
    """The plane of a star's direction (x) and the Sun (y), in AU, seen from the Earth: (ray, body, x, y, w) of the bodies, w off the plane; and (ray, k, x, y) of
    the star's ray that reaches the Earth, at `inner` distances up to the target and `outer` beyond it.

    rays: ray, `key`, px, py, pz (the star), target_au. deflectors as in `ephemeris.deflected`, the Sun's number 10. A source on the star's line at a distance is bent less
    than the star; the difference, times the distance, is how far the ray lies off the line there.
    """
    p = Vec(*(F.col(f"p{c}") for c in "xyz"))
    of = lambda body: Vec(body["bx"], body["by_"], body["bz"])
    met = beside(rays, deflectors, key).withColumn("__sun", F.get(F.filter("__bodies", lambda x: x["body"] == 10), F.lit(0))).where("__sun IS NOT NULL")
    u = of(F.col("__sun"))
    across = u.minus(p.times(u.dot(p)))
    # With the Sun on the star's line any direction across it serves.
    flat = F.sqrt(p.x * p.x + p.y * p.y)
    spare = Vec(p.y / flat, -p.x / flat, num(0))
    on_line = across.norm() < 1e-9 * u.norm()
    based = _columns(met, "y", Vec(*(F.when(on_line, a).otherwise(c) for a, c in zip(spare, across.unit(), strict=True))))
    y = _vec("y")
    based = _columns(based, "w", p.cross(y))
    apart = based.withColumn("__b", F.explode("__bodies"))
    bodies = apart.select("ray", F.col("__b.body").alias("body"), *[(of(F.col("__b")).dot(v) / AU_KM).alias(c) for c, v in (("x", p), ("y", y), ("w", _vec("w")))])
    rows = based.select("ray", "target_au", "__bodies", *[f"p{c}" for c in "xyz"], *[f"__y{c}" for c in "xyz"])
    curve = rows.mapInArrow(lambda batches: _bent(batches, inner, outer), f"ray {dict(rays.dtypes)['ray']}, k int, x double, y double")
    return bodies, curve


#: Points of curves that are worked out at once, times bodies.
POINTS = 250_000


def _bent(batches: Iterator[pa.RecordBatch], inner: int, outer: int) -> Iterator[pa.RecordBatch]:
    """A ray's points from its row: the bodies' shares are added up here, so that no point is grouped. Each body bends by its place along the line (ahead), across it
    and its distance; the share is that of the star less that of a source at the point."""
    k = np.arange(1, inner + outer + 1)
    beyond = np.clip((k - inner) / outer, 0, None)
    for whole in batches:
        step = max(1, POINTS // len(k))
        for b in (whole.slice(first, step) for first in range(0, whole.num_rows, step)):
            numbers = lambda c: c.to_numpy(zero_copy_only=False).astype(float)
            p, y = (np.stack([numbers(b.column(f"{n}{c}")) for c in "xyz"], 1) for n in ("p", "__y"))
            target = numbers(b.column("target_au"))[:, None]
            far = np.fmax(2.6, 1.7 * target)
            x = np.where(k <= inner, target * (k / inner), target + (far - target) * beyond)
            listed = b.column("__bodies")
            count, flat = numbers(listed.value_lengths()).astype(int), listed.flatten()
            place, gm = np.stack([numbers(flat.field(c)) for c in ("bx", "by_", "bz")], 1), numbers(flat.field("gm"))
            row = np.repeat(np.arange(b.num_rows), count)
            along, up, r = (place * p[row]).sum(1), (place * y[row]).sum(1), np.linalg.norm(place, axis=1)
            across = place - along[:, None] * p[row]
            along, up, r = along[:, None], up[:, None], r[:, None]
            at = x[row] * AU_KM
            away = np.sqrt((at - along) ** 2 + (across**2).sum(1)[:, None])
            share = lambda opening: np.where(opening > 1e-12, 1 / np.where(opening > 1e-12, opening, 1), 0)
            star = -up / r * share(1 - along / r)
            source = -up * at / (r * away) * share(1 + (r * r - at * along) / (r * away))
            bend = gm[:, None] * (2.0 / LIGHT_KM_S**2) / r * (star - source)
            total = x * np.add.reduceat(bend, np.cumsum(count) - count, axis=0)
            rays = b.column("ray").take(pa.array(np.repeat(np.arange(b.num_rows), len(k))))
            yield pa.RecordBatch.from_arrays([rays, pa.array(np.tile(k, b.num_rows), pa.int32()), *[pa.array(c.ravel(), pa.float64(), from_pandas=True) for c in (x, total)]], ["ray", "k", "x", "y"])
