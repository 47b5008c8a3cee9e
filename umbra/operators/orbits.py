"""Orbits: Kepler's equation, the planets' pull, interpolation between states, light time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.constants import AU_KM, DAY_S, GM_SUN, LIGHT_KM_S, OBLIQUITY_ARCSEC
from umbra.functions.sky import Vec, num
from umbra.operators.cells import unfolded

TILT = np.radians(OBLIQUITY_ARCSEC / 3600.0)


def with_eccentric_anomaly(df: DataFrame, mean: Column, e: str = "e", steps: int = 12, out: str = "ecc") -> DataFrame:
    """Adds the eccentric anomaly: Newton's steps, one projection each, so no step repeats the one before it. Twelve reach rounding
    for e below 0.99 from this start."""
    now = df.withColumns({"__m": mean, out: mean + F.col(e) * F.sin(mean)})
    for _ in range(steps):
        x = F.col(out)
        now = now.withColumn(out, x - (x - F.col(e) * F.sin(x) - F.col("__m")) / (1 - F.col(e) * F.cos(x)))
    return now.drop("__m")


def two_body_states(bodies: DataFrame, jd: Column) -> DataFrame:
    """Adds x, y, z (AU) and vx, vy, vz (AU a day), heliocentric equatorial, at a time, from elements a, e, i, om, w, ma, epoch_jd."""
    n = F.sqrt(num(GM_SUN) / F.pow("a", num(3)))
    solved = with_eccentric_anomaly(bodies.withColumn("__n", n), F.radians("ma") + F.col("__n") * (jd - F.col("epoch_jd")))
    c, s = F.cos("ecc"), F.sin("ecc")
    r = 1 - F.col("e") * c
    b = F.col("a") * F.sqrt(1 - F.col("e") * F.col("e"))
    flat = solved.withColumns({"__xp": F.col("a") * (c - F.col("e")), "__yp": b * s, "__vxp": -F.col("a") * F.col("__n") * s / r, "__vyp": b * F.col("__n") * c / r})
    co, so, ci, si, cw, sw = (f(F.radians(x)) for x in ("om", "i", "w") for f in (F.cos, F.sin))
    p = Vec(co * cw - so * sw * ci, so * cw + co * sw * ci, sw * si)
    q = Vec(-co * sw - so * cw * ci, -so * sw + co * cw * ci, cw * si)
    turned = flat.withColumns({f"__{k}{a}": getattr(v, a) for k, v in (("p", p), ("q", q)) for a in "xyz"})
    out: dict[str, Column] = {}
    for pre, (xp, yp) in (("", ("__xp", "__yp")), ("v", ("__vxp", "__vyp"))):
        ex, ey, ez = (F.col(f"__p{a}") * F.col(xp) + F.col(f"__q{a}") * F.col(yp) for a in "xyz")
        out |= {f"{pre}x": ex, f"{pre}y": num(np.cos(TILT)) * ey - num(np.sin(TILT)) * ez, f"{pre}z": num(np.sin(TILT)) * ey + num(np.cos(TILT)) * ez}
    drop = [f"__{k}" for k in ("n", "xp", "yp", "vxp", "vyp", "px", "py", "pz", "qx", "qy", "qz")]
    return turned.withColumns(out).drop(*drop, "ecc")


def hermite(s: Column, h: Column, ends: tuple[tuple[Column, Column, Column], tuple[Column, Column, Column]]) -> Column:
    """Quintic interpolation at 0 <= s <= 1 of a step of h days, from value, rate and second rate at both ends."""
    (p0, v0, a0), (p1, v1, a1) = ends
    d = p1 - p0
    c2 = a0 * h * h / 2
    k0, k1, k2 = d - v0 * h - c2, v1 * h - v0 * h - 2 * c2, a1 * h * h - 2 * c2
    c3, c4, c5 = 10 * k0 - 4 * k1 + k2 / 2, -15 * k0 + 7 * k1 - k2, 6 * k0 - 3 * k1 + k2 / 2
    return p0 + s * (v0 * h + s * (c2 + s * (c3 + s * (c4 + s * c5))))


def lagrange(s: Column, values: tuple[Column, Column, Column, Column]) -> Column:
    """Cubic through values at s = 0, 1, 2, 3."""
    a, b, c, d = values
    return -(s - 1) * (s - 2) * (s - 3) / 6 * a + s * (s - 2) * (s - 3) / 2 * b - s * (s - 1) * (s - 3) / 2 * c + s * (s - 1) * (s - 2) / 6 * d


def retarded(place: Vec, velocity: Vec, observer: Vec, rounds: int = 2) -> Vec:
    """From observer to body (AU) as the light shows it: the body is where it was when the light left."""
    seen = place.minus(observer)
    for _ in range(rounds):
        days = seen.norm() * (AU_KM / LIGHT_KM_S / DAY_S)
        seen = place.minus(velocity.times(days)).minus(observer)
    return seen


def interpolated(nodes: DataFrame, asked: DataFrame, step_s: float) -> DataFrame:
    """`asked` (target, et and others) with x, y, z, vx, vy, vz between the rows of an ephemeris: nodes (target, et, the same columns) at multiples of
    `step_s`. The cubic that has place and velocity of both nodes around a time; without either of them, no row.

    Both nodes come by equi-joins on target and step, so targets and times spread over all tasks alike.
    """
    states = [*"xyz", "vx", "vy", "vz"]
    step = asked.withColumn("__k", F.floor(F.col("et") / step_s))
    placed = nodes.withColumn("__k", F.floor(F.col("et") / step_s + 0.5))
    side = lambda tag, by: placed.select("target", (F.col("__k") - by).alias("__k"), *[F.col(c).alias(f"__{c}{tag}") for c in states])
    both = unfolded(step).join(unfolded(side("a", 0)), ["target", "__k"]).join(unfolded(side("b", 1)), ["target", "__k"]).withColumn("__s", F.col("et") / step_s - F.col("__k"))
    s = F.col("__s")
    out = {}
    for c in "xyz":
        a, b, va, vb = (F.col(f"__{n}") for n in (f"{c}a", f"{c}b", f"v{c}a", f"v{c}b"))
        # In powers of s, from place and slope at 0: what the far end asks beyond a straight line gives the other two terms.
        slope, missing, bend = step_s * va, b - a - step_s * va, step_s * (vb - va)
        square, cube = 3 * missing - bend, bend - 2 * missing
        out[c] = a + s * (slope + s * (square + s * cube))
        out[f"v{c}"] = (slope + s * (2 * square + 3 * s * cube)) / step_s
    return both.select(*asked.columns, *[out[c].alias(c) for c in states])


def source_for(sources: DataFrame, et0: float, et1: float, fresh_days: float) -> DataFrame:
    """(target, source, stale): of orbits (source, target, et0, et1, age_days) that cover a window, the newest one of each target; stale if it's
    older than `fresh_days`, as then a new one should be fetched, and this one serves if that fails."""
    covering = sources.where((F.col("et0") <= et0) & (F.col("et1") >= et1))
    best = covering.groupBy("target").agg(F.min(F.struct("age_days", "source")).alias("b"))
    return best.select("target", F.col("b.source").alias("source"), (F.col("b.age_days") > fresh_days).alias("stale"))
