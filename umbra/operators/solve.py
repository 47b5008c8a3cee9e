"""Closest approaches and crossing times of shadow tracks, and what an event looks like from a site."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import earth, sky
from umbra.functions.constants import DAY_S, EARTH_SPIN, LIGHT_KM_S, TDB_UTC
from umbra.functions.sky import Vec, num
from umbra.operators.shadow import _columns, _vec, _with_axes, jd_of, plane_at, turned

GOLDEN = (np.sqrt(5) - 1) / 2


def closest_at_site(pairs: DataFrame, steps: int = 6) -> DataFrame:
    """Adds t_ca, miss_km and speed_kms: the shadow axis' closest approach to an observer (site_lat, site_lon, ele_m).

    The observer sees at once what passes the plane through the Earth's centre later, by the light time of the way that the site lies nearer
    to the star; so the axis is taken at that later time. Newton's method on half the square of the distance, in plane coordinates relative to the turning site, whose velocity and
    acceleration are exact; a fixed number of steps, each kept within the event's half length.
    """
    now = _columns(_with_axes(pairs), "o", earth.earth_fixed(F.col("site_lat"), F.col("site_lon"), F.col("ele_m")))
    now = now.withColumn("t_ca", F.col("et"))

    def state(t: Column) -> dict[str, Column]:
        o = turned(_vec("o"), -earth.earth_turn(jd_of(t)))
        v = Vec(-o.y * EARTH_SPIN, o.x * EARTH_SPIN, num(0))
        a = Vec(-o.x * EARTH_SPIN**2, -o.y * EARTH_SPIN**2, num(0))
        tau = t + o.dot(_vec("s")) / LIGHT_KM_S
        px, py = plane_at(tau)
        dt, sooner = tau - F.col("et"), 1 + v.dot(_vec("s")) / LIGHT_KM_S
        e, n = _vec("e"), _vec("n")
        return {
            "__x": px - o.dot(e),
            "__y": py - o.dot(n),
            "__vx": (F.col("vx") + 2 * F.col("ax") * dt) * sooner - v.dot(e),
            "__vy": (F.col("vy") + 2 * F.col("ay") * dt) * sooner - v.dot(n),
            "__ax": 2 * F.col("ax") - a.dot(e),
            "__ay": 2 * F.col("ay") - a.dot(n),
        }

    for _ in range(steps):
        now = now.withColumns(state(F.col("t_ca")))
        slope = F.col("__x") * F.col("__vx") + F.col("__y") * F.col("__vy")
        bend = F.col("__vx") ** 2 + F.col("__vy") ** 2 + F.col("__x") * F.col("__ax") + F.col("__y") * F.col("__ay")
        moved = F.col("t_ca") - slope / F.when(bend > 1e-9, bend).otherwise(F.col("__vx") ** 2 + F.col("__vy") ** 2)
        now = now.withColumn("t_ca", F.least(F.greatest(moved, F.col("et") - F.col("half")), F.col("et") + F.col("half")))
    last = now.withColumns(state(F.col("t_ca"))).withColumns({"miss_km": F.sqrt(F.col("__x") ** 2 + F.col("__y") ** 2), "speed_kms": F.sqrt(F.col("__vx") ** 2 + F.col("__vy") ** 2)})
    return last.select(*pairs.columns, "t_ca", "miss_km", "speed_kms")


def metrics(miss: Column, radius: Column, speed: Column) -> dict[str, Column]:
    """chord_km and duration_s of a pass at this distance from the axis."""
    chord = 2 * F.sqrt(F.greatest(radius * radius - miss * miss, num(0)))
    return {"chord_km": chord, "duration_s": chord / speed}


def _track(b: pd.DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    c = {k: b[k].to_numpy(float) for k in ("et", "x0", "y0", "vx", "vy", "ax", "ay")}

    def distance(t: np.ndarray) -> np.ndarray:
        dt = t - c["et"]
        return np.hypot(c["x0"] + dt * (c["vx"] + dt * c["ax"]), c["y0"] + dt * (c["vy"] + dt * c["ay"]))

    return distance


def _bisected(f: Callable[[np.ndarray], np.ndarray], inside: np.ndarray, outside: np.ndarray, tol: float) -> np.ndarray:
    """Where f, negative at `inside` and positive at `outside`, is zero; all rows at once."""
    lo, hi = inside.copy(), outside.copy()
    for _ in range(int(np.ceil(np.log2(max(float(np.nanmax(np.abs(hi - lo), initial=1.0)), 1.0) / tol))) + 1):
        mid = (lo + hi) / 2
        out = f(mid) > 0
        hi, lo = np.where(out, mid, hi), np.where(out, lo, mid)
    return (lo + hi) / 2


def minimised(events: DataFrame, half_s: float, tol: float = 1e-3) -> DataFrame:
    """(event_id, t_min, d_km): the least distance between axis and centre within half_s of et, by golden sections on the offset
    from et, so that large times lose no digits; rows of a batch together. Near its least the distance hardly changes, so sections alone
    leave some 1e-5 s open; a step of Newton's method on its slope settles the rest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f, et = _track(b), b["et"].to_numpy(float)
            lo, hi = np.full(len(b), -half_s), np.full(len(b), half_s)
            for _ in range(int(np.ceil(np.log(tol / (2 * half_s)) / np.log(GOLDEN)))):
                x, y = hi - GOLDEN * (hi - lo), lo + GOLDEN * (hi - lo)
                left = f(et + x) < f(et + y)
                hi, lo = np.where(left, y, hi), np.where(left, lo, x)
            off = (lo + hi) / 2
            px, py, vx, vy, ax, ay = (b[k].to_numpy(float) for k in ("x0", "y0", "vx", "vy", "ax", "ay"))
            px, py, vx, vy = px + off * (vx + off * ax), py + off * (vy + off * ay), vx + 2 * off * ax, vy + 2 * off * ay
            bend = vx * vx + vy * vy + 2 * (px * ax + py * ay)
            finer = off - (px * vx + py * vy) / np.where(bend > 0, bend, np.inf)
            better = (np.abs(finer) <= half_s) & (f(et + finer) <= f(et + off) * (1 + 1e-12))
            t = et + np.where(better, finer, off)
            yield pd.DataFrame({"event_id": b["event_id"], "t_min": t, "d_km": f(t)})

    return events.mapInPandas(run, "event_id bigint, t_min double, d_km double")


def crossings(events: DataFrame, limit: str, step_s: float = 600.0, most: int = 144, tol: float = 1e-3) -> DataFrame:
    """(event_id, t_in, t_out): when the distance from the centre falls below the column `limit` and rises above it again, around t_ca;
    null where the track never comes within, or stays within for `most` steps. Steps outward first, then halves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            track, r, t0 = _track(b), b[limit].to_numpy(float), b["t_ca"].to_numpy(float)
            f = lambda t: track(t) - r  # noqa: E731, B023
            found = []
            for sign in (-1, 1):
                far, open_ = t0 + sign * step_s, np.ones(len(b), bool)
                for _ in range(most):
                    open_ = f(far) <= 0
                    if not open_.any():
                        break
                    far = np.where(open_, far + sign * step_s, far)
                found.append(np.where((f(t0) < 0) & ~open_, _bisected(f, t0, far, tol), np.nan))
            both = np.isfinite(found[0]) & np.isfinite(found[1])
            yield pd.DataFrame({"event_id": b["event_id"], "t_in": pd.Series(found[0]).where(both), "t_out": pd.Series(found[1]).where(both)})

    raw = events.mapInPandas(run, "event_id bigint, t_in double, t_out double")
    return raw.select("event_id", *[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) for c in ("t_in", "t_out")])


class _SiteTracks:
    """Pairs of curved tracks and turning sites, all rows of a batch at once: place and velocity of the axis relative to each observer, with the
    observer's own light time. A track is the polynomial through an event's nodes (array of dt, x, y: seconds from et, kilometres)."""

    def __init__(self, b: pd.DataFrame) -> None:
        col = lambda c: b[c].to_numpy(float)
        self.et, self.half = col("et"), col("half")
        ra, dec, lat, lon = (np.radians(col(c)) for c in ("ra", "dec", "site_lat", "site_lon"))
        self.s = np.stack((np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)), -1)
        self.e = np.stack((-np.sin(ra), np.cos(ra), np.zeros(len(b))), -1)
        self.n = np.cross(self.s, self.e)
        curve = earth.EARTH_KM / np.sqrt(1 - earth.E2 * np.sin(lat) ** 2)
        h = col("ele_m") / 1000
        self.rho, self.up, self.lon = (curve + h) * np.cos(lat), (curve * (1 - earth.E2) + h) * np.sin(lat), lon
        nodes = [np.array([(p["dt"], p["x"], p["y"]) for p in row], float) for row in b["nodes"]]
        grid = np.stack(nodes) if nodes else np.zeros((0, 2, 3))
        # Newton's divided differences, for both axes together.
        self.t = grid[:, :, 0]
        c = grid[:, :, 1:].copy()
        for k in range(1, c.shape[1]):
            c[:, k:] = (c[:, k:] - c[:, k - 1 : -1]) / (self.t[:, k:] - self.t[:, :-k])[:, :, None]
        self.c = c

    def __call__(self, dt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, k, 2) places and velocities at the offsets dt (n, k) from et."""
        days = (self.et[:, None] + dt) / DAY_S
        turned = 0.7790572732640 + 1.00273781191135448 * days
        angle = 2 * np.pi * (turned - np.floor(turned)) + self.lon[:, None]
        rho = self.rho[:, None]
        o = np.stack((rho * np.cos(angle), rho * np.sin(angle), np.broadcast_to(self.up[:, None], angle.shape)), -1)
        v = EARTH_SPIN * np.stack((-o[..., 1], o[..., 0], np.zeros_like(angle)), -1)
        on = lambda w, axis: np.einsum("nkj,nj->nk", w, axis)
        tau, sooner = dt + on(o, self.s) / LIGHT_KM_S, 1 + on(v, self.s) / LIGHT_KM_S
        p, d = np.zeros((*dt.shape, 2)), np.zeros((*dt.shape, 2))
        for k in range(self.c.shape[1] - 1, -1, -1):
            w = (tau - self.t[:, k : k + 1])[..., None]
            p, d = self.c[:, k : k + 1] + w * p, p + w * d
        site, motion = (np.stack((on(w, self.e), on(w, self.n)), -1) for w in (o, v))
        return p - site, d * sooner[..., None] - motion

    def distance(self, dt: np.ndarray) -> np.ndarray:
        return np.linalg.norm(self(dt)[0], axis=-1)

    def slope(self, dt: np.ndarray) -> np.ndarray:
        p, v = self(dt)
        return (p * v).sum(-1)


def _root(f: Callable[[np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, tol: float) -> np.ndarray:
    """Where f, not above 0 at `low` and above 0 at `high`, changes sign, row by row; `low` may lie on either side. Halved to `tol`, then taken from the
    chord of what is left, whose error goes with the square of that; where f keeps its sign, the middle."""
    most = float(np.max(np.abs(high - low), initial=tol))
    for _ in range(max(1, int(np.ceil(np.log2(most / tol))) + 1)):
        mid = (low + high) / 2
        above = f(mid[:, None])[:, 0] > 0
        low, high = np.where(above, low, mid), np.where(above, mid, high)
    a, b = f(low[:, None])[:, 0], f(high[:, None])[:, 0]
    between = (a <= 0) & (b > 0)
    return low + np.where(between, -a / np.where(between, b - a, 1.0), 0.5) * (high - low)


def contacts_at_sites(pairs: DataFrame, limit: str, samples: int = 121, tol: float = 1e-6, rows: int = 2000) -> DataFrame:
    """(event_id, site_id, dt_ca, miss_km, speed_kms, dt_in, dt_out): on curved tracks, the closest approach within the event to an observer and when
    the axis comes within the column `limit` (km) of it and leaves; seconds from et. dt_in and dt_out are null where it stays outside, or
    where one of them lies beyond the event's `half`. Pairs: event_id, site_id, et, half, ra, dec, nodes, site_lat, site_lon, ele_m.

    The lowest of evenly spread samples brackets the least distance, whose slope then changes sign; the first samples outside brackets the
    contacts. Both are found by halving, all rows of a batch at once.
    """

    def solved(b: pd.DataFrame) -> pd.DataFrame:
        f = _SiteTracks(b)
        step = 2 * f.half / (samples - 1)
        grid = -f.half[:, None] + step[:, None] * np.arange(samples)
        far = f.distance(grid)
        k = far.argmin(1)
        low, high = (np.clip(grid[np.arange(len(b)), np.clip(k + d, 0, samples - 1)], -f.half, f.half) for d in (-1, 1))
        t = _root(f.slope, low, high, tol)
        # Where the slope keeps its sign, halving ends at a border, as it should.
        place, speed = f(t[:, None])
        miss, r = np.linalg.norm(place[:, 0], axis=-1), b[limit].to_numpy(float)
        ends = []
        for sign in (-1, 1):
            outside = (far > r[:, None]) & (sign * (grid - t[:, None]) > 0)
            found = outside.any(1) & (miss < r)
            first = outside.argmax(1) if sign > 0 else samples - 1 - outside[:, ::-1].argmax(1)
            out = grid[np.arange(len(b)), first]
            ends.append(np.where(found, _root(lambda x: f.distance(x) - r[:, None], t, np.where(found, out, t), tol), np.nan))
        both = np.isfinite(ends[0]) & np.isfinite(ends[1])
        return pd.DataFrame({"event_id": b["event_id"].to_numpy(), "site_id": b["site_id"].to_numpy(), "dt_ca": t, "miss_km": miss, "speed_kms": np.linalg.norm(speed[:, 0], axis=-1), "dt_in": np.where(both, ends[0], np.nan), "dt_out": np.where(both, ends[1], np.nan)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), rows):
                yield solved(b.iloc[k : k + rows])

    raw = pairs.select("event_id", "site_id", "et", "half", "ra", "dec", "nodes", "site_lat", "site_lon", "ele_m", limit).mapInPandas(run, "event_id bigint, site_id bigint, dt_ca double, miss_km double, speed_kms double, dt_in double, dt_out double")
    return raw.select("event_id", "site_id", "dt_ca", "miss_km", "speed_kms", *[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) for c in ("dt_in", "dt_out")])


def instants(events: DataFrame, step_s: float = 30.0, most_s: float = 14400.0, tol: float = 1e-9) -> DataFrame:
    """(event_id, instant, dt): when the axis touches down on the ellipsoid, is closest to the Earth's centre, and leaves; seconds from et. An axis that
    passes by at its closest has the middle row only. The Earth's outline in the plane is an ellipse, by the star's declination."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = {k: b[k].to_numpy(float)[:, None] for k in ("x0", "y0", "vx", "vy", "ax", "ay")}
            polar = np.sqrt(1 - earth.E2 * np.cos(np.radians(b["dec"].to_numpy(float))) ** 2)[:, None]
            x, y = (lambda t, a=a: c[f"{a}0"] + t * (c[f"v{a}"] + t * c[f"a{a}"]) for a in "xy")
            slope = lambda t: x(t) * (c["vx"] + 2 * t * c["ax"]) + y(t) * (c["vy"] + 2 * t * c["ay"])
            off = lambda t: np.hypot(x(t), y(t) / polar) - earth.EARTH_KM
            grid = np.broadcast_to(np.arange(-most_s / 2, most_s / 2 + 1, step_s)[None], (len(b), int(most_s / step_s) + 1))
            k = np.hypot(x(grid), y(grid)).argmin(1) if len(b) else np.zeros(0, int)
            low, high = (grid[np.arange(len(b)), np.clip(k + d, 0, grid.shape[1] - 1)] for d in (-1, 1))
            centre = _root(slope, low, high, tol)
            hit = off(centre[:, None])[:, 0] < 0
            out = [pd.DataFrame({"event_id": b["event_id"].to_numpy(), "instant": "centre", "dt": centre})]
            for sign, name in ((-1, "touch-down"), (1, "leaving")):
                near, far = centre.copy(), centre + sign * step_s
                inside = hit & (off(far[:, None])[:, 0] <= 0)
                while inside.any() and float(np.abs(far - centre).max()) < most_s:
                    near, far = np.where(inside, far, near), np.where(inside, far + sign * step_s, far)
                    inside = inside & (off(far[:, None])[:, 0] <= 0)
                t = _root(off, near, far, tol)
                found = hit & ~inside
                out.append(pd.DataFrame({"event_id": b["event_id"].to_numpy()[found], "instant": name, "dt": t[found]}))
            yield pd.concat(out, ignore_index=True)

    return events.select("event_id", "dec", "x0", "y0", "vx", "vy", "ax", "ay").mapInPandas(run, "event_id bigint, instant string, dt double")


def of_date(rows: DataFrame, t: Column) -> DataFrame:
    """Adds d and mu (degrees) of the star at a time: declination and Greenwich hour angle for the true equator and equinox of date."""
    jd = jd_of(t)
    named = sky.with_nutation(rows.withColumn("__jd", jd), F.col("__jd"))
    true = named.withColumns(dict(zip(("__ra", "d"), sky.true_position(F.col("ra"), F.col("dec"), F.col("__jd")), strict=True)))
    hour = sky.sidereal(F.col("__jd") - TDB_UTC / DAY_S) + F.col("nut_lon") / 3600.0 * F.cos(F.radians(sky.mean_tilt(F.col("__jd")) + F.col("nut_tilt") / 3600.0)) - F.col("__ra")
    return true.withColumn("mu", sky.turn(hour)).drop("__jd", "__ra", "nut_lon", "nut_tilt")


def context(star: Vec, before: Vec, after: Vec, sun: Vec) -> dict[str, Column]:
    """motion_ra and motion_dec in arcseconds an hour, from directions a minute before and after, and the star's elongation."""
    (a1, d1), (a2, d2) = sky.position(before), sky.position(after)
    da = sky.turn(a2 - a1 + 180.0) - 180.0
    return {
        "motion_ra": da * F.cos(F.radians((d1 + d2) / 2)) * 3600.0 * 30.0,
        "motion_dec": (d2 - d1) * 3600.0 * 30.0,
        "elongation": F.degrees(F.acos(F.least(F.greatest(star.dot(sun), num(-1)), num(1)))),
    }


#: Lines of a path by how many radii and how many errors they lie off the axis.
LINES = {"centre": (0, 0), "north limit": (1, 0), "south limit": (-1, 0), "north 1-sigma": (1, 1), "south 1-sigma": (-1, -1), "north 3-sigma": (1, 3), "south 3-sigma": (-1, -3)}


def path_lines(events: DataFrame, n: int = 25, sigma: str = "sigma_km") -> DataFrame:
    """(event_id, line, k, lat, lon): where the axis, the shadow's edges and its error limits meet the ellipsoid, at n times.

    Each line is the axis moved across its motion in the plane. A line of sight that misses the Earth gives no row. Points on
    the ellipsoid have their latitude in closed form. Times count from the event's, as the difference of two large ones has lost digits.
    """
    flat = (1 - earth.FLATTENING) ** 2
    rows = _with_axes(events).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    offsets = F.array(*[F.struct(F.lit(name).alias("line"), F.lit(float(a)).alias("radii"), F.lit(float(b)).alias("errors")) for name, (a, b) in LINES.items()])
    rows = rows.withColumn("__l", F.explode(offsets)).withColumn("__dt", F.col("half") * (F.col("k").cast("double") * (2.0 / (n - 1)) - 1.0))
    dt = F.col("__dt")
    px, py = (F.col(f"{c}0") + F.col(f"v{c}") * dt + F.col(f"a{c}") * dt * dt for c in "xy")
    rows = rows.withColumns({"__px": px, "__py": py, "__mx": F.col("vx") + 2 * F.col("ax") * dt, "__my": F.col("vy") + 2 * F.col("ay") * dt, "__off": F.col("__l.radii") * F.col("r_km") + F.col("__l.errors") * F.col(sigma)})
    speed = F.sqrt(F.col("__mx") ** 2 + F.col("__my") ** 2)
    rows = rows.withColumns({"__qx": F.col("__px") - F.col("__my") / speed * F.col("__off"), "__qy": F.col("__py") + F.col("__mx") / speed * F.col("__off"), "__turn": earth.earth_turn(jd_of(F.col("et") + F.col("__dt")))})
    p = _vec("e").times(F.col("__qx")).plus(_vec("n").times(F.col("__qy")))
    rows = _columns(_columns(rows, "b", turned(p, F.col("__turn"))), "d", turned(_vec("s"), F.col("__turn")))
    b, d = _vec("b"), _vec("d")
    qa, qb, qc = d.x * d.x + d.y * d.y + d.z * d.z / flat, b.x * d.x + b.y * d.y + b.z * d.z / flat, b.x * b.x + b.y * b.y + b.z * b.z / flat - earth.EARTH_KM**2
    rows = rows.withColumns({"__a": qa, "__b": qb, "__disc": qb * qb - qa * qc})
    far = F.when(F.col("__disc") >= 0, (-F.col("__b") + F.sqrt("__disc")) / F.col("__a"))
    rows = _columns(rows.withColumn("__far", far), "h", b.plus(d.times(F.col("__far"))))
    h = _vec("h")
    lat, lon = F.degrees(F.atan2(h.z, F.sqrt(h.x * h.x + h.y * h.y) * flat)), F.degrees(F.atan2(h.y, h.x))
    # Exploding no or one point keeps the test where it is; a filter would be pushed below all the steps, and they into it.
    point = F.when(F.col("__far").isNotNull(), F.array(F.struct(lat.alias("lat"), lon.alias("lon")))).otherwise(F.array().cast("array<struct<lat:double,lon:double>>"))
    return rows.select("event_id", F.col("__l.line").alias("line"), "k", F.explode(point).alias("p")).select("event_id", "line", "k", "p.lat", "p.lon")


#: Lines of a full path: sides of the axis, whether the radius counts, and which further distance.
PATH_LINES = {
    "centre": (0, 0, None, 0.0),
    "north limit": (1, 1, None, 0.0),
    "south limit": (-1, 1, None, 0.0),
    "north 1-sigma": (1, 1, "sigma3_km", 1 / 3),
    "south 1-sigma": (-1, 1, "sigma3_km", 1 / 3),
    "north 3-sigma": (1, 1, "sigma3_km", 1.0),
    "south 3-sigma": (-1, 1, "sigma3_km", 1.0),
    "north satellite": (1, 1, "sat_km", 1.0),
    "south satellite": (-1, 1, "sat_km", 1.0),
}


def shadow_paths(events: DataFrame, step_km: float = 100.0, reach: float = 1.3, rounds: int = 3) -> DataFrame:
    """(event_id, line, k, et, lat, lon, duration_s): the shadow's path on the ellipsoid, in steps of about `step_km` along the track, from
    `reach` Earth radii before the axis is nearest to the Earth's centre to as far behind it. Events have the elements, r_km, sigma3_km and
    sat_km, null without a known satellite; then the satellite's lines are left out. A step takes 1 to 60 s.

    The shadow comes down at the speed of light: at a ground point that lies `z` nearer to the star than the centre it stands where it
    will cross the plane through the centre z / c later. So point and time are found together, in a few rounds. The duration on the
    centre line is that of the radius at the shadow's speed over the turning ground. Lines off the Earth have no rows.
    """
    flat = (1 - earth.FLATTENING) ** 2
    near = -(F.col("x0") * F.col("vx") + F.col("y0") * F.col("vy")) / (F.col("vx") ** 2 + F.col("vy") ** 2)
    speed = lambda dt: F.sqrt((F.col("vx") + 2 * F.col("ax") * dt) ** 2 + (F.col("vy") + 2 * F.col("ay") * dt) ** 2)
    timed = _with_axes(events).withColumn("__near", near).withColumn("__speed", speed(F.col("__near")))
    stepped = timed.withColumn("__step", F.least(F.greatest(step_km / F.col("__speed"), num(1)), num(60)))
    side = F.ceil(reach * earth.EARTH_KM / F.col("__speed") / F.col("__step")).cast("int")
    lines = [F.struct(F.lit(name).alias("line"), (F.lit(float(s)) * (F.lit(float(own)) * F.col("r_km") + (F.col(more) * F.lit(share) if more else F.lit(0.0)))).alias("off")) for name, (s, own, more, share) in PATH_LINES.items()]
    rows = stepped.withColumn("k", F.explode(F.sequence(-side, side))).withColumn("__l", F.explode(F.filter(F.array(*lines), lambda x: x["off"].isNotNull())))
    rows = rows.withColumns({"__dt": F.col("__near") + F.col("k") * F.col("__step"), "__z": num(0)})
    rows = rows.withColumn("__turn", earth.earth_turn(jd_of(F.col("et") + F.col("__dt"))))
    rows = _columns(rows, "d", turned(_vec("s"), F.col("__turn")))
    for _ in range(rounds):
        tau = F.col("__dt") + F.col("__z") / LIGHT_KM_S
        rows = rows.withColumn("__tau", tau)
        mx, my = F.col("vx") + 2 * F.col("ax") * F.col("__tau"), F.col("vy") + 2 * F.col("ay") * F.col("__tau")
        px, py = F.col("x0") + F.col("__tau") * (F.col("vx") + F.col("ax") * F.col("__tau")), F.col("y0") + F.col("__tau") * (F.col("vy") + F.col("ay") * F.col("__tau"))
        rows = rows.withColumns({"__px": px, "__py": py, "__mx": mx, "__my": my})
        share = F.col("__l.off") / F.sqrt(F.col("__mx") ** 2 + F.col("__my") ** 2)
        rows = rows.withColumns({"__qx": F.col("__px") - F.col("__my") * share, "__qy": F.col("__py") + F.col("__mx") * share})
        rows = _columns(rows, "b", turned(_vec("e").times(F.col("__qx")).plus(_vec("n").times(F.col("__qy"))), F.col("__turn")))
        b, d = _vec("b"), _vec("d")
        qa, qb, qc = d.x * d.x + d.y * d.y + d.z * d.z / flat, b.x * d.x + b.y * d.y + b.z * d.z / flat, b.x * b.x + b.y * b.y + b.z * b.z / flat - earth.EARTH_KM**2
        rows = rows.withColumns({"__a": qa, "__b": qb, "__c": qc})
        # A line that misses the Earth has no root: null from here on.
        disc = F.col("__b") * F.col("__b") - F.col("__a") * F.col("__c")
        rows = rows.withColumn("__z", F.when(disc >= 0, (F.sqrt(disc) - F.col("__b")) / F.col("__a")))
    rows = _columns(rows, "h", _vec("b").plus(_vec("d").times(F.col("__z"))))
    h = _vec("h")
    # The ground's own motion, back on the sky's axes: the Earth's turn times the distance from its axis.
    sky_h = turned(h, -F.col("__turn"))
    ground = Vec(-EARTH_SPIN * sky_h.y, EARTH_SPIN * sky_h.x, num(0))
    rows = _columns(rows, "w", ground)
    over = F.sqrt((F.col("__mx") - _vec("w").dot(_vec("e"))) ** 2 + (F.col("__my") - _vec("w").dot(_vec("n"))) ** 2)
    lat, lon = F.degrees(F.atan2(h.z, F.sqrt(h.x * h.x + h.y * h.y) * flat)), F.degrees(F.atan2(h.y, h.x))
    place = F.struct((F.col("et") + F.col("__dt")).alias("et"), lat.alias("lat"), lon.alias("lon"), F.when(F.col("__l.line") == "centre", 2 * F.col("r_km") / F.greatest(over, num(1e-6))).alias("duration_s"))
    point = F.when(F.col("__z").isNotNull(), F.array(place)).otherwise(F.array().cast("array<struct<et:double,lat:double,lon:double,duration_s:double>>"))
    return rows.select("event_id", F.col("__l.line").alias("line"), "k", F.explode(point).alias("p")).select("event_id", "line", "k", "p.*")
