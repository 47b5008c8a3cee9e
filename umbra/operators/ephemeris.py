"""Tables of states: interpolation over windows of nodes, integration under all planets, bending by several bodies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbra.functions import sky
from umbra.functions.constants import DAY_S, GM_PLANETS, GM_SUN, LIGHT_KM_S
from umbra.functions.sky import Vec, num
from umbra.operators.cells import unfolded
from umbra.operators.orbits import two_body_states

STATE = ("x", "y", "z", "vx", "vy", "vz")


def windows(nodes: DataFrame, size: int, bucket_s: float) -> DataFrame:
    """(target, __bucket, __from, __to, __nodes): for each time span between two nodes the `size` nodes around it, half on either side, or, near a
    target's ends, those at that end. Nodes (target, et, x .. vz) may lie at uneven times. A span stands in each bucket of time that it touches."""
    along = W.partitionBy("target").orderBy("et")
    ahead = [F.lead(F.struct("et", *STATE), k).over(along) for k in range(size)]
    placed = nodes.select("target", "et", F.row_number().over(along).alias("__i"), F.count("*").over(W.partitionBy("target")).alias("__n"), F.array(*ahead).alias("__nodes"))
    # Window i is for the span between its two middle nodes; the first one also for all before, the last one for all behind.
    half = size // 2
    at = lambda k: F.get("__nodes", F.lit(k))["et"]
    begin = F.when(F.col("__i") == 1, at(0)).otherwise(at(half - 1))
    last = F.col("__i") == F.col("__n") - size + 1
    end = F.when(last, at(size - 1)).otherwise(at(half))
    whole = placed.where(F.col("__i") <= F.col("__n") - size + 1).select("target", begin.alias("__from"), end.alias("__to"), last.alias("__last"), "__nodes")
    bucket = lambda t: F.floor(t / bucket_s)
    return whole.withColumn("__bucket", F.explode(F.sequence(bucket(F.col("__from")), bucket(F.col("__to")))))


def hermite_states(nodes: DataFrame, asked: DataFrame, size: int = 4, bucket_s: float = DAY_S) -> DataFrame:
    """`asked` (target, et and others) with the states between an ephemeris' nodes: the polynomial of degree 2 * size - 1 that has place and velocity
    of the `size` nodes around a time. Times before the first or behind the last node, and targets with fewer nodes, have no row.

    Divided differences over nodes that count twice, level by level, as arrays; each level is a projection of its own. Windows and
    times meet by an equi-join on target and bucket of time.
    """
    names = list(asked.columns)
    keyed = asked.withColumn("__bucket", F.floor(F.col("et") / bucket_s))
    inside = (F.col("et") >= F.col("__from")) & ((F.col("et") < F.col("__to")) | (F.col("__last") & (F.col("et") == F.col("__to"))))
    now = unfolded(keyed).join(windows(nodes, size, bucket_s), ["target", "__bucket"]).where(inside)
    # Times from the asked one, in units of the window, so that powers stay near one.
    unit = (F.get("__nodes", F.lit(size - 1))["et"] - F.get("__nodes", F.lit(0))["et"]) / (size - 1)
    now = now.withColumn("__u", unit)
    twice = lambda f: F.flatten(F.transform("__nodes", lambda n: F.array(f(n), f(n))))
    now = now.withColumns({"__z": twice(lambda n: (n["et"] - F.col("et")) / F.col("__u"))} | {f"__d{c}": twice(lambda n, c=c: n[c]) for c in "xyz"} | {f"__r{c}": twice(lambda n, c=c: n[f"v{c}"] * F.col("__u")) for c in "xyz"})
    for level in range(1, 2 * size):
        now = now.withColumns({f"__c{c}{level - 1}": F.get(f"__d{c}", F.lit(0)) for c in "xyz"})
        left = 2 * size - level
        part = lambda a, first, left=left: F.slice(a, F.lit(first), F.lit(left))
        steps = F.zip_with(part("__z", level + 1), part("__z", 1), lambda b, a: b - a)
        found = {}
        for c in "xyz":
            rise = F.zip_with(part(f"__d{c}", 2), part(f"__d{c}", 1), lambda b, a: b - a)
            slope = F.zip_with(rise, steps, lambda d, h: d / F.nullif(h, num(0)))
            # At one and the same node the first difference is the rate there.
            found[f"__d{c}"] = F.zip_with(slope, part(f"__r{c}", 1), lambda d, v: F.coalesce(d, v)) if level == 1 else slope
        now = now.withColumns(found)
    now = now.withColumns({f"__c{c}{2 * size - 1}": F.get(f"__d{c}", F.lit(0)) for c in "xyz"})
    out: dict[str, Column] = {}
    for c in "xyz":
        pairs = F.reverse(F.zip_with(F.array(*[F.col(f"__c{c}{k}") for k in range(2 * size)]), F.col("__z"), lambda a, z: F.struct(a.alias("c"), z.alias("z"))))
        start = F.struct(num(0).alias("p"), num(0).alias("dp"))
        now = now.withColumn(f"__p{c}", F.aggregate(pairs, start, lambda a, t: F.struct((t["c"] - t["z"] * a["p"]).alias("p"), (a["p"] - t["z"] * a["dp"]).alias("dp"))))
        out |= {c: F.col(f"__p{c}.p"), f"v{c}": F.col(f"__p{c}.dp") / F.col("__u")}
    return now.select(*names, *[out[c].alias(c) for c in STATE])


#: Mean elements of the planets' barycentres at J2000: a (AU), e, i, node, perihelion's longitude, mean longitude (degrees; Standish, 1800 to 2050),
#: Pluto's last. Fixed values.
PLANET_ELEMENTS = {
    1: (0.38709927, 0.20563593, 7.00497902, 48.33076593, 77.45779628, 252.25032350),
    2: (0.72333566, 0.00677672, 3.39467605, 76.67984255, 131.60246718, 181.97909950),
    3: (1.00000261, 0.01671123, -0.00001531, 0.0, 102.93768193, 100.46457166),
    4: (1.52371034, 0.09339410, 1.84969142, 49.55953891, -23.94362959, -4.55343205),
    5: (5.20288700, 0.04838624, 1.30439695, 100.47390909, 14.72847983, 34.39644051),
    6: (9.53667594, 0.05386179, 2.48599187, 113.66242448, 92.59887831, 49.95424423),
    7: (19.18916464, 0.04725744, 0.77263783, 74.01692503, 170.95427630, 313.23810451),
    8: (30.06992276, 0.00859048, 1.77004347, 131.78422574, 44.96476227, -55.12002969),
    9: (39.48211675, 0.24882730, 17.14001206, 110.30393684, 224.06891629, 238.92903833),
}


def planet_nodes(days: DataFrame) -> DataFrame:
    """(jd, body, gm, x, y, z, vx, vy, vz), barycentric, of the Sun (10) and the nine barycentres at each jd of `days`: mean orbits, the Sun where the
    nine pull it. Stands in for a table of a measured ephemeris, which has the same columns."""
    rows = [(k, GM_PLANETS[k], a, e, i, om, peri - om, lon - peri, 2451545.0) for k, (a, e, i, om, peri, lon) in PLANET_ELEMENTS.items()]
    elements = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("body", "gm", "a", "e", "i", "om", "w", "ma", "epoch_jd"), r, strict=True)]) for r in rows])
    around_sun = two_body_states(days.select("jd", F.explode(elements).alias("p")).select("jd", "p.*"), F.col("jd"))
    total = GM_SUN + sum(GM_PLANETS.values())
    pull = W.partitionBy("jd")
    sun = {f"__s{c}": -F.sum(F.col("gm") * F.col(c)).over(pull) / total for c in STATE}
    moved = around_sun.select("jd", F.col("body").cast("int").alias("body"), "gm", *STATE).withColumns(sun)
    nine = moved.select("jd", "body", "gm", *[(F.col(c) + F.col(f"__s{c}")).alias(c) for c in STATE])
    one = moved.where("body = 1").select("jd", F.lit(10).alias("body"), num(GM_SUN).alias("gm"), *[F.col(f"__s{c}").alias(c) for c in STATE])
    return nine.unionByName(one)


#: Rows of planets' states that go to all tasks at most: ten bodies at a hundred thousand times.
BROADCAST_ROWS = 1_000_000


class _Planets:
    """Places of all bodies at any time within a table's nodes, by the cubic through place and velocity of two nodes."""

    def __init__(self, rows: pd.DataFrame) -> None:
        ordered = rows.sort_values(["jd", "body"])
        self.jd, self.gm = np.unique(ordered["jd"].to_numpy(float)), ordered.groupby("body")["gm"].first().to_numpy(float)
        shape = (len(self.jd), len(self.gm), 3)
        if len(ordered) != shape[0] * shape[1]:
            raise ValueError("each body needs a row at each time of the table")
        self.r, self.v = (ordered[list(c)].to_numpy(float).reshape(shape) for c in (STATE[:3], STATE[3:]))
        self.sun = int(np.argmax(self.gm))

    def _span(self, t: float) -> tuple[int, float, float]:
        if not self.jd[0] <= t <= self.jd[-1]:
            raise ValueError(f"the planets' table ends before {t}")
        k = min(max(int(np.searchsorted(self.jd, t, "right")) - 1, 0), len(self.jd) - 2)
        h = self.jd[k + 1] - self.jd[k]
        return k, h, (t - self.jd[k]) / h

    def places(self, t: float) -> np.ndarray:
        k, h, s = self._span(t)
        a, va, b, vb = self.r[k], self.v[k] * h, self.r[k + 1], self.v[k + 1] * h
        miss, bend = b - a - va, vb - va
        return a + s * (va + s * (3 * miss - bend + s * (bend - 2 * miss)))

    def sun_state(self, t: float) -> tuple[np.ndarray, np.ndarray]:
        k, h, s = self._span(t)
        v = self.v[:, self.sun]
        return self.places(t)[self.sun], v[k] + s * (v[k + 1] - v[k])

    def pull(self, r: np.ndarray, t: float) -> np.ndarray:
        # Axis by axis, a row for each planet: long plain loops, no third power by pow.
        x, y, z = (there[:, None] - here[None] for there, here in zip(self.places(t).T, np.ascontiguousarray(r.T), strict=True))
        far = x * x + y * y + z * z
        weight = self.gm[:, None] / (far * np.sqrt(far))
        return np.stack([(weight * c).sum(0) for c in (x, y, z)], axis=1)


def quintic(s: np.ndarray, h: float, ends: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Place and velocity at 0 <= s <= 1 of a step of h, from place, velocity and pull (n, 3) at both ends; s has a row for each time."""
    (p0, v0, a0), (p1, v1, a1) = ends
    c2 = a0 * h * h / 2
    k0, k1, k2 = p1 - p0 - v0 * h - c2, (v1 - v0) * h - 2 * c2, (a1 - a0) * h * h
    c3, c4, c5 = 10 * k0 - 4 * k1 + k2 / 2, -15 * k0 + 7 * k1 - k2, 6 * k0 - 3 * k1 + k2 / 2
    s = s[:, None, None]
    place = p0 + s * (v0 * h + s * (c2 + s * (c3 + s * (c4 + s * c5))))
    return place, v0 + s * (2 * c2 + s * (3 * c3 + s * (4 * c4 + s * 5 * c5))) / h


def integrated(bodies: DataFrame, planets: DataFrame, times: list[float], step: float = 0.5, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(number, jd, x .. vz): barycentric states of bodies at `times`, under the Sun and all bodies of `planets` (as `planet_nodes` gives them).

    bodies: number, epoch_jd and heliocentric states x .. vz at their own epoch. The bodies of a batch with one epoch are integrated together, by
    fourth-order Runge-Kutta steps from the epoch to the farthest time, and read off between steps by quintics; epochs need not
    come together, so one epoch of all bodies is no hot key. An epoch that lies inside the window of times is an error. Bodies are dealt by number first, as a small table's file is few tasks' and the steps are many.
    The planets' table goes to all tasks behind a check of its size.
    """
    rows = planets.limit(most_rows + 1).toPandas()
    if len(rows) > most_rows:
        raise ValueError(f"the planets' table has more than {most_rows} rows")
    held = bodies.sparkSession.sparkContext.broadcast(_Planets(rows))
    out_jd = np.array(sorted(times), float)

    def group(numbers: np.ndarray, r: np.ndarray, v: np.ndarray, epoch: float) -> pd.DataFrame:
        field = held.value
        if out_jd[0] < epoch < out_jd[-1]:
            raise ValueError(f"epoch {epoch} lies inside the window of times")
        sun, sun_v = field.sun_state(epoch)
        r, v = r + sun, v + sun_v
        far = out_jd[-1] if abs(out_jd[-1] - epoch) >= abs(out_jd[0] - epoch) else out_jd[0]
        n = max(1, int(np.ceil(abs(far - epoch) / step)))
        h = (far - epoch) / n
        which = np.clip(np.ceil(np.abs(out_jd - epoch) / abs(h) - 1e-12).astype(int) - 1, 0, n - 1) if h else np.zeros(len(out_jd), int)
        place, speed = np.empty((len(out_jd), *r.shape)), np.empty((len(out_jd), *r.shape))
        if not h:
            place[:], speed[:] = r, v
        a1 = field.pull(r, epoch)
        for k in range(n if h else 0):
            t = epoch + k * h
            r2, v2 = r + h / 2 * v, v + h / 2 * a1
            a2 = field.pull(r2, t + h / 2)
            r3, v3 = r + h / 2 * v2, v + h / 2 * a2
            a3 = field.pull(r3, t + h / 2)
            r4, v4 = r + h * v3, v + h * a3
            end = min(t + h, max(epoch, far)) if h > 0 else max(t + h, min(epoch, far))
            a4 = field.pull(r4, end)
            new_r, new_v = r + h / 6 * (v + 2 * v2 + 2 * v3 + v4), v + h / 6 * (a1 + 2 * a2 + 2 * a3 + a4)
            new_a = field.pull(new_r, end)
            here = np.flatnonzero(which == k)
            if len(here):
                place[here], speed[here] = quintic((out_jd[here] - t) / h, h, ((r, v, a1), (new_r, new_v, new_a)))
            r, v, a1 = new_r, new_v, new_a
        m = len(out_jd)
        flat = np.concatenate((place, speed), axis=2).transpose(1, 0, 2).reshape(-1, 6)
        return pd.DataFrame({"number": np.repeat(numbers, m), "jd": np.tile(out_jd, len(numbers)), **dict(zip(STATE, flat.T, strict=True))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for epoch, part in b.groupby("epoch_jd"):
                yield group(part["number"].to_numpy(), part[list(STATE[:3])].to_numpy(float), part[list(STATE[3:])].to_numpy(float), float(epoch))

    kept = bodies.select("number", F.col("epoch_jd").cast("double").alias("epoch_jd"), *[F.col(c).cast("double") for c in STATE])
    spread = kept.repartition(int(bodies.sparkSession.conf.get("spark.sql.shuffle.partitions")), "number")
    return spread.mapInPandas(run, "number bigint, jd double, " + ", ".join(f"{c} double" for c in STATE))


def beside(rays: DataFrame, deflectors: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Rays with __bodies, the deflectors of their `key` as an array, by body. There are few bodies to a key and few keys (days, say) to many rays, so a key's
    rays would be all in one task if they were shuffled by it: the deflectors go to all tasks instead."""
    listed = deflectors.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("body", "gm", "bx", "by_", "bz"))).alias("__bodies"))
    return rays.join(listed.hint("broadcast"), key, how)


def deflected(rays: DataFrame, deflectors: DataFrame, key: str = "day") -> DataFrame:
    """(ray, dx, dy, dz, bent_mas, by): how bodies bend a star's light against that of a target which they bend too, as one vector to add to the star's
    direction.

    rays: ray (an id), `key`, px, py, pz (the star's direction), tx, ty, tz (from the Earth to the target, km), centre (the body whose system the
    target belongs to, null for none). deflectors: `key`, body, gm (km^3/s^2), bx, by_, bz (from the Earth to the body, km). The
    target's own system bends nothing here. `by` has the bodies' shares in mas, by body.
    """
    p, t = (Vec(*(F.col(c) for c in names)) for names in (("px", "py", "pz"), ("tx", "ty", "tz")))
    mas = 180 / np.pi * 3.6e6

    # In steps, as what is said twice within a step is worked out twice.
    vec = lambda x, name: Vec(*(x[f"{name}{k}"] for k in "xyz"))
    named = lambda v, name: [c.alias(f"{name}{k}") for k, c in zip("xyz", v, strict=True)]
    also = lambda x, *names: [x[n].alias(n) for n in ("body", *names)]
    axes = lambda *names: [f"{n}{k}" for n in names for k in "xyz"]

    def placed(x: Column) -> Column:
        b = Vec(x["bx"], x["by_"], x["bz"])
        return F.struct(*also(x, "gm"), b.norm().alias("away"), *named(b, "b"), *named(t.minus(b), "t"))

    def directed(x: Column) -> Column:
        return F.struct(*also(x), (x["gm"] * (2.0 / LIGHT_KM_S**2) / x["away"]).alias("g"), *named(vec(x, "b").times(-1 / x["away"]), "o"), *named(vec(x, "t").unit(), "q"))

    def turned(x: Column) -> Column:
        o, q = vec(x, "o"), vec(x, "q")
        return F.struct(*also(x, "g", *axes("o", "q")), p.dot(o).alias("po"), p.dot(q).alias("pq"), sky.unless_opposite(1.0 + p.dot(o)).alias("star"), sky.unless_opposite(1.0 + q.dot(o)).alias("near"))

    def bent_by(x: Column) -> Column:
        o, q = vec(x, "o"), vec(x, "q")
        d = o.minus(p.times(x["po"])).times(x["star"]).minus(o.times(x["pq"]).minus(q.times(x["po"])).times(x["near"]))
        return F.struct(*also(x), *named(d.times(x["g"]), "d"))

    shares = F.filter("__bodies", lambda body: ~F.coalesce(F.col("centre") == body["body"], F.lit(False)))
    for step in (placed, directed, turned, bent_by):
        shares = F.transform(shares, step)
    bent = beside(rays, deflectors, key, "left").withColumn("__bent", F.coalesce(shares, F.array()))
    total = lambda name: F.aggregate("__bent", num(0), lambda a, x: a + x[name]).alias(name)
    summed = bent.select("ray", "__bent", *[total(f"d{k}") for k in "xyz"])
    size = lambda x: F.sqrt(x["dx"] * x["dx"] + x["dy"] * x["dy"] + x["dz"] * x["dz"]) * mas
    by = F.transform("__bent", lambda x: F.struct(x["body"].alias("body"), size(x).alias("mas")))
    return summed.select("ray", "dx", "dy", "dz", (F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2) * mas).alias("bent_mas"), by.alias("by"))
