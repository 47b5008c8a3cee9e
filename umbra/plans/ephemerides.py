"""Tables of states: windows of nodes, integration under all planets, bending by several bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import sky
from umbra.functions.constants import GM_SUN
from umbra.functions.sky import num
from umbra.operators import ephemeris, orbits
from umbra.plans.registry import query
from umbra.plans.tables import table

NODES, ASKED = 12, 10
#: Orbits three times as eccentric as the table's, up to 0.9; a node each quarter radian of the eccentric anomaly, so at uneven times.
ORBIT = f"SELECT number, a, 3*e AS ec, a*sqrt(1-9*e*e) AS b, sqrt({GM_SUN!r}::DOUBLE/pow(a,3)) AS nn, radians(ma) AS e0 FROM {{asteroids}}"


def _sql_at(k: str, orbit: str = "o") -> str:
    ea = f"({orbit}.e0+{k}*0.25::DOUBLE)"
    r = f"(1-{orbit}.ec*cos({ea}))"
    return f"({ea}-{orbit}.ec*sin({ea}))/{orbit}.nn AS t, {orbit}.a*(cos({ea})-{orbit}.ec) AS x, {orbit}.b*sin({ea}) AS y, -{orbit}.a*{orbit}.nn*sin({ea})/{r} AS vx, {orbit}.b*{orbit}.nn*cos({ea})/{r} AS vy"


def on_orbits(spark: SparkSession, sf_dir: str, k: DataFrame) -> DataFrame:
    """(target, k, et in days, x .. vz) at the eccentric anomalies e0 + k / 4."""
    o = table(spark, sf_dir, "asteroids").select("number", "a", (3 * F.col("e")).alias("ec"), F.radians("ma").alias("e0"), F.sqrt(num(GM_SUN) / F.pow("a", num(3))).alias("nn"))
    rows = o.withColumn("k", F.explode(k)).withColumn("ea", F.col("e0") + F.col("k") * 0.25)
    c, s, b = F.cos("ea"), F.sin("ea"), F.col("a") * F.sqrt(1 - F.col("ec") ** 2)
    r = 1 - F.col("ec") * c
    states = {"x": F.col("a") * (c - F.col("ec")), "y": b * s, "z": num(0), "vx": -F.col("a") * F.col("nn") * s / r, "vy": b * F.col("nn") * c / r, "vz": num(0)}
    return rows.select(F.col("number").alias("target"), "k", ((F.col("ea") - F.col("ec") * s) / F.col("nn")).alias("et"), *[x.alias(n) for n, x in states.items()])


def windowed(spark: SparkSession, sf_dir: str, size: int = 4) -> DataFrame:
    """States at ten times between the nodes of each orbit, with the true ones: q, tx, ty, tvx."""
    nodes = on_orbits(spark, sf_dir, F.sequence(F.lit(0), F.lit(NODES - 1)))
    asked = on_orbits(spark, sf_dir, F.transform(F.sequence(F.lit(0), F.lit(ASKED - 1)), lambda q: q + 0.37))
    known = asked.select("target", F.floor("k").cast("int").alias("q"), "et", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("vx").alias("tvx"))
    return ephemeris.hermite_states(nodes.drop("k"), known, size, 100.0)


@query(
    "hermite_window",
    f"""WITH o AS ({ORBIT}), nd AS (SELECT number, CAST(i AS INTEGER) AS i, {_sql_at('i')} FROM o CROSS JOIN (SELECT unnest(range({NODES})) AS i)),
    qs AS (SELECT number, CAST(q AS INTEGER) AS q, least(greatest(q-1,0),{NODES - 4}) AS first_, {_sql_at('(q+0.37::DOUBLE)')} FROM o CROSS JOIN (SELECT unnest(range({ASKED})) AS q)),
    w AS (SELECT qs.number, q, qs.t, n.i, n.t AS ti, n.x, n.y, n.vx, n.vy FROM qs JOIN nd n ON n.number=qs.number AND n.i BETWEEN first_ AND first_+3),
    l AS (SELECT w.number, w.q, w.i, any_value(w.t-w.ti) AS d, any_value(w.x) AS x, any_value(w.y) AS y, any_value(w.vx) AS vx, any_value(w.vy) AS vy, product((w.t-m.ti)/(w.ti-m.ti)) AS l, sum(1/(w.ti-m.ti)) AS s, sum(1/(w.t-m.ti)) AS g FROM w JOIN w m ON m.number=w.number AND m.q=w.q AND m.i<>w.i GROUP BY w.number, w.q, w.i)
    SELECT number, q, round(sum((1-2*d*s)*l*l*x+d*l*l*vx),6) AS x, round(sum((1-2*d*s)*l*l*y+d*l*l*vy),6) AS y, round(1000*sum((-2*s*l*l+(1-2*d*s)*2*l*l*g)*x+(l*l+2*d*l*l*g)*vx),6) AS vx3 FROM l GROUP BY number, q""",
)
def hermite_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eccentric orbits between uneven nodes, by windows of four."""
    found = windowed(spark, sf_dir)
    return found.select(F.col("target").alias("number"), "q", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round(1000 * F.col("vx"), 6).alias("vx3"))


def planets(spark: SparkSession, first: float, last: float, step: float = 1.0) -> DataFrame:
    n = int((last - first) / step) + 1
    return ephemeris.planet_nodes(spark.range(n).select((F.col("id") * step + first).alias("jd")))


@query("propagate_nbody")
def propagate_nbody(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barycentric states at three times, from three epochs. Rows only: integration has no SQL form. Tests hold it against two bodies, against
    itself run back, and in other batches."""
    bodies = table(spark, sf_dir, "asteroids").withColumn("epoch_jd", F.col("epoch_jd") + F.col("number") % 3 * 10)
    return ephemeris.integrated(orbits.two_body_states(bodies, F.col("epoch_jd")), planets(spark, 2460790.0, 2460860.0), [2460830.5, 2460841.25, 2460850.5])


#: Bodies that bend light: number, GM (km^3/s^2), distance (km), phase and rate (radians, radians a day) of the circle that stands for its path.
BENDING = [(10, 1.32712440018e11, 1.5e8, 0.4, 0.0172), (5, 1.26712764e8, 8.5e8, 2.0, 0.0015), (6, 3.7940585e7, 1.4e9, 5.1, 0.0006)]
CENTRE = "CASE WHEN number%11=5 THEN 5 WHEN number%11=6 THEN 6 END"
_BODIES = ", ".join(f"({b}, {gm!r}::DOUBLE, {r!r}::DOUBLE, {p!r}::DOUBLE, {w!r}::DOUBLE)" for b, gm, r, p, w in BENDING)


def _bend_sql(q: str) -> str:
    """Bending of direction p for a source in direction q from the body, by its three axes; o is the direction from the body to the observer."""
    pq, pe, qe = (f"({a}x*{b}x+{a}y*{b}y+{a}z*{b}z)" for a, b in (("p", q), ("p", "o"), (q, "o")))
    return ", ".join(f"2*gm/(pow(299792.458::DOUBLE,2)*dist)*(o{k}*{pq}-{q}{k}*{pe})/(1+{qe}) AS {q}b{k}" for k in "xyz")


@query(
    "star_deflection",
    f"""WITH e AS (SELECT event_id, CAST(floor(et/86400) AS INTEGER) AS day, {CENTRE} AS centre, x0, y0, ra, dec, (1.5::DOUBLE+number%17/10::DOUBLE)*149597870.7::DOUBLE AS far FROM {{elements}}),
    p AS (SELECT *, cos(radians(dec))*cos(radians(ra)) AS px, cos(radians(dec))*sin(radians(ra)) AS py, sin(radians(dec)) AS pz, -sin(radians(ra)) AS ex, cos(radians(ra)) AS ey FROM e),
    t AS (SELECT *, px*far+ex*x0-pz*ey*y0 AS tx, py*far+ey*x0+pz*ex*y0 AS ty, pz*far+(px*ey-py*ex)*y0 AS tz FROM p),
    b AS (SELECT t.*, body, gm, r AS dist, r*cos(ph+w*day) AS bx, r*sin(ph+w*day)*0.9175::DOUBLE AS by_, r*sin(ph+w*day)*0.3978::DOUBLE AS bz FROM t CROSS JOIN (SELECT * FROM (VALUES {_BODIES}) v(body, gm, r, ph, w)) WHERE centre IS NULL OR centre <> body),
    u AS (SELECT * REPLACE (sqrt(bx*bx+by_*by_+bz*bz) AS dist), sqrt(pow(tx-bx,2)+pow(ty-by_,2)+pow(tz-bz,2)) AS td FROM b),
    v AS (SELECT *, -bx/dist AS ox, -by_/dist AS oy, -bz/dist AS oz, (tx-bx)/td AS qx, (ty-by_)/td AS qy, (tz-bz)/td AS qz FROM u),
    d AS (SELECT *, {_bend_sql('p')}, {_bend_sql('q')} FROM v),
    s AS (SELECT event_id, count(*) AS n, sum(pbx-qbx) AS dx, sum(pby-qby) AS dy, sum(pbz-qbz) AS dz, max(sqrt(pow(pbx-qbx,2)+pow(pby-qby,2)+pow(pbz-qbz,2))) AS most FROM d GROUP BY event_id)
    SELECT event_id, n AS bodies, round(log10(sqrt(dx*dx+dy*dy+dz*dz)*180/pi()*3.6e6::DOUBLE),4) AS log_mas, round(log10(most*180/pi()*3.6e6::DOUBLE),4) AS log_most FROM s""",
)
def star_deflection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the Sun, Jupiter and Saturn bend each event's star against its body, without the body's own system."""
    found = ephemeris.deflected(rays_of(spark, sf_dir).drop("far"), deflecting(spark, sf_dir))
    most = F.array_max(F.transform("by", lambda x: x["mas"]))
    return found.select(F.col("ray").alias("event_id"), F.size("by").cast("bigint").alias("bodies"), F.round(F.log10("bent_mas"), 4).alias("log_mas"), F.round(F.log10(most), 4).alias("log_most"))


def rays_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ray, day, centre, far in km, px .. pz, tx .. tz) of all events."""
    events = table(spark, sf_dir, "elements").withColumns({"day": F.floor(F.col("et") / 86400).cast("int"), "centre": F.expr(CENTRE), "far": (1.5 + F.col("number") % 17 / 10.0) * 149597870.7})
    p = sky.direction(F.col("ra"), F.col("dec"))
    east, north = sky.plane_axes(p)
    t = p.times(F.col("far")).plus(east.times(F.col("x0"))).plus(north.times(F.col("y0")))
    return events.select(F.col("event_id").alias("ray"), "day", "centre", "far", *[c.alias(f"p{k}") for k, c in zip("xyz", p, strict=True)], *[c.alias(f"t{k}") for k, c in zip("xyz", t, strict=True)])


def deflecting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, body, gm, bx, by_, bz) of the bending bodies on each day that has events."""
    bodies = F.array(*[F.struct(F.lit(b).alias("body"), num(gm).alias("gm"), num(r).alias("r"), num(ph).alias("ph"), num(w).alias("w")) for b, gm, r, ph, w in BENDING])
    angle = F.col("b.ph") + F.col("b.w") * F.col("day")
    there = {"bx": F.col("b.r") * F.cos(angle), "by_": F.col("b.r") * F.sin(angle) * 0.9175, "bz": F.col("b.r") * F.sin(angle) * 0.3978}
    days = table(spark, sf_dir, "elements").select(F.floor(F.col("et") / 86400).cast("int").alias("day")).distinct()
    return days.withColumn("b", F.explode(bodies)).select("day", "b.body", "b.gm", *[x.alias(c) for c, x in there.items()])
