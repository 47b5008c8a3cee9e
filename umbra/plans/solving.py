"""Orbits, site solutions, contact times and paths on the ground."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbra.functions import light, sky
from umbra.functions.constants import EARTH_KM, NUTATION, NUTATION_ARGUMENTS
from umbra.functions.sky import Vec, num
from umbra.operators import orbits, scan, solve, tracks
from umbra.operators.shadow import jd_of, plane_at
from umbra.plans import paths
from umbra.plans.registry import query
from umbra.plans.shadows import ALL_PAIRS, passing
from umbra.plans.tables import table

JD = 2460900.5
NEWTON = ", ".join(f"k{i + 1} AS (SELECT * REPLACE (ecc - (ecc - e*sin(ecc) - m)/(1 - e*cos(ecc)) AS ecc) FROM k{i})" for i in range(12))
STATES = f"""k0 AS (SELECT *, nn*({JD}::DOUBLE-epoch_jd)+radians(ma) AS m, nn*({JD}::DOUBLE-epoch_jd)+radians(ma)+e*sin(nn*({JD}::DOUBLE-epoch_jd)+radians(ma)) AS ecc FROM (SELECT *, sqrt(2.9591220828411956e-04::DOUBLE/pow(a,3)) AS nn FROM {{asteroids}})), {NEWTON},
  f AS (SELECT *, a*(cos(ecc)-e) AS xp, a*sqrt(1-e*e)*sin(ecc) AS yp, -a*nn*sin(ecc)/(1-e*cos(ecc)) AS vxp, a*sqrt(1-e*e)*nn*cos(ecc)/(1-e*cos(ecc)) AS vyp, radians(84381.448::DOUBLE/3600) AS tl, cos(radians(om)) AS co, sin(radians(om)) AS so, cos(radians(i)) AS ci, sin(radians(i)) AS si, cos(radians(w)) AS cw, sin(radians(w)) AS sw FROM k12),
  g AS (SELECT number, tl, (co*cw-so*sw*ci)*xp+(-co*sw-so*cw*ci)*yp AS gx, (so*cw+co*sw*ci)*xp+(-so*sw+co*cw*ci)*yp AS gy, sw*si*xp+cw*si*yp AS gz, (co*cw-so*sw*ci)*vxp+(-co*sw-so*cw*ci)*vyp AS hx, (so*cw+co*sw*ci)*vxp+(-so*sw+co*cw*ci)*vyp AS hy, sw*si*vxp+cw*si*vyp AS hz FROM f),
  st AS (SELECT number, gx AS x, cos(tl)*gy-sin(tl)*gz AS y, sin(tl)*gy+cos(tl)*gz AS z, hx AS vx, cos(tl)*hy-sin(tl)*hz AS vy, sin(tl)*hy+cos(tl)*hz AS vz FROM g)"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orbits.two_body_states(table(spark, sf_dir, "asteroids"), num(JD))


@query("kepler_state", f"WITH {STATES} SELECT number, round(x,7) AS x, round(y,7) AS y, round(z,7) AS z, round(vx*1000,6) AS vx, round(vy*1000,6) AS vy, round(vz*1000,6) AS vz FROM st")
def kepler_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir).select("number", *[F.round(c, 7).alias(c) for c in "xyz"], *[F.round(F.col(f"v{c}") * 1000, 6).alias(f"v{c}") for c in "xyz"])


@query(
    "light_time",
    f"""WITH {STATES}, s0 AS (SELECT *, x-0.98::DOUBLE AS a, y-0.1::DOUBLE AS b, z-0.05::DOUBLE AS c FROM st), s1 AS (SELECT *, sqrt(a*a+b*b+c*c)*(149597870.7::DOUBLE/299792.458::DOUBLE/86400) AS d1 FROM s0),
    s2 AS (SELECT *, sqrt(pow(x-vx*d1-0.98::DOUBLE,2)+pow(y-vy*d1-0.1::DOUBLE,2)+pow(z-vz*d1-0.05::DOUBLE,2))*(149597870.7::DOUBLE/299792.458::DOUBLE/86400) AS d2 FROM s1)
    SELECT number, round(x-vx*d2-0.98::DOUBLE,8) AS gx, round(sqrt(pow(x-vx*d2-0.98::DOUBLE,2)+pow(y-vy*d2-0.1::DOUBLE,2)+pow(z-vz*d2-0.05::DOUBLE,2)),8) AS dist FROM s2""",
)
def light_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = orbits.retarded(Vec(*(F.col(c) for c in "xyz")), Vec(*(F.col(f"v{c}") for c in "xyz")), Vec(num(0.98), num(0.1), num(0.05)))
    return states(spark, sf_dir).select("number", F.round(seen.x, 8).alias("gx"), F.round(seen.norm(), 8).alias("dist"))


@query(
    "hermite_interp",
    """WITH e AS (SELECT number, 0.37::DOUBLE AS s, 0.5::DOUBLE AS h, a AS p0, e AS v0, i/100 AS a0, a+0.2::DOUBLE AS p1, e+0.05::DOUBLE AS v1, i/90 AS a1 FROM {asteroids})
    SELECT number, round((1-10*pow(s,3)+15*pow(s,4)-6*pow(s,5))*p0+(s-6*pow(s,3)+8*pow(s,4)-3*pow(s,5))*v0*h+0.5::DOUBLE*(s*s-3*pow(s,3)+3*pow(s,4)-pow(s,5))*a0*h*h+0.5::DOUBLE*(pow(s,3)-2*pow(s,4)+pow(s,5))*a1*h*h+(-4*pow(s,3)+7*pow(s,4)-3*pow(s,5))*v1*h+(10*pow(s,3)-15*pow(s,4)+6*pow(s,5))*p1,8) AS v FROM e""",
)
def hermite_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = ((F.col("a"), F.col("e"), F.col("i") / 100), (F.col("a") + 0.2, F.col("e") + 0.05, F.col("i") / 90))
    return table(spark, sf_dir, "asteroids").select("number", F.round(orbits.hermite(num(0.37), num(0.5), ends), 8).alias("v"))


@query(
    "lagrange_interp",
    """WITH p AS (SELECT number, j, dec*dec AS y, lead(dec*dec,1) OVER w AS y1, lead(dec*dec,2) OVER w AS y2, lead(dec*dec,3) OVER w AS y3, 1.4::DOUBLE AS s FROM {path_samples} WINDOW w AS (PARTITION BY number ORDER BY j))
    SELECT number, j, round(-(s-1)*(s-2)*(s-3)/6*y+s*(s-2)*(s-3)/2*y1-s*(s-1)*(s-3)/2*y2+s*(s-1)*(s-2)/6*y3,7) AS v FROM p WHERE y3 IS NOT NULL""",
)
def lagrange_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("dec") * F.col("dec")
    four = table(spark, sf_dir, "path_samples").withColumn("y", y).select("number", "j", "y", *[F.lead("y", k).over(tracks.path()).alias(f"y{k}") for k in (1, 2, 3)]).where("y3 IS NOT NULL")
    return four.select("number", "j", F.round(orbits.lagrange(num(1.4), tuple(F.col(c) for c in ("y", "y1", "y2", "y3"))), 7).alias("v"))


DAYS = "((2451545::DOUBLE+{t}/86400)-2451545)"
ERA = f"2*pi()*(0.7790572732640::DOUBLE+1.00273781191135448::DOUBLE*{DAYS}-floor(0.7790572732640::DOUBLE+1.00273781191135448::DOUBLE*{DAYS}))"

S = "7.2921150e-5::DOUBLE"


C = "299792.458::DOUBLE"


def _newton(i: int) -> str:
    era = ERA.format(t="t")
    return f"""a{i} AS (SELECT *, fx*cos({era})-fy*sin({era}) AS ox, fx*sin({era})+fy*cos({era}) AS oy FROM n{i}), l{i} AS (SELECT *, t-et+(ox*sx+oy*sy+fz*sz)/{C} AS dt, 1+{S}*(-oy*sx+ox*sy)/{C} AS so FROM a{i}),
    b{i} AS (SELECT * EXCLUDE (so), x0+vx*dt+ax*dt*dt-(ox*ex+oy*ey) AS rx, y0+vy*dt+ay*dt*dt-(ox*nx+oy*ny+fz*nz) AS ry, (vx+2*ax*dt)*so-{S}*(-oy*ex+ox*ey) AS ux, (vy+2*ay*dt)*so-{S}*(-oy*nx+ox*ny) AS uy, 2*ax+{S}*{S}*(ox*ex+oy*ey) AS wx, 2*ay+{S}*{S}*(ox*nx+oy*ny) AS wy FROM l{i}),
    n{i + 1} AS (SELECT * EXCLUDE (ox,oy,dt,rx,ry,ux,uy,wx,wy) REPLACE (least(greatest(t-(rx*ux+ry*uy)/CASE WHEN ux*ux+uy*uy+rx*wx+ry*wy > 1e-9 THEN ux*ux+uy*uy+rx*wx+ry*wy ELSE ux*ux+uy*uy END, et-half), et+half) AS t) FROM b{i})"""


PAIRED = "e.*, s.site_id, s.lat, s.lon, s.ele_m, cos(radians(e.dec))*cos(radians(e.ra)) AS sx, cos(radians(e.dec))*sin(radians(e.ra)) AS sy, sin(radians(e.dec)) AS sz, -sin(radians(e.ra)) AS ex, cos(radians(e.ra)) AS ey, 1/298.257223563::DOUBLE*(2-1/298.257223563::DOUBLE) AS e2"
DEALT = f"p AS (SELECT {PAIRED} FROM {{elements}} e JOIN (SELECT *, row_number() OVER (ORDER BY site_id)-1 AS no, count(*) OVER () AS n FROM {{sites}}) s ON s.no = e.number % s.n)"
SOLVING = f"""q AS (SELECT *, -sz*ey AS nx, sz*ex AS ny, sx*ey-sy*ex AS nz, 6378.137::DOUBLE/sqrt(1-e2*sin(radians(lat))*sin(radians(lat))) AS nn FROM p),
  n0 AS (SELECT *, et AS t, (nn+ele_m/1000)*cos(radians(lat))*cos(radians(lon)) AS fx, (nn+ele_m/1000)*cos(radians(lat))*sin(radians(lon)) AS fy, (nn*(1-e2)+ele_m/1000)*sin(radians(lat)) AS fz FROM q), {", ".join(_newton(i) for i in range(6))}, {_newton(6)}"""
SITE = f"{DEALT}, {SOLVING}"
SOLVED = f"{SITE}, done AS (SELECT *, sqrt(rx*rx+ry*ry) AS miss, sqrt(ux*ux+uy*uy) AS speed FROM b6)"


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, each at one of all sites, by the body's number."""
    sites = table(spark, sf_dir, "sites").select("site_id", F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon"), "ele_m", (F.row_number().over(W.orderBy("site_id")) - 1).alias("no"))
    n = sites.agg(F.count("*")).scalar()
    return table(spark, sf_dir, "elements").withColumn("no", F.col("number") % n).join(sites, "no")


def solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solve.closest_at_site(dealt(spark, sf_dir))


# The steps of the solver have names that the test of all pairs uses too, so that comes as a subquery.
@query(
    "site_events",
    f"WITH near AS (WITH {ALL_PAIRS} SELECT * FROM near), p AS (SELECT {PAIRED}, closest_km FROM {{elements}} e JOIN near USING (event_id) JOIN {{sites}} s USING (site_id)), {SOLVING} SELECT event_id, site_id, round(closest_km,1) AS closest_km, round(t-et,1) AS dt_s, round(sqrt(rx*rx+ry*ry),1) AS miss_km FROM b6",
)
def site_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events at all sites that they pass: index, exact test, then the time and distance of closest approach there."""
    sites = table(spark, sf_dir, "sites").select("site_id", F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon"), "ele_m")
    near = passing(spark, sf_dir).select("event_id", "site_id", "closest_km")
    pairs = near.join(table(spark, sf_dir, "elements"), "event_id").join(sites, "site_id")
    done = solve.closest_at_site(pairs)
    return done.select("event_id", "site_id", F.round("closest_km", 1).alias("closest_km"), F.round(F.col("t_ca") - F.col("et"), 1).alias("dt_s"), F.round("miss_km", 1).alias("miss_km"))


@query("site_solve_newton", f"WITH {SOLVED} SELECT event_id, site_id, round(t-et,1) AS dt_s, round(miss,1) AS miss_km, round(speed,4) AS speed_kms FROM done")
def site_solve_newton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved(spark, sf_dir).select("event_id", "site_id", F.round(F.col("t_ca") - F.col("et"), 1).alias("dt_s"), F.round("miss_km", 1).alias("miss_km"), F.round("speed_kms", 4).alias("speed_kms"))


@query(
    "event_metrics",
    f"WITH {SOLVED} SELECT event_id, round(2*sqrt(greatest(r_km*r_km-miss*miss,0)),3) AS chord_km, round(2*sqrt(greatest(r_km*r_km-miss*miss,0))/speed,4) AS duration_s, round(2.5::DOUBLE*log10(1+pow(10,0.4::DOUBLE*(m_ast-g))),6) AS drop_mag, round(miss-r_km,1) AS margin_km FROM done",
)
def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = solve.metrics(F.col("miss_km"), F.col("r_km"), F.col("speed_kms"))
    return solved(spark, sf_dir).select("event_id", F.round(m["chord_km"], 3).alias("chord_km"), F.round(m["duration_s"], 4).alias("duration_s"), F.round(light.drop(F.col("m_ast"), F.col("g")), 6).alias("drop_mag"), F.round(F.col("miss_km") - F.col("r_km"), 1).alias("margin_km"))


@query(
    "pick_acceptance",
    f"WITH {SOLVED}, m AS (SELECT *, 2.5::DOUBLE*log10(1+pow(10,0.4::DOUBLE*(m_ast-g))) AS dm, 2*sqrt(greatest(r_km*r_km-miss*miss,0))/speed AS dur FROM done) SELECT event_id, CASE WHEN miss > r_km+2000 THEN 'miss' WHEN abs(t-et) > half-1 THEN 'edge' WHEN dm < 0.1 THEN 'low drop' WHEN g > 14 THEN 'faint' END AS reason FROM m",
)
def pick_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of tests, in order; null for an event that passes them all."""
    reason = F.when(F.col("miss_km") > F.col("r_km") + 2000, "miss").when(F.abs(F.col("t_ca") - F.col("et")) > F.col("half") - 1, "edge").when(light.drop(F.col("m_ast"), F.col("g")) < 0.1, "low drop").when(F.col("g") > 14, "faint")
    return solved(spark, sf_dir).select("event_id", reason.alias("reason"))


#: How much a track bends beyond its quadratic elements: kilometres by the third power of seconds.
BENDX, BENDY = "1e-9::DOUBLE*(number%7-3)", "1e-9::DOUBLE*(number%5-2)"
LIMIT = "(r_km*40)"


def curved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, each at one of all sites, with nine nodes of a curved track and a body of planetary size as `limit`."""
    dt = lambda k: F.col("half") * (k / 4.0 - 1.0)
    at = lambda a, bend, t: F.col(f"{a}0") + F.col(f"v{a}") * t + F.col(f"a{a}") * t * t + bend * t * t * t
    bends = ((F.col("number") % 7 - 3) * 1e-9, (F.col("number") % 5 - 2) * 1e-9)
    nodes = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.struct(dt(k).alias("dt"), at("x", bends[0], dt(k)).alias("x"), at("y", bends[1], dt(k)).alias("y")))
    return dealt(spark, sf_dir).withColumns({"nodes": nodes, "limit": F.col("r_km") * 40.0})


def _curved(i: str, to: str, step: str) -> str:
    """A round of Newton's method on a curved track, on the offset `t` from et: from table i to table `to`, by `step` of rx, ry, ux, uy, bx, by_."""
    era = "2*pi()*(0.7790572732640::DOUBLE+1.00273781191135448::DOUBLE*((et+t)/86400)-floor(0.7790572732640::DOUBLE+1.00273781191135448::DOUBLE*((et+t)/86400)))"
    return f"""a{to} AS (SELECT *, fx*cos({era})-fy*sin({era}) AS ox, fx*sin({era})+fy*cos({era}) AS oy FROM {i}), l{to} AS (SELECT *, t+(ox*sx+oy*sy+fz*sz)/{C} AS dt, 1+{S}*(-oy*sx+ox*sy)/{C} AS so FROM a{to}),
    b{to} AS (SELECT *, x0+vx*dt+ax*dt*dt+jx*dt*dt*dt-(ox*ex+oy*ey) AS rx, y0+vy*dt+ay*dt*dt+jy*dt*dt*dt-(ox*nx+oy*ny+fz*nz) AS ry, (vx+2*ax*dt+3*jx*dt*dt)*so-{S}*(-oy*ex+ox*ey) AS ux, (vy+2*ay*dt+3*jy*dt*dt)*so-{S}*(-oy*nx+ox*ny) AS uy, 2*ax+6*jx*dt+{S}*{S}*(ox*ex+oy*ey) AS wx, 2*ay+6*jy*dt+{S}*{S}*(ox*nx+oy*ny) AS wy FROM l{to}),
    {to} AS (SELECT * EXCLUDE (ox,oy,dt,so,rx,ry,ux,uy,wx,wy) REPLACE ({step} AS t) FROM b{to})"""


_TO_CLOSEST = "t-(rx*ux+ry*uy)/CASE WHEN ux*ux+uy*uy+rx*wx+ry*wy > 1e-9 THEN ux*ux+uy*uy+rx*wx+ry*wy ELSE ux*ux+uy*uy END"
_TO_EDGE = f"t-(rx*rx+ry*ry-{LIMIT}*{LIMIT})/(2*(rx*ux+ry*uy))"


def _chain(name: str, start: str, step: str, rounds: int) -> str:
    return ", ".join(_curved(start if k == 0 else f"{name}{k}", f"{name}{k + 1}", step) for k in range(rounds))


@query(
    "site_contacts",
    f"""WITH {DEALT}, {SOLVING.split(", a0 AS")[0]}, s0 AS (SELECT * REPLACE (0::DOUBLE AS t), {BENDX} AS jx, {BENDY} AS jy FROM n0), {_chain('c', 's0', f'least(greatest({_TO_CLOSEST}, -half), half)', 9)},
    ca AS (SELECT bc9.* EXCLUDE (ox,oy,dt,so,wx,wy), sqrt(rx*rx+ry*ry) AS miss, sqrt(ux*ux+uy*uy) AS speed FROM bc9), us AS (SELECT * EXCLUDE (rx,ry,ux,uy) FROM ca WHERE miss < {LIMIT} AND abs(t) < half-1),
    i0 AS (SELECT * REPLACE (t-sqrt({LIMIT}*{LIMIT}-miss*miss)/speed AS t) FROM us), {_chain('i', 'i0', _TO_EDGE, 9)}, o0 AS (SELECT * REPLACE (t+sqrt({LIMIT}*{LIMIT}-miss*miss)/speed AS t) FROM us), {_chain('o', 'o0', _TO_EDGE, 9)}
    SELECT us.event_id, us.site_id, round(us.t,3) AS dt_ca, round(us.miss,4) AS miss_km, round(us.speed,5) AS speed_kms, round(i9.t,3) AS dt_in, round(o9.t,3) AS dt_out FROM us JOIN i9 USING (event_id, site_id) JOIN o9 USING (event_id, site_id) WHERE abs(i9.t) < us.half AND abs(o9.t) < us.half""",
)
def site_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a large body's shadow reaches a site and leaves it, on curved tracks, with the site's own light time."""
    found = solve.contacts_at_sites(curved(spark, sf_dir), "limit")
    digits = {"dt_ca": 3, "miss_km": 4, "speed_kms": 5, "dt_in": 3, "dt_out": 3}
    return found.where("dt_in IS NOT NULL").select("event_id", "site_id", *[F.round(c, d).alias(c) for c, d in digits.items()])


_TERMS = ", ".join("(" + ", ".join(f"{float(x)!r}::DOUBLE" for x in row) + ")" for row in NUTATION)
_ARGUMENTS = ", ".join(f"radians({c0!r}::DOUBLE+{c1!r}::DOUBLE*tc+({c2!r}::DOUBLE)*tc*tc+({c3!r}::DOUBLE)*tc*tc*tc) AS g{k}" for k, (c0, c1, c2, c3) in enumerate(NUTATION_ARGUMENTS))


def _date_sql(source: str) -> str:
    """Steps that end in `da`: the columns of `source` (with key, ra, dec, t) with d and mu."""
    return f"""t0 AS (SELECT *, 2451545+t/86400 AS jd, (2451545+t/86400-2451545)/36525 AS tc, (2451545+t/86400-69.184::DOUBLE/86400-2451545)/36525 AS tu FROM {source}), t1 AS (SELECT *, {_ARGUMENTS} FROM t0),
    nu AS (SELECT key, sum((a+at_*tc)*sin(g0*m0+g1*m1+g2*m2+g3*m3+g4*m4))/1e4::DOUBLE AS psi, sum((b+bt*tc)*cos(g0*m0+g1*m1+g2*m2+g3*m3+g4*m4))/1e4::DOUBLE AS eps FROM t1 CROSS JOIN (SELECT * FROM (VALUES {_TERMS}) v(m0,m1,m2,m3,m4,a,at_,b,bt)) GROUP BY key),
    t2 AS (SELECT t0.*, psi, eps, (84381.448::DOUBLE-46.8150::DOUBLE*tc-0.00059::DOUBLE*tc*tc+0.001813::DOUBLE*tc*tc*tc)/3600 AS e0, radians((2306.2181::DOUBLE*tc+0.30188::DOUBLE*tc*tc+0.017998::DOUBLE*tc*tc*tc)/3600) AS ze, radians((2306.2181::DOUBLE*tc+1.09468::DOUBLE*tc*tc+0.018203::DOUBLE*tc*tc*tc)/3600) AS zz, radians((2004.3109::DOUBLE*tc-0.42665::DOUBLE*tc*tc-0.041833::DOUBLE*tc*tc*tc)/3600) AS th FROM t0 JOIN nu USING (key)),
    t3 AS (SELECT *, atan2(cos(radians(dec))*sin(radians(ra)+ze), cos(th)*cos(radians(dec))*cos(radians(ra)+ze)-sin(th)*sin(radians(dec)))+zz AS am, asin(sin(th)*cos(radians(dec))*cos(radians(ra)+ze)+cos(th)*sin(radians(dec))) AS dm FROM t2),
    t4 AS (SELECT *, atan2(cos(radians(e0))*cos(dm)*sin(am)+sin(radians(e0))*sin(dm), cos(dm)*cos(am))+radians(psi/3600) AS el, asin(cos(radians(e0))*sin(dm)-sin(radians(e0))*cos(dm)*sin(am)) AS eb, radians(e0+eps/3600) AS et_ FROM t3),
    t5 AS (SELECT *, degrees(atan2(cos(et_)*cos(eb)*sin(el)-sin(et_)*sin(eb), cos(eb)*cos(el))) AS rt, degrees(asin(sin(et_)*cos(eb)*sin(el)+cos(et_)*sin(eb))) AS d FROM t4),
    t6 AS (SELECT *, 280.46061837::DOUBLE+360.98564736629::DOUBLE*(tu*36525)+0.000387933::DOUBLE*tu*tu-tu*tu*tu/38710000+psi/3600*cos(et_)-rt AS h FROM t5), da AS (SELECT *, h-floor(h/360)*360 AS mu FROM t6)"""


@query("besselian_of_date", f"WITH src AS (SELECT event_id AS key, ra, dec, et AS t FROM {{elements}}), {_date_sql('src')} SELECT key AS event_id, round(d,6) AS d, round(mu,4) AS mu, round(psi,5) AS nut_lon, round(eps,5) AS nut_tilt FROM da")
def besselian_of_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = sky.with_nutation(table(spark, sf_dir, "elements"), jd_of(F.col("et"))).withColumns({"p": F.round("nut_lon", 5), "e": F.round("nut_tilt", 5)})
    dated = solve.of_date(events.select("event_id", "ra", "dec", "et", "p", "e"), F.col("et"))
    return dated.select("event_id", F.round("d", 6).alias("d"), F.round("mu", 4).alias("mu"), F.col("p").alias("nut_lon"), F.col("e").alias("nut_tilt"))


_ROUNDS = 8
_CLOSE = ", ".join(f"k{i + 1} AS (SELECT * REPLACE (dt-((x0+dt*(vx+dt*ax))*(vx+2*ax*dt)+(y0+dt*(vy+dt*ay))*(vy+2*ay*dt))/(pow(vx+2*ax*dt,2)+pow(vy+2*ay*dt,2)+2*ax*(x0+dt*(vx+dt*ax))+2*ay*(y0+dt*(vy+dt*ay))) AS dt) FROM k{i})" for i in range(_ROUNDS))


def _rim(name: str, sign: str) -> str:
    """Newton's rounds to where the axis crosses the Earth's outline, from the straight track's crossing of a circle."""
    first = f"{name}0 AS (SELECT * REPLACE (dt{sign}sqrt(pow(6378.137::DOUBLE,2)-near2)/sqrt(pow(vx+2*ax*dt,2)+pow(vy+2*ay*dt,2)) AS dt) FROM cl WHERE near2 < pow(4000,2))"
    value = "pow(x0+dt*(vx+dt*ax),2)+pow(y0+dt*(vy+dt*ay),2)/k2-pow(6378.137::DOUBLE,2)"
    rate = "2*(x0+dt*(vx+dt*ax))*(vx+2*ax*dt)+2*(y0+dt*(vy+dt*ay))*(vy+2*ay*dt)/k2"
    return ", ".join([first, *(f"{name}{i + 1} AS (SELECT * REPLACE (dt-({value})/({rate}) AS dt) FROM {name}{i})" for i in range(_ROUNDS))])


@query(
    "besselian_instants",
    f"""WITH k0 AS (SELECT *, 1-1/298.257223563::DOUBLE*(2-1/298.257223563::DOUBLE)*pow(cos(radians(dec)),2) AS k2, -(x0*vx+y0*vy)/(vx*vx+vy*vy) AS dt FROM {{elements}}), {_CLOSE}, cl AS (SELECT *, pow(x0+dt*(vx+dt*ax),2)+pow(y0+dt*(vy+dt*ay),2) AS near2 FROM k{_ROUNDS} WHERE abs(dt) < 7000),
    {_rim('p', '-')}, {_rim('q', '+')}, al AS (SELECT *, 'centre' AS instant FROM cl WHERE near2 < pow(4000,2) UNION ALL SELECT *, 'touch-down' FROM p{_ROUNDS} UNION ALL SELECT *, 'leaving' FROM q{_ROUNDS}),
    src AS (SELECT event_id || instant AS key, *, et+dt AS t FROM al), {_date_sql('src')}
    SELECT event_id, instant, round(dt,2) AS dt_s, round((x0+dt*(vx+dt*ax))/6378.137::DOUBLE,5) AS x, round((y0+dt*(vy+dt*ay))/6378.137::DOUBLE,5) AS y, round(vx+2*ax*dt,5) AS dx, round(vy+2*ay*dt,5) AS dy, round(d,6) AS d, round(mu,3) AS mu FROM da""",
)
def besselian_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements where the axis touches down, is closest to the Earth's centre, and leaves; of axes that pass within 4000 km of it."""
    events = table(spark, sf_dir, "elements")
    found = solve.instants(events).join(events, "event_id").withColumns({"t": F.col("et") + F.col("dt")})
    px, py = plane_at(F.col("t"))
    placed = found.withColumns({"px": px, "py": py, "mx": F.col("vx") + 2 * F.col("ax") * F.col("dt"), "my": F.col("vy") + 2 * F.col("ay") * F.col("dt")})
    closest = F.max(F.when(F.col("instant") == "centre", F.struct(F.hypot("px", "py").alias("km"), F.abs("dt").alias("dt")))).over(W.partitionBy("event_id"))
    near = placed.withColumn("c", closest).where("c.km < 4000 AND c.dt < 7000")
    dated = solve.of_date(near, F.col("t"))
    rounded = {"dt_s": ("dt", 2), "dx": ("mx", 5), "dy": ("my", 5), "d": ("d", 6), "mu": ("mu", 3)}
    return dated.select("event_id", "instant", F.round(F.col("px") / EARTH_KM, 5).alias("x"), F.round(F.col("py") / EARTH_KM, 5).alias("y"), *[F.round(c, n).alias(k) for k, (c, n) in rounded.items()])


LINE = "(SELECT event_id, et, x0, y0, vx, vy, r_km, -(x0*vx+y0*vy)/(vx*vx+vy*vy) AS dt, vx*vx+vy*vy AS v2 FROM {elements})"


def straight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "elements").withColumns({"ax": num(0), "ay": num(0)})


@query("bounded_minimum", f"SELECT event_id, round(dt,0) AS dt_s, round(sqrt(pow(x0+vx*dt,2)+pow(y0+vy*dt,2)),2) AS d_km FROM {LINE} WHERE abs(dt) < 7000")
def bounded_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden sections on straight tracks, whose closest approach is known in closed form."""
    events = straight(spark, sf_dir)
    found = solve.minimised(events, 7200.0, 1e-6).join(events.select("event_id", "et"), "event_id").withColumn("dt", F.col("t_min") - F.col("et"))
    return found.where(F.abs("dt") < 7000).select("event_id", F.round("dt", 0).alias("dt_s"), F.round("d_km", 2).alias("d_km"))


@query("contact_times", f"WITH c AS (SELECT *, pow(x0+vx*dt,2)+pow(y0+vy*dt,2) AS d2, pow(6378.137::DOUBLE+r_km,2) AS l2 FROM {LINE}) SELECT event_id, round(CASE WHEN d2<l2 THEN dt-sqrt((l2-d2)/v2) END,1) AS in_s, round(CASE WHEN d2<l2 THEN dt+sqrt((l2-d2)/v2) END,1) AS out_s FROM c")
def contact_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the shadow touches the Earth and leaves it, on straight tracks."""
    t_ca = F.col("et") - (F.col("x0") * F.col("vx") + F.col("y0") * F.col("vy")) / (F.col("vx") ** 2 + F.col("vy") ** 2)
    events = straight(spark, sf_dir).withColumns({"t_ca": t_ca, "limit": F.col("r_km") + EARTH_KM})
    found = solve.crossings(events, "limit", tol=1e-7).join(events.select("event_id", "et"), "event_id")
    return found.select("event_id", F.round(F.col("t_in") - F.col("et"), 1).alias("in_s"), F.round(F.col("t_out") - F.col("et"), 1).alias("out_s"))


@query(
    "event_context",
    """WITH p AS (SELECT number, j, lag(ra) OVER w AS a1, lag(dec) OVER w AS d1, lead(ra) OVER w AS a2, lead(dec) OVER w AS d2, ra, dec, et FROM {path_samples} WINDOW w AS (PARTITION BY number ORDER BY j)), q AS (SELECT *, (a2-a1+180)-floor((a2-a1+180)/360)*360-180 AS da FROM p WHERE a1 IS NOT NULL AND a2 IS NOT NULL)
    SELECT number, j, round(da*cos(radians((d1+d2)/2))*3600*30,3) AS motion_ra, round((d2-d1)*3600*30,3) AS motion_dec, round(degrees(acos(least(greatest(cos(radians(dec))*cos(radians(ra)),-1),1))),4) AS elongation FROM q""",
)
def event_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    around = table(spark, sf_dir, "path_samples").select("number", "j", "ra", "dec", *[f("ra" if c == "a" else "dec").over(tracks.path()).alias(f"{c}{k}") for k, f in ((1, F.lag), (2, F.lead)) for c in "ad"]).where("a1 IS NOT NULL AND a2 IS NOT NULL")
    c = solve.context(sky.direction(F.col("ra"), F.col("dec")), sky.direction(F.col("a1"), F.col("d1")), sky.direction(F.col("a2"), F.col("d2")), Vec(num(1), num(0), num(0)))
    return around.select("number", "j", F.round(c["motion_ra"], 3).alias("motion_ra"), F.round(c["motion_dec"], 3).alias("motion_dec"), F.round(c["elongation"], 4).alias("elongation"))


OFFS = ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in solve.LINES.items())


def lines_sql(n: int) -> str:
    """Points (event_id, line, k, lat, lon) of the seven lines at n times, as steps that end in `pts`."""
    return f"""a AS (SELECT *, r_km/4 AS sg, cos(radians(dec))*cos(radians(ra)) AS sx, cos(radians(dec))*sin(radians(ra)) AS sy, sin(radians(dec)) AS sz, -sin(radians(ra)) AS ex, cos(radians(ra)) AS ey FROM {{elements}}),
    t AS (SELECT a.*, k, half*(k*(2/{n - 1}::DOUBLE)-1) AS dt, l.line, l.ra_, l.er FROM a CROSS JOIN (SELECT CAST(unnest(range({n})) AS INTEGER) AS k) CROSS JOIN (SELECT * FROM (VALUES {OFFS}) v(line, ra_, er)) l),
    m AS (SELECT *, x0+vx*dt+ax*dt*dt AS px, y0+vy*dt+ay*dt*dt AS py, vx+2*ax*dt AS mx, vy+2*ay*dt AS my, ra_*r_km+er*sg AS o, {ERA.format(t='(et+dt)')} AS era, -sz*ey AS nx, sz*ex AS ny, sx*ey-sy*ex AS nz FROM t),
    q AS (SELECT *, px-my/sqrt(mx*mx+my*my)*o AS qx, py+mx/sqrt(mx*mx+my*my)*o AS qy FROM m),
    w AS (SELECT *, ex*qx+nx*qy AS gx, ey*qx+ny*qy AS gy, nz*qy AS gz FROM q),
    r AS (SELECT event_id, line, k, gx*cos(era)+gy*sin(era) AS bx, gy*cos(era)-gx*sin(era) AS by_, gz AS bz, sx*cos(era)+sy*sin(era) AS dx, sy*cos(era)-sx*sin(era) AS dy, sz AS dz, pow(1-1/298.257223563::DOUBLE,2) AS f FROM w),
    z AS (SELECT *, dx*dx+dy*dy+dz*dz/f AS qa, bx*dx+by_*dy+bz*dz/f AS qb, bx*bx+by_*by_+bz*bz/f-pow(6378.137::DOUBLE,2) AS qc FROM r),
    h AS (SELECT *, (-qb+sqrt(qb*qb-qa*qc))/qa AS far FROM z WHERE qb*qb-qa*qc >= 0),
    pts AS (SELECT event_id, line, k, degrees(atan2(bz+dz*far, sqrt(pow(bx+dx*far,2)+pow(by_+dy*far,2))*f)) AS lat, degrees(atan2(by_+dy*far, bx+dx*far)) AS lon FROM h)"""


@query("shadow_path_lines", f"WITH {lines_sql(9)} SELECT event_id, line, k, round(lat,2) AS lat, round(lon,2) AS lon FROM pts")
def shadow_path_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "elements").withColumn("sigma_km", F.col("r_km") / 4)
    return solve.path_lines(events, 9).select("event_id", "line", "k", F.round("lat", 2).alias("lat"), F.round("lon", 2).alias("lon"))


@query("refine_and_bracket", f"WITH c AS ({paths.REFINED}), w AS ({paths.BRACKETS}) SELECT c.number, c.source_id, c.j, c.et_guess, w.width_s FROM c JOIN w USING (number, j)")
def refine_and_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the width of the search around each, as the exact solver takes them."""
    stars = table(spark, sf_dir, "stars").select("source_id", F.col("ra").alias("star_ra"), F.col("dec").alias("star_dec"), "g")
    samples = tracks.with_directions(table(spark, sf_dir, "path_samples"))
    wide = tracks.with_neighbours(samples).withColumn("width_s", scan.bracket_s(600, 8000))
    return scan.candidates(wide, stars, 4e6, 600, 2.0, 4.2e6, ("width_s",)).select("number", "source_id", "j", F.round("et_guess", 1).alias("et_guess"), F.round("width_s", 3).alias("width_s"))



def _round_sql(i: int) -> str:
    """One round of point and time together."""
    return f"""u{i} AS (SELECT *, dt+z/299792.458::DOUBLE AS tau FROM z{i}), w{i} AS (SELECT *, x0+vx*tau+ax*tau*tau AS px, y0+vy*tau+ay*tau*tau AS py, vx+2*ax*tau AS mx, vy+2*ay*tau AS my FROM u{i}),
    y{i} AS (SELECT *, px-my/sqrt(mx*mx+my*my)*off AS qx, py+mx/sqrt(mx*mx+my*my)*off AS qy FROM w{i}), g{i} AS (SELECT *, ex*qx+nx*qy AS gx, ey*qx+ny*qy AS gy, nz*qy AS gz FROM y{i}),
    b{i} AS (SELECT *, gx*cos(era)+gy*sin(era) AS bx, gy*cos(era)-gx*sin(era) AS by_, gz AS bz FROM g{i}), q{i} AS (SELECT *, dx*dx+dy*dy+dz*dz/f AS qa, bx*dx+by_*dy+bz*dz/f AS qb, bx*bx+by_*by_+bz*bz/f-pow(6378.137::DOUBLE,2) AS qc FROM b{i}),
    z{i + 1} AS (SELECT * EXCLUDE ({'tau,px,py,qx,qy,gx,gy,gz,qa,qb,qc,mx,my,bx,by_,bz' if i < 2 else 'tau,px,py,qx,qy,gx,gy,gz,qa,qb,qc'}) REPLACE (CASE WHEN qb*qb-qa*qc>=0 THEN (sqrt(qb*qb-qa*qc)-qb)/qa END AS z) FROM q{i})"""


SIDES = ", ".join(f"('{k}', {s}::DOUBLE, {own}::DOUBLE, {(share if more == 'sigma3_km' else 0.0)!r}::DOUBLE, {int(more == 'sat_km')})" for k, (s, own, more, share) in solve.PATH_LINES.items())


@query(
    "shadow_paths",
    f"""WITH a AS (SELECT *, r_km/2 AS s3, CASE WHEN event_id%3=0 THEN r_km*3 END AS sat, cos(radians(dec))*cos(radians(ra)) AS sx, cos(radians(dec))*sin(radians(ra)) AS sy, sin(radians(dec)) AS sz, -sin(radians(ra)) AS ex, cos(radians(ra)) AS ey, -(x0*vx+y0*vy)/(vx*vx+vy*vy) AS near FROM {{elements}}),
    v AS (SELECT *, -sz*ey AS nx, sz*ex AS ny, sx*ey-sy*ex AS nz, sqrt(pow(vx+2*ax*near,2)+pow(vy+2*ay*near,2)) AS speed FROM a), st AS (SELECT *, least(greatest(2000/speed,1),60) AS step FROM v), sd AS (SELECT *, CAST(ceil(1.3::DOUBLE*6378.137::DOUBLE/speed/step) AS INTEGER) AS side FROM st),
    ks AS (SELECT *, unnest(range(-side, side+1)) AS k FROM sd), ls AS (SELECT ks.*, l.line, l.s*(l.own*r_km+l.share*s3+CASE WHEN l.sat_=1 THEN sat ELSE 0 END) AS off FROM ks CROSS JOIN (SELECT * FROM (VALUES {SIDES}) t(line, s, own, share, sat_)) l),
    ts AS (SELECT *, near+k*step AS dt, 0::DOUBLE AS z FROM ls WHERE off IS NOT NULL), er AS (SELECT *, {ERA.format(t='(et+dt)')} AS era, pow(1-1/298.257223563::DOUBLE,2) AS f FROM ts),
    z0 AS (SELECT *, sx*cos(era)+sy*sin(era) AS dx, sy*cos(era)-sx*sin(era) AS dy, sz AS dz FROM er), {_round_sql(0)}, {_round_sql(1)}, {_round_sql(2)},
    h AS (SELECT *, bx+dx*z AS hx, by_+dy*z AS hy, bz+dz*z AS hz FROM z3 WHERE z IS NOT NULL), o AS (SELECT *, -{S}*(hx*sin(era)+hy*cos(era)) AS wx, {S}*(hx*cos(era)-hy*sin(era)) AS wy FROM h),
    r AS (SELECT event_id, line, k, dt, degrees(atan2(hz, sqrt(hx*hx+hy*hy)*f)) AS lat, degrees(atan2(hy, hx)) AS lon, CASE WHEN line='centre' THEN 2*r_km/greatest(sqrt(pow(mx-(wx*ex+wy*ey),2)+pow(my-(wx*nx+wy*ny),2)),1e-6::DOUBLE) END AS d FROM o)
    SELECT event_id, line, count(*) AS n, round(min(dt),1) AS from_s, round(max(dt),1) AS to_s, round(min(lat),2) AS south, round(max(lat),2) AS north, round(arg_min(lon, k),2) AS first_lon, round(max(d),3) AS longest_s, round(min(d),3) AS shortest_s FROM r GROUP BY event_id, line""",
)
def shadow_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine lines of each event's path, seven without a satellite, in steps by the shadow's speed: how far each goes, and how long it lasts."""
    events = table(spark, sf_dir, "elements").withColumns({"sigma3_km": F.col("r_km") / 2, "sat_km": F.when(F.col("event_id") % 3 == 0, F.col("r_km") * 3)})
    lines = solve.shadow_paths(events, 2000.0).withColumnRenamed("et", "t")
    both = lines.join(events.select("event_id", "et"), "event_id")
    dt = F.col("t") - F.col("et")
    summed = {"from_s": (F.min(dt), 1), "to_s": (F.max(dt), 1), "south": (F.min("lat"), 2), "north": (F.max("lat"), 2), "first_lon": (F.min_by("lon", "k"), 2), "longest_s": (F.max("duration_s"), 3), "shortest_s": (F.min("duration_s"), 3)}
    return both.groupBy("event_id", "line").agg(F.count("*").alias("n"), *[F.round(x, d).alias(c) for c, (x, d) in summed.items()])


EPHEM = "(SELECT number AS target, k*1200::DOUBLE AS et, a*cos(radians(ma)+k*1200*w_) AS x, a*sin(radians(ma)+k*1200*w_) AS y, -a*w_*sin(radians(ma)+k*1200*w_) AS vx, a*w_*cos(radians(ma)+k*1200*w_) AS vy FROM (SELECT *, 1e-5::DOUBLE/a AS w_ FROM {asteroids}) CROSS JOIN (SELECT CAST(unnest(range(26)) AS INTEGER) AS k))"


@query(
    "ephemeris_states",
    f"""WITH e AS ({EPHEM}), q AS (SELECT p.number, p.j, p.et+111.5::DOUBLE AS t, CAST(floor((p.et+111.5::DOUBLE)/1200) AS INTEGER) AS k FROM {{path_samples}} p), b AS (SELECT q.*, e0.x AS x0, e1.x AS x1, e0.vx AS v0, e1.vx AS v1, e0.y AS y0, e1.y AS y1, e0.vy AS w0, e1.vy AS w1, (q.t-e0.et)/1200 AS s FROM q JOIN e e0 ON e0.target=q.number AND e0.et=q.k*1200 JOIN e e1 ON e1.target=q.number AND e1.et=(q.k+1)*1200)
    SELECT number, j, round((1+2*s)*(1-s)*(1-s)*x0+s*(1-s)*(1-s)*1200*v0+s*s*(3-2*s)*x1+s*s*(s-1)*1200*v1,7) AS x, round((1+2*s)*(1-s)*(1-s)*y0+s*(1-s)*(1-s)*1200*w0+s*s*(3-2*s)*y1+s*s*(s-1)*1200*w1,7) AS y, round(((6*s*s-6*s)*x0+(1-4*s+3*s*s)*1200*v0+(6*s-6*s*s)*x1+(3*s*s-2*s)*1200*v1)/1200*1e6::DOUBLE,5) AS vx6 FROM b""",
)
def ephemeris_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States between the rows of an ephemeris table at twenty-minute steps, for every sample of every path."""
    w, k = F.lit(1e-5) / F.col("a"), F.col("k")
    turned_by = F.radians("ma") + k * 1200 * w
    rows = table(spark, sf_dir, "asteroids").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(25))))
    nodes = rows.select(F.col("number").alias("target"), (k * num(1200)).alias("et"), (F.col("a") * F.cos(turned_by)).alias("x"), (F.col("a") * F.sin(turned_by)).alias("y"), num(0).alias("z"), (-F.col("a") * w * F.sin(turned_by)).alias("vx"), (F.col("a") * w * F.cos(turned_by)).alias("vy"), num(0).alias("vz"))
    asked = table(spark, sf_dir, "path_samples").select(F.col("number").alias("target"), "j", (F.col("et") + 111.5).alias("et"))
    found = orbits.interpolated(nodes, asked, 1200.0)
    return found.select(F.col("target").alias("number"), "j", F.round("x", 7).alias("x"), F.round("y", 7).alias("y"), F.round(F.col("vx") * 1e6, 5).alias("vx6"))


SOURCES = "(SELECT o_orderkey AS source, o_custkey AS target, o_orderkey%40*10::DOUBLE AS et0, o_orderkey%40*10+200::DOUBLE AS et1, o_orderkey%30::DOUBLE AS age_days FROM orders)"


@query("ephemeris_source", f"SELECT target, arg_min(source, ROW(CASE WHEN age_days<=10 THEN 0 ELSE 1 END, age_days, source)) AS source, bool_and(age_days>10) AS stale FROM {SOURCES} WHERE et0<=150 AND et1>=300 GROUP BY target")
def ephemeris_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each target the newest orbit that covers a window; an old one only where there's no fresh one."""
    sources = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS source", "o_custkey AS target", "CAST(o_orderkey%40*10 AS DOUBLE) AS et0", "CAST(o_orderkey%40*10+200 AS DOUBLE) AS et1", "CAST(o_orderkey%30 AS DOUBLE) AS age_days")
    return orbits.source_for(sources, 150.0, 300.0, 10.0)
