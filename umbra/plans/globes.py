"""The Earth as the star sees it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.sky import num
from umbra.operators import globe
from umbra.operators.cells import together
from umbra.plans.ephemerides import BENDING, deflecting, rays_of
from umbra.plans.registry import query
from umbra.plans.solving import ERA, dealt
from umbra.plans.tables import table

AXES = "cos(radians(dec))*cos(radians(ra)) AS sx, cos(radians(dec))*sin(radians(ra)) AS sy, sin(radians(dec)) AS sz, -sin(radians(ra)) AS ex, cos(radians(ra)) AS ey, -sin(radians(dec))*cos(radians(ra)) AS nx, -sin(radians(dec))*sin(radians(ra)) AS ny, cos(radians(dec)) AS nz"
SUN = """l0 AS (SELECT *, et/86400::DOUBLE AS d FROM a), l1 AS (SELECT *, radians(280.460::DOUBLE+0.9856474::DOUBLE*d+1.915::DOUBLE*sin(radians(357.528::DOUBLE+0.9856003::DOUBLE*d))+0.020::DOUBLE*sin(2*radians(357.528::DOUBLE+0.9856003::DOUBLE*d))) AS sl, radians(23.439::DOUBLE-4e-7::DOUBLE*d) AS tilt FROM l0),
    l AS (SELECT *, cos(sl) AS lx, cos(tilt)*sin(sl) AS ly, sin(tilt)*sin(sl) AS lz FROM l1)"""
POINTS = 6


@query(
    "day_polygons",
    f"""WITH a AS (SELECT event_id, et, {AXES} FROM {{elements}}), {SUN},
    c0 AS (SELECT *, sy*lz-sz*ly AS c1, sz*lx-sx*lz AS c2, sx*ly-sy*lx AS c3 FROM l), p AS (SELECT *, c1/sqrt(c1*c1+c2*c2+c3*c3) AS px, c2/sqrt(c1*c1+c2*c2+c3*c3) AS py, c3/sqrt(c1*c1+c2*c2+c3*c3) AS pz FROM c0),
    k AS (SELECT p.*, CAST(k AS INTEGER) AS k, pi()/{POINTS}*(k%{POINTS + 1}) AS al, k>{POINTS} AS back FROM p CROSS JOIN (SELECT unnest(range({2 * POINTS + 2})) AS k)),
    v AS (SELECT *, CASE WHEN back THEN ly*pz-lz*py ELSE py*sz-pz*sy END AS gx, CASE WHEN back THEN lz*px-lx*pz ELSE pz*sx-px*sz END AS gy, CASE WHEN back THEN lx*py-ly*px ELSE px*sy-py*sx END AS gz, CASE WHEN back THEN -cos(al) ELSE cos(al) END AS c, sin(al) AS s FROM k)
    SELECT event_id, k, round((c*px+s*gx)*ex+(c*py+s*gy)*ey, 6) AS x, round((c*px+s*gx)*nx+(c*py+s*gy)*ny+(c*pz+s*gz)*nz, 6) AS y FROM v""",
)
def day_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return globe.day_polygon(table(spark, sf_dir, "elements"), POINTS).select("event_id", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


CORNERS = 24


def land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round land of 5 to 53 degrees about each site, as corners counterclockwise: (poly, seq, lat, lon)."""
    rows = table(spark, sf_dir, "sites").withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(CORNERS - 1))))
    r, a, p = F.radians(num(5) + 8 * (F.col("site_id") % 7)), -F.radians(F.col("seq") * (360.0 / CORNERS)), F.radians("lat")
    lat = F.asin(F.sin(p) * F.cos(r) + F.cos(p) * F.sin(r) * F.cos(a))
    lon = F.radians("lon") + F.atan2(F.sin(a) * F.sin(r) * F.cos(p), F.cos(r) - F.sin(p) * F.sin(lat))
    return rows.select(F.col("site_id").alias("poly"), "seq", F.degrees(lat).alias("lat"), F.degrees(lon).alias("lon"))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with one of all lands."""
    return dealt(spark, sf_dir).select(F.col("event_id").alias("view"), F.col("site_id").alias("poly"), "et", "ra", "dec")


@query(
    "land_on_disc",
    f"""WITH l0 AS (SELECT site_id AS poly, CAST(q AS INTEGER) AS seq, radians(5+8*(site_id%7)) AS r, -radians(q*{360.0 / CORNERS}::DOUBLE) AS a, radians(lat) AS p, radians(lon) AS lo FROM {{sites}} CROSS JOIN (SELECT unnest(range({CORNERS})) AS q)),
    l1 AS (SELECT *, asin(sin(p)*cos(r)+cos(p)*sin(r)*cos(a)) AS la FROM l0), l2 AS (SELECT poly, seq, la, lo+atan2(sin(a)*sin(r)*cos(p), cos(r)-sin(p)*sin(la)) AS lo, 1/298.257223563::DOUBLE*(2-1/298.257223563::DOUBLE) AS e2 FROM l1),
    l3 AS (SELECT *, sqrt(pow(cos(la),2)+pow((1-e2)*sin(la),2)) AS nn FROM l2), ld AS (SELECT poly, seq, cos(la)*cos(lo)/nn AS fx, cos(la)*sin(lo)/nn AS fy, (1-e2)*sin(la)/nn AS fz FROM l3),
    w AS (SELECT e.event_id AS view, s.site_id AS poly, {AXES}, {ERA.format(t='et')} AS era FROM {{elements}} e JOIN (SELECT site_id, row_number() OVER (ORDER BY site_id)-1 AS no, count(*) OVER () AS n FROM {{sites}}) s ON s.no = e.number % s.n),
    c AS (SELECT w.*, seq, fx*cos(era)-fy*sin(era) AS cx, fx*sin(era)+fy*cos(era) AS cy, fz AS cz FROM w JOIN ld USING (poly)), f AS (SELECT view, poly, seq, cx*ex+cy*ey AS x, cx*nx+cy*ny+cz*nz AS y, cx*sx+cy*sy+cz*sz AS z FROM c),
    g AS (SELECT f.*, n.x AS x2, n.y AS y2, n.z AS z2 FROM f JOIN f n ON n.view=f.view AND n.poly=f.poly AND n.seq=(f.seq+1)%{CORNERS}),
    h AS (SELECT *, atan2(y+z/(z-z2)*(y2-y), x+z/(z-z2)*(x2-x)) AS al FROM g),
    co AS (SELECT view, poly, CASE WHEN z>=0 AND z2>=0 THEN x*y2-y*x2 WHEN z>=0 THEN x*sin(al)-y*cos(al) ELSE cos(al)*y2-sin(al)*x2 END/2 AS part, 1 AS co, 0 AS li FROM h WHERE z>=0 OR z2>=0),
    q AS (SELECT view, poly, al, z>=0 AS leaves FROM h WHERE (z>=0)<>(z2>=0)), o AS (SELECT *, coalesce(lead(al) OVER v, min(al) OVER (PARTITION BY view, poly)+2*pi())-al AS arc FROM q WINDOW v AS (PARTITION BY view, poly ORDER BY al)),
    u AS (SELECT * FROM co UNION ALL SELECT view, poly, arc/2, 0, 1 FROM o WHERE leaves)
    SELECT view AS event_id, poly, round(sum(part),5) AS area, sum(co)::BIGINT AS corners, sum(li)::BIGINT AS arcs FROM u GROUP BY view, poly""",
)
def land_on_disc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the disc each event's land covers, clipped at the limb."""
    found = globe.visible_area(globe.clipped(views(spark, sf_dir), land(spark, sf_dir)))
    return found.select(F.col("view").alias("event_id"), "poly", F.round("area", 5).alias("area"), "corners", "arcs")


@query(
    "axis_course",
    """WITH e AS (SELECT *, 1.6::DOUBLE*6378.137::DOUBLE/sqrt(vx*vx+vy*vy) AS span FROM {elements}), s AS (SELECT event_id, unnest(list_transform(range(CAST(ceil(2*span/20) AS BIGINT)), lambda k: et-span+k*20)) AS t FROM e), m AS (SELECT event_id, unnest(range(CAST(floor((et-span)/60) AS BIGINT)+1, CAST(floor((et+span)/60) AS BIGINT)+1))*60::DOUBLE AS t FROM e),
    u AS (SELECT * FROM s UNION SELECT * FROM m), p AS (SELECT event_id, t, t%60=0 AS minute, x0+(t-et)*(vx+(t-et)*ax) AS x, y0+(t-et)*(vy+(t-et)*ay) AS y, t-et AS dt FROM u JOIN e USING (event_id))
    SELECT event_id, count(*) AS n, sum(CASE WHEN minute THEN 1 ELSE 0 END)::BIGINT AS minutes, round(min(dt),3) AS first_s, round(max(dt),3) AS last_s, round(min(sqrt(x*x+y*y)),3) AS nearest_km, round(sum(x)/count(*),2) AS mean_x FROM p GROUP BY event_id""",
)
def axis_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axis' course in steps of 20 s and at whole minutes, summed up for each event."""
    rows = globe.axis_course(together(table(spark, sf_dir, "elements"), "event_id"))
    dt = F.col("t") - F.col("et")
    away = F.sqrt(F.col("x_km") ** 2 + F.col("y_km") ** 2)
    return rows.groupBy("event_id").agg(F.count("*").alias("n"), F.sum(F.col("minute").cast("bigint")).alias("minutes"), F.round(F.min(dt), 3).alias("first_s"), F.round(F.max(dt), 3).alias("last_s"), F.round(F.min(away), 3).alias("nearest_km"), F.round(F.avg("x_km"), 2).alias("mean_x"))


@query(
    "globe_facts",
    """WITH e AS (SELECT event_id, (1.5::DOUBLE+number%17/10::DOUBLE)*149597870.7::DOUBLE AS d, sqrt(vx*vx+vy*vy) AS v, r_km, r_km/4 AS sg FROM {elements}), k AS (SELECT *, d/(180/pi()*3.6e6::DOUBLE) AS km FROM e)
    SELECT event_id, round(km,6) AS km_per_mas, round(1/v,6) AS s_per_km, round(km/v,6) AS s_per_mas, round(2*r_km/km,4) AS diameter_mas, round(sg/km,4) AS sigma_mas, round(degrees(asin(6378.137::DOUBLE/d))*3600,5) AS parallax_arcsec, round(d/149597870.7::DOUBLE,6) AS dist_au FROM k""",
)
def globe_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = {"km_per_mas": 6, "s_per_km": 6, "s_per_mas": 6, "diameter_mas": 4, "sigma_mas": 4, "parallax_arcsec": 5, "dist_au": 6}
    found = globe.facts((1.5 + F.col("number") % 17 / 10.0) * 149597870.7, F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2), F.col("r_km"), F.col("r_km") / 4)
    return table(spark, sf_dir, "elements").select("event_id", *[F.round(found[c], n).alias(c) for c, n in digits.items()])


_BODIES = ", ".join(f"({b}, {gm!r}::DOUBLE, {r!r}::DOUBLE, {p!r}::DOUBLE, {w!r}::DOUBLE)" for b, gm, r, p, w in BENDING)
INNER, OUTER = 5, 6
PLANE = f"""e AS (SELECT event_id, CAST(floor(et/86400) AS INTEGER) AS day, 1.5::DOUBLE+number%17/10::DOUBLE AS au, cos(radians(dec))*cos(radians(ra)) AS px, cos(radians(dec))*sin(radians(ra)) AS py, sin(radians(dec)) AS pz FROM {{elements}}),
    b AS (SELECT e.*, body, gm, r*cos(ph+w*day) AS bx, r*sin(ph+w*day)*0.9175::DOUBLE AS by_, r*sin(ph+w*day)*0.3978::DOUBLE AS bz FROM e CROSS JOIN (SELECT * FROM (VALUES {_BODIES}) v(body, gm, r, ph, w))),
    s AS (SELECT event_id, bx-(bx*px+by_*py+bz*pz)*px AS ax, by_-(bx*px+by_*py+bz*pz)*py AS ay, bz-(bx*px+by_*py+bz*pz)*pz AS az FROM b WHERE body=10), y AS (SELECT event_id, ax/sqrt(ax*ax+ay*ay+az*az) AS yx, ay/sqrt(ax*ax+ay*ay+az*az) AS yy, az/sqrt(ax*ax+ay*ay+az*az) AS yz FROM s), m AS (SELECT * FROM b JOIN y USING (event_id))"""


def planes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rays = rays_of(spark, sf_dir).withColumn("target_au", F.col("far") / 149597870.7).select("ray", "day", "px", "py", "pz", "target_au")
    return globe.system(rays, deflecting(spark, sf_dir), INNER, OUTER)


@query(
    "system_bodies",
    f"WITH {PLANE} SELECT event_id, body, round((bx*px+by_*py+bz*pz)/149597870.7::DOUBLE,6) AS x, round((bx*yx+by_*yy+bz*yz)/149597870.7::DOUBLE,6) AS y, round((bx*(py*yz-pz*yy)+by_*(pz*yx-px*yz)+bz*(px*yy-py*yx))/149597870.7::DOUBLE,6) AS w FROM m",
)
def system_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sun, Jupiter and Saturn in the plane of the star and the Sun."""
    bodies, _ = planes(spark, sf_dir)
    return bodies.select(F.col("ray").alias("event_id"), "body", *[F.round(c, 6).alias(c) for c in "xyw"])


@query(
    "star_ray",
    f"""WITH {PLANE}, k AS (SELECT m.*, CAST(k AS INTEGER) AS k, CASE WHEN k<={INNER} THEN au*(k::DOUBLE/{INNER}) ELSE au+(greatest(2.6::DOUBLE,1.7::DOUBLE*au)-au)*((k-{INNER})::DOUBLE/{OUTER}) END AS x, sqrt(bx*bx+by_*by_+bz*bz) AS dist FROM m CROSS JOIN (SELECT unnest(range(1,{INNER + OUTER + 1})) AS k)),
    t AS (SELECT *, -bx/dist AS ox, -by_/dist AS oy, -bz/dist AS oz, px*x*149597870.7::DOUBLE-bx AS tx, py*x*149597870.7::DOUBLE-by_ AS ty, pz*x*149597870.7::DOUBLE-bz AS tz FROM k), q AS (SELECT *, tx/sqrt(tx*tx+ty*ty+tz*tz) AS qx, ty/sqrt(tx*tx+ty*ty+tz*tz) AS qy, tz/sqrt(tx*tx+ty*ty+tz*tz) AS qz FROM t),
    d AS (SELECT event_id, k, x, 2*gm/(pow(299792.458::DOUBLE,2)*dist) AS g, ox*yx+oy*yy+oz*yz AS oy_, px*ox+py*oy+pz*oz AS po, px*yx+py*yy+pz*yz AS py_, qx*yx+qy*yy+qz*yz AS qy_, px*qx+py*qy+pz*qz AS pq, qx*ox+qy*oy+qz*oz AS qo FROM q)
    SELECT event_id, k, round(any_value(x),6) AS x, round(1e9::DOUBLE*any_value(x)*sum(g*((oy_-py_*po)/(1+po)-(oy_*pq-qy_*po)/(1+qo))),4) AS y9 FROM d GROUP BY event_id, k""",
)
def star_ray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bent ray of each event's star, in billionths of an AU off its line."""
    _, curve = planes(spark, sf_dir)
    return curve.select(F.col("ray").alias("event_id"), "k", F.round("x", 6).alias("x"), F.round(1e9 * F.col("y"), 4).alias("y9"))
