"""Paths, their analytics, and the search for stars along them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbra.functions import light, sky
from umbra.functions.sky import num
from umbra.operators import scan, tracks
from umbra.operators.cells import cell_join, interval_join, unfolded
from umbra.plans.registry import query
from umbra.plans.tables import STEP_S, table

D3 = "sqrt(pow({a}ux-{b}ux,2)+pow({a}uy-{b}uy,2)+pow({a}uz-{b}uz,2))"
#: Paths with directions and distance, in DuckDB.
DIRS = "(SELECT *, cos(radians(dec))*cos(radians(ra)) AS ux, cos(radians(dec))*sin(radians(ra)) AS uy, sin(radians(dec)) AS uz, delta_au*149597870.7::DOUBLE AS dk FROM {path_samples})"
NEAR = f"(SELECT *, lag(ux) OVER w AS pux, lag(uy) OVER w AS puy, lag(uz) OVER w AS puz, lag(dk) OVER w AS pdk, lead(ux) OVER w AS nux, lead(uy) OVER w AS nuy, lead(uz) OVER w AS nuz, lead(dk) OVER w AS ndk FROM {DIRS} WINDOW w AS (PARTITION BY number ORDER BY j))"
STARS = "(SELECT source_id, ra AS sra, dec AS sdec, g, cos(radians(dec))*cos(radians(ra)) AS sx, cos(radians(dec))*sin(radians(ra)) AS sy, sin(radians(dec)) AS sz FROM {stars})"
SPEED = f"(SELECT *, coalesce(v, lead(v) OVER (PARTITION BY number ORDER BY j)) AS speed FROM (SELECT *, sqrt(pow(ux-pux,2)+pow(uy-puy,2)+pow(uz-puz,2))/600*dk AS v FROM {NEAR}))"


SEEN = f"""(SELECT number, j, cos(radians(48::DOUBLE))*cos(w)*ux+cos(radians(48::DOUBLE))*sin(w)*uy+sin(radians(48::DOUBLE))*uz > sin(radians(12::DOUBLE)) AND cos(radians(48::DOUBLE))*cos(w)*cos(l)+cos(radians(48::DOUBLE))*sin(w)*cos(t)*sin(l)+sin(radians(48::DOUBLE))*sin(t)*sin(l) < sin(radians(-6::DOUBLE)) AS vis
    FROM (SELECT *, 2*pi()*(x-floor(x))+radians(16::DOUBLE) AS w, radians(280.460::DOUBLE+0.9856474::DOUBLE*d+1.915::DOUBLE*sin(radians(357.528::DOUBLE+0.9856003::DOUBLE*d))+0.020::DOUBLE*sin(2*radians(357.528::DOUBLE+0.9856003::DOUBLE*d))) AS l, radians(23.439::DOUBLE-4e-7::DOUBLE*d) AS t FROM (SELECT *, 0.7790572732640::DOUBLE+1.00273781191135448::DOUBLE*d AS x FROM (SELECT *, (2451545::DOUBLE+et/86400)-2451545 AS d FROM {DIRS}))))"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.with_directions(table(spark, sf_dir, "path_samples"))


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "stars").select("source_id", F.col("ra").alias("star_ra"), F.col("dec").alias("star_dec"), "g")


@query("cone_cells", f"SELECT p.number, p.j, s.source_id FROM {DIRS} p JOIN {STARS} s ON s.sdec BETWEEN p.dec-0.3 AND p.dec+0.3 AND pow(p.ux-s.sx,2)+pow(p.uy-s.sy,2)+pow(p.uz-s.sz,2) <= pow(2*sin(radians(0.2::DOUBLE)/2),2) AND s.g <= 16")
def cone_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_join(samples(spark, sf_dir), stars(spark, sf_dir).where("g <= 16"), 0.2, 0.25, spread_right=True, left_u=tracks.U).select("number", "j", "source_id")


PICKED = f"""WITH near AS (SELECT p.number, p.j, p.et, p.delta_au, s.source_id, s.g, degrees(2*asin(sqrt(pow(p.ux-s.sx,2)+pow(p.uy-s.sy,2)+pow(p.uz-s.sz,2))/2)) AS sep FROM {DIRS} p JOIN {STARS} s ON s.sdec BETWEEN p.dec-1.1 AND p.dec+1.1 AND pow(p.ux-s.sx,2)+pow(p.uy-s.sy,2)+pow(p.uz-s.sz,2) <= pow(2*sin(radians(1::DOUBLE)/2),2)),
  mag AS (SELECT n.*, a.h+5*log10(a.a*n.delta_au) AS m_ast FROM near n JOIN {{asteroids}} a USING (number)),
  ok AS (SELECT *, 2.5::DOUBLE*log10(1+pow(10,0.4::DOUBLE*(m_ast-g))) AS drop_mag FROM mag WHERE g <= m_ast - 2.5::DOUBLE*log10(pow(10,0.4::DOUBLE*0.1::DOUBLE)-1)),
  best AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY sep, source_id, j) AS k FROM ok)
  SELECT number, source_id, j, round(sep,6) AS sep_deg, round(g,6) AS g, round(drop_mag,6) AS drop_mag FROM best WHERE k=1 ORDER BY best.g, number LIMIT 20"""


@query("pick_slice_topk", PICKED)
def pick_slice_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best star of each body, of those whose covering would show; the twenty brightest."""
    bodies = table(spark, sf_dir, "asteroids").select("number", "h", "a")
    # Each sample's own limit stands on its row before paths meet stars, which tests it.
    bright = unfolded(samples(spark, sf_dir)).join(bodies, "number").withColumn("m_ast", light.hg_magnitude(F.col("h"), num(0.15), F.col("a"), F.col("delta_au"), num(1)))
    limited = bright.withColumn("faintest", F.col("m_ast") + light.drop_margin(0.1)).select("number", "j", *tracks.U, "m_ast", "faintest")
    best = scan.nearest(limited, stars(spark, sf_dir), 1.0, 2.0).withColumn("drop_mag", light.drop(F.col("m_ast"), F.col("g")))
    return best.orderBy("g", "number").limit(20).select("number", "source_id", "j", F.round("sep", 6).alias("sep_deg"), F.round("g", 6).alias("g"), F.round("drop_mag", 6).alias("drop_mag"))


@query("path_speed", f"SELECT number, j, round(speed,5) AS speed_kms FROM {SPEED}")
def path_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.with_speed(samples(spark, sf_dir), STEP_S).select("number", "j", F.round("speed_kms", 5).alias("speed_kms"))


@query("max_speed", f"SELECT number, round(max(speed)+0.5,5) AS vmax FROM {SPEED} GROUP BY number")
def max_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.with_speed(samples(spark, sf_dir), STEP_S).groupBy("number").agg(F.round(F.max("speed_kms") + 0.5, 5).alias("vmax"))


@query(
    "visibility_dilate",
    f"""WITH v AS {SEEN},
    d AS (SELECT number, j, max(vis) OVER (PARTITION BY number ORDER BY j ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS vis FROM v)
    SELECT number, j, vis, CAST(sum(vis::INT) OVER (PARTITION BY number ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS seen FROM d""",
)
def visibility_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = tracks.with_visibility(samples(spark, sf_dir), num(48), num(16), 12.0, -6.0)
    return tracks.with_running_count(tracks.dilated(flagged, "vis"), "vis", "seen").select("number", "j", "vis", "seen")


@query(
    "path_strip_area",
    f"""WITH w AS (SELECT *, degrees(7000/dk)+20/3600::DOUBLE AS w FROM {NEAR}),
    l AS (SELECT number, degrees(2*asin(sqrt(pow(ux-nux,2)+pow(uy-nuy,2)+pow(uz-nuz,2))/2)) AS a, w+lead(w) OVER (PARTITION BY number ORDER BY j) AS b FROM w)
    SELECT number, round(sum(a),6) AS path_deg, round(sum(a*b),8) AS area_deg2 FROM l GROUP BY number""",
)
def path_strip_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.strip(samples(spark, sf_dir), num(7000), 20.0).select("number", F.round("path_deg", 6).alias("path_deg"), F.round("area_deg2", 8).alias("area_deg2"))


@query("pm_pad", "SELECT number, round(1500/1000::DOUBLE*abs(2000+max(et+8e8::DOUBLE)/(365.25::DOUBLE*86400)-2016)+2,6) AS pad FROM {path_samples} GROUP BY number")
def pm_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "path_samples").groupBy("number").agg(F.max(F.col("et") + 8e8).alias("last")).select("number", F.round(sky.motion_pad(1500, F.col("last")), 6).alias("pad"))


@query(
    "mag_cap",
    """WITH m AS (SELECT p.number, max(a.h+5*log10(a.a*p.delta_au)) AS faint FROM {path_samples} p JOIN {asteroids} a USING (number) GROUP BY p.number)
    SELECT number, round(faint,6) AS faint, round(least(15, faint-2.5::DOUBLE*log10(pow(10,0.4::DOUBLE*0.1::DOUBLE)-1)+0.5::DOUBLE),6) AS cap FROM m""",
)
def mag_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = table(spark, sf_dir, "asteroids").select("number", "h", "a")
    m = light.hg_magnitude(F.col("h"), num(0.15), F.col("a"), F.col("delta_au"), num(1))
    faint = unfolded(table(spark, sf_dir, "path_samples")).join(bodies, "number").groupBy("number").agg(F.max(m).alias("faint"))
    return faint.select("number", F.round("faint", 6).alias("faint"), F.round(F.least(num(15), F.col("faint") + light.drop_margin(0.1) + 0.5), 6).alias("cap"))


@query(
    "pick_cap",
    f"""WITH d AS (SELECT s.number, max(a.h+5*log10(a.a*s.delta_au)) AS faint, max(20/greatest(s.speed-0.5::DOUBLE,0.3::DOUBLE)) AS dur FROM {SPEED} s JOIN {{asteroids}} a USING (number) JOIN {SEEN} v ON v.number=s.number AND v.j=s.j WHERE v.vis GROUP BY s.number)
    SELECT number, round(dur,5) AS max_dur, round(least(least(16, faint-2.5::DOUBLE*log10(pow(10,0.4::DOUBLE*0.1::DOUBLE)-1)), 5*log10(20::DOUBLE)+2.5::DOUBLE*log10(greatest(dur,1e-9::DOUBLE)/4)+8.5::DOUBLE),5) AS cap FROM d""",
)
def pick_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = table(spark, sf_dir, "asteroids").select("number", "h", "a")
    m = light.hg_magnitude(F.col("h"), num(0.15), F.col("a"), F.col("delta_au"), num(1))
    fast = tracks.with_speed(samples(spark, sf_dir), STEP_S)
    seen = unfolded(tracks.with_visibility(fast, num(48), num(16), 12.0, -6.0).where("vis")).join(bodies, "number")
    most = seen.groupBy("number").agg(F.max(m).alias("faint"), F.max(20.0 / F.greatest(F.col("speed_kms") - 0.5, num(0.3))).alias("dur"))
    cap = F.least(num(16), F.col("faint") + light.drop_margin(0.1), light.faintest_observable(num(20), F.col("dur"), num(4)))
    return most.where(cap >= 0).select("number", F.round("dur", 5).alias("max_dur"), F.round(cap, 5).alias("cap"))


@query(
    "arc_resample",
    f"""WITH l AS (SELECT number, j, coalesce(degrees(2*asin(sqrt(pow(ux-pux,2)+pow(uy-puy,2)+pow(uz-puz,2))/2)),0) AS leg FROM {NEAR}),
    c AS (SELECT number, j, sum(leg) OVER (PARTITION BY number ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS arc FROM l),
    b AS (SELECT *, floor(arc/0.0513::DOUBLE) AS b FROM c), k AS (SELECT *, lag(b) OVER w AS pb, lead(j) OVER w AS nj FROM b WINDOW w AS (PARTITION BY number ORDER BY j))
    SELECT number, j, round(arc,6) AS arc_deg FROM k WHERE pb IS NULL OR b<>pb OR nj IS NULL""",
)
def arc_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.resampled(samples(spark, sf_dir), 0.0513).select("number", "j", F.round("arc_deg", 6).alias("arc_deg"))


@query(
    "half_steps",
    f"SELECT number, j, round(0.5::DOUBLE*greatest(coalesce(sqrt(pow(ux*dk-pux*pdk,2)+pow(uy*dk-puy*pdk,2)+pow(uz*dk-puz*pdk,2)),0), coalesce(sqrt(pow(ux*dk-nux*ndk,2)+pow(uy*dk-nuy*ndk,2)+pow(uz*dk-nuz*ndk,2)),0)),2) AS half_step_km FROM {NEAR}",
)
def half_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.half_steps(samples(spark, sf_dir)).select("number", "j", F.round("half_step_km", 2).alias("half_step_km"))


MIN_KM = 4e6
MINIMA = f"""lim AS (SELECT *, sqrt(pow({MIN_KM}::DOUBLE,2)+pow((max(speed) OVER (PARTITION BY number)+0.5::DOUBLE)*600/2,2)) AS lim FROM {SPEED}),
  d AS (SELECT l.*, s.source_id, s.sx, s.sy, s.sz, s.g, greatest(2-2*(s.sx*ux+s.sy*uy+s.sz*uz),0)*dk*dk AS d2, greatest(2-2*(s.sx*pux+s.sy*puy+s.sz*puz),0)*pdk*pdk AS e2, greatest(2-2*(s.sx*nux+s.sy*nuy+s.sz*nuz),0)*ndk*ndk AS f2 FROM lim l JOIN {STARS} s ON s.sdec BETWEEN l.dec-1.3 AND l.dec+1.3 AND greatest(2-2*(s.sx*ux+s.sy*uy+s.sz*uz),0)*dk*dk < lim*lim),
  m AS (SELECT * FROM d WHERE d2 <= CASE WHEN pux IS NULL THEN 'inf'::DOUBLE ELSE e2 END AND d2 < CASE WHEN nux IS NULL THEN 'inf'::DOUBLE ELSE f2 END)"""


@query("local_minima", f"WITH {MINIMA} SELECT number, source_id, j, round(sqrt(d2)/1000,3) AS d_mm FROM m")
def local_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.minima(samples(spark, sf_dir), stars(spark, sf_dir), MIN_KM, STEP_S, 2.0)
    return found.select("number", "source_id", "j", F.round(F.sqrt("d2") / 1000, 3).alias("d_mm"))


#: Refined candidates, and the width of the search at each sample.
REFINED = f"""WITH {MINIMA}, i AS (SELECT * FROM m WHERE pux IS NOT NULL AND nux IS NOT NULL),
    t AS (SELECT i.*, k, k*(2/120::DOUBLE)-1 AS t FROM i CROSS JOIN (SELECT unnest(range(121)) AS k)),
    u AS (SELECT *, t*(t-1)/2 AS wa, 1-t*t AS wb, t*(t+1)/2 AS wc FROM t),
    v AS (SELECT *, wa*pux+wb*ux+wc*nux AS vx, wa*puy+wb*uy+wc*nuy AS vy, wa*puz+wb*uz+wc*nuz AS vz, wa*pdk+wb*dk+wc*ndk AS vd FROM u),
    q AS (SELECT number, source_id, j, et, lim, k, greatest(2-2*(sx*vx+sy*vy+sz*vz)/sqrt(vx*vx+vy*vy+vz*vz),0)*vd*vd AS s FROM v),
    l AS (SELECT number, source_id, j, et, lim, list(s ORDER BY k) AS s FROM q GROUP BY ALL),
    p AS (SELECT *, least(greatest(list_position(s, list_min(s))-1,1),119) AS i FROM l),
    y AS (SELECT *, s[i] AS ym, s[i+1] AS y0, s[i+2] AS yp FROM p),
    z AS (SELECT *, ym-2*y0+yp AS den FROM y), f AS (SELECT *, CASE WHEN den>0 THEN least(greatest(0.5::DOUBLE*(ym-yp)/den,-1),1) ELSE 0 END AS dl FROM z)
    SELECT number, source_id, j, round(et+(i*(2/120::DOUBLE)-1+dl*(2/120::DOUBLE))*600,1) AS et_guess, round(sqrt(greatest(CASE WHEN den>0 THEN y0-0.25::DOUBLE*(ym-yp)*dl ELSE y0 END,0))/1000,2) AS d_mm FROM f
    WHERE sqrt(greatest(CASE WHEN den>0 THEN y0-0.25::DOUBLE*(ym-yp)*dl ELSE y0 END,0)) <= 1.05::DOUBLE*{MIN_KM}::DOUBLE"""


@query("candidates_refined", REFINED)
def candidates_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scan.candidates(samples(spark, sf_dir), stars(spark, sf_dir), MIN_KM, STEP_S, 2.0, 1.05 * MIN_KM)
    return done.select("number", "source_id", "j", F.round("et_guess", 1).alias("et_guess"), F.round(F.col("d_km") / 1000, 2).alias("d_mm"))


BRACKETS = f"""WITH v AS (SELECT number, j, sqrt(pow(coalesce(nux,ux)-coalesce(pux,ux),2)+pow(coalesce(nuy,uy)-coalesce(puy,uy),2)+pow(coalesce(nuz,uz)-coalesce(puz,uz),2))/(((pux IS NOT NULL)::INT+(nux IS NOT NULL)::INT)*600)*dk AS v FROM {NEAR})
    SELECT number, j, round(2*least(greatest(1.3::DOUBLE*8000/greatest(v,1e-3::DOUBLE),600),7200),3) AS width_s FROM v"""


@query("solver_bracket", BRACKETS)
def solver_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.with_neighbours(samples(spark, sf_dir)).select("number", "j", F.round(scan.bracket_s(STEP_S, 8000), 3).alias("width_s"))


@query(
    "early_gate",
    """WITH t AS (SELECT number, j, et, ra, dec, [et-600, et, et+600] AS ts FROM {path_samples})
    SELECT number, j, len(list_filter(ts, lambda x: sin(x/86400*2*pi()) < 0.2::DOUBLE AND dec + 10*cos(x/86400*2*pi()) > 5)) > 0 AS pass FROM t""",
)
def early_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether at any of three instants the Sun (here a daily sine) is low and the target (here a daily swing) high enough."""
    phase = lambda t: t / 86400.0 * 2 * F.pi()
    instants = F.array(F.col("et") - 600.0, F.col("et"), F.col("et") + 600.0)
    passed = F.exists(instants, lambda t: (F.sin(phase(t)) < 0.2) & (F.col("dec") + 10.0 * F.cos(phase(t)) > 5.0))
    return table(spark, sf_dir, "path_samples").select("number", "j", passed.alias("pass"))


@query(
    "visible_in_bracket",
    """WITH v AS (SELECT number, j, (j*7+number)%5=0 AS vis FROM {path_samples})
    SELECT a.number, a.j, CAST((SELECT count(*) FROM v b WHERE b.number=a.number AND b.vis AND b.j BETWEEN a.j-3 AND a.j+3) AS BIGINT) AS n_visible FROM v a""",
)
def visible_in_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = table(spark, sf_dir, "path_samples").withColumn("vis", (F.col("j") * 7 + F.col("number")) % 5 == 0)
    run = tracks.with_running_count(flagged, "vis", "c")
    ends = W.partitionBy("number")
    last = F.coalesce(F.lead("c", 3).over(tracks.path()), F.max("c").over(ends))
    before = F.coalesce(F.lag("c", 4).over(tracks.path()), F.lit(0))
    return run.withColumn("n_visible", (last - before).cast("bigint")).select("number", "j", "n_visible")


@query(
    "windows_screen",
    f"WITH d AS (SELECT s.source_id, p.number, min(greatest(2-2*(s.sx*ux+s.sy*uy+s.sz*uz),0)*dk*dk) AS d2 FROM {DIRS} p JOIN {STARS} s ON s.sdec BETWEEN p.dec-0.9 AND p.dec+0.9 AND pow(p.ux-s.sx,2)+pow(p.uy-s.sy,2)+pow(p.uz-s.sz,2) <= pow(2*sin(radians(0.8::DOUBLE)/2),2) WHERE s.g<=15 GROUP BY ALL) SELECT source_id, number, round(sqrt(d2)/1000,3) AS d_mm FROM d WHERE d2 < pow(3e6::DOUBLE,2)",
)
def windows_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.closest(samples(spark, sf_dir), stars(spark, sf_dir).where("g <= 15"), 0.8, 2.0, 3e6)
    return found.select("source_id", "number", F.round(F.sqrt("d2") / 1000, 3).alias("d_mm"))


@query(
    "window_touch",
    "SELECT e.event_id, w.site_id FROM {elements} e JOIN (SELECT site_id, 86400+site_id*3600::DOUBLE AS t0, 86400+site_id*3600::DOUBLE+5000 AS t1 FROM {sites}) w ON e.et-e.half <= w.t1 AND w.t0 <= e.et+e.half",
)
def window_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "elements").selectExpr("event_id", "et - half AS a0", "et + half AS a1")
    windows = table(spark, sf_dir, "sites").selectExpr("site_id", "CAST(86400+site_id*3600 AS DOUBLE) AS t0", "CAST(86400+site_id*3600+5000 AS DOUBLE) AS t1")
    return interval_join(spans, windows, ("a0", "a1"), ("t0", "t1"), 6 * 3600.0).select("event_id", "site_id")
