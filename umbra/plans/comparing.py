"""Comparisons with reference lists, fits and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbra.functions.sky import num
from umbra.operators import compare, tracks
from umbra.plans.registry import query
from umbra.plans.tables import base, table

REF = "(SELECT id AS ref_id, target_id, best_et + (id % 13)*120::DOUBLE - 700 AS ref_t, 1+(id%5)*0.3::DOUBLE AS ref_drop, 2+(id%4)::DOUBLE AS ref_dur FROM {hits} WHERE id % 3 = 0)"
HIT = "(SELECT id AS hit_id, target_id, best_et AS hit_t, 1+(id%6)*0.3::DOUBLE AS hit_drop, 2+(id%3)::DOUBLE AS hit_dur FROM {hits} WHERE id % 3 <> 0)"
MATCH = f"""b AS (SELECT r.ref_id, h.hit_id, h.hit_t - r.ref_t AS dt, h.hit_drop, h.hit_dur, row_number() OVER (PARTITION BY r.ref_id ORDER BY abs(h.hit_t-r.ref_t), h.hit_id) AS k FROM {REF} r JOIN {HIT} h ON h.target_id=r.target_id AND abs(h.hit_t-r.ref_t) <= 600),
  m AS (SELECT r.*, b.hit_id, b.dt, b.hit_drop, b.hit_dur FROM {REF} r LEFT JOIN b ON b.ref_id=r.ref_id AND b.k=1)"""


# A third of the hits plays the reference list, the others are ours.
def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "hits").where("id % 3 = 0").select(F.col("id").alias("ref_id"), "target_id", (F.col("best_et") + (F.col("id") % 13) * num(120) - 700).alias("ref_t"), (1 + (F.col("id") % 5) * num(0.3)).alias("ref_drop"), (2 + (F.col("id") % 4) * num(1)).alias("ref_dur"))


def ours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "hits").where("id % 3 <> 0").select(F.col("id").alias("hit_id"), "target_id", F.col("best_et").alias("hit_t"), (1 + (F.col("id") % 6) * num(0.3)).alias("hit_drop"), (2 + (F.col("id") % 3) * num(1)).alias("hit_dur"))


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.nearest_in_time(reference(spark, sf_dir), ours(spark, sf_dir), "target_id", "ref_t", "hit_t", 600.0)


@query("nearest_time_match", f"WITH {MATCH} SELECT ref_id, hit_id, round(dt,3) AS dt FROM m")
def nearest_time_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir).select("ref_id", "hit_id", F.round("dt", 3).alias("dt"))


@query("extras_anti", f"WITH {MATCH} SELECT hit_id, target_id FROM {HIT} WHERE hit_id NOT IN (SELECT hit_id FROM m WHERE hit_id IS NOT NULL)")
def extras_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = matched(spark, sf_dir).where("hit_id IS NOT NULL").select("hit_id")
    return ours(spark, sf_dir).join(used, "hit_id", "left_anti").select("hit_id", "target_id")


VERDICT = "CASE WHEN hit_id IS NULL THEN 'NOT FOUND' WHEN t AND d AND s THEN 'ok' WHEN t AND d THEN 'ok, size differs' ELSE 'FAIL '||CASE WHEN t THEN 'drop' WHEN d THEN 'time' ELSE 'time,drop' END||CASE WHEN s THEN '' ELSE ' (+size)' END END"
JUDGED = f"v AS (SELECT *, abs(dt)<=120 AS t, abs(hit_drop-ref_drop)<=0.25 OR least(hit_drop,ref_drop)>5 AS d, abs(hit_dur/ref_dur-1)<=0.1 AS s FROM m), w AS (SELECT ref_id, {VERDICT} AS result FROM v)"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matched(spark, sf_dir)
    drop_ok = (F.abs(F.col("hit_drop") - F.col("ref_drop")) <= 0.25) | (F.least("hit_drop", "ref_drop") > 5)
    result = compare.verdict(F.col("hit_id").isNotNull(), F.abs("dt") <= 120, drop_ok, F.abs(F.col("hit_dur") / F.col("ref_dur") - 1) <= 0.1)
    return m.select("ref_id", result.alias("result"))


@query("match_verdicts", f"WITH {MATCH}, {JUDGED} SELECT ref_id, result FROM w")
def match_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir)


@query("match_stats", f"WITH {MATCH}, {JUDGED} SELECT count(*) AS n, count(*) FILTER (result LIKE 'ok%') AS n_ok, count(*) FILTER (result='ok, size differs') AS n_size FROM w")
def match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("result").startswith("ok")).alias("n_ok"), F.count_if(F.col("result") == "ok, size differs").alias("n_size"))


@query(
    "lookup_star_first",
    """WITH c AS (SELECT r.ref_id, h.id, h.star = r.ref_id % 7 AS same, abs(h.best_et-r.ref_t) AS away, row_number() OVER (PARTITION BY r.ref_id ORDER BY abs(h.best_et-r.ref_t), h.id) AS k FROM """
    + REF
    + """ r JOIN {hits} h ON h.target_id=r.target_id AND abs(h.best_et-r.ref_t) <= 7200)
    SELECT ref_id, coalesce(arg_min(id, k) FILTER (same), arg_min(id, k) FILTER (away <= 600)) AS id FROM c WHERE k <= 3 GROUP BY ref_id""",
)
def lookup_star_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the three events nearest in time, within two hours, the one with the same star; else the nearest within ten minutes."""
    tol = 7200.0
    wide = reference(spark, sf_dir).withColumn("b", F.explode(F.array(*[F.floor(F.col("ref_t") / tol) + k for k in (-1, 0, 1)])))
    placed = table(spark, sf_dir, "hits").select("target_id", "id", "star", "best_et", F.floor(F.col("best_et") / tol).alias("b"))
    near = wide.join(placed, ["target_id", "b"]).withColumn("away", F.abs(F.col("best_et") - F.col("ref_t"))).where(F.col("away") <= tol)
    three = near.withColumn("k", F.row_number().over(W.partitionBy("ref_id").orderBy("away", "id"))).where("k <= 3")
    same = F.col("star") == F.col("ref_id") % 7
    return three.groupBy("ref_id").agg(F.coalesce(F.min_by(F.when(same, F.col("id")), F.when(same, F.col("k"))), F.min_by(F.when(F.col("away") <= 600, F.col("id")), F.when(F.col("away") <= 600, F.col("k")))).alias("id"))


POINTS = "(SELECT number, j, dec*10 + (j%5)*0.1::DOUBLE AS across, 20 + j AS alt, sin(number*1.7::DOUBLE+j)+0.3::DOUBLE AS px, cos(number*0.9::DOUBLE+j*2)-0.2::DOUBLE AS py, j/10::DOUBLE AS dx, (48-j)/20::DOUBLE AS dy FROM {path_samples})"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    j, n = F.col("j"), F.col("number")
    return table(spark, sf_dir, "path_samples").select("number", "j", (F.col("dec") * 10 + (j % 5) * num(0.1)).alias("across"), (20 + j).alias("alt"), (F.sin(n * num(1.7) + j) + 0.3).alias("px"), (F.cos(n * num(0.9) + j * 2) - 0.2).alias("py"), (j / num(10)).alias("dx"), ((48 - j) / num(20)).alias("dy"))


@query(
    "path_statistics",
    f"""WITH p AS (SELECT number, 'all' AS subset, across FROM {POINTS} UNION ALL SELECT number, 'high' AS subset, across FROM {POINTS} WHERE alt >= 40)
    SELECT number, subset, count(*) AS n, round(min(across),5) AS least, round(max(across),5) AS most, round(avg(across),5) AS mean, round(stddev_pop(across),5) AS deviation, round(stddev_pop(across)/sqrt(count(*)),5) AS error FROM p GROUP BY number, subset""",
)
def path_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = compare.spread(points(spark, sf_dir), ["number"], "across", {"all": F.lit(True), "high": F.col("alt") >= 40})
    return s.select("number", "subset", "n", *[F.round(c, 5).alias(c) for c in ("least", "most", "mean", "deviation", "error")])


FIT = f"""s AS (SELECT number, count(*) AS n, sum(px) AS sx, sum(py) AS sy, sum(dx) AS dx, sum(dy) AS dy, sum(dx*dx+dy*dy) AS dd, sum(dx*px+dy*py) AS dp, sum(px*px+py*py) AS pp FROM {POINTS} GROUP BY number), a AS (SELECT *, (dp-(dx*sx+dy*sy)/n)/(dd-(dx*dx+dy*dy)/n) AS angle FROM s), c AS (SELECT *, (sx-angle*dx)/n AS cx, (sy-angle*dy)/n AS cy FROM a)"""


@query("fit_constant", f"WITH {FIT} SELECT number, round(sx/n,6) AS const_x, round(sy/n,6) AS const_y, round(sqrt((pp-(sx*sx+sy*sy)/n)/(2*n)),6) AS const_rms FROM c")
def fit_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.plane_fit(points(spark, sf_dir), ["number"]).select("number", *[F.round(c, 6).alias(c) for c in ("const_x", "const_y", "const_rms")])


@query("fit_rotation", f"WITH {FIT} SELECT number, round(cx,6) AS cx, round(cy,6) AS cy, round(angle,6) AS angle, round(sqrt((pp-cx*sx-cy*sy-angle*dp)/(2*n)),6) AS rms FROM c")
def fit_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.plane_fit(points(spark, sf_dir), ["number"]).select("number", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "angle", "rms")])


@query(
    "fit_errors",
    f"""WITH {FIT}, r AS (SELECT *, greatest(pp-cx*sx-cy*sy-angle*dp,0)/(2*n-3) AS u, dd-(dx*dx+dy*dy)/n AS den FROM c)
    SELECT number, round(sqrt(greatest(pp-(sx*sx+sy*sy)/n,0)/(2*n-2)/n),7) AS const_sigma, round(sqrt(u*(1/n+pow(dx/n,2)/den)),7) AS cx_sigma, round(sqrt(u*(1/n+pow(dy/n,2)/den)),7) AS cy_sigma, round(sqrt(u/den),7) AS angle_sigma FROM r""",
)
def fit_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sigma of the fitted constant and rotation."""
    return compare.plane_fit(points(spark, sf_dir), ["number"]).select("number", *[F.round(c, 7).alias(c) for c in ("const_sigma", "cx_sigma", "cy_sigma", "angle_sigma")])


@query("regr_alt", f"SELECT number, round(regr_intercept(px, dx),6) AS intercept, round(regr_slope(px, dx),6) AS slope, round(stddev_pop(px),6) AS rms_before, round(sqrt((regr_syy(px,dx)-regr_sxy(px,dx)*regr_sxy(px,dx)/regr_sxx(px,dx))/count(*)),6) AS rms_after FROM {POINTS} GROUP BY number")
def regr_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = compare.line_fit(points(spark, sf_dir), ["number"], "px", "dx")
    return fit.select("number", *[F.round(c, 6).alias(c) for c in ("intercept", "slope", "rms_before", "rms_after")])


@query("sample_fractions", "WITH n AS (SELECT number, j, count(*) OVER (PARTITION BY number) AS c FROM {path_samples}) SELECT number, j FROM n WHERE j IN (SELECT CAST(round(f*0.1::DOUBLE*(c-1)) AS INTEGER) FROM (SELECT unnest(range(11)) AS f))")
def sample_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "path_samples").withColumn("c", F.count("*").over(W.partitionBy("number")))
    wanted = F.array(*[F.round(f * num(0.1) * (F.col("c") - 1)).cast("int") for f in range(11)])
    return counted.where(F.array_contains(wanted, F.col("j"))).select("number", "j")


ARCHIVE = "(SELECT l_partkey+1 AS number, CAST(l_shipdate AS DATE) AS date, l_linenumber % 5 AS quality, l_quantity AS major, l_discount > 0.05 AS assumed FROM lineitem)"


@query(
    "occultation_summary",
    f"WITH a AS {ARCHIVE} SELECT number, count(*) AS n, CAST(min(date) AS VARCHAR) AS first, CAST(max(date) AS VARCHAR) AS last, count(*) FILTER (quality=0) AS q0, count(*) FILTER (quality>=3) AS q3, max(quality) FILTER (quality>=2 AND NOT assumed) AS best FROM a GROUP BY number",
)
def occultation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = base(spark, sf_dir, "lineitem").select((F.col("l_partkey") + 1).alias("number"), F.to_date("l_shipdate").alias("date"), (F.col("l_linenumber") % 5).alias("quality"), F.col("l_quantity").alias("major"), (F.col("l_discount") > 0.05).alias("assumed"))
    s = compare.occultations(records)
    q = lambda k: F.coalesce(F.try_element_at("by_quality", F.lit(k)), F.lit(0))
    return s.select("number", "n", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), q(0).alias("q0"), (q(3) + q(4)).alias("q3"), F.col("best.quality").alias("best"))


@query("satellite_zone", "SELECT s_nationkey AS system, count(*) AS n, round(max(s_acctbal + s_suppkey/2::DOUBLE),4) AS zone_km FROM supplier GROUP BY s_nationkey")
def satellite_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half width of the zone around a body where its satellites may be: the farthest orbit and half that satellite."""
    moons = base(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("system"), F.col("s_acctbal").alias("axis_km"), F.col("s_suppkey").alias("diameter_km"))
    return moons.groupBy("system").agg(F.count("*").alias("n"), F.round(F.max(F.col("axis_km") + F.col("diameter_km") / num(2)), 4).alias("zone_km"))


@query("unwrap_lon", "WITH w AS (SELECT number, j, (j*37 + number*11 + 180) % 360 - 180 AS lon FROM {path_samples}), d AS (SELECT *, CASE WHEN lon-lag(lon) OVER w > 180 THEN -360 WHEN lon-lag(lon) OVER w < -180 THEN 360 ELSE 0 END AS t FROM w WINDOW w AS (PARTITION BY number ORDER BY j)) SELECT number, j, CAST(lon + sum(t) OVER (PARTITION BY number ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS lon FROM d")
def unwrap_lon(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = table(spark, sf_dir, "path_samples").select("number", "j", ((F.col("j") * 37 + F.col("number") * 11 + 180) % 360 - 180).cast("double").alias("lon"))
    return tracks.unwrapped(wrapped, "lon", ["number"], ["j"], "whole").select("number", "j", F.col("whole").alias("lon"))
