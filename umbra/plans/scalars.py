"""Scalar functions over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import earth, light, sky
from umbra.functions.constants import BRIGHT_SPIN, TYPICAL_ERRORS
from umbra.functions.sky import num
from umbra.plans.registry import query
from umbra.plans.tables import table

KIND = "CASE WHEN pmra IS NULL OR parallax IS NULL THEN 2 WHEN ruwe < 1.4 THEN 0 ELSE 1 END"


def r(x, digits: int = 6):
    return F.round(x, digits)


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "stars")


@query("cell_of", "SELECT source_id, CAST(least(greatest(floor((dec+90)/0.25::DOUBLE),0),719)*1440 + floor((ra-floor(ra/360::DOUBLE)*360)/0.25::DOUBLE)%1440 AS BIGINT) AS cell FROM {stars}")
def cell_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stars(spark, sf_dir).select("source_id", sky.cell_of(F.col("ra"), F.col("dec")).alias("cell"))


@query(
    "encode_decode",
    """WITH c AS (SELECT source_id, ra, dec, CAST(least(greatest(floor((dec+90)/0.25::DOUBLE),0),719)*1440 + floor(ra/0.25::DOUBLE)%1440 AS BIGINT) AS cell,
      CAST(least(greatest(floor((ra-floor(ra/0.25::DOUBLE)*0.25::DOUBLE)/(0.25::DOUBLE/4294967296)+0.5::DOUBLE),0),4294967295) AS BIGINT) AS ra_off,
      CAST(least(greatest(floor((dec+90-floor((dec+90)/0.25::DOUBLE)*0.25::DOUBLE)/(0.25::DOUBLE/4294967296)+0.5::DOUBLE),0),4294967295) AS BIGINT) AS dec_off FROM {stars})
    SELECT source_id, cell, round((cell%1440)*0.25::DOUBLE + ra_off*(0.25::DOUBLE/4294967296), 6) AS ra_back, round(floor(cell/1440)*0.25::DOUBLE - 90 + dec_off*(0.25::DOUBLE/4294967296), 6) AS dec_back,
      abs(ra - ((cell%1440)*0.25::DOUBLE + ra_off*(0.25::DOUBLE/4294967296))) < 1e-9 AS ra_close FROM c""",
)
def encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = stars(spark, sf_dir).select("source_id", "ra", sky.cell_of(F.col("ra"), F.col("dec")).alias("cell"), sky.cell_offset(F.col("ra")).alias("ra_off"), sky.cell_offset(F.col("dec") + 90.0).alias("dec_off"))
    ra, dec = sky.cell_position(F.col("cell"), F.col("ra_off"), F.col("dec_off"))
    return coded.select("source_id", "cell", r(ra).alias("ra_back"), r(dec).alias("dec_back"), (F.abs(F.col("ra") - ra) < 1e-9).alias("ra_close"))


@query(
    "propagate_linear",
    """WITH m AS (SELECT source_id, ra + coalesce(pmra,0)/greatest(cos(radians(dec)),1e-6)*9.5::DOUBLE/3.6e6::DOUBLE AS a, dec + coalesce(pmdec,0)*9.5::DOUBLE/3.6e6::DOUBLE AS dec2 FROM {stars})
    SELECT source_id, round(a - floor(a/360)*360, 9) AS ra, round(dec2, 9) AS dec FROM m""",
)
def propagate_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    ra, dec = sky.moved(F.col("ra"), F.col("dec"), F.col("pmra"), F.col("pmdec"), 9.5)
    return stars(spark, sf_dir).select("source_id", r(ra, 9).alias("ra"), r(dec, 9).alias("dec"))


def _spin_case(k: int) -> str:
    return "CASE " + " ".join(f"WHEN g < {row[1]} THEN {row[k]}::DOUBLE" for row in BRIGHT_SPIN) + " ELSE 0::DOUBLE END"


@query(
    "pm_bias",
    f"""WITH w AS (SELECT *, radians(ra) AS a, radians(dec) AS d, {_spin_case(2)} AS wx, {_spin_case(3)} AS wy, {_spin_case(4)} AS wz FROM {{stars}} WHERE pmra IS NOT NULL)
    SELECT source_id, round(pmra - (-sin(d)*cos(a)*wx - sin(d)*sin(a)*wy + cos(d)*wz)/1000, 6) AS pmra, round(pmdec - (sin(a)*wx - cos(a)*wy)/1000, 6) AS pmdec FROM w""",
)
def pm_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, d = sky.unbiased_motion(F.col("pmra"), F.col("pmdec"), F.col("ra"), F.col("dec"), F.col("g"), F.lit(0))
    return stars(spark, sf_dir).where("pmra IS NOT NULL").select("source_id", r(a).alias("pmra"), r(d).alias("pmdec"))


@query(
    "separation",
    """WITH p AS (SELECT source_id, ra, dec, ra + 0.1::DOUBLE AS ra2, dec*0.99::DOUBLE AS dec2 FROM {stars})
    SELECT source_id, round(degrees(2*asin(sqrt(least(greatest(pow(sin((radians(dec2)-radians(dec))/2),2)+cos(radians(dec))*cos(radians(dec2))*pow(sin((radians(ra2)-radians(ra))/2),2),0),1))))*3600,4) AS by_haversine,
      round(degrees(acos(least(greatest(cos(radians(dec))*cos(radians(ra))*cos(radians(dec2))*cos(radians(ra2))+cos(radians(dec))*sin(radians(ra))*cos(radians(dec2))*sin(radians(ra2))+sin(radians(dec))*sin(radians(dec2)),-1),1)))*3600,2) AS by_cosine FROM p""",
)
def separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, d, a2, d2 = F.col("ra"), F.col("dec"), F.col("ra") + 0.1, F.col("dec") * 0.99
    return stars(spark, sf_dir).select("source_id", r(sky.separation(a, d, a2, d2), 4).alias("by_haversine"), r(sky.separation_by_cosine(a, d, a2, d2), 2).alias("by_cosine"))


@query(
    "gnomonic",
    """WITH p AS (SELECT source_id, radians(dec) AS d, radians(dec*0.98::DOUBLE) AS d0, radians(0.5::DOUBLE) AS h FROM {stars}),
    q AS (SELECT *, sin(d0)*sin(d)+cos(d0)*cos(d)*cos(h) AS c FROM p)
    SELECT source_id, round(degrees(cos(d)*sin(h)/c)*60,6) AS xi, round(degrees((cos(d0)*sin(d)-sin(d0)*cos(d)*cos(h))/c)*60,6) AS eta FROM q""",
)
def gnomonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    xi, eta = sky.gnomonic(num(0.5), F.col("dec"), num(0), F.col("dec") * 0.98)
    return stars(spark, sf_dir).select("source_id", r(xi).alias("xi"), r(eta).alias("eta"))


@query(
    "space_motion",
    """WITH b AS (SELECT source_id, ra, dec, radians(ra) AS a, radians(dec) AS d, pi()/648e6::DOUBLE AS k, greatest(coalesce(parallax,0),0.01::DOUBLE) AS p, coalesce(pmra,0) AS mu, coalesce(pmdec,0) AS nu, 30::DOUBLE AS rv FROM {stars}),
    v AS (SELECT source_id, cos(d)*cos(a) + 10*(-sin(a)*mu*k - sin(d)*cos(a)*nu*k + cos(d)*cos(a)*rv*p/4.740470463::DOUBLE*k) AS x,
      cos(d)*sin(a) + 10*(cos(a)*mu*k - sin(d)*sin(a)*nu*k + cos(d)*sin(a)*rv*p/4.740470463::DOUBLE*k) AS y, sin(d) + 10*(cos(d)*nu*k + sin(d)*rv*p/4.740470463::DOUBLE*k) AS z FROM b),
    u AS (SELECT source_id, x, y, z, sqrt(x*x+y*y+z*z) AS n FROM v)
    SELECT source_id, round(x/n,10) AS x, round(y/n,10) AS y, round(z/n,10) AS z FROM u""",
)
def space_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    ra, dec = sky.space_motion(F.col("ra"), F.col("dec"), F.col("parallax"), F.col("pmra"), F.col("pmdec"), num(30), 10)
    # As a direction, which has no seam and no poles.
    moved = stars(spark, sf_dir).select("source_id", ra.alias("ra"), dec.alias("dec"))
    there = sky.direction(F.col("ra"), F.col("dec"))
    return moved.select("source_id", *[r(c, 10).alias(k) for k, c in zip("xyz", there, strict=True)])


@query("perspective", "SELECT source_id, round(sqrt(pmra*pmra+pmdec*pmdec)*(40/4.740470463::DOUBLE*parallax*pi()/648e6::DOUBLE)*100,9) AS mas FROM {stars} WHERE parallax IS NOT NULL")
def perspective(spark: SparkSession, sf_dir: str) -> DataFrame:
    pm = light.hypot(F.col("pmra"), F.col("pmdec"))
    return stars(spark, sf_dir).where("parallax IS NOT NULL").select("source_id", r(sky.perspective_mas(pm, num(-40), F.col("parallax"), 10), 9).alias("mas"))


@query(
    "parallax_shift",
    """WITH u AS (SELECT source_id, parallax AS p, cos(radians(dec))*cos(radians(ra)) AS x, cos(radians(dec))*sin(radians(ra)) AS y, sin(radians(dec)) AS z FROM {stars} WHERE parallax IS NOT NULL),
    f AS (SELECT *, 1000/p*3.0856775814913673e13::DOUBLE AS far FROM u),
    g AS (SELECT *, x*far-149597870.7::DOUBLE AS gx, y*far-1e7::DOUBLE AS gy, z*far+2e7::DOUBLE AS gz FROM f),
    h AS (SELECT *, gx/sqrt(gx*gx+gy*gy+gz*gz) AS hx, gy/sqrt(gx*gx+gy*gy+gz*gz) AS hy, gz/sqrt(gx*gx+gy*gy+gz*gz) AS hz FROM g)
    SELECT source_id, round(atan2(sqrt(pow(y*hz-z*hy,2)+pow(z*hx-x*hz,2)+pow(x*hy-y*hx,2)), x*hx+y*hy+z*hz)*180/pi()*3.6e6::DOUBLE,4) AS mas FROM h""",
)
def parallax_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = sky.direction(F.col("ra"), F.col("dec"))
    seen = sky.seen_from(u, F.col("parallax"), sky.Vec(num(149597870.7), num(1e7), num(-2e7)))
    return stars(spark, sf_dir).where("parallax IS NOT NULL").select("source_id", r(sky.angle_mas(u, seen), 4).alias("mas"))


@query(
    "light_deflection",
    """WITH u AS (SELECT source_id, cos(radians(dec))*cos(radians(ra)) AS x, cos(radians(dec))*sin(radians(ra)) AS y, sin(radians(dec)) AS z, 1.5e8::DOUBLE AS e FROM {stars}),
    w AS (SELECT *, 1 - x AS den, 2*1.32712440018e11::DOUBLE/(299792.458::DOUBLE*299792.458::DOUBLE*e) AS k FROM u)
    SELECT source_id, round(log10(sqrt(pow(k*(-1 + x*x)/den,2)+pow(k*x*y/den,2)+pow(k*x*z/den,2))*180/pi()*3.6e6::DOUBLE),4) AS log_mas FROM w""",
)
def light_deflection(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = sky.direction(F.col("ra"), F.col("dec"))
    bend = sky.light_bend(u, sky.Vec(num(-1.5e8), num(0), num(0)), u, 1.32712440018e11)
    mas = bend.norm() * (180 / 3.141592653589793 * 3.6e6)
    return stars(spark, sf_dir).select("source_id", r(F.log10(mas), 4).alias("log_mas"))


@query(
    "alt_az",
    """WITH s AS (SELECT source_id, radians(ra) AS a, radians(dec) AS d, (2460800.25::DOUBLE-2451545)/36525 AS t FROM {stars}),
    p AS (SELECT *, radians((2306.2181::DOUBLE*t+0.30188::DOUBLE*t*t+0.017998::DOUBLE*t*t*t)/3600) AS ze, radians((2306.2181::DOUBLE*t+1.09468::DOUBLE*t*t+0.018203::DOUBLE*t*t*t)/3600) AS zz, radians((2004.3109::DOUBLE*t-0.42665::DOUBLE*t*t-0.041833::DOUBLE*t*t*t)/3600) AS th FROM s),
    q AS (SELECT source_id, atan2(cos(d)*sin(a+ze), cos(th)*cos(d)*cos(a+ze)-sin(th)*sin(d))+zz AS a, asin(least(greatest(sin(th)*cos(d)*cos(a+ze)+cos(th)*sin(d),-1),1)) AS d, t,
       280.46061837::DOUBLE+360.98564736629::DOUBLE*(2460800.25::DOUBLE-2451545)+0.000387933::DOUBLE*t*t-t*t*t/38710000 AS st FROM p),
    h AS (SELECT *, radians(st-floor(st/360)*360+20) - a AS h, radians(48::DOUBLE) AS f FROM q),
    o AS (SELECT source_id, degrees(asin(sin(d)*sin(f)+cos(d)*cos(f)*cos(h))) AS alt, degrees(atan2(-cos(d)*sin(h), sin(d)*cos(f)-cos(d)*sin(f)*cos(h))) AS az0 FROM h)
    SELECT source_id, round(alt,5) AS alt, round(az0-floor(az0/360)*360,4) AS az, ['N','NE','E','SE','S','SW','W','NW'][CAST(floor((az0-floor(az0/360)*360+22.5::DOUBLE)/45) AS BIGINT)%8+1] AS toward FROM o""",
)
def alt_az(spark: SparkSession, sf_dir: str) -> DataFrame:
    alt, az = sky.alt_az(F.col("ra"), F.col("dec"), num(2460800.25), num(48), num(20))
    return stars(spark, sf_dir).select("source_id", r(alt, 5).alias("alt"), r(az, 4).alias("az"), sky.compass(az).alias("toward"))


@query(
    "precession",
    """WITH s AS (SELECT source_id, radians(ra) AS a, radians(dec) AS d, 0.25::DOUBLE AS t FROM {stars}),
    p AS (SELECT *, radians((2306.2181::DOUBLE*t+0.30188::DOUBLE*t*t+0.017998::DOUBLE*t*t*t)/3600) AS ze, radians((2306.2181::DOUBLE*t+1.09468::DOUBLE*t*t+0.018203::DOUBLE*t*t*t)/3600) AS zz, radians((2004.3109::DOUBLE*t-0.42665::DOUBLE*t*t-0.041833::DOUBLE*t*t*t)/3600) AS th FROM s)
    SELECT source_id, round(atan2(cos(d)*sin(a+ze), cos(th)*cos(d)*cos(a+ze)-sin(th)*sin(d))+zz,9) AS ra_rad, round(asin(least(greatest(sin(th)*cos(d)*cos(a+ze)+cos(th)*sin(d),-1),1)),9) AS dec_rad FROM p""",
)
def precession(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, d = sky.precessed(F.col("ra"), F.col("dec"), num(2451545.0 + 0.25 * 36525))
    return stars(spark, sf_dir).select("source_id", r(a, 9).alias("ra_rad"), r(d, 9).alias("dec_rad"))


@query("compass_octant", "SELECT source_id, ['N','NE','E','SE','S','SW','W','NW'][CAST(floor((ra+22.5::DOUBLE)/45) AS BIGINT)%8+1] AS toward, CAST(CAST(floor((ra+22.5::DOUBLE)/45) AS BIGINT)%8 AS INTEGER) AS icon FROM {stars}")
def compass_octant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stars(spark, sf_dir).select("source_id", sky.compass(F.col("ra")).alias("toward"), sky.moon_icon(F.col("ra")).alias("icon"))


@query(
    "position_shift",
    """SELECT source_id, round(((ra+0.001::DOUBLE-ra+180) - floor((ra+0.001::DOUBLE-ra+180)/360)*360 - 180)*cos(radians(dec))*3.6e6::DOUBLE,3) AS east_mas, round((dec*0.9999::DOUBLE-dec)*3.6e6::DOUBLE,3) AS north_mas FROM {stars}""",
)
def position_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = sky.shift_mas(F.col("ra"), F.col("dec"), F.col("ra") + 0.001, F.col("dec") * 0.9999)
    return stars(spark, sf_dir).select("source_id", r(e, 3).alias("east_mas"), r(n, 3).alias("north_mas"))


@query(
    "hg_mag",
    """WITH t AS (SELECT number, h, coalesce(g_slope,0.15::DOUBLE) AS g, a, a-0.9::DOUBLE AS dl, tan(acos(least(greatest(1-e,-1),1))/2) AS t FROM {asteroids})
    SELECT number, round(h+5*log10(a*dl)-2.5::DOUBLE*log10((1-g)*exp(-3.33::DOUBLE*pow(t,0.63::DOUBLE))+g*exp(-1.87::DOUBLE*pow(t,1.22::DOUBLE))),6) AS mag FROM t""",
)
def hg_mag(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = light.hg_magnitude(F.col("h"), F.coalesce("g_slope", num(0.15)), F.col("a"), F.col("a") - 0.9, 1 - F.col("e"))
    return table(spark, sf_dir, "asteroids").select("number", r(m).alias("mag"))


@query("drop_cut", "SELECT source_id, round(-2.5::DOUBLE*log10(pow(10,0.4::DOUBLE*(0.05::DOUBLE+g/20))-1),6) AS cut, round(2.5::DOUBLE*log10(1+pow(10,0.4::DOUBLE*(15-g))),6) AS drop_mag, round(-2.5::DOUBLE*log10(pow(10,-0.4::DOUBLE*g)+pow(10,-0.4::DOUBLE*15)),6) AS both FROM {stars}")
def drop_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("g")
    return stars(spark, sf_dir).select("source_id", r(light.drop_margin(0.05 + g / 20)).alias("cut"), r(light.drop(num(15), g)).alias("drop_mag"), r(light.combined(g, num(15))).alias("both"))


@query("owc_limit", "SELECT site_id, round(5*log10(aperture_cm)+2.5::DOUBLE*log10(greatest(reach_km/10,1e-9::DOUBLE)/frames)+8.5::DOUBLE+0.3::DOUBLE,6) AS lim, least(round(5*log10(aperture_cm)+2.5::DOUBLE*log10(0.5::DOUBLE)+8.5::DOUBLE+0.3::DOUBLE,1),16) AS site_lim FROM {sites}")
def owc_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lim = light.faintest_observable(F.col("aperture_cm"), F.col("reach_km") / 10, F.col("frames"), 0.3)
    return table(spark, sf_dir, "sites").select("site_id", r(lim).alias("lim"), light.site_limit(F.col("aperture_cm"), num(0.5), 0.3, 16).alias("site_lim"))


@query("airmass_extinction", "SELECT site_id, round(1/(sin(radians(abs(lat)))+0.50572::DOUBLE*pow(abs(lat)+6.07995::DOUBLE,-1.6364::DOUBLE)),6) AS airmass, round(0.2::DOUBLE*(1/(sin(radians(abs(lat)))+0.50572::DOUBLE*pow(abs(lat)+6.07995::DOUBLE,-1.6364::DOUBLE))-1),6) AS loss FROM {sites}")
def airmass_extinction(spark: SparkSession, sf_dir: str) -> DataFrame:
    alt = F.abs("lat")
    return table(spark, sf_dir, "sites").select("site_id", r(light.airmass(alt)).alias("airmass"), r(light.extinction_loss(alt, 0.2)).alias("loss"))


@query("body_magnitude", "SELECT number, round(-1.6::DOUBLE+5*log10(a*(a-0.9::DOUBLE))+0.01::DOUBLE*i,6) AS mag FROM {asteroids}")
def body_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = light.planet_magnitude(num(-1.6), F.col("a"), F.col("a") - 0.9, num(0.01), F.col("i"))
    return table(spark, sf_dir, "asteroids").select("number", r(m).alias("mag"))


DIA = "1329/sqrt({p}::DOUBLE)*pow(10,-h/5)"


@query(
    "size_precedence",
    f"""WITH s AS (SELECT number, h, albedo, CASE WHEN diameter>0 THEN diameter END AS dm, CASE WHEN diameter_sigma>0 THEN diameter_sigma END AS sg, CASE WHEN number%6=0 THEN [diameter*1.4::DOUBLE, diameter, diameter*0.5::DOUBLE] ELSE [] END AS ext FROM {{asteroids}}),
    z AS (SELECT *, greatest((dm-3*coalesce(sg,0.15::DOUBLE*dm))/2,0) AS lo, (dm+3*coalesce(sg,0.15::DOUBLE*dm))/2 AS hi, len(ext)>=2 AS wide FROM s)
    SELECT number, round(CASE WHEN dm IS NOT NULL THEN dm/2 WHEN albedo>0 THEN 1329/sqrt(albedo)*pow(10,-h/5)/2 ELSE {DIA.format(p=0.14)}/2 END,6) AS r_km,
      round(CASE WHEN dm IS NOT NULL THEN CASE WHEN wide THEN least(lo, list_min(ext)/2) ELSE lo END WHEN albedo>0 THEN 1329/sqrt(least(albedo*1.5::DOUBLE,1))*pow(10,-h/5)/2 ELSE {DIA.format(p=0.30)}/2 END,6) AS r_min_km,
      round(CASE WHEN dm IS NOT NULL THEN CASE WHEN wide THEN greatest(hi, list_max(ext)/2) ELSE hi END WHEN albedo>0 THEN 1329/sqrt(albedo/1.5::DOUBLE)*pow(10,-h/5)/2 ELSE {DIA.format(p=0.05)}/2 END,6) AS r_max_km,
      CASE WHEN dm IS NOT NULL THEN 'diameter' WHEN albedo>0 THEN 'H and albedo' ELSE 'H only' END AS source FROM z""",
)
def size_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.when(F.col("number") % 6 == 0, F.array(F.col("diameter") * 1.4, F.col("diameter"), F.col("diameter") * 0.5)).otherwise(F.array().cast("array<double>"))
    size = light.size_by_precedence(F.col("h"), F.col("diameter"), F.col("diameter_sigma"), F.col("albedo"), ext)
    return table(spark, sf_dir, "asteroids").select("number", *[r(c).alias(k) if k != "source" else c.alias(k) for k, c in size.items()])


@query("pick_size_rule", f"SELECT number, round(CASE WHEN diameter>0 THEN diameter ELSE {DIA.format(p=0.14)} END,6) AS d_km, round(CASE WHEN diameter>0 THEN diameter+3*coalesce(diameter_sigma,0.15::DOUBLE*diameter) ELSE {DIA.format(p=0.05)} END,6) AS d_max_km, NOT coalesce(diameter>0,false) AS estimated FROM {{asteroids}} WHERE a>0 AND e>=0 AND e<0.99 AND h<15")
def pick_size_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = light.size_for_screen(F.col("h"), F.col("diameter"), F.col("diameter_sigma"))
    admitted = (F.col("a") > 0) & F.col("e").between(0, 0.99) & (F.col("e") < 0.99) & F.col("epoch_jd").isNotNull() & (F.col("h") < 15)
    return table(spark, sf_dir, "asteroids").where(admitted).select("number", r(size["d_km"]).alias("d_km"), r(size["d_max_km"]).alias("d_max_km"), size["estimated"].alias("estimated"))


@query(
    "star_sigma",
    """WITH k AS (SELECT source_id, CASE WHEN (source_id//1000)%20=11 THEN 2 WHEN (source_id//1000)%10=4 THEN 3 WHEN ruwe>=1.4 THEN 1 ELSE 0 END AS kind, ruwe, pos_err FROM {stars})
    SELECT source_id, kind, round(CASE kind WHEN 2 THEN sqrt(pow(pos_err,2)+pow(10*9.5::DOUBLE,2)) WHEN 3 THEN sqrt(pow(pos_err,2)+pow(2.5::DOUBLE*9.5::DOUBLE,2)) WHEN 1 THEN sqrt(pow(pos_err*ruwe,2)+pow(pos_err*ruwe*9.5::DOUBLE,2)) END,6) AS sigma FROM k""",
)
def star_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.expr("source_id div 1000")
    kind = F.when(key % 20 == 11, 2).when(key % 10 == 4, 3).when(F.col("ruwe") >= 1.4, 1).otherwise(0)
    return stars(spark, sf_dir).withColumn("kind", kind).select("source_id", "kind", r(light.star_sigma(F.col("kind"), F.col("ruwe"), F.col("pos_err"), num(2.5), 9.5)).alias("sigma"))


@query(
    "ellipse_roundtrip",
    """WITH c AS (SELECT source_id, pos_err*2 AS a, pos_err AS b, ra/2 AS pa FROM {stars}),
    v AS (SELECT source_id, a*a*pow(sin(radians(pa)),2)+b*b*pow(cos(radians(pa)),2) AS xx, (a*a-b*b)*sin(radians(pa))*cos(radians(pa)) AS xy, a*a*pow(cos(radians(pa)),2)+b*b*pow(sin(radians(pa)),2) AS yy FROM c),
    e AS (SELECT *, sqrt(greatest(pow((xx+yy)/2,2)-(xx*yy-xy*xy),0)) AS s, degrees(0.5::DOUBLE*atan2(2*xy,yy-xx)) AS p FROM v)
    SELECT source_id, round(sqrt((xx+yy)/2+s),6) AS major, round(sqrt(greatest((xx+yy)/2-s,0)),6) AS minor, round(p-floor(p/180)*180,4) AS pa FROM e""",
)
def ellipse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    major, minor, pa = light.ellipse(*light.covariance(F.col("pos_err") * 2, F.col("pos_err"), F.col("ra") / 2))
    return stars(spark, sf_dir).select("source_id", r(major).alias("major"), r(minor).alias("minor"), r(pa, 4).alias("pa"))


@query(
    "star_ellipse",
    """WITH c AS (SELECT source_id, pos_err AS sa, pos_err*0.9::DOUBLE AS sd, pos_err*1.1::DOUBLE AS pa, pos_err*1.2::DOUBLE AS pd, 9.5::DOUBLE AS t, 0.1::DOUBLE AS c1, -0.2::DOUBLE AS c2, 0.05::DOUBLE AS c3 FROM {stars}),
    v AS (SELECT source_id, sa*sa+2*t*c2*sa*pa+t*t*pa*pa AS xx, sd*sd+t*t*pd*pd AS yy, c1*sa*sd+t*t*c3*pa*pd AS xy FROM c),
    e AS (SELECT *, sqrt(greatest(pow((xx+yy)/2,2)-(xx*yy-xy*xy),0)) AS s FROM v)
    SELECT source_id, round(sqrt((xx+yy)/2+s),6) AS major, round(sqrt(greatest((xx+yy)/2-s,0)),6) AS minor FROM e""",
)
def star_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("pos_err")
    err = {"ra_error": e, "dec_error": e * 0.9, "pmra_error": e * 1.1, "pmdec_error": e * 1.2, "ra_dec_corr": num(0.1), "ra_pmra_corr": num(-0.2), "pmra_pmdec_corr": num(0.05)}
    major, minor, _ = light.ellipse(*light.star_covariance(err, 9.5))
    return stars(spark, sf_dir).select("source_id", r(major).alias("major"), r(minor).alias("minor"))


def _typical(k: int) -> str:
    steps = zip(TYPICAL_ERRORS, TYPICAL_ERRORS[1:], strict=False)
    return "CASE " + " ".join(f"WHEN q <= {b[0]} THEN {a[k]}::DOUBLE*pow({b[k] / a[k]!r}::DOUBLE,(q-{a[0]}::DOUBLE)/{b[0] - a[0]!r}::DOUBLE)" for a, b in steps) + " END"


@query("typical_star", f"WITH q AS (SELECT source_id, least(greatest(g,12),21) AS q FROM {{stars}}) SELECT source_id, round(sqrt(pow({_typical(1)},2)+pow(9.5::DOUBLE*{_typical(2)},2)),6) AS sigma FROM q")
def typical_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stars(spark, sf_dir).select("source_id", r(light.typical_sigma(F.col("g"), 9.5)).alias("sigma"))


@query(
    "across_track",
    """WITH v AS (SELECT source_id, pos_err AS xx, pos_err/4 AS xy, pos_err*0.7::DOUBLE AS yy, pmra AS a, pmdec AS b, sqrt(pmra*pmra+pmdec*pmdec) AS m FROM {stars})
    SELECT source_id, round(CASE WHEN m>0 THEN sqrt(greatest(b/m*b/m*xx-2*b/m*a/m*xy+a/m*a/m*yy,0)) END,6) AS sigma FROM v""",
)
def across_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("pos_err")
    return stars(spark, sf_dir).select("source_id", r(light.across_track(e, e / 4, e * 0.7, F.col("pmra"), F.col("pmdec"))).alias("sigma"))


PHI = "0.5::DOUBLE*(1+sign({z})*(1-(1/(1+0.3275911::DOUBLE*abs({z}/sqrt(2))))*(0.254829592::DOUBLE+(1/(1+0.3275911::DOUBLE*abs({z}/sqrt(2))))*(-0.284496736::DOUBLE+(1/(1+0.3275911::DOUBLE*abs({z}/sqrt(2))))*(1.421413741::DOUBLE+(1/(1+0.3275911::DOUBLE*abs({z}/sqrt(2))))*(-1.453152027::DOUBLE+(1/(1+0.3275911::DOUBLE*abs({z}/sqrt(2))))*1.061405429::DOUBLE))))*exp(-({z}/sqrt(2))*({z}/sqrt(2)))))"


@query(
    "site_probability",
    f"WITH v AS (SELECT event_id, r_km AS r, abs(x0)/100 AS d, CASE WHEN number%9=0 THEN 0 ELSE half/60 END AS s FROM {{elements}}) SELECT event_id, round(CASE WHEN s>0 THEN {PHI.format(z='((r-d)/s)')} - {PHI.format(z='((-r-d)/s)')} WHEN abs(d)<=r THEN 1 ELSE 0 END,6) AS p FROM v",
)
def site_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigma = F.when(F.col("number") % 9 == 0, num(0)).otherwise(F.col("half") / 60)
    return table(spark, sf_dir, "elements").select("event_id", r(light.shadow_chance(F.col("r_km"), F.abs("x0") / 100, sigma)).alias("p"))


@query(
    "geodetic_ecef",
    """WITH c AS (SELECT site_id, radians(lat) AS p, radians(lon) AS l, ele_m/1000 AS h, 1/298.257223563::DOUBLE AS f FROM {sites}),
    n AS (SELECT *, f*(2-f) AS e2, 6378.137::DOUBLE/sqrt(1-f*(2-f)*sin(p)*sin(p)) AS n FROM c)
    SELECT site_id, round((n+h)*cos(p)*cos(l),6) AS x, round((n+h)*cos(p)*sin(l),6) AS y, round((n*(1-e2)+h)*sin(p),6) AS z FROM n""",
)
def geodetic_ecef(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = earth.earth_fixed(F.col("lat"), F.col("lon"), F.col("ele_m"))
    return table(spark, sf_dir, "sites").select("site_id", r(v.x).alias("x"), r(v.y).alias("y"), r(v.z).alias("z"))


@query("ecef_geodetic", "SELECT site_id, round(lat,7) AS lat, round(ele_m,2) AS ele_m FROM {sites}")
def ecef_geodetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = earth.earth_fixed(F.col("lat"), F.col("lon"), F.col("ele_m"))
    lat, height = earth.geodetic(light.hypot(v.x, v.y) / earth.EARTH_KM, v.z / earth.EARTH_KM)
    return table(spark, sf_dir, "sites").select("site_id", r(lat, 7).alias("lat"), r(height, 2).alias("ele_m"))


@query("great_circle", "SELECT site_id, round(2*6371*asin(sqrt(least(pow(sin((radians(50::DOUBLE)-radians(lat))/2),2)+cos(radians(lat))*cos(radians(50::DOUBLE))*pow(sin((radians(10::DOUBLE)-radians(lon))/2),2),1))),4) AS km, round(degrees(2*atan(aperture_cm/(2*reach_km)))*60,6) AS fov FROM {sites}")
def great_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    km = earth.great_circle_km(F.col("lat"), F.col("lon"), num(50), num(10))
    return table(spark, sf_dir, "sites").select("site_id", r(km, 4).alias("km"), r(earth.field_of_view(F.col("aperture_cm"), F.col("reach_km"))).alias("fov"))


@query(
    "in_box",
    """WITH v AS (SELECT site_id, lat, lon, reach_km AS m, lon-170::DOUBLE AS e FROM {sites})
    SELECT site_id, (lat >= -40-m/111.2::DOUBLE AND lat <= 40+m/111.2::DOUBLE) AND ((e-floor(e/360)*360) <= 40 + m/(111.2::DOUBLE*greatest(cos(radians(lat)),0.02::DOUBLE)) OR (e-floor(e/360)*360) >= 360 - m/(111.2::DOUBLE*greatest(cos(radians(lat)),0.02::DOUBLE))) AS inside FROM v""",
)
def in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = {"lat_min": num(-40), "lat_max": num(40), "lon_min": num(170), "lon_max": num(-150)}
    return table(spark, sf_dir, "sites").select("site_id", earth.in_box(F.col("lat"), F.col("lon"), box, F.col("reach_km")).alias("inside"))


@query("moved_site", "SELECT a.site_id, abs(a.lat-a.lat*1.0001::DOUBLE)>0.01 OR abs((a.lon+0.005::DOUBLE-a.lon+180)-floor((a.lon+0.005::DOUBLE-a.lon+180)/360)*360-180)>0.01 AS moved FROM {sites} a")
def moved_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sites").select("site_id", earth.site_moved(F.col("lat"), F.col("lon"), F.col("lat") * 1.0001, F.col("lon") + 0.005).alias("moved"))


@query(
    "ground_reach",
    """WITH v AS (SELECT event_id, sin(radians(abs(dec))) AS s, r_km+30 AS rho, sin(radians(4::DOUBLE)) AS m FROM {elements}),
    c AS (SELECT *, sqrt(greatest(1-s*s,0)) AS c, rho/6378.137::DOUBLE AS q FROM v),
    w AS (SELECT *, CASE WHEN c-q<=0 THEN 1 ELSE sqrt(greatest(1-(c-q)*(c-q),0)) END AS hi, greatest(CASE WHEN c+q>=1 THEN -1 ELSE sqrt(greatest(1-(c+q)*(c+q),0)) END, m) AS lo FROM c)
    SELECT event_id, round(2*6378.137::DOUBLE*asin(least(sqrt(rho*rho+pow(6378.137::DOUBLE*greatest(greatest(hi-s,s-lo),0),2))/(2*6378.137::DOUBLE),1)),4) AS km FROM w""",
)
def ground_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    km = earth.ground_reach(F.sin(F.radians(F.abs("dec"))), F.col("r_km") + 30, F.sin(F.radians(num(4))))
    return table(spark, sf_dir, "elements").select("event_id", r(km, 4).alias("km"))
