"""Records, runs, favourites, picks, and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbra.functions.sky import num
from umbra.operators import catalog, compare, records
from umbra.plans import paths
from umbra.plans.registry import query
from umbra.plans.tables import base, table
from umbra.sources import files

JD = "(2440587.5::DOUBLE+(1767225600+event_id%400*1800)/86400::DOUBLE)"
TC = f"(({JD}-2451545)/36525)"
SEC = "radians(1/3600::DOUBLE)"
#: Altitude and azimuth by IAU 1976 precession and mean sidereal time.
ALTAZ = f"""pr AS (SELECT *, {JD} AS jd, {TC} AS tc FROM ev), an AS (SELECT *, (2306.2181::DOUBLE*tc+0.30188::DOUBLE*tc*tc+0.017998::DOUBLE*tc*tc*tc)*{SEC} AS ze, (2306.2181::DOUBLE*tc+1.09468::DOUBLE*tc*tc+0.018203::DOUBLE*tc*tc*tc)*{SEC} AS z, (2004.3109::DOUBLE*tc-0.42665::DOUBLE*tc*tc-0.041833::DOUBLE*tc*tc*tc)*{SEC} AS th FROM pr),
  pc AS (SELECT *, cos(radians(dec))*sin(radians(ra)+ze) AS pa_, cos(th)*cos(radians(dec))*cos(radians(ra)+ze)-sin(th)*sin(radians(dec)) AS pb_, sin(th)*cos(radians(dec))*cos(radians(ra)+ze)+cos(th)*sin(radians(dec)) AS pcz FROM an),
  hd AS (SELECT *, atan2(pa_, pb_)+z AS ra_d, asin(pcz) AS de_d, 280.46061837::DOUBLE+360.98564736629::DOUBLE*(jd-2451545)+0.000387933::DOUBLE*tc*tc-tc*tc*tc/38710000 AS gst FROM pc),
  hh AS (SELECT *, radians(gst+lon)-ra_d AS ha FROM hd),
  aa AS (SELECT *, degrees(asin(sin(radians(lat))*sin(de_d)+cos(radians(lat))*cos(de_d)*cos(ha))) AS c_alt, degrees(atan2(-cos(de_d)*sin(ha), sin(de_d)*cos(radians(lat))-cos(de_d)*cos(ha)*sin(radians(lat)))) AS c_az FROM hh)"""


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of strings as a log holds them, with gaps, for all events."""
    e = table(spark, sf_dir, "elements")
    k, s = F.col("event_id"), lambda c: c.cast("string")
    utc = F.date_format(F.timestamp_seconds(F.lit(1767225600) + k % 400 * 1800), "yyyy-MM-dd'T'HH:mm:ss")
    parts = {
        "target_id": F.when(k % 11 == 0, F.lit("M:Io")).otherwise(s(F.col("number"))),
        "target_name": F.when(k % 3 == 0, F.lit(" Body ")).otherwise(""),
        "best_utc": utc,
        "speed_kms": s(F.round("vx", 3)),
        "r_km": s(F.round("r_km", 3)),
        "max_duration_s": F.when(k % 4 == 0, "12.5").otherwise(""),
        "star_az": F.when(k % 5 == 0, "101.5").otherwise("n/a"),
        "star_alt": F.when(k % 2 == 0, "33.0").otherwise(""),
        "star_ra": s(F.round("ra", 5)),
        "star_dec": s(F.round("dec", 5)),
        "min_distance": s(F.round(F.abs("x0"), 2)),
        "margin_km": F.when(k % 6 == 0, "-1.5").otherwise(""),
        "moon_alt_deg": s(k % 40 - 20),
        "moon_sep_deg": F.when(k % 7 == 0, "").otherwise("55"),
        "moon_age_deg": s(k % 360),
    }
    record = F.map_from_arrays(F.array(*[F.lit(n) for n in parts]), F.array(*parts.values()))
    return e.select("event_id", record.alias("record"), num(48.2).alias("lat"), num(16.4).alias("lon"))


@query(
    "event_view",
    f"""WITH ev AS (SELECT event_id, number, round(vx,3) AS v, round(r_km,3) AS r, round(ra,5) AS ra, round(dec,5) AS dec, round(abs(x0),2) AS md, 48.2::DOUBLE AS lat, 16.4::DOUBLE AS lon FROM {{elements}}), {ALTAZ}
    SELECT event_id, CASE WHEN event_id%11=0 THEN CASE WHEN event_id%3=0 THEN 'Body' ELSE 'Io' END ELSE trim('('||number||') '||CASE WHEN event_id%3=0 THEN 'Body' ELSE '' END) END AS label, event_id%11=0 AS body,
      round(CASE WHEN event_id%4=0 THEN 12.5::DOUBLE ELSE 2*r/v END,4) AS duration_s, round(CASE WHEN event_id%2=0 THEN 33 WHEN event_id%5<>0 THEN c_alt END,3) AS alt, round(CASE WHEN event_id%5=0 THEN 101.5::DOUBLE ELSE c_az-floor(c_az/360)*360 END,3) AS az,
      round(CASE WHEN event_id%6=0 THEN -1.5::DOUBLE ELSE md-r END,2) AS margin_km, CASE WHEN event_id%40>20 AND event_id%7<>0 THEN CAST(CAST(floor((event_id%360)/45::DOUBLE+0.5::DOUBLE) AS INTEGER)%8 AS VARCHAR) END AS moon FROM aa""",
)
def event_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = records.shown_event(logged(spark, sf_dir))
    return shown.select("event_id", "label", "body", F.round("duration_s", 4).alias("duration_s"), F.round("alt", 3).alias("alt"), F.round("az", 3).alias("az"), F.round("margin_km", 2).alias("margin_km"), F.col("moon_icon").cast("int").cast("string").alias("moon"))


RUNS = "(SELECT s_suppkey AS id, s_nationkey AS series FROM supplier)"
LISTS = "(SELECT n_nationkey AS list, n_nationkey*2 AS series, n_nationkey%3<>1 AS fresh FROM nation)"


@query(
    "runs_started",
    f"""WITH a AS (SELECT l.*, CASE WHEN fresh AND EXISTS (SELECT 1 FROM {RUNS} r WHERE r.series = l.series) THEN 1 ELSE 0 END AS new_ FROM {LISTS} l), t AS (SELECT greatest((SELECT max(series) FROM {RUNS}), (SELECT max(series) FROM {LISTS})) AS top, (SELECT max(id) FROM {RUNS}) AS last_)
    SELECT list, CAST(CASE WHEN new_=1 THEN top+sum(new_) OVER (ORDER BY list) ELSE series END AS BIGINT) AS series, CAST(last_+row_number() OVER (ORDER BY list) AS BIGINT) AS run_id FROM a CROSS JOIN t""",
)
def runs_started(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = base(spark, sf_dir, "nation").selectExpr("n_nationkey AS list", "n_nationkey*2 AS series", "n_nationkey%3<>1 AS fresh")
    return records.started_runs(lists, base(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_nationkey AS series"))


FAV = "(SELECT DISTINCT target_id AS key FROM {hits} WHERE id%2=0)"


@query(
    "favorites_status",
    f"""WITH c AS (SELECT target_id AS key, id AS seq, CASE id%4 WHEN 0 THEN 'observed' WHEN 1 THEN 'lost' WHEN 2 THEN 'negative' END AS status, CASE WHEN id%5=0 THEN kind END AS note FROM {{hits}} WHERE id%3=0),
    n AS (SELECT key, arg_max(status, seq) FILTER (status IN ('planned','observed','positive','negative','cancelled')) AS s, arg_max(note, seq) FILTER (note IS NOT NULL) AS n FROM c GROUP BY key)
    SELECT f.key, coalesce(n.s, 'planned') AS status, coalesce(n.n, '') AS note FROM {FAV} f LEFT JOIN n ON n.key = f.key""",
)
def favorites_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "hits")
    known = h.where("id % 2 = 0").select(F.col("target_id").alias("key")).distinct().withColumns({"status": F.lit("planned"), "note": F.lit("")})
    changes = h.where("id % 3 = 0").selectExpr("target_id AS key", "id AS seq", "CASE id%4 WHEN 0 THEN 'observed' WHEN 1 THEN 'lost' WHEN 2 THEN 'negative' END AS status", "CASE WHEN id%5=0 THEN kind END AS note")
    return records.with_status(known, changes).select("key", "status", "note")


@query("favorites_cleanup", "SELECT event_id FROM events WHERE strftime(ts, '%Y-%m-%d') >= '2024-01-15'")
def favorites_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = base(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("best_utc"))
    return records.kept_since(stamped, "2024-01-15").select("event_id")


PICKS = "(SELECT o_orderkey AS pick, o_orderkey%50 AS site, CAST('2026-01-01' AS DATE)+CAST(o_orderkey%90 AS INTEGER) AS start, CAST(o_orderkey%12+1 AS INTEGER) AS days, o_orderkey%17 AS picked, CASE WHEN o_orderkey%9<>0 THEN 40+(o_orderkey%4)*0.008::DOUBLE END AS lat, 10+(o_orderkey%3)*0.006::DOUBLE AS lon FROM orders)"
ASKED = "(SELECT o_orderkey AS request, o_orderkey%50 AS site, CAST('2026-01-01' AS DATE)+CAST(o_orderkey%80+4 AS INTEGER) AS start, CAST(o_orderkey%5+1 AS INTEGER) AS days, 40.01::DOUBLE AS lat, 10.005::DOUBLE AS lon FROM orders)"


@query("best_pick", f"SELECT a.request, arg_max(p.pick, ROW(p.picked, p.start, p.pick)) AS pick FROM {ASKED} a JOIN {PICKS} p ON p.site=a.site AND p.start<=a.start AND p.start+p.days>=a.start+a.days AND (p.lat IS NULL OR greatest(abs(p.lat-a.lat),abs(p.lon-a.lon))<=0.01::DOUBLE) GROUP BY a.request")
def best_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved pick that serves each request."""
    o = base(spark, sf_dir, "orders")
    picks = o.selectExpr("o_orderkey AS pick", "o_orderkey%50 AS site", "date_add(DATE'2026-01-01', CAST(o_orderkey%90 AS INT)) AS start", "CAST(o_orderkey%12+1 AS INT) AS days", "o_orderkey%17 AS picked", "CASE WHEN o_orderkey%9<>0 THEN 40+(o_orderkey%4)*CAST(0.008 AS DOUBLE) END AS lat", "10+(o_orderkey%3)*CAST(0.006 AS DOUBLE) AS lon")
    asked = o.selectExpr("o_orderkey AS request", "o_orderkey%50 AS site", "date_add(DATE'2026-01-01', CAST(o_orderkey%80+4 AS INT)) AS start", "CAST(o_orderkey%5+1 AS INT) AS days", "CAST(40.01 AS DOUBLE) AS lat", "CAST(10.005 AS DOUBLE) AS lon")
    return records.covering_pick(asked, picks)


ROWS = "(SELECT event_id, number, round(g,6) AS star_mag, et, round(m_ast-g,6) AS margin, round(r_km/10,6) AS drop_ FROM {elements})"


@query("pick_orders", f"SELECT event_id, CAST(row_number() OVER (PARTITION BY number ORDER BY star_mag, et, event_id) AS INTEGER) AS by_mag, CAST(row_number() OVER (PARTITION BY number ORDER BY et, event_id) AS INTEGER) AS by_date, CAST(row_number() OVER (PARTITION BY number ORDER BY margin DESC, event_id) AS INTEGER) AS by_margin, CAST(row_number() OVER (PARTITION BY number ORDER BY drop_ DESC, event_id) AS INTEGER) AS by_drop FROM {ROWS}")
def pick_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each body's events in the four orders of a pick."""
    rows = table(spark, sf_dir, "elements").select("event_id", "number", F.round("g", 6).alias("star_mag"), "et", F.round(F.col("m_ast") - F.col("g"), 6).alias("margin"), F.round(F.col("r_km") / 10, 6).alias("drop"))
    for by in records.ORDERS:
        rows = records.ranked(rows, by, ["number"], "event_id").withColumnRenamed("pos", f"by_{by}")
    return rows.select("event_id", *[f"by_{by}" for by in records.ORDERS])


@query("comparison_rows", "WITH r AS (SELECT event_id, number, CASE WHEN event_id%6<>0 THEN (event_id%50-25)/2::DOUBLE END AS dt, event_id%8+0.5::DOUBLE AS dl, event_id%8+0.5::DOUBLE+(event_id%3)*0.2::DOUBLE AS dw, 4::DOUBLE AS ul, 4+(event_id%5)*0.2::DOUBLE AS uw FROM {elements}) SELECT event_id, '| '||number||' | '||CASE WHEN dt IS NULL THEN 'NOT FOUND | ' ELSE CASE WHEN abs(dt)>1.5::DOUBLE THEN '**'||printf('%+.1f',dt)||'**' ELSE printf('%+.1f',dt) END||' | '||array_to_string(list_filter([CASE WHEN abs(dt)>10 THEN 'time' END, CASE WHEN NOT (dl>5 AND dw>5) AND abs(dw-dl)>0.25::DOUBLE THEN 'drop' END, CASE WHEN abs(uw/ul-1)>0.1::DOUBLE THEN 'duration' END], lambda x: x IS NOT NULL), ', ') END||' |' AS line FROM r")
def comparison_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the report that compares a list of others with our events."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "elements").select(k, F.col("number").alias("target"), F.when(k % 6 != 0, (k % 50 - 25) / num(2)).alias("dt_s"), (k % 8 + 0.5).alias("drop_listed"), (k % 8 + 0.5 + k % 3 * 0.2).alias("drop_own"), num(4).alias("dur_listed"), (4 + k % 5 * 0.2).alias("dur_own"))
    return rows.select("event_id", records.compared(rows).alias("line"))


@query("chance_text", "SELECT event_id, CASE WHEN p IS NULL THEN '' WHEN p<0.01::DOUBLE THEN '< 1 %' WHEN p>0.99::DOUBLE THEN '> 99 %' ELSE CAST(round(100*p) AS INTEGER)||' %' END AS chance FROM (SELECT event_id, CASE WHEN event_id%9<>0 THEN (event_id%201)/200.7::DOUBLE END AS p FROM {elements})")
def chance_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "elements").select("event_id", records.chance(F.when(F.col("event_id") % 9 != 0, F.col("event_id") % 201 / num(200.7))).alias("chance"))


@query("preview_stars", "WITH f AS (SELECT source_id, g, (source_id//1000)%7 AS field FROM {stars}), c AS (SELECT *, count(*) OVER (PARTITION BY field) AS n, row_number() OVER (PARTITION BY field ORDER BY g, source_id) AS k FROM f) SELECT source_id, field, n > 100 AND k > 60 AS faded FROM c")
def preview_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stars of crowded fields are drawn faded."""
    rows = table(spark, sf_dir, "stars").select("source_id", "g", (F.expr("source_id div 1000") % 7).alias("field"))
    return records.brighter_first(rows, 60, 100, ["field"]).select("source_id", "field", "faded")


@query("combined_ellipse", "WITH c AS (SELECT source_id, radians(g*10) AS p, 2+pos_err AS a, 1+pos_err AS b, pos_err*5 AS s FROM {stars}), v AS (SELECT *, a*a*sin(p)*sin(p)+b*b*cos(p)*cos(p)+s*s AS xx, (a*a-b*b)*sin(p)*cos(p) AS xy, a*a*cos(p)*cos(p)+b*b*sin(p)*sin(p)+s*s AS yy FROM c), e AS (SELECT *, (xx+yy)/2 AS h, sqrt(greatest(pow((xx+yy)/2,2)-(xx*yy-xy*xy),0)) AS r FROM v) SELECT source_id, round(sqrt(h+r),6) AS major, round(sqrt(greatest(h-r,0)),6) AS minor FROM e")
def combined_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body's error ellipse and a star's, added."""
    s = F.col("pos_err")
    major, minor, _ = records.event_error(2 + s, 1 + s, F.col("g") * 10, s * 5)
    return table(spark, sf_dir, "stars").select("source_id", F.round(major, 6).alias("major"), F.round(minor, 6).alias("minor"))


@query("bodies_order", "SELECT s_suppkey AS id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_suppkey%4=0 THEN 0 ELSE 1 END, s_suppkey%6 DESC, s_suppkey) AS INTEGER) AS pos FROM supplier")
def bodies_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A system's bodies: the planet, then its moons by size."""
    s = base(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey", (F.col("s_suppkey") % 4 == 0).alias("planet"), (F.col("s_suppkey") % 6).alias("radius"))
    order = W.partitionBy("s_nationkey").orderBy(F.desc("planet"), F.desc("radius"), "id")
    return s.select("id", F.row_number().over(order).alias("pos"))


BODIES = "(SELECT DISTINCT CASE WHEN n_nationkey%2=0 THEN 'P' ELSE 'M' END AS prefix, lower(n_name) AS name, n_nationkey%5<>0 AS usable FROM nation)"


@query("body_kinds", f"WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey%3 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN 'P:'||n_name ELSE 'M:'||n_name END AS target FROM orders JOIN nation ON n_nationkey = o_custkey%25) SELECT t.id, CASE WHEN NOT contains(target, ':') THEN 'asteroid' WHEN b.usable THEN CASE b.prefix WHEN 'P' THEN 'planet' ELSE 'moon' END END AS kind FROM t LEFT JOIN {BODIES} b ON contains(target, ':') AND b.prefix = split_part(target, ':', 1) AND b.name = lower(split_part(target, ':', 2))")
def body_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a target's label names: an asteroid by number, or a usable planet or moon by prefix and name; null for an unknown one."""
    n = base(spark, sf_dir, "nation")
    bodies = n.select(F.when(F.col("n_nationkey") % 2 == 0, "P").otherwise("M").alias("prefix"), F.lower("n_name").alias("name"), (F.col("n_nationkey") % 5 != 0).alias("usable")).distinct()
    o = base(spark, sf_dir, "orders").withColumn("n_nationkey", F.col("o_custkey") % 25).join(n.select("n_nationkey", "n_name"), "n_nationkey")
    target = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey").cast("string")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("P:"), F.col("n_name"))).otherwise(F.concat(F.lit("M:"), F.col("n_name")))
    named = o.select(F.col("o_orderkey").alias("id"), target.alias("target")).withColumns({"prefix": F.when(F.col("target").contains(":"), F.substring_index("target", ":", 1)), "name": F.lower(F.substring_index("target", ":", -1))})
    both = named.join(bodies, ["prefix", "name"], "left")
    return both.select("id", F.when(F.col("prefix").isNull(), "asteroid").when(F.col("usable"), F.when(F.col("prefix") == "P", "planet").otherwise("moon")).alias("kind"))


@query("elements_order", "SELECT event_id, CAST(row_number() OVER (PARTITION BY number ORDER BY et, event_id) AS INTEGER) AS pos FROM {elements}")
def elements_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each body's shadow elements by time, the order in which they are stored."""
    return table(spark, sf_dir, "elements").select("event_id", F.row_number().over(W.partitionBy("number").orderBy("et", "event_id")).alias("pos"))


def _ecef(p: str, lat: str, lon: str) -> str:
    n = f"6378.137::DOUBLE/sqrt(1-(1/298.257223563::DOUBLE*(2-1/298.257223563::DOUBLE))*sin(radians({lat}))*sin(radians({lat})))"
    return f"{n}*cos(radians({lat}))*cos(radians({lon})) AS {p}x, {n}*cos(radians({lat}))*sin(radians({lon})) AS {p}y, {n}*(1-(1/298.257223563::DOUBLE*(2-1/298.257223563::DOUBLE)))*sin(radians({lat})) AS {p}z"


@query(
    "path_offsets",
    f"""WITH r AS (SELECT event_id, event_id%120-60+0.5::DOUBLE AS lat, event_id%360-180::DOUBLE AS lon, 0.0001::DOUBLE*(event_id%7+1) AS d FROM {{elements}}), v AS (SELECT event_id, {_ecef('p', 'lat', 'lon')}, {_ecef('q', '(lat+d)', '(lon+2*d)')}, {_ecef('t', '(lat-5*d)', '(lon+9*d)')} FROM r),
    s AS (SELECT *, qx-px AS sx, qy-py AS sy, qz-pz AS sz, tx-px AS ox, ty-py AS oy, tz-pz AS oz, sqrt(px*px+py*py+pz*pz) AS pn FROM v), u AS (SELECT *, sqrt(sx*sx+sy*sy+sz*sz) AS l FROM s)
    SELECT event_id, round((ox*(py*sz-pz*sy)+oy*(pz*sx-px*sz)+oz*(px*sy-py*sx))/(pn*l),5) AS across_km, round((ox*sx+oy*sy+oz*sz)/l,5) AS along_km, round((ox*sx+oy*sy+oz*sz)/l/(l/0.5::DOUBLE),5) AS dt_s, round(sqrt(ox*ox+oy*oy+oz*oz),5) AS away_km FROM u""",
)
def path_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of another program's path against ours at the same times."""
    k, d = F.col("event_id"), F.col("d")
    rows = table(spark, sf_dir, "elements").select(k, (k % 120 - 60 + num(0.5)).alias("lat"), (k % 360 - num(180)).alias("lon"), (0.0001 * (k % 7 + 1)).alias("d"))
    moved = rows.withColumns({"lat1": F.col("lat") + d, "lon1": F.col("lon") + 2 * d, "their_lat": F.col("lat") - 5 * d, "their_lon": F.col("lon") + 9 * d})
    return compare.path_offsets(moved).select("event_id", *[F.round(c, 5).alias(c) for c in ("across_km", "along_km", "dt_s", "away_km")])


@query("earlier_layout", "SELECT source_id, g AS g_mag, coalesce(pmra,0) AS pmra, 0::DOUBLE AS pm_error, 0 AS kind, '' AS note FROM {stars}")
def earlier_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars of an earlier layout in the present one."""
    old = table(spark, sf_dir, "stars").select("source_id", F.col("g").alias("g_mag"), F.coalesce("pmra", num(0)).alias("pmra"), F.lit(1).alias("gone"))
    return catalog.upgraded(old, "source_id bigint, g_mag double, pmra double, pm_error double, kind int, note string")


@query("event_facts", "SELECT e.event_id, CASE WHEN e.event_id%5=0 THEN 'dup' ELSE '' END AS flag, CASE WHEN e.event_id%4=0 THEN e.event_id%90-45::DOUBLE ELSE 0 END AS rv_kms, CAST(CASE WHEN e.number%3=0 AND e.number<=(SELECT max(p_partkey)+1 FROM part) THEN e.number%4 ELSE 0 END AS INTEGER) AS companions FROM {elements} e")
def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of an event's star and body, with defaults for what isn't."""
    e = table(spark, sf_dir, "elements")
    flags = e.where("event_id % 5 = 0").select("star", F.lit("dup").alias("flag"))
    velocities = e.where("event_id % 4 = 0").select("star", (F.col("event_id") % 90 - num(45)).alias("rv_kms"))
    binaries = table(spark, sf_dir, "asteroids").where("number % 3 = 0").select("number", (F.col("number") % 4).cast("int").alias("companions"))
    return catalog.with_facts(e.select("event_id", "star", "number"), flags, velocities, binaries).select("event_id", "flag", "rv_kms", "companions")


@query("candidates_order", f"SELECT number, source_id, j, CAST(row_number() OVER (PARTITION BY number ORDER BY et_guess, source_id, j) AS INTEGER) AS pos FROM ({paths.REFINED})")
def candidates_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each body's candidates by their estimated time, the order in which the exact search takes them."""
    done = paths.candidates_refined(spark, sf_dir)
    return done.select("number", "source_id", "j", F.row_number().over(W.partitionBy("number").orderBy("et_guess", "source_id", "j")).alias("pos"))


@query("newest_archive", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def newest_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several archive files in a folder the newest is read."""
    folder = files.scratch(spark, "archives")
    rows = base(spark, sf_dir, "nation").select(F.format_string("%d|%s", "n_nationkey", "n_name").alias("value"))
    for part in (rows.limit(3), rows):
        spark.createDataFrame([("id|name",)], "value string").unionByName(part).coalesce(1).write.mode("append").text(folder)
    return files.read_archive(spark, files.newest_file(spark, folder, "*.txt"), "id int, name string")


@query("header_facts", "SELECT site_id, CAST(site_id+100 AS VARCHAR) AS jpl, round(15*(site_id%24+site_id%60/60::DOUBLE+12.5::DOUBLE/3600),6) AS star_ra, round((CASE WHEN site_id%2=0 THEN -1 ELSE 1 END)*(site_id%80+30/60::DOUBLE+7.25::DOUBLE/3600),6) AS star_dec, site_id+0.5::DOUBLE AS dia_km FROM {sites}")
def header_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("site_id")
    made = F.format_string("Orbit JPL# %d\nRA = %d %d 12.5  Dec = %s%d 30 7.25, Dia = %d.5+-2 km", k + 100, k % 24, k % 60, F.when(k % 2 == 0, "-").otherwise(""), k % 80, k)
    sites = table(spark, sf_dir, "sites").select(made.alias("text"))
    found = files.header_facts(sites)
    return found.select((F.col("jpl").cast("bigint") - 100).alias("site_id"), "jpl", F.round("star_ra", 6).alias("star_ra"), F.round("star_dec", 6).alias("star_dec"), "dia_km")
