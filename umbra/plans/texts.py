"""Parsers and formatters, on strings made from the derived tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import earth, text
from umbra.functions.light import hypot
from umbra.functions.sky import num
from umbra.plans.registry import query
from umbra.plans.tables import base, table
from umbra.sources import files


@query("parse_dms", "SELECT site_id, round((CASE WHEN lat<0 THEN -1 ELSE 1 END)*floor(abs(lat)*36000+0.5::DOUBLE)/36000,6) AS lat FROM {sites}")
def parse_dms(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = table(spark, sf_dir, "sites").select("site_id", text.sexagesimal(F.col("lat"), 1).alias("t"))
    return shown.select("site_id", F.round(text.parsed_sexagesimal(F.col("t")), 6).alias("lat"))


@query("format_hms", "WITH u AS (SELECT source_id, CAST(floor(ra/15*360000+0.5::DOUBLE) AS BIGINT) AS u FROM {stars}) SELECT source_id, printf('%02d %02d %05.2f', u//360000, (u%360000)//6000, (u%6000)/100::DOUBLE) AS ra FROM u")
def format_hms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "stars").select("source_id", text.hours(F.col("ra")).alias("ra"))


@query("parse_coordinates", "SELECT site_id, round((CASE WHEN lat<0 THEN -1 ELSE 1 END)*CASE site_id%3 WHEN 0 THEN round(abs(lat),4) WHEN 1 THEN floor(abs(lat))+round((abs(lat)-floor(abs(lat)))*60,2)/60 ELSE floor(abs(lat)*3600+0.5::DOUBLE)/3600 END,5) AS lat, round((CASE WHEN lon<0 THEN -1 ELSE 1 END)*CASE site_id%3 WHEN 0 THEN round(abs(lon),4) WHEN 1 THEN floor(abs(lon))+round((abs(lon)-floor(abs(lon)))*60,2)/60 ELSE floor(abs(lon)*3600+0.5::DOUBLE)/3600 END,5) AS lon FROM {sites}")
def parse_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three notations: signed decimals, a hemisphere before degrees and minutes, and one behind degrees, minutes and seconds."""
    lat, lon = F.col("lat"), F.col("lon")
    side = lambda x, a, b: F.when(x < 0, b).otherwise(a)
    minutes = lambda x: F.format_string("%d°%.2f'", F.floor(F.abs(x)), F.round((F.abs(x) - F.floor(F.abs(x))) * 60, 2))
    units = lambda x: F.floor(F.abs(x) * 3600 + 0.5)
    seconds = lambda x: F.format_string("%d°%d'%d\"", F.floor(units(x) / 3600), F.floor(units(x) % 3600 / 60), units(x) % 60)
    shown = F.when(F.col("site_id") % 3 == 0, F.format_string("Lat: %.4f, Lon: %.4f", F.round(lat, 4), F.round(lon, 4)))
    shown = shown.when(F.col("site_id") % 3 == 1, F.concat(side(lat, "N ", "S "), minutes(lat), F.lit(" "), side(lon, "E ", "W "), minutes(lon)))
    shown = shown.otherwise(F.concat(seconds(lon), F.lit(" "), side(lon, "E", "W"), F.lit(", "), seconds(lat), F.lit(" "), side(lat, "N", "S")))
    found = text.coordinates(F.col("t"))
    return table(spark, sf_dir, "sites").select("site_id", shown.alias("t")).select("site_id", F.round(found["lat"], 5).alias("lat"), F.round(found["lon"], 5).alias("lon"))


LISTED = "SELECT site_id, lat, lon, floor(abs(lon)*3600+0.5::DOUBLE) AS a, floor(abs(lat)*3600+0.5::DOUBLE) AS b FROM {sites}"


@query("parse_listing", f"WITH u AS ({LISTED}) SELECT round((CASE WHEN lon<0 THEN -1 ELSE 1 END)*a/3600,6) AS lon, round((CASE WHEN lat<0 THEN -1 ELSE 1 END)*b/3600,6) AS lat, CAST(36000+60*(site_id%60)+5.5::DOUBLE AS DOUBLE) AS second, 30::DOUBLE AS star_alt, CAST(site_id%360 AS DOUBLE) AS star_az, -20::DOUBLE AS sun_alt FROM u")
def parse_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = lambda x: F.format_string("%s%d %d %d", F.when(x < 0, "-").otherwise(""), F.floor(F.floor(F.abs(x) * 3600 + 0.5) / 3600), F.floor(F.floor(F.abs(x) * 3600 + 0.5) % 3600 / 60), F.floor(F.abs(x) * 3600 + 0.5) % 60)
    row = F.concat_ws(" ", parts(F.col("lon")), parts(F.col("lat")), F.format_string("10 %d 5.5 30 %d -20", F.col("site_id") % 60, F.col("site_id") % 360), F.lit("1 2 3 4 5 6 7 8 9"))
    lines = table(spark, sf_dir, "sites").select(row.alias("value")).unionByName(spark.range(1).select(F.lit("Longitude Latitude U.T.").alias("value")))
    found = files.read_listing(lines)
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query("parse_reference_list", "SELECT p_partkey+1 AS number, trim(p_name) AS name, '2026-03-0'||(p_size%9+1)||'T0'||(p_size%10)||':15:30' AS utc, CASE WHEN p_partkey%4=0 THEN -5::DOUBLE END AS sun_alt, 12.5::DOUBLE AS mag, 3.1::DOUBLE AS drop, 4.2::DOUBLE AS duration, CAST(p_size AS DOUBLE) AS altitude FROM part")
def parse_reference_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = base(spark, sf_dir, "part")
    sun = F.when(F.col("p_partkey") % 4 == 0, F.lit(" ☼ -5°")).otherwise(F.lit(""))
    row = F.concat(F.format_string("(%d) %s\t2026-Mar-0%d, 0%d:15:30", F.col("p_partkey") + 1, "p_name", F.col("p_size") % 9 + 1, F.col("p_size") % 10), sun, F.format_string("\t 12.5\t 3.1\t 4.2\t %d", "p_size"))
    found = files.read_list(p.select(row.alias("text")))
    return found.drop("pos")


@query("clean_names", "SELECT p_partkey, 'Body '||p_partkey AS name, '('||p_partkey||') Body '||p_partkey AS label, 'Body_'||p_partkey||'_x' AS file FROM part")
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("Body "), F.col("p_partkey").cast("string"))
    tagged = F.concat(raw, F.when(F.col("p_partkey") % 2 == 0, " NALowMagMDSurvey").otherwise(" IBEROC"))
    return base(spark, sf_dir, "part").select("p_partkey", text.without_tags(tagged).alias("name"), text.body_label(F.col("p_partkey"), raw).alias("label"), text.file_id(F.concat(raw, F.lit("?#x"))).alias("file"))


@query("clock_text", "SELECT event_id, strftime(make_timestamp(CAST((946684800+floor(et-69.184::DOUBLE+43200+0.5::DOUBLE))*1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS utc, round(2451545+et/86400,6) AS jd FROM {elements}")
def clock_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "elements").select("event_id", text.clock(F.col("et")).alias("utc"), F.round(2451545.0 + F.col("et") / 86400.0, 6).alias("jd"))


@query("twilight_notes", "SELECT site_id, CASE WHEN lat>-6 THEN 'civil' WHEN lat>-12 THEN 'nautical' WHEN lat>-18 THEN 'astronomical' ELSE '' END AS twilight, CASE site_id%5 WHEN 1 THEN printf('RUWE %.2f', 1.4::DOUBLE+site_id/100::DOUBLE) WHEN 2 THEN 'no proper motion' WHEN 3 THEN 'motion from catalog A' WHEN 4 THEN 'motion from catalog B' ELSE '' END AS note FROM {sites}")
def twilight_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sites").select("site_id", text.twilight(F.col("lat")).alias("twilight"), text.star_note(F.col("site_id") % 5, 1.4 + F.col("site_id") / num(100)).alias("note"))


@query("markdown_rows", "SELECT run_id, '| id | kind |'||chr(10)||'| --- | --- |'||chr(10)||string_agg('| '||id||' | '||kind||' |', chr(10) ORDER BY id) AS markdown FROM {hits} GROUP BY run_id")
def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's table as text: one string for each run, whose hits come together in it."""
    rows = table(spark, sf_dir, "hits").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("id", text.table_row(F.col("id"), F.col("kind")).alias("row")))).alias("rows"))
    return rows.select("run_id", F.concat(F.lit("| id | kind |\n| --- | --- |\n"), F.array_join(F.transform("rows", lambda r: r["row"]), "\n")).alias("markdown"))


E2 = "(1/298.257223563::DOUBLE*(2-1/298.257223563::DOUBLE))"
#: Characters of the longest code, and of a longitude with all its digits: it is shown to three places, and rounded once only.
CODE, LON = 19, 18
#: Latitudes from the constants as the file has them, by iteration.
OBSERVATORY = f"""WITH g AS (SELECT site_id, lon, radians(lat) AS f, ele_m/6378137::DOUBLE AS h, 1/sqrt(1-{E2}*sin(radians(lat))*sin(radians(lat))) AS n FROM {{sites}}),
    c AS (SELECT site_id, lon, CAST(printf('%.6f', (n+h)*cos(f)) AS DOUBLE) AS rc, CAST(printf('%.6f', (n*(1-{E2})+h)*sin(f)) AS DOUBLE) AS rs FROM g),
    i AS (SELECT *, list_reduce(range(12), lambda t, k: atan2(rs+{E2}*sin(t)/sqrt(1-{E2}*sin(t)*sin(t)), rc), atan2(rs, rc)) AS t FROM (SELECT * FROM c))
    SELECT printf('%03d', site_id) AS code, round(degrees(t),3) AS lat, round(CASE WHEN lon < 0 THEN lon+360 ELSE lon END,3) AS lon FROM i"""


@query("observatory_rows", OBSERVATORY)
def observatory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-width observatory codes, written and read again, with geodetic latitude from the parallax constants; longitudes count eastward. A code
    has three digits or more, up to a bigint's, and longitudes keep their digits, so the fields are wider than in the files of others."""
    v = earth.earth_fixed(F.col("lat"), F.col("lon"), F.col("ele_m"))
    line = F.concat(F.rpad(F.format_string("%03d", "site_id"), CODE, " "), F.format_string(f" %{LON}.14f", F.when(F.col("lon") < 0, F.col("lon") + 360.0).otherwise(F.col("lon"))), F.format_string("%8.6f%+9.6f", hypot(v.x, v.y) / earth.EARTH_KM, v.z / earth.EARTH_KM), F.concat(F.lit("Site "), F.col("site_id").cast("string")))
    path = files.scratch(spark, "observatories")
    table(spark, sf_dir, "sites").select(line.alias("value")).write.text(path)
    read = files.read_fixed(spark, path, files.observatories(CODE, LON))
    lat, _ = earth.geodetic(F.col("rho_cos"), F.col("rho_sin"))
    return read.select("code", F.round(lat, 3).alias("lat"), F.round("lon", 3).alias("lon"))
