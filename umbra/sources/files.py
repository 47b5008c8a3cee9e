"""Files that come in and go out: catalogs, archives, logs, listings, maps and exports."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG = "source_id bigint, ra double, dec double, parallax double, pmra double, pmdec double, phot_g_mean_mag double, ruwe double"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or, in a local session without it, a temporary one that goes when the process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="umbra-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
    return f"{root.rstrip('/')}/umbra/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_catalog(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Catalog files: gzip CSV with # comments and `null`; only the named columns are parsed. The header names all columns of a file."""
    known = T.StructType.fromDDL(CATALOG)
    return spark.read.csv(path, header=True, comment="#", nullValue="null", schema=known, enforceSchema=False).select(*columns)


def write_catalog(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, nullValue="null", compression="gzip", mode="overwrite")


def read_archive(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Archive tables with bars between their columns."""
    return spark.read.csv(path, sep="|", header=True, schema=schema, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue="")


def read_fixed(spark: SparkSession, path: str, layout: dict[str, tuple[int, int, str]]) -> DataFrame:
    """Fixed-width rows: name -> (first character from 1, width, type). What doesn't parse is null; blank fields are null."""
    field = lambda a, n: F.trim(F.substring("value", a, n))
    return spark.read.text(path).where(F.trim("value") != "").select(*[(F.when(field(a, n) != "", field(a, n)) if t == "string" else field(a, n).try_cast(t)).alias(c) for c, (a, n, t) in layout.items()])


#: Observatory codes: code, longitude, parallax constants, name.
OBSERVATORIES = {"code": (1, 3, "string"), "lon": (5, 9, "double"), "rho_cos": (14, 8, "double"), "rho_sin": (22, 9, "double"), "name": (31, 80, "string")}


def observatories(code: int, lon: int) -> dict[str, tuple[int, int, str]]:
    """The layout of observatory codes for tables with longer codes and finer longitudes, of so many characters: the other fields move along."""
    wide, moved = {"code": code, "lon": lon}, {"code": 0, "lon": code - 3}
    return {c: (a + moved.get(c, code - 3 + lon - 9), wide.get(c, n), t) for c, (a, n, t) in OBSERVATORIES.items()}


def labelled_layout(spark: SparkSession, label: str) -> dict[str, tuple[int, int, str]]:
    """A fixed-width table's layout from its XML label: each `Field_Character` has a name, its first character, its length and a type."""
    types = {"integer": "bigint", "real": "double"}
    field = lambda tag: F.expr(f"xpath(value, '//Field_Character/{tag}/text()')")
    label_text = spark.read.text(label, wholetext=True)
    row = label_text.select(*[F.transform(field(t), lambda x: F.trim(x)).alias(n) for t, n in (("name", "names"), ("field_location", "places"), ("field_length", "widths"), ("data_type", "types"))]).first()
    if row is None or not row.names or len({len(x) for x in row}) != 1:
        raise ValueError(f"{label} doesn't give each field a name, place, length and type")
    kind = lambda t: next((v for k, v in types.items() if k in t.lower()), "string")
    return {n: (int(a), int(w), kind(t)) for n, a, w, t in zip(row.names, row.places, row.widths, row.types, strict=True)}


def read_labelled(spark: SparkSession, path: str, label: str, columns: list[str], missing: float | None = None) -> DataFrame:
    """Named columns of a fixed-width table whose layout stands in a label. Numbers not above `missing` (-9.9 for tables that write -9.99 and the like)
    are null."""
    layout = labelled_layout(spark, label)
    unknown = [c for c in columns if c not in layout]
    if unknown:
        raise ValueError(f"{label} has no field {', '.join(unknown)}")
    rows = read_fixed(spark, path, {c: layout[c] for c in columns})
    return rows if missing is None else rows.select(*[F.when(F.col(c) > missing, F.col(c)).alias(c) if layout[c][2] == "double" else F.col(c) for c in columns])


#: Lines of a log that one window holds at most.
LOG_LINES = 65536


def log_lines(spark: SparkSession, path: str, first: str, most: int = LOG_LINES) -> DataFrame:
    """(header, fields, ok): the rows of a log that runs have appended to, each with the header that stands before it in its file. A line whose first
    field is `first` is a header; columns may come and go from one to the next. ok: there is a header, and the row is as wide. Blank lines are
    none; byte-order marks are dropped.

    Lines keep their order within a split of a file, and a split is cut into pieces of `most` lines; a piece that begins without a header takes the last one
    of the pieces before. So windows are as long as a piece, and one row for each piece goes through the other one.
    """
    read = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    pieces = F.regexp_extract_all(F.concat("line", F.lit(",")), F.lit(r'((?:"(?:[^"]++|"")*+"|[^,]*+)),'), F.lit(1))
    plain = F.transform(pieces, lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    rows = read.where(F.trim("line") != "").select("file", "block", F.floor(F.col("id") / most).alias("piece"), "id", plain.alias("fields"))
    is_header = F.trim(F.get("fields", F.lit(0))) == first
    marked = rows.withColumn("own", F.when(is_header, F.transform("fields", lambda x: F.trim(x))))
    piece = ["file", "block", "piece"]
    here = marked.withColumn("seen", F.last("own", ignorenulls=True).over(W.partitionBy(*piece).orderBy("id")))
    ends = marked.groupBy(*piece).agg(F.max(F.when(F.col("own").isNotNull(), F.struct("id", "own"))).alias("end"))
    before = ends.withColumn("carried", F.last("end.own", ignorenulls=True).over(W.partitionBy("file").orderBy("block", "piece").rowsBetween(W.unboundedPreceding, -1)))
    joined = here.join(before.select(*piece, "carried"), piece).where(F.col("own").isNull()).withColumn("header", F.coalesce("seen", "carried"))
    return joined.select("header", "fields", F.coalesce(F.size("header") == F.size("fields"), F.lit(False)).alias("ok"))


def read_log(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of a log's rows, by the header before each row (see `log_lines`); one that it lacks is null. The first of the columns starts
    headers. Rows without a header or of another width are left out."""
    rows = log_lines(spark, path, columns[0]).where("ok")
    at = lambda c: F.try_element_at("fields", F.nullif(F.array_position("header", c), F.lit(0).cast("bigint")).cast("int"))
    return rows.select(*[at(c).alias(c) for c in columns])


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Run summaries, one JSON object a line; broken lines are left out."""
    parsed = spark.read.text(path).select(F.from_json("value", schema).alias("r"), "value")
    return parsed.where(F.get_json_object("value", "$").isNotNull() & F.col("r").isNotNull()).select("r.*")


def read_list(text: DataFrame) -> DataFrame:
    """Events of comparison lists pasted as text (column `text`), one a line: pos, number, name, utc, sun_alt, mag, drop, duration, altitude.

    A line's fields stand between tabs: `(number) name`, `date, time` with the Sun's altitude behind a sun sign if it's up enough, then
    four numbers. Lines with fewer fields, without a number in brackets or without a date are no events.
    """
    lines = text.select(F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    fields = lines.select("pos", F.transform(F.split("line", "\t"), lambda x: F.trim(x)).alias("f")).where(F.size("f") >= 6)
    f = lambda k: F.get("f", F.lit(k))
    body, when, sun = F.split(f(0), r"\)", 2), F.split(f(1), "☼", 2), F.lit("°")
    opened = F.substring_index(F.get(body, F.lit(0)), "(", -1)
    moment = F.try_to_timestamp(F.concat_ws(" ", F.transform(F.split(F.get(when, F.lit(0)), ","), lambda x: F.trim(x))), F.lit("yyyy-MMM-dd HH:mm:ss"))
    number = lambda x: x.try_cast("double")
    rows = fields.select(
        "pos",
        opened.try_cast("bigint").alias("number"),
        F.trim(F.get(body, F.lit(1))).alias("name"),
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss").alias("utc"),
        number(F.trim(F.replace(F.get(when, F.lit(1)), sun))).alias("sun_alt"),
        *[number(f(k)).alias(c) for k, c in enumerate(("mag", "drop", "duration"), 2)],
        number(F.substring_index(f(5), " ", 1)).alias("altitude"),
    )
    return rows.where(F.col("number").isNotNull() & F.col("utc").isNotNull())


#: What a list's search line says by name, and what is taken where it says nothing. Fixed values.
LIST_DEFAULTS = {"starmag": 15.0, "mindur": 0.4, "aperture": 25.0, "detectionframes": 4.0, "minstaraltitude": 10.0, "km from shadow": 20.0}


def list_settings(text: DataFrame) -> DataFrame:
    """The search that a comparison list (column `text`) came from: one column for each entry of LIST_DEFAULTS. The line that tells of the
    filter holds `Name: number` pairs and `number km from shadow`."""
    line = F.get(F.filter(F.split("text", "\n"), lambda x: F.lower(x).contains("results for filter")), F.lit(0))
    word = lambda x, k: F.element_at(F.split(F.trim(x), r"[\s,;|]+"), k)
    parts = F.filter(F.split(F.lower(line), "[,;|]"), lambda x: x.contains(":"))
    pairs = F.transform(parts, lambda x: F.struct(word(F.substring_index(x, ":", 1), -1).alias("name"), word(F.substring_index(x, ":", -1), 1).try_cast("double").alias("value")))
    far = F.when(F.lower(line).contains("km from shadow"), word(F.substring_index(F.lower(line), "km from shadow", 1), -1).try_cast("double"))
    said = text.select(pairs.alias("pairs"), far.alias("far"))
    named = lambda k: F.get(F.filter("pairs", lambda p: p["name"] == k), F.lit(0))["value"]
    return said.select(*[F.coalesce(F.col("far") if k == "km from shadow" else named(k), F.lit(v)).alias(k.replace(" ", "_")) for k, v in LIST_DEFAULTS.items()])


def read_listing(lines: DataFrame) -> DataFrame:
    """Rows of a path listing (column `value`) with at least twenty tokens: longitude and latitude in degrees, seconds of the day, star
    altitude and azimuth, Sun altitude. A minus that runs into the number before it is set apart first."""
    tokens = F.split(F.trim(F.regexp_replace("value", r"(?<=\d)-", " -")), r"\s+")
    t = lambda k: F.get("t", F.lit(k))
    v = lambda k: t(k).try_cast("double")
    angle = lambda k: F.when(t(k).startswith("-"), -1.0).otherwise(1.0) * (F.abs(v(k)) + v(k + 1) / 60 + v(k + 2) / 3600)
    rows = lines.select(tokens.alias("t")).where((F.size("t") >= 20) & v(0).isNotNull() & v(8).isNotNull())
    return rows.select(angle(0).alias("lon"), angle(3).alias("lat"), (v(6) * 3600 + v(7) * 60 + v(8)).alias("second"), v(9).alias("star_alt"), v(10).alias("star_az"), v(11).alias("sun_alt"))


def kml_of(points: DataFrame, by: list[str], line: str, order: str, every: int = 10) -> DataFrame:
    """(by…, kml): a document for each group with a path for each line and a tick at every tenth point of the first one.

    A group is one event's path, of a few hundred points.
    """
    at = F.format_string("%.5f,%.5f,0", "lon", "lat")
    lines = points.groupBy(*by, line).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), at.alias("p")))).alias("ps"))
    place = F.concat(F.lit("<Placemark><name>"), F.replace(F.replace(F.col(line), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</name><LineString><coordinates>"), F.array_join(F.transform("ps", lambda p: p["p"]), " "), F.lit("</coordinates></LineString></Placemark>"))
    ticks = F.transform(F.filter("ps", lambda p, i: i % every == 0), lambda p: F.concat(F.lit("<Placemark><Point><coordinates>"), p["p"], F.lit("</coordinates></Point></Placemark>")))
    parts = lines.select(*by, F.struct(F.col(line).alias("line"), place.alias("place"), F.array_join(ticks, "").alias("ticks")).alias("part"))
    whole = parts.groupBy(*by).agg(F.array_sort(F.collect_list("part")).alias("all"))
    body = F.concat(F.array_join(F.transform("all", lambda p: p["place"]), ""), F.get("all", F.lit(0))["ticks"])
    return whole.select(*by, F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'), body, F.lit("</Document></kml>")).alias("kml"))


def read_kml(documents: DataFrame) -> DataFrame:
    """From documents (column `kml` and others) to points: the other columns, line, k, lon, lat. Ticks are left out."""
    others = [c for c in documents.columns if c != "kml"]
    pattern = r"<Placemark><name>([^<]*)</name><LineString><coordinates>([^<]*)</coordinates>"
    found = documents.select(*others, F.explode(F.regexp_extract_all("kml", F.lit(pattern), F.lit(0))).alias("m"))
    name = F.replace(F.replace(F.regexp_extract("m", pattern, 1), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))
    points = found.select(*others, name.alias("line"), F.posexplode(F.split(F.trim(F.regexp_extract("m", pattern, 2)), r"\s+")).alias("k", "p"))
    return points.select(*others, "line", "k", F.split("p", ",")[0].cast("double").alias("lon"), F.split("p", ",")[1].cast("double").alias("lat"))


def export_columns(df: DataFrame, spec: list[tuple[str, str | Callable[[DataFrame], Column]]]) -> DataFrame:
    """Columns of an export by (heading, source): a column's name as shown, `raw:name` as it is, `*` for all others, or a function of the
    table that gives a column, which may be a user's own UDF. Nothing stands for null and NaN."""
    used = {s.removeprefix("raw:") for _, s in spec if isinstance(s, str)}
    out: list[Column] = []
    for heading, s in spec:
        if callable(s):
            out.append(s(df).alias(heading))
        elif s == "*":
            out += [F.col(f"`{c}`") for c in df.columns if c not in used]
        elif s.startswith("raw:"):
            out.append(F.col(f"`{s[4:]}`").alias(heading))
        else:
            kind = df.schema[s].dataType
            c = F.round(f"`{s}`", 3) if isinstance(kind, T.DoubleType) else F.col(f"`{s}`")
            out.append(F.when(F.isnan(c), "").otherwise(F.coalesce(c.cast("string"), F.lit(""))).alias(heading) if isinstance(kind, T.DoubleType) else F.coalesce(c.cast("string"), F.lit("")).alias(heading))
    return df.select(*out)


def write_export(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, mode="overwrite", emptyValue="")


def write_lines(df: DataFrame, path: str) -> None:
    df.write.json(path, mode="overwrite", ignoreNullFields=False)


def newest_file(spark: SparkSession, folder: str, pattern: str = "*") -> str:
    """The path of the file in a folder that was changed last; of several, the last by name. Contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    row = found.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()
    if row is None or row.path is None:
        raise FileNotFoundError(f"no file {pattern} in {folder}")
    return row.path


def stored_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """(part, files, bytes) of a table's folder: what each directory of it takes. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    inner = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    return found.groupBy(inner.alias("part")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def header_facts(text: DataFrame) -> DataFrame:
    """What a plot's header (column `text`) says: jpl, the orbit's number behind `JPL#`; star_ra and star_dec in degrees, each three numbers behind its
    name; dia_km behind `Dia`. Null where it says nothing."""
    words = F.filter(F.split(F.regexp_replace("text", "[=,;]", " "), r"\s+"), lambda w: w != "")
    rows = text.select(words.alias("w"))
    behind = lambda name, k: F.when(F.array_position("w", name) > 0, F.try_element_at("w", (F.array_position("w", name) + k).cast("int")))
    number = lambda name, k: behind(name, k).try_cast("double")
    parts = lambda name: F.abs(number(name, 1)) + number(name, 2) / 60.0 + number(name, 3) / 3600.0
    tag = F.get(F.filter("w", lambda w: w.startswith("JPL#")), F.lit(0))
    jpl = F.coalesce(F.nullif(F.substring_index(tag, "#", -1), F.lit("")), F.when(tag == "JPL#", behind("JPL#", 1)))
    return rows.select(jpl.alias("jpl"), (15.0 * parts("RA")).alias("star_ra"), (F.when(behind("Dec", 1).startswith("-"), -1.0).otherwise(1.0) * parts("Dec")).alias("star_dec"), F.regexp_replace(behind("Dia", 1), "[^0-9.].*$", "").try_cast("double").alias("dia_km"))


def targets_text(picks: DataFrame) -> DataFrame:
    """(pick, text): each pick's targets as a file that Python can import: a line that names window and site, the numbers in order with what is expected behind
    each, and their names. Rows: pick, site, start (date), days, pos, number, name, note. A pick has as many targets as were asked for."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    rows = picks.groupBy("pick", "site", "start", "days").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("number").cast("string").alias("number"), "name", "note"))).alias("all"))
    head = F.concat(F.lit("# events "), F.col("start").cast("string"), F.lit(" + "), F.col("days").cast("string"), F.lit(" d, site "), F.col("site"), F.lit(", best first\n\n"))
    numbers = F.array_join(F.transform("all", lambda x: F.concat(F.lit("    "), quoted(x["number"]), F.lit(",  # "), F.replace(x["note"], F.lit("\n"), F.lit(" ")), F.lit("\n"))), "")
    names = F.array_join(F.transform("all", lambda x: F.concat(F.lit("    "), quoted(x["number"]), F.lit(": "), quoted(x["name"]), F.lit(",\n"))), "")
    return rows.select("pick", F.concat(head, F.lit("targets = [\n"), numbers, F.lit("]\n\ntarget_names = {\n"), names, F.lit("}\n")).alias("text"))


def read_targets(text: DataFrame) -> DataFrame:
    """Files of targets (columns of `text` and `text`): site, start, days, pos, number, name of each; a file without a line that names its window has no rows.
    A target without a name has a null one."""
    keep = [c for c in text.columns if c != "text"]
    window = r"(?m)^# events (\d{4}-\d\d-\d\d) \+ ([0-9.]+) d, site ([^,\n]*)"
    part = lambda k: F.regexp_extract("text", window, k)
    body = F.substring_index(F.substring_index("text", "targets = [", -1), "]\n", 1)
    numbers = F.regexp_extract_all(body, F.lit(r"(?m)^\s*'([^'\n]*)',"), F.lit(1))
    name = lambda k: F.regexp_extract_all("text", F.lit(r"(?m)^\s*'([^'\n]*)': '((?:[^'\\\n]|\\.)*)',$"), F.lit(k))
    # Numbers and names as rows of their own, which meet by file and number: a map of all names on each number's row would make a file's rows as wide as the file.
    listed = F.transform(numbers, lambda x, i: F.struct(i.alias("pos"), x.alias("number"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("name")))
    called = F.transform(F.arrays_zip(name(1).alias("a"), name(2).alias("b")), lambda x, i: F.struct(F.lit(None).cast("int").alias("pos"), x["a"].alias("number"), i.alias("at"), F.regexp_replace(x["b"], r"\\(.)", "$1").alias("name")))
    # What stands once in a file is worked out before its rows unfold, so no row carries the text.
    head = text.where(part(1) != "").select(*keep, F.trim(part(3)).alias("site"), part(1).cast("date").alias("start"), part(2).cast("double").alias("days"), F.sha2("text", 256).alias("__file"), F.concat(listed, called).alias("__all"))
    rows = head.select(*keep, "site", "start", "days", "__file", F.explode("__all").alias("__r")).select(*keep, "site", "start", "days", "__file", "__r.*")
    # Of several names of one number the last; files of the same text and columns name alike.
    last = F.max(F.when(F.col("at").isNotNull(), F.struct("at", "name"))).over(W.partitionBy(*keep, "__file", "number"))
    named = rows.withColumn("__last", last).where("pos IS NOT NULL")
    return named.select(*keep, "site", "start", "days", "pos", "number", F.col("__last.name").alias("name"))


def save_picks(picks: DataFrame, path: str) -> None:
    """Adds picks to a store by site and window. A pick of the same site and window is replaced, the others stay."""
    picks.write.partitionBy("site", "start", "days").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
