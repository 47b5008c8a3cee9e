"""Builds that go on where they stopped, records filled from other sources, tables and logs that say themselves how they are laid out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.sky import num
from umbra.operators import backfill, scan, tracks
from umbra.plans import paths
from umbra.plans.registry import query
from umbra.plans.tables import PATH, STEPS, base, frac, table
from umbra.sources import files
from umbra.streaming import increments


def samples_of(bodies: DataFrame) -> DataFrame:
    """Path samples of bodies (number)."""
    return bodies.select("number", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("j")).selectExpr(*[f"{e} AS {c}" for c, e in PATH.items()])


def screened(stars: DataFrame):
    """The pre-screen of some bodies: close passages of stars along their paths, refined."""

    def screen(bodies: DataFrame) -> DataFrame:
        near = scan.candidates(tracks.with_directions(samples_of(bodies)), stars, 4e6, 600, 2.0, 4.2e6)
        return near.select("number", "source_id", "j", F.round("et_guess", 1).alias("et_guess"))

    return screen


def stars_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "stars").select("source_id", F.col("ra").alias("star_ra"), F.col("dec").alias("star_dec"), "g")


@query("prescreen_build", f"SELECT number, source_id, j, et_guess FROM ({paths.REFINED})")
def prescreen_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bodies, screened in three batches of a stream, of which two hold some bodies twice."""
    out, source = files.scratch(spark, "build"), files.scratch(spark, "bodies")
    numbers = base(spark, sf_dir, "part").selectExpr("p_partkey + 1 AS number")
    for k in range(3):
        numbers.where(f"number % 3 = {k} OR number % 50 = {k}").coalesce(1).write.mode("append").parquet(source)
    increments.build(source, numbers.schema, out, f"{out}/checkpoint", screened(stars_of(spark, sf_dir)), {"margin_km": 4e6}, spark)
    return increments.events_of(spark, out).select("number", "source_id", "j", "et_guess")


@query(
    "double_check_routes",
    """WITH e AS (SELECT event_id, g AS mag, CASE WHEN event_id%5=0 THEN NULL ELSE 12+event_id%7 END AS g_max, event_id%11<>3 AS flags, event_id%13<>4 AS all_stars, event_id%17<>6 AS enabled FROM {elements})
    SELECT event_id, CASE WHEN NOT enabled THEN 'switched off' WHEN g_max IS NULL THEN 'no local catalog' WHEN flags AND all_stars AND mag+5<=g_max THEN 'covered by the local catalog' WHEN flags AND all_stars THEN 'neighbours beyond the local catalog' WHEN NOT flags THEN 'no flags in the local catalog' ELSE 'bad-quality stars are left out of the local catalog' END AS why,
    CASE WHEN NOT enabled OR (flags AND all_stars AND coalesce(mag+5<=g_max, false)) THEN 'local' ELSE 'archive' END AS route FROM e""",
)
def double_check_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    events = table(spark, sf_dir, "elements").select("event_id", F.col("g").alias("mag"))
    g_max = F.when(i % 5 != 0, 12 + i % 7)
    return backfill.routed(events, g_max, i % 11 != 3, i % 13 != 4, i % 17 != 6).select("event_id", "why", "route")


RECORDS = "(SELECT event_id, number, g AS mag, CASE WHEN event_id%9=0 THEN NULL ELSE m_ast END AS m_ast, CASE WHEN event_id%4=0 THEN 2.5::DOUBLE ELSE NULL END AS dist_au, CASE WHEN event_id%6=0 THEN 9.5::DOUBLE END AS m_combined, CASE WHEN event_id%3=0 THEN 33.0::DOUBLE END AS diameter, CASE WHEN event_id%8=0 THEN '12:00' WHEN event_id%8=1 THEN 'nan' ELSE '' END AS shadow_from, event_id%10 AS site FROM {elements})"


@query(
    "favorites_backfilled",
    f"""WITH r AS {RECORDS}, o AS (SELECT number, a FROM {{asteroids}} WHERE number%7<>2), p AS (SELECT number, diameter, h FROM {{asteroids}} WHERE number%5<>1), b AS (SELECT number, h FROM {{asteroids}}), k AS (SELECT event_id, '~' || CAST(event_id%24 AS VARCHAR) || ':30' AS mark FROM {{elements}} WHERE event_id%5<>0)
    SELECT r.event_id, round(coalesce(r.dist_au, o.a-1), 6) AS dist_au, CASE WHEN r.dist_au IS NOT NULL THEN 'own' WHEN o.a IS NOT NULL THEN 'orbit' END AS dist_au_from,
    round(coalesce(r.m_combined, CASE WHEN m_ast IS NOT NULL THEN -2.5::DOUBLE*log10(pow(10,-0.4::DOUBLE*mag)+pow(10,-0.4::DOUBLE*m_ast)) END, mag), 6) AS m_combined, CASE WHEN r.m_combined IS NOT NULL THEN 'own' ELSE 'record' END AS m_combined_from,
    round(coalesce(r.diameter, p.diameter, 1329/sqrt(0.14::DOUBLE)*pow(10,-0.2::DOUBLE*b.h)), 5) AS diameter, CASE WHEN r.diameter IS NOT NULL THEN 'own' WHEN p.diameter IS NOT NULL THEN 'phys' WHEN b.h IS NOT NULL THEN 'bulk' END AS diameter_from,
    CASE WHEN shadow_from='12:00' THEN shadow_from ELSE k.mark END AS shadow_from, CASE WHEN shadow_from='12:00' THEN 'own' WHEN k.mark IS NOT NULL THEN 'map' END AS shadow_from_from
    FROM r LEFT JOIN o USING (number) LEFT JOIN p USING (number) LEFT JOIN b USING (number) LEFT JOIN k ON k.event_id=r.event_id""",
)
def favorites_backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Favourites with blank fields: from the orbit, the physical data or the bulk list, the record itself, the stored map."""
    i = F.col("event_id")
    records = table(spark, sf_dir, "elements").select(
        "event_id", "number", F.col("g").alias("mag"), F.when(i % 9 != 0, F.col("m_ast")).alias("m_ast"), F.when(i % 4 == 0, 2.5).alias("dist_au"), F.when(i % 6 == 0, 9.5).alias("m_combined"), F.when(i % 3 == 0, 33.0).alias("diameter"),
        F.when(i % 8 == 0, "12:00").when(i % 8 == 1, "nan").otherwise("").alias("shadow_from"),
    )
    bodies, number = table(spark, sf_dir, "asteroids"), {"number": F.col("number")}
    marks = table(spark, sf_dir, "elements").where("event_id % 5 <> 0").select("event_id", F.concat(F.lit("~"), (i % 24).cast("string"), F.lit(":30")).alias("mark"))
    sources = {
        "orbit": backfill.Source(bodies.where("number % 7 <> 2").select("number", "a"), number),
        "phys": backfill.Source(bodies.where("number % 5 <> 1").select("number", "diameter"), number),
        "bulk": backfill.Source(bodies.select("number", "h"), number),
        "map": backfill.Source(marks, {"event_id": i}),
    }
    chains = {
        "dist_au": [("orbit", F.col("orbit.a") - 1)],
        "m_combined": [("record", backfill.combined_magnitude(F.col("mag"), F.col("m_ast")))],
        "diameter": [("phys", F.col("phys.diameter")), ("bulk", 1329 / F.sqrt(num(0.14)) * F.pow(num(10), -0.2 * F.col("bulk.h")))],
        "shadow_from": [("map", F.col("map.mark"))],
    }
    done = backfill.filled(records, sources, chains)
    digits = {"dist_au": 6, "m_combined": 6, "diameter": 5}
    return done.select("event_id", *[F.round(c, n).alias(c) for c, n in digits.items()], "shadow_from", *[f"{c}_from" for c in chains])


#: Name, width and type of the fields of a table of companions, in its order.
LABEL = (("AST_NUMBER", 9, "ASCII_Integer"), ("AST_NAME", 14, "ASCII_String"), ("PRIMARY_DIAMETER", 10, "ASCII_Real"), ("PERIOD", 12, "ASCII_Real"), ("NOTE", 6, "ASCII_String"))


@query(
    "labelled_rows",
    f"""SELECT CAST(number AS BIGINT) AS "AST_NUMBER", CASE WHEN number%4=1 THEN NULL ELSE 'body ' || CAST(number%1000 AS VARCHAR) END AS "AST_NAME", CASE WHEN number%3=0 THEN NULL ELSE round({frac('number', 0.37)}*900,3) END AS "PRIMARY_DIAMETER", CASE WHEN number%6=0 THEN NULL ELSE round({frac('number', 0.113)}*90,4) END AS "PERIOD" FROM {{asteroids}}""",
)
def labelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed-width table and its XML label, written, and read by what the label says; missing numbers are -9.99 or blank."""
    starts = [2 + sum(w + 1 for _, w, _ in LABEL[:k]) for k in range(len(LABEL))]
    fields = "".join(f"<Field_Character><name>{n}</name><field_number>{k + 1}</field_number><field_location unit=\"byte\">{a}</field_location><data_type>{t}</data_type><field_length unit=\"byte\">{w}</field_length></Field_Character>" for k, ((n, w, t), a) in enumerate(zip(LABEL, starts, strict=True)))
    n = F.col("number")
    text = {
        "AST_NUMBER": n.cast("string"),
        "AST_NAME": F.when(n % 4 != 1, F.concat(F.lit("body "), (n % 1000).cast("string"))).otherwise(""),
        "PRIMARY_DIAMETER": F.when(n % 3 != 0, F.format_string("%.3f", F.round(F.expr(frac("number", 0.37)) * 900, 3))).otherwise("-9.99"),
        "PERIOD": F.when(n % 6 != 0, F.format_string("%.4f", F.round(F.expr(frac("number", 0.113)) * 90, 4))).otherwise(""),
        "NOTE": F.lit("x"),
    }
    line = F.concat(F.lit(" "), F.concat_ws(" ", *[F.rpad(text[c], w, " ") for c, w, _ in LABEL]))
    path = files.scratch(spark, "labelled")
    table(spark, sf_dir, "asteroids").select(line.alias("value")).write.text(f"{path}/table")
    spark.createDataFrame([(f'<?xml version="1.0"?><Product><Table_Character><records>1</records><Record_Character>{fields}</Record_Character></Table_Character></Product>',)], "value string").coalesce(1).write.text(f"{path}/label")
    return files.read_labelled(spark, f"{path}/table", f"{path}/label", ["AST_NUMBER", "AST_NAME", "PRIMARY_DIAMETER", "PERIOD"], -9.9)


@query(
    "changing_log",
    """SELECT CAST(target_id AS VARCHAR) AS target_id, CASE WHEN id%3=0 THEN NULL ELSE kind || ', "seen"' END AS kind, CAST(id AS VARCHAR) AS id, n FROM {hits} CROSS JOIN (SELECT unnest(['1', '2']) AS n) WHERE id%3<>2 AND NOT (id%5=1 AND n='2')""",
)
def changing_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log whose headers change: without a column, in another order, with one more; rows of the wrong width are left out, and no row is read by
    another header than the last before it."""
    i, said = F.col("id"), F.concat(F.lit('"'), F.col("kind"), F.lit(', ""seen"""'))
    t, own = F.col("target_id").cast("string"), F.col("id").cast("string")
    row = lambda n: F.when(i % 3 == 0, F.concat_ws(",", t, F.lit(n), own)).when(i % 3 == 1, F.concat_ws(",", t, said, own, F.lit("more"), F.lit(n))).otherwise(F.concat_ws(",", t, own))
    header = F.when(i % 3 == 0, "target_id,n,id").when(i % 3 == 1, " target_id,kind, id,extra,n").otherwise("target_id,n,id,kind")
    second = F.when(i % 5 == 1, F.concat(row("2"), F.lit(",far,too,many"))).otherwise(row("2"))
    path = files.scratch(spark, "log")
    table(spark, sf_dir, "hits").select(F.concat_ws("\n", header, row("1"), F.lit("  "), second).alias("value")).write.text(path)
    return files.read_log(spark, path, ["target_id", "kind", "id", "n"])
