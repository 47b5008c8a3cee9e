"""Building and reading the star catalog, and keeping caches of bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.functions import light, sky
from umbra.functions.constants import FAST_MAS_YR, KIND_MAIN, KIND_RUWE, KIND_TWO, KIND_TWO_A, RUWE_GOOD
from umbra.functions.sky import num
from umbra.operators.cells import cell_join, size_for

MISSING_MAG = 65535


def admitted(raw: DataFrame, g_max: float) -> DataFrame:
    """Stars with a position and G up to the limit. Adds kind: two parameters without motion or parallax, high or unknown RUWE, or
    neither."""
    ruwe = F.when(F.isnan("ruwe"), None).otherwise(F.col("ruwe"))
    kind = F.when(F.col("pmra").isNull() | F.col("parallax").isNull(), KIND_TWO).when(ruwe < RUWE_GOOD, KIND_MAIN).otherwise(KIND_RUWE)
    return raw.where((F.col("g") <= g_max) & F.col("ra").isNotNull() & F.col("dec").isNotNull()).withColumn("kind", kind)


def encoded(stars: DataFrame) -> DataFrame:
    """Adds the stored form: cell, offsets in it, and magnitude in millimag with a sentinel for a missing one."""
    mmag = F.when(F.col("g").isNull(), F.lit(MISSING_MAG)).otherwise(F.least(F.greatest(F.floor(F.col("g") * 1000 + 0.5), F.lit(0)), F.lit(MISSING_MAG - 1)))
    return stars.withColumns({"cell": sky.cell_of(F.col("ra"), F.col("dec")), "ra_off": sky.cell_offset(F.col("ra")), "dec_off": sky.cell_offset(F.col("dec") + 90.0), "mmag": mmag.cast("int")})


def decoded_mag(mmag: Column) -> Column:
    return F.when(mmag != MISSING_MAG, mmag / 1000.0)


def offsets(stars: DataFrame) -> DataFrame:
    """(cell, n, first_row): stars in each cell, and how many lie in cells before it."""
    counts = stars.groupBy("cell").agg(F.count("*").alias("n"))
    # One row a cell, so the one task that sums them up has a fixed bound: the number of cells.
    before = W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("first_row", F.coalesce(F.sum("n").over(before), F.lit(0)))


def ranked(stars: DataFrame) -> DataFrame:
    """Adds rank, the place within the cell by (G, source_id)."""
    return stars.withColumn("rank", F.row_number().over(W.partitionBy("cell").orderBy("g", "source_id")))


def write(stars: DataFrame, path: str, band_cells: int = 20 * 1440) -> None:
    """The catalog on disk: directories by band of cells, files sorted by (cell, G, id), so a scan with a magnitude cap skips the
    faint row groups of each band."""
    banded = stars.withColumn("band", F.floor(F.col("cell") / band_cells).cast("int"))
    banded.repartitionByRange("band", "cell").sortWithinPartitions("band", "cell", "g", "source_id").write.mode("overwrite").partitionBy("band").parquet(path)


def bright(stars: DataFrame, cells: DataFrame, cap: float) -> DataFrame:
    """Stars of given cells up to a magnitude: what a prefix scan of each sorted cell gives."""
    return stars.where(F.col("g") <= cap).join(cells.select("cell").distinct(), "cell", "left_semi")


def fast(stars: DataFrame) -> DataFrame:
    return stars.where(F.sqrt(F.col("pmra") ** 2 + F.col("pmdec") ** 2) > FAST_MAS_YR)


def first_wins(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both; where a key is in both, the first one's. Within a side the smallest row of a key."""
    both = first.withColumn("__side", F.lit(0)).unionByName(second.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "__side"]
    return both.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct("__side", *columns)).alias("r")).select("r.*")


def matched(ours: DataFrame, theirs: DataFrame, radius_arcsec: float, accept: Column) -> DataFrame:
    """The nearest acceptable partner of each of our stars: (source_id, other_id, sep). Ties go to the smaller id.

    `theirs` has other_id, other_ra, other_dec and what `accept` needs.
    """
    pairs = cell_join(ours, theirs, radius_arcsec / 3600.0 * 1.001, size_for(radius_arcsec / 3600.0), right_at=("other_ra", "other_dec"))
    near = pairs.withColumn("sep", sky.separation(F.col("ra"), F.col("dec"), F.col("other_ra"), F.col("other_dec"))).where((F.col("sep") <= radius_arcsec) & accept)
    return near.groupBy("source_id").agg(F.min(F.struct("sep", "other_id")).alias("m")).select("source_id", "m.other_id", "m.sep")


def companions(events: DataFrame, stars: DataFrame, years: float, radius_arcsec: float, fainter: float = 5.0) -> DataFrame:
    """Neighbours of event stars at the event's epoch: the events' columns and `companions`, array of (sep, g, source_id), closest first.

    `events` has source_id, ra, dec, g; events without neighbours have an empty array.
    """
    a, d = sky.moved(F.col("ra"), F.col("dec"), F.col("pmra"), F.col("pmdec"), years)
    there = stars.where("g IS NOT NULL").select(F.col("source_id").alias("other_id"), a.alias("other_ra"), d.alias("other_dec"), F.col("g").alias("other_g"))
    near = cell_join(events, there, radius_arcsec / 3600.0 * 1.001, size_for(radius_arcsec / 3600.0), right_at=("other_ra", "other_dec"))
    sep = sky.separation(F.col("ra"), F.col("dec"), F.col("other_ra"), F.col("other_dec"))
    kept = near.withColumn("sep", sep).where((F.col("sep") <= radius_arcsec) & (F.col("other_id") != F.col("source_id")) & (F.col("other_g") <= F.col("g") + fainter))
    lists = kept.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct(F.col("sep"), F.col("other_g").alias("g"), F.col("other_id").alias("source_id")))).alias("companions"))
    none = F.array().cast("array<struct<sep:double,g:double,source_id:bigint>>")
    return events.join(lists, "source_id", "left").withColumn("companions", F.coalesce("companions", none))


def companion_light(events: DataFrame, stars: DataFrame, years: float, radius_arcsec: float, fainter: float = 5.0) -> DataFrame:
    """The events' columns and what `companions` sums up to: n, nearest (arcseconds), near_g, light (the sum of tens to the power of -0.4 g); without
    neighbours 0, null, null, 0. Of neighbours equally near, any one's near_g.

    Pairs grow with the square of the stars' density, so none is kept: they are added up where they are joined, in fixed-width sums, and what is shuffled
    is a few rows for each event. Cells are twice as wide as for a join whose pairs go on, so that an event stands in about four.
    """
    a, d = sky.moved(F.col("ra"), F.col("dec"), F.col("pmra"), F.col("pmdec"), years)
    there = stars.where("g IS NOT NULL").select(F.col("source_id").alias("other_id"), a.alias("other_ra"), d.alias("other_dec"), F.col("g").alias("other_g"), light.ten(-0.4 * F.col("g")).alias("__light"))
    u = dict(zip(("ux", "uy", "uz"), sky.direction(F.col("ra"), F.col("dec")), strict=True))
    here = events.select("source_id", "ra", "dec", "g", *[c.alias(n) for n, c in u.items()])
    near = cell_join(here, there, radius_arcsec / 3600.0, size_for(2 * radius_arcsec / 3600.0), right_at=("other_ra", "other_dec"), left_u=tuple(u), right_u=("vx", "vy", "vz"))
    kept = near.where((F.col("other_id") != F.col("source_id")) & (F.col("other_g") <= F.col("g") + fainter))
    gap = sum(((F.col(f"u{c}") - F.col(f"v{c}")) * (F.col(f"u{c}") - F.col(f"v{c}")) for c in "xyz"), num(0))
    sums = kept.withColumn("__gap", gap).groupBy("source_id").agg(F.count("*").alias("__n"), F.min("__gap").alias("__near"), F.min_by("other_g", "__gap").alias("near_g"), F.sum("__light").alias("__sum"))
    sep = F.degrees(2 * F.asin(F.sqrt("__near") / 2)) * 3600.0
    return events.join(sums, "source_id", "left").select(*events.columns, F.coalesce("__n", F.lit(0)).cast("int").alias("n"), sep.alias("nearest"), "near_g", F.coalesce("__sum", num(0)).alias("light"))


def typed_bodies(raw: DataFrame, fields: list[str], h_max: float | None) -> DataFrame:
    """Bodies from rows of strings in a named order: numbers where they parse, only bound orbits with all that the screen needs."""
    at = {f: i for i, f in enumerate(fields)}
    text = lambda f: F.get("row", F.lit(at[f]))
    value = lambda f: text(f).try_cast("double")
    spk = text("spkid").try_cast("bigint")
    named = raw.select(
        F.when(spk >= 20000000, spk - 20000000).otherwise(spk - 2000000).alias("number"),
        F.trim(F.coalesce(text("full_name"), F.lit(""))).alias("name"),
        *[value(f).alias(f.lower()) for f in ("H", "G", "diameter", "diameter_sigma", "a", "e", "epoch")],
        (text("neo") == "Y").alias("neo"),
    )
    bound = (F.col("a") > 0) & (F.col("e") >= 0) & (F.col("e") < 0.99) & F.col("epoch").isNotNull() & F.col("h").isNotNull()
    return named.where(bound & (F.col("h") < h_max if h_max is not None else F.lit(True))).withColumn("g", F.coalesce("g", num(0.15)))


def newest(rows: DataFrame, key: list[str], by: str, columns: list[str]) -> DataFrame:
    """The row of each key with the largest `by`."""
    return rows.groupBy(*key).agg(F.max(F.struct(by, *columns)).alias("n")).select(*key, "n.*")


def gaps(spans: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """(key…, gap_from, gap_to): where the spans of a key leave time uncovered between their first start and last end."""
    before = W.partitionBy(*key).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    run = spans.withColumn("__covered", F.max(end).over(before))
    return run.where(F.col(start) > F.col("__covered")).select(*key, F.col("__covered").alias("gap_from"), F.col(start).alias("gap_to"))


def two_parameter(kind: Column) -> Column:
    return kind >= KIND_TWO_A


def upgraded(old: DataFrame, layout: str) -> DataFrame:
    """Rows of an earlier layout in the present one (DDL): columns by name, cast; those that the earlier one lacks are 0, or empty text."""
    fields = T.StructType.fromDDL(layout).fields
    blank = lambda f: F.lit("" if isinstance(f.dataType, T.StringType) else 0)
    return old.select(*[(F.col(f.name) if f.name in old.columns else blank(f)).cast(f.dataType).alias(f.name) for f in fields])


def with_facts(events: DataFrame, flags: DataFrame, velocities: DataFrame, binaries: DataFrame) -> DataFrame:
    """Events (star, number and others) with what is known of their star and body by key: flag (none: empty), rv_kms (unknown: 0) and
    companions (none: 0). flags: star, flag; velocities: star, rv_kms; binaries: number, companions. One row a key each."""
    joined = events.join(flags, "star", "left").join(velocities, "star", "left").join(binaries, "number", "left")
    return joined.withColumns({"flag": F.coalesce("flag", F.lit("")), "rv_kms": F.coalesce("rv_kms", F.lit(0.0)), "companions": F.coalesce("companions", F.lit(0))})
