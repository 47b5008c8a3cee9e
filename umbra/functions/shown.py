"""Values of events and picks as tables show them. A dash stands for what isn't known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import sky
from umbra.functions.constants import TDB_UTC

NONE = "—"
WARNING, FLAG, SUN, TICK = "⚠", "⚑", "☼", "✓"
#: Twilight is noted for a Sun above this.
TWILIGHT_ALT = -12.0


def number(x: Column, digits: int = 2, unit: str = "", none: str | None = NONE) -> Column:
    """A number with so many decimals, halves to even; what rounds to nothing from below keeps its sign."""
    value = x.cast("double")
    near = F.bround(value, digits)
    sign = F.when((value < 0) & (near == 0), "-").otherwise("")
    return F.when(value.isNull() | F.isnan(value), F.lit(none)).otherwise(F.concat(sign, F.format_string(f"%.{digits}f", near), F.lit(unit)))


def _stamp(et: Column) -> Column:
    return F.timestamp_micros((F.floor((et - TDB_UTC + 43200.0 + 946684800.0) * 1e6 + 0.5)).cast("bigint"))


def moment(et: Column) -> Column:
    """Date with the month's name and time, to the nearest second."""
    return F.when(et.isNull(), NONE).otherwise(F.date_format(_stamp(et + 0.5), "yyyy-MMM-dd HH:mm:ss"))


def contact(et: Column) -> Column:
    """Time of the day to a tenth of a second."""
    tenths = F.floor((et - TDB_UTC + 43200.0) * 10 + 0.5).cast("bigint") % 864000
    return F.when(et.isNull(), NONE).otherwise(F.format_string("%02d:%02d:%02d.%d", F.floor(tenths / 36000), F.floor(tenths % 36000 / 600), F.floor(tenths % 600 / 10), tenths % 10))


def altitude(alt: Column, az: Column) -> Column:
    """Whole degrees, with the quarter of the sky where it is known."""
    return F.when(alt.isNull(), NONE).otherwise(F.concat(number(alt, 0, "°"), F.when(az.isNotNull(), F.concat(F.lit(" "), sky.compass(az))).otherwise("")))


def shadow(miss: Column, margin: Column) -> Column:
    """How far the shadow's axis passes, and whether its edge covers the site."""
    edge = F.when(margin.isNull(), "").when(margin <= 0, ", inside").otherwise(F.concat(F.lit(", "), number(margin, 1, " km out")))
    return F.when(miss.isNull(), NONE).otherwise(F.concat(number(miss, 1, " km"), edge))


def likelihood(p: Column) -> Column:
    return F.when(p.isNull(), NONE).when((p > 0) & (p < 0.005), "<1 %").otherwise(number(100 * p, 0, " %"))


def span(seconds: Column) -> Column:
    """A duration in seconds, from two minutes on in minutes."""
    return F.when(seconds.isNull() | (seconds == 0), NONE).when(seconds >= 120, number(seconds / 60, 1, " min")).otherwise(number(seconds, 1, " s"))


def twilight(sun_alt: Column) -> Column:
    """The Sun's altitude with its sign where it disturbs, else nothing."""
    return F.when(F.coalesce(sun_alt > TWILIGHT_ALT, F.lit(False)), F.concat(F.lit(f"{SUN} "), F.replace(number(sun_alt, 0, "°"), F.lit("-"), F.lit("−")))).otherwise("")


def _noted(text: Column, *notes: Column) -> Column:
    """A text with the notes that aren't empty behind it."""
    return F.concat_ws(" ", text, *[F.nullif(n, F.lit("")) for n in notes])


def events(rows: DataFrame) -> DataFrame:
    """Adds shown_… columns. Rows: label, kind (null for an asteroid), size_estimated, satellites (how many known), et, mag, star_flag, star_sigma, r_km, sun_alt,
    drop, drop_blend, double_hint, dur, alt, az, moon_sep, miss, margin, p_site, contact_s."""
    c = F.col
    # A star's own error matters where it is more than the body's radius.
    unsure = F.when(c("star_sigma") > F.greatest(F.coalesce("r_km", F.lit(0.0)), F.lit(1.0)), F.concat(F.lit(f"{WARNING} star ±"), number(c("star_sigma"), 0, " km")))
    flagged = F.coalesce(unsure, F.when(F.coalesce("star_flag", F.lit("")) != "", F.concat(F.lit(f"{FLAG} "), c("star_flag"))), F.lit(""))
    moons = F.when(c("kind").isNotNull() | c("satellites").isNull(), "").when(c("satellites") == 0, "+moon?").when(c("satellites") == 1, "+moon").otherwise(F.format_string("+%d moons", c("satellites")))
    name = F.concat(c("label"), F.when(c("kind").isNotNull(), F.concat(F.lit(" ("), c("kind"), F.lit(")"))).otherwise(""))
    warned = F.when(c("double_hint"), F.concat_ws(" ", F.lit(WARNING), F.when(c("drop_blend").isNotNull(), number(c("drop_blend")))))
    shown = {
        "asteroid": _noted(name, moons, F.when(c("size_estimated"), "*").otherwise("")),
        "time": moment(c("et")),
        "star_mag": _noted(number(c("mag")), flagged, twilight(c("sun_alt"))),
        "drop": _noted(number(c("drop")), F.coalesce(warned, F.lit(""))),
        "max_dur": number(c("dur")),
        "altitude": altitude(c("alt"), c("az")),
        "moon": F.when(c("moon_sep").isNull(), "").otherwise(number(c("moon_sep"), 0, "°")),
        "shadow": shadow(c("miss"), c("margin")),
        "chance": likelihood(c("p_site")),
        "diameter_km": F.round(2 * c("r_km"), 1),
        "duration": span(c("contact_s")),
    }
    return rows.withColumns({f"shown_{k}": x for k, x in shown.items()})


def picks(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds shown_… columns to rows of a pick: number, name, estimated, h, star_mag, drop, dur_s, mag_margin, miss_km, star_alt, star_flag, no_motion (the
    strong warning), sun_alt. `targets` (number) are marked, one row a number."""
    c = F.col
    marked = rows.join(targets.select(c("number"), F.lit(True).alias("__wanted")), "number", "left")
    flag = F.coalesce("star_flag", F.lit(""))
    sign = F.when(F.coalesce("no_motion", F.lit(False)), WARNING).otherwise(FLAG)
    shown = {f"shown_{k}": number(c(k), 2, none="") for k in ("h", "drop", "dur_s", "mag_margin", "miss_km", "star_alt")}
    shown |= {
        "shown_name": _noted(c("name"), F.when(c("estimated"), "*").otherwise("")),
        "shown_target": F.when(c("__wanted"), TICK).otherwise(""),
        "shown_star_mag": _noted(number(c("star_mag"), 2, none=""), F.when(flag != "", F.concat_ws(" ", sign, flag)).otherwise(""), twilight(c("sun_alt"))),
    }
    return marked.withColumns(shown).drop("__wanted")
