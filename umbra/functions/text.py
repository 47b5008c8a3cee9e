"""Parsing and formatting of the notations that people and other programs use, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbra.functions.sky import num, turn


def sexagesimal(x: Column, digits: int = 1, sign: bool = True) -> Column:
    """`+dd mm ss.s`; seconds are rounded first, so 60 never shows."""
    scale = 10**digits
    units = F.floor(F.abs(x) * 3600 * scale + 0.5).cast("bigint")
    whole, rest = F.expr("0") + F.floor(units / (3600 * scale)), units % (3600 * scale)
    minutes, seconds = F.floor(rest / (60 * scale)), (rest % (60 * scale)) / num(scale)
    body = F.format_string(f"%02d %02d %0{digits + 3 if digits else 2}.{digits}f", whole.cast("bigint"), minutes.cast("bigint"), seconds)
    return F.concat(F.when(x < 0, "-").otherwise("+"), body) if sign else body


def hours(ra: Column, digits: int = 2) -> Column:
    return sexagesimal(turn(ra) / 15.0, digits, False)


def from_parts(sign: Column, d: Column, m: Column, s: Column) -> Column:
    value = d.try_cast("double") + F.coalesce(m.try_cast("double"), num(0)) / 60.0 + F.coalesce(s.try_cast("double"), num(0)) / 3600.0
    return F.when(sign == "-", -value).otherwise(value)


def parsed_sexagesimal(text: Column) -> Column:
    """Degrees of `±d m s` with spaces, colons or unit signs between; null if there is no number."""
    pattern = r"^\s*([+-]?)\s*(\d+(?:\.\d+)?)[\s:°d]*(\d+(?:\.\d+)?)?[\s:'′m]*(\d+(?:\.\d+)?)?"
    part = lambda k: F.regexp_extract(text, pattern, k)
    none = lambda x: F.when(x != "", x)
    return from_parts(part(1), none(part(2)), none(part(3)), none(part(4)))


NUMBER = r"([+-]?\d+(?:\.\d+)?)\s*°?\s*(?:(\d+(?:\.\d+)?)\s*['′])?\s*(?:(\d+(?:\.\d+)?)\s*(?:\"|″|''))?"
#: One angle: number, up to two finer parts, and a hemisphere's letter (in three languages) before or, without one, behind.
ANGLE = rf"(?i)(?<![a-z])(?:([NSEWO])\s*{NUMBER}|{NUMBER}\s*(?:([NSEWO])(?![a-z]))?)"


def coordinates(text: Column) -> dict[str, Column]:
    """lat and lon from free text such as `48.2083, 16.3667`, `N 48°12.5' E 16°22'` or `48°12'30" N 16°22'10" W`; null if it doesn't hold
    two angles or they are out of range. Without letters the first is the latitude."""
    plain = F.regexp_replace(text, r"(?i)\b(?:lat(?:itude)?|lon(?:g(?:itude)?)?|breite|länge)\b\.?\s*[:=]?", " ")
    found = F.regexp_extract_all(plain, F.lit(ANGLE), F.lit(0))
    group = lambda one, k: F.regexp_extract(one, ANGLE, k)

    def value(one: Column) -> Column:
        none = lambda x: F.when(x != "", x)
        either = lambda i, j: F.coalesce(none(group(one, i)), none(group(one, j)))
        side, whole = F.upper(either(1, 8)), either(2, 5)
        number = from_parts(F.when(whole.startswith("-"), "-").otherwise("+"), F.regexp_replace(whole, "^[+-]", ""), either(3, 6), either(4, 7))
        return F.struct(F.when(side.isin("S", "W", "O"), -F.abs(number)).otherwise(number).alias("value"), side.alias("side"))

    a, b = value(F.get(found, F.lit(0))), value(F.get(found, F.lit(1)))
    swapped = a["side"].isin("E", "W", "O") | b["side"].isin("N", "S")
    lat, lon = F.when(swapped, b["value"]).otherwise(a["value"]), F.when(swapped, a["value"]).otherwise(b["value"])
    good = (F.size(found) == 2) & lat.between(-90, 90) & lon.between(-180, 360)
    return {"lat": F.when(good, lat), "lon": F.when(good, turn(lon + 180.0) - 180.0)}


def clock(et: Column, digits: int = 0) -> Column:
    """UTC of seconds past J2000, rounded half up; the fixed difference of 69.184 s stands in for leap seconds."""
    scale = 10**digits
    units = F.floor((et - 69.184 + 43200.0) * scale + 0.5)
    whole = F.timestamp_seconds((F.lit(946684800) + F.floor(units / scale)).cast("bigint"))
    text = F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss")
    return text if not digits else F.concat(text, F.lit("."), F.lpad((units % scale).cast("bigint").cast("string"), digits, "0"))


def body_label(number: Column, name: Column) -> Column:
    """`(123) Name`, or the provisional designation alone."""
    bare = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s*\(?\d*\)?\s*", ""))
    return F.trim(F.concat(F.lit("("), number.cast("string"), F.lit(") "), bare))


def without_tags(name: Column) -> Column:
    """A designation without the tag words at its end. A tag has letters only and starts with two capitals, with a small letter among
    those that follow, or with four capitals. The first word always stays."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    capitals = lambda w, n: (F.length(w) >= n) & (F.left(w, F.lit(n)) == F.upper(F.left(w, F.lit(n))))
    tag = lambda w: (F.length(F.regexp_replace(w, "[A-Za-z]", "")) == 0) & ((capitals(w, 2) & (w != F.upper(w))) | capitals(w, 4))
    last = F.array_max(F.transform(words, lambda w, i: F.when((i == 0) | ~tag(w), i + 1).otherwise(F.lit(1))))
    return F.array_join(F.slice(words, F.lit(1), F.coalesce(last, F.lit(1))), " ")


def file_id(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_-]+", "_")


def table_row(*cells: Column) -> Column:
    """A row of a Markdown table; bars in cells are escaped and nulls are empty."""
    return F.concat(F.lit("| "), F.array_join(F.array(*[F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in cells]), " | "), F.lit(" |"))


def twilight(sun_alt: Column) -> Column:
    return F.when(sun_alt > -6, "civil").when(sun_alt > -12, "nautical").when(sun_alt > -18, "astronomical").otherwise("")


def star_note(kind: Column, ruwe: Column) -> Column:
    ruwe_text = F.when(ruwe.isNotNull(), F.format_string("RUWE %.2f", ruwe)).otherwise("RUWE >= 1.4")
    return F.when(kind == 1, ruwe_text).when(kind == 2, "no proper motion").when(kind == 3, "motion from catalog A").when(kind == 4, "motion from catalog B").otherwise("")


def listing_angle(x: Column, width: int = 3) -> Column:
    """An angle as path listings have it: the sign apart, whole degrees in a field, minutes and whole seconds, rounded as one number."""
    seconds = F.round(F.abs(x) * 3600).cast("bigint")
    return F.concat(F.when(x < 0, "-").otherwise(" "), F.format_string(f"%{width}d %2d %2d", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60))


def listing_time(second: Column) -> Column:
    """Seconds of the day as hours, minutes and seconds to two places."""
    hundredths = F.floor(second * 100 + 0.5).cast("bigint")
    return F.format_string("%2d %2d %5.2f", F.floor(hundredths / 360000), F.floor(hundredths % 360000 / 6000), hundredths % 6000 / num(100))
