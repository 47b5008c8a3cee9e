"""Places on the Earth, as column expressions. Degrees, metres for heights, kilometres otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.constants import EARTH_KM, FLATTENING, KM_PER_DEGREE
from umbra.functions.sky import Vec, num, turn

E2 = FLATTENING * (2 - FLATTENING)


def earth_fixed(lat: Column, lon: Column, height_m: Column) -> Vec:
    phi, lam = F.radians(lat), F.radians(lon)
    n = EARTH_KM / F.sqrt(1.0 - E2 * F.sin(phi) * F.sin(phi))
    h = height_m / 1000.0
    return Vec((n + h) * F.cos(phi) * F.cos(lam), (n + h) * F.cos(phi) * F.sin(lam), (n * (1 - E2) + h) * F.sin(phi))


def geodetic(rho_cos: Column, rho_sin: Column) -> tuple[Column, Column]:
    """(latitude, height in metres) from the parallax constants, in Earth radii: Bowring's closed form by the reduced latitude,
    good to far below a millimetre near the surface, so no iteration is needed."""
    p, z = rho_cos * EARTH_KM, rho_sin * EARTH_KM
    polar = EARTH_KM * (1 - FLATTENING)
    beta = F.atan2(z, p * (1 - FLATTENING))
    phi = F.atan2(z + E2 / (1 - E2) * polar * F.pow(F.sin(beta), num(3)), p - E2 * EARTH_KM * F.pow(F.cos(beta), num(3)))
    n = EARTH_KM / F.sqrt(1.0 - E2 * F.sin(phi) * F.sin(phi))
    height = F.when(F.abs(p) > 1.0, p / F.cos(phi) - n).otherwise(F.abs(z) - n * (1 - E2))
    return F.degrees(phi), height * 1000.0


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    a1, o1, a2, o2 = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, num(1))))


def in_box(lat: Column, lon: Column, box: dict[str, Column], margin_km: Column) -> Column:
    """Within a box of latitudes and longitudes widened by a margin; boxes may cross the date line."""
    up = margin_km / KM_PER_DEGREE
    side = margin_km / (KM_PER_DEGREE * F.greatest(F.cos(F.radians(lat)), num(0.02)))
    width = turn(box["lon_max"] - box["lon_min"])
    width = F.when((width == 0) & (box["lon_max"] != box["lon_min"]), num(360)).otherwise(width)
    east = turn(lon - box["lon_min"])
    return (lat >= box["lat_min"] - up) & (lat <= box["lat_max"] + up) & ((east <= width + side) | (east >= 360.0 - side))


def ground_reach(sin_alt: Column, plane_km: Column, sin_least: Column | float) -> Column:
    """Farthest on the ground that an observer can be from the axis' ground point and lie within plane_km of the axis in the
    plane, with the star above an altitude: the plane is the Earth seen from the star, so a low star stretches it."""
    q = plane_km / EARTH_KM
    c = F.sqrt(F.greatest(1.0 - sin_alt * sin_alt, num(0)))
    near, far = c - q, c + q
    high = F.when(near <= 0, num(1)).otherwise(F.sqrt(F.greatest(1.0 - near * near, num(0))))
    low = F.greatest(F.when(far >= 1, num(-1)).otherwise(F.sqrt(F.greatest(1.0 - far * far, num(0)))), num(sin_least))
    d = F.greatest(F.greatest(high - sin_alt, sin_alt - low), num(0))
    chord = F.sqrt(plane_km * plane_km + F.pow(EARTH_KM * d, num(2)))
    return 2.0 * EARTH_KM * F.asin(F.least(chord / (2.0 * EARTH_KM), num(1)))


def field_of_view(sensor_mm: Column, focal_mm: Column) -> Column:
    """Arcminutes."""
    return F.degrees(2 * F.atan(sensor_mm / (2 * focal_mm))) * 60.0


def sensor_mm(pixels: Column, pixel_um: Column) -> Column:
    return pixels * pixel_um / 1000.0


def earth_turn(jd: Column) -> Column:
    """Earth rotation angle in radians; stands in for measured Earth orientation."""
    x = 0.7790572732640 + 1.00273781191135448 * (jd - 2451545.0)
    return 2 * math.pi * (x - F.floor(x))


def site_moved(lat1: Column, lon1: Column, lat2: Column, lon2: Column, tol: float = 0.01) -> Column:
    away = turn(lon2 - lon1 + 180.0) - 180.0
    return (F.abs(lat2 - lat1) > tol) | (F.abs(away) > tol)


def on_grid(places: DataFrame, grid: DataFrame, step: float) -> DataFrame:
    """`places` (lat, lon) with height_m between the four nodes of a grid (row from the north pole, col eastward from 0, height_m) of `step` degrees.
    Columns close up behind 360 degrees; south of the last row its cell goes on. Four equi-joins on one key each."""
    rows, cols = round(180 / step) + 1, round(360 / step)
    down, east = (90.0 - F.col("lat")) / step, turn(F.col("lon")) / step
    row = F.least(F.greatest(F.floor(down), F.lit(0)), F.lit(rows - 2))
    cornered = places.withColumns({"__r": row.cast("int"), "__c": (F.floor(east) % cols).cast("int"), "__fr": down - row, "__fc": east - F.floor(east)})
    nodes = grid.select((F.col("row") * cols + F.col("col")).alias("__key"), F.col("height_m").alias("__h"))
    total = num(0)
    for i, (dr, dc) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
        key = (F.col("__r") + dr) * cols + (F.col("__c") + dc) % cols
        cornered = cornered.withColumn("__key", key).join(nodes.withColumnRenamed("__h", f"__h{i}"), "__key", "left").drop("__key")
        weight = (F.col("__fr") if dr else 1 - F.col("__fr")) * (F.col("__fc") if dc else 1 - F.col("__fc"))
        total = total + weight * F.col(f"__h{i}")
    return cornered.select(*places.columns, total.alias("height_m"))
