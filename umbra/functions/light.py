"""Magnitudes, limits and sizes, as column expressions."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.constants import KIND_RUWE, KIND_TWO, KIND_TWO_A, KIND_TWO_B, TYPICAL_ERRORS, UNKNOWN_PM_MAS_YR
from umbra.functions.sky import num


def log10(x: Column) -> Column:
    return F.log10(x)


def ten(x: Column) -> Column:
    return F.pow(num(10), x)


def hypot(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def hg_magnitude(h: Column, g: Column, sun_au: Column, earth_au: Column, cos_phase: Column) -> Column:
    t = F.tan(F.acos(F.least(F.greatest(cos_phase, num(-1)), num(1))) / 2)
    phi1, phi2 = F.exp(-3.33 * F.pow(t, num(0.63))), F.exp(-1.87 * F.pow(t, num(1.22)))
    return h + 5 * log10(sun_au * earth_au) - 2.5 * log10((1 - g) * phi1 + g * phi2)


def drop_margin(least_drop: Column | float) -> Column:
    """How much fainter than the body a star may be to drop by this much."""
    return -2.5 * log10(ten(0.4 * num(least_drop)) - 1.0)


def drop(m_body: Column, m_star: Column) -> Column:
    return 2.5 * log10(1.0 + ten(0.4 * (m_body - m_star)))


def combined(m1: Column, m2: Column) -> Column:
    return -2.5 * log10(ten(-0.4 * m1) + ten(-0.4 * m2))


def blended_drop(m_star: Column, m_body: Column, others: Column) -> Column:
    """Drop with the light of other stars (array of magnitudes) remaining; null where no light remains."""
    return drop_beside(m_star, m_body, F.aggregate(others, num(0), lambda a, m: a + ten(-0.4 * m)))


def drop_beside(m_star: Column, m_body: Column, others: Column) -> Column:
    """Drop with other light remaining, given as a sum of tens to the power of -0.4 times a magnitude; null where no light remains."""
    rest = others + F.coalesce(ten(-0.4 * m_body), num(0))
    return F.when(rest > 0, 2.5 * log10((ten(-0.4 * m_star) + rest) / rest))


def faintest_observable(aperture_cm: Column, duration_s: Column, frames: Column, adjust: Column | float = 0.0) -> Column:
    """Limit of the general observability criterion."""
    return 5 * log10(aperture_cm) + 2.5 * log10(F.greatest(duration_s, num(1e-9)) / frames) + 8.5 + num(adjust)


def site_limit(aperture_cm: Column, exposure_s: Column, adjust: Column | float, catalog: float) -> Column:
    return F.least(F.round(5 * log10(aperture_cm) + 2.5 * log10(exposure_s) + 8.5 + num(adjust), 1), num(catalog))


def airmass(alt: Column) -> Column:
    return 1.0 / (F.sin(F.radians(alt)) + 0.50572 * F.pow(alt + 6.07995, num(-1.6364)))


def extinction_loss(alt: Column, k: Column | float) -> Column:
    return F.when(num(k) == 0, num(0)).otherwise(num(k) * (airmass(alt) - 1.0))


def planet_magnitude(v10: Column, sun_au: Column, earth_au: Column, beta: Column, phase_deg: Column) -> Column:
    return v10 + 5 * log10(sun_au * earth_au) + beta * phase_deg


def diameter_of(h: Column, albedo: Column | float) -> Column:
    """Kilometres from absolute magnitude and albedo."""
    return 1329.0 / F.sqrt(num(albedo)) * ten(-h / 5)


#: Albedos for satellites: those of unknown size, the sixth planet's icy ones of unknown brightness, and all others of that kind. Fixed values.
DARK, ICY, OTHER = 0.05, 0.5, 0.07


def completed_moons(moons: DataFrame, planet: Column | None = None) -> DataFrame:
    """Satellites (naif, radius_km, h) with a missing size from the brightness or a missing brightness from the size, rounded to two places,
    and radius_est and h_est that say so. `planet` is each one's planet; without it, it is in the number: its hundreds, or ten thousands for
    five-digit ones."""
    planet = planet if planet is not None else F.when(F.col("naif") < 1000, F.expr("naif div 100")).otherwise(F.expr("naif div 10000"))
    albedo = F.when(planet == 6, ICY).otherwise(OTHER)
    no_size = F.col("radius_km").isNull() & F.col("h").isNotNull()
    no_light = ~no_size & F.col("h").isNull() & F.coalesce(F.col("radius_km") > 0, F.lit(False))
    size = F.round(diameter_of(F.col("h"), DARK) / 2, 2)
    bright = F.round(5 * log10(1329.0 / (2 * F.col("radius_km") * F.sqrt(albedo))), 2)
    return moons.withColumns({"radius_est": no_size, "h_est": no_light, "radius_km": F.when(no_size, size).otherwise(F.col("radius_km")), "h": F.when(no_light, bright).otherwise(F.col("h"))})


def size_by_precedence(h: Column, diameter: Column, sigma: Column, albedo: Column, extents: Column) -> dict[str, Column]:
    """r_km, r_min_km, r_max_km, source: a measured diameter first, widened by measured extents, then H with albedo, then H."""
    d = F.when(diameter > 0, diameter)
    s = F.coalesce(F.when(sigma > 0, sigma), 0.15 * d)
    wide = F.size(extents) >= 2
    low, high = F.greatest((d - 3 * s) / 2, num(0)), (d + 3 * s) / 2
    low = F.when(wide, F.least(low, F.array_min(extents) / 2)).otherwise(low)
    high = F.when(wide, F.greatest(high, F.array_max(extents) / 2)).otherwise(high)
    p = F.when(albedo > 0, albedo)

    def pick(measured: Column, with_albedo: Column, plain: Column) -> Column:
        return F.when(d.isNotNull(), measured).when(h.isNotNull() & p.isNotNull(), with_albedo).when(h.isNotNull(), plain)

    return {
        "r_km": pick(d / 2, diameter_of(h, p) / 2, diameter_of(h, 0.14) / 2),
        "r_min_km": pick(low, diameter_of(h, F.least(p * 1.5, num(1))) / 2, diameter_of(h, 0.30) / 2),
        "r_max_km": pick(high, diameter_of(h, p / 1.5) / 2, diameter_of(h, 0.05) / 2),
        "source": pick(F.lit("diameter"), F.lit("H and albedo"), F.lit("H only")),
    }


def size_for_screen(h: Column, diameter: Column, sigma: Column) -> dict[str, Column]:
    """d_km, d_max_km, estimated: the screen's own rule, which knows neither albedo nor extents."""
    known = F.coalesce(diameter > 0, F.lit(False))
    return {
        "d_km": F.when(known, diameter).otherwise(diameter_of(h, 0.14)),
        "d_max_km": F.when(known, diameter + 3 * F.coalesce(sigma, 0.15 * diameter)).otherwise(diameter_of(h, 0.05)),
        "estimated": ~known,
    }


def star_sigma(kind: Column, ruwe: Column, pos_err: Column, pm_err: Column, years: Column | float) -> Column:
    """Error in mas of a star outside the main catalog, some years on; null for a main-catalog star."""
    t = F.greatest(num(years), num(0))
    known = lambda x, other: F.when(x > 0, x).otherwise(num(other))
    unknown = hypot(known(pos_err, 1.0), UNKNOWN_PM_MAS_YR * t)
    matched = hypot(known(pos_err, 1.0), known(pm_err, UNKNOWN_PM_MAS_YR) * t)
    scaled = known(pos_err, 0.1) * F.greatest(known(ruwe, 1.4), num(1))
    return F.when(kind == KIND_TWO, unknown).when(kind.isin(KIND_TWO_A, KIND_TWO_B), matched).when(kind == KIND_RUWE, hypot(scaled, scaled * t))


def covariance(major: Column, minor: Column, pa: Column) -> tuple[Column, Column, Column]:
    """(xx, xy, yy), x east, y north, of an ellipse whose major axis points to position angle pa."""
    x, y = F.sin(F.radians(pa)), F.cos(F.radians(pa))
    a, b = major * major, minor * minor
    return a * x * x + b * y * y, (a - b) * x * y, a * y * y + b * x * x


def ellipse(xx: Column, xy: Column, yy: Column) -> tuple[Column, Column, Column]:
    """(major, minor, pa) of a covariance."""
    half = (xx + yy) / 2
    spread = F.sqrt(F.greatest(half * half - (xx * yy - xy * xy), num(0)))
    pa = F.degrees(0.5 * F.atan2(2 * xy, yy - xx))
    return F.sqrt(half + spread), F.sqrt(F.greatest(half - spread, num(0))), pa - F.floor(pa / 180.0) * 180.0


#: The measured quantities of a star, by the names their errors and correlations begin with.
MEASURED = ("ra", "dec", "pmra", "pmdec")


def star_covariance(err: dict[str, Column], years: Column | float) -> tuple[Column, Column, Column]:
    """Position covariance some years on, from errors and correlations of position and proper motion (missing ones are 0).

    Each coordinate is a sum of measured quantities: itself once, its motion `years` times. The covariance of two sums is the
    sum over all pairs of what they hold, weighted, with the pair's own covariance.
    """
    t = num(years)
    east, north = {"ra": num(1), "pmra": t}, {"dec": num(1), "pmdec": t}

    def joint(a: str, b: str) -> Column | None:
        if a == b:
            return err[f"{a}_error"] * err[f"{a}_error"]
        first, second = sorted((a, b), key=MEASURED.index)
        key = f"{first}_{second}_corr"
        return F.coalesce(err[key], num(0)) * err[f"{a}_error"] * err[f"{b}_error"] if key in err else None

    def covary(u: dict[str, Column], v: dict[str, Column]) -> Column:
        terms = [wa * wb * c for a, wa in u.items() for b, wb in v.items() if (c := joint(a, b)) is not None]
        return functools.reduce(operator.add, terms, num(0))

    return covary(east, east), covary(east, north), covary(north, north)


def log_table(x: Column, table: Sequence[tuple[float, float]]) -> Column:
    """Between the entries (x, value) of a table in the logarithm of the value, beyond them the first or last value: the sum of a ramp
    for each gap, as long as the gap."""
    (x0, v0), steps = table[0], zip(table, table[1:], strict=False)
    ramps = [F.least(F.greatest(x - a, num(0)), num(b - a)) * num(math.log(w / v) / (b - a)) for (a, v), (b, w) in steps]
    return num(v0) * F.exp(functools.reduce(operator.add, ramps))


def typical_sigma(g: Column, years: Column | float) -> Column:
    """Error in mas of a typical catalog star of this G: position and motion."""
    at_rest, motion = ([(e[0], e[k]) for e in TYPICAL_ERRORS] for k in (1, 2))
    return hypot(log_table(g, at_rest), num(years) * log_table(g, motion))


def across_track(xx: Column, xy: Column, yy: Column, move_east: Column, move_north: Column) -> Column:
    """Error across a motion on the sky; null without motion."""
    square = move_east * move_east + move_north * move_north
    variance = (move_north * move_north * xx - 2 * move_east * move_north * xy + move_east * move_east * yy) / square
    return F.when(square > 0, F.sqrt(F.greatest(variance, num(0))))


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26, error below 1.5e-7."""
    t = 1.0 / (1.0 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def normal(z: Column) -> Column:
    return 0.5 * (1.0 + erf(z / math.sqrt(2)))


def shadow_chance(radius: Column, miss: Column, sigma: Column) -> Column:
    """Probability that a site this far from the predicted centre line lies in the shadow."""
    inside = normal((radius - miss) / sigma) - normal((-radius - miss) / sigma)
    return F.when(sigma > 0, inside).otherwise(F.when(F.abs(miss) <= radius, num(1)).otherwise(num(0)))
