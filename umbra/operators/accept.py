"""Which solved passes count as events, and why the others don't."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import earth, light, sky
from umbra.functions.sky import Vec, num, turn
from umbra.operators import results
from umbra.operators.shadow import jd_of, sun_direction, turned


def first_reason(tests: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first test, in order, whose condition holds; null where none does. An unknown condition doesn't hold."""
    return F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in tests])


def up_at(lat: Column, lon: Column, jd: Column) -> Vec:
    """The zenith of a site on the sky's axes."""
    phi, lam = F.radians(lat), F.radians(lon)
    return turned(Vec(F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)), -earth.earth_turn(jd))


def with_sky(solved: DataFrame, time: str = "t_ca") -> DataFrame:
    """Adds star_alt and sun_alt, degrees at the site at that time; needs ra, dec, site_lat, site_lon."""
    jd = jd_of(F.col(time))
    placed = solved.withColumn("__jd", jd)
    up = up_at(F.col("site_lat"), F.col("site_lon"), F.col("__jd"))
    named = placed.withColumns({"__ux": up.x, "__uy": up.y, "__uz": up.z})
    zenith = Vec(F.col("__ux"), F.col("__uy"), F.col("__uz"))
    height = lambda v: F.degrees(F.asin(F.least(F.greatest(zenith.dot(v), num(-1)), num(1))))
    return named.withColumns({"star_alt": height(sky.direction(F.col("ra"), F.col("dec"))), "sun_alt": height(sun_direction(F.col("__jd")))}).drop("__jd", "__ux", "__uy", "__uz")


def observable(star_alt: Column, sun_alt: Column, least_alt: Column | float, most_sun: Column | float) -> Column:
    """The exact search's test: both limits excluded."""
    return (star_alt > least_alt) & (sun_alt < most_sun)


def observable_for_pick(star_alt: Column, sun_alt: Column, least_alt: Column | float, most_sun: Column | float) -> Column:
    """The pick's test: both limits included."""
    return (star_alt >= least_alt) & (sun_alt <= most_sun)


def worth_solving(pairs: DataFrame, least_alt: float, most_sun: float, margin_deg: float = 3.0) -> DataFrame:
    """Adds `worth`: whether, at the start, middle or end of a pair's bracket, the Sun is down and the star, within a margin, up at the site.
    A cheap gate before the solver. Needs et, half, ra, dec, site_lat, site_lon."""
    at = pairs
    for name, shift in (("a", -1.0), ("b", 0.0), ("c", 1.0)):
        here = with_sky(at.withColumn("__t", F.col("et") + shift * F.col("half")), "__t")
        at = here.withColumn(f"__{name}", observable(F.col("star_alt"), F.col("sun_alt"), least_alt - margin_deg, most_sun)).drop("star_alt", "sun_alt", "__t")
    return at.withColumn("worth", F.col("__a") | F.col("__b") | F.col("__c")).drop("__a", "__b", "__c")


def exact_reasons(solved: DataFrame, window: tuple[float, float], reach_km: float, least_alt: float, most_sun: float, least_drop: float, key: list[str], order: str, tol_s: float = 300.0) -> DataFrame:
    """Adds `reason`: why the exact search drops a pass, null for an event. Seven tests in order: too far from the site, least distance at
    the bracket's edge, outside the run's window, an earlier event of its key within `tol_s`, not observable, drop too small.

    A pass that gets as far as the fourth test counts as an earlier event from then on, whatever the later ones say. Needs et and half (the
    bracket), t_ca, miss_km, r_km, m_ast, g, star_alt, sun_alt.
    """
    before = [
        ("miss", F.col("miss_km").isNull() | (F.col("miss_km") > F.col("r_km") + reach_km)),
        ("edge", F.col("half") - F.abs(F.col("t_ca") - F.col("et")) < 1.0),
        ("outside window", ~F.col("t_ca").between(*window)),
    ]
    tested = solved.withColumn("__first", first_reason(before))
    # Exploding no or one time keeps the test here; a filter would be pushed below the solver's steps, and they copied into it.
    time = F.explode(F.when(F.col("__first").isNull(), F.array("t_ca")).otherwise(F.array().cast("array<double>"))).alias("t_ca")
    kept = results.first_hits(tested.select(*key, order, time), key, "t_ca", order, tol_s).select(order).withColumn("__kept", F.lit(True))
    drop = light.drop(F.col("m_ast"), F.col("g"))
    after = [
        ("duplicate", F.col("__first").isNull() & F.col("__kept").isNull()),
        ("not visible", ~observable(F.col("star_alt"), F.col("sun_alt"), least_alt, most_sun)),
        ("low drop", drop < least_drop),
    ]
    return tested.join(kept, order, "left").withColumn("reason", F.coalesce("__first", first_reason(after))).drop("__first", "__kept")


def pick_reason(reach_km: Column | float, least_alt: float, most_sun: float, least_drop: float, least_dur: float, frames: float, extinction: float) -> Column:
    """Why the pick drops a pass, null for an event; needs miss_km, speed_kms, d_max_km, m_ast, g, aperture_cm, star_alt, sun_alt.

    In order: farther than the largest radius and the reach, altitudes, drop, duration at the largest size, and a magnitude beyond what
    the site can observe in that time, extinction taken off.
    """
    longest = F.col("d_max_km") / F.greatest(F.col("speed_kms"), num(1e-6))
    margin = light.faintest_observable(F.col("aperture_cm"), longest, num(frames)) - F.col("g") - light.extinction_loss(F.col("star_alt"), extinction)
    return first_reason(
        [
            ("miss", F.col("miss_km") > F.col("d_max_km") / 2 + reach_km),
            ("altitude", F.col("star_alt") < least_alt),
            ("sun", F.col("sun_alt") > most_sun),
            ("low drop", light.drop(F.col("m_ast"), F.col("g")) < least_drop),
            ("short", longest < least_dur),
            ("faint", margin <= 0),
        ]
    )


def moon(place: Vec, sun: Vec, site: Vec, up: Vec, star: Vec) -> dict[str, Column]:
    """moon_sep_deg, moon_alt_deg, moon_illum_pct, moon_age_deg from geocentric places in km of the Moon, the Sun and a site.

    Separation and altitude are as the site sees them, phase and age as the Earth's centre does. Age: how far along the ecliptic the Moon
    is ahead of the Sun, 0 at new moon to 360.
    """
    seen = place.minus(site)
    angle = lambda a, b: F.acos(F.least(F.greatest(a.dot(b) / (a.norm() * b.norm()), num(-1)), num(1)))
    phase = angle(place.minus(sun), place)
    tilt = F.radians(num(84381.448 / 3600))
    along = lambda v: F.atan2(F.cos(tilt) * v.y + F.sin(tilt) * v.z, v.x)
    return {
        "moon_sep_deg": F.degrees(angle(seen, star)),
        "moon_alt_deg": F.degrees(F.asin(F.least(F.greatest(seen.dot(up) / seen.norm(), num(-1)), num(1)))),
        "moon_illum_pct": 50.0 * (1 + F.cos(phase)),
        "moon_age_deg": turn(F.degrees(along(place) - along(sun))),
    }
