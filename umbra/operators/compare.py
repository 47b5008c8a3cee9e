"""Comparison with reference lists and listings, and statistics of what differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import earth
from umbra.functions.sky import Vec, num


def nearest_in_time(reference: DataFrame, hits: DataFrame, key: str, ref_time: str, hit_time: str, tol: float) -> DataFrame:
    """Each reference row with the nearest hit of its key, earlier or later, within `tol`; null columns where there is none.

    Both sides go into buckets of time as wide as the tolerance, a reference row also into its neighbours, so a join on key and bucket
    meets only rows near in time, however many hits a key has. `reference` has ref_id, `hits` hit_id; equal distances go to the lower id.
    """
    bucket = lambda t: F.floor(t / tol).cast("bigint")
    wide = reference.withColumn("__b", F.explode(F.array(*[bucket(F.col(ref_time)) + k for k in (-1, 0, 1)])))
    placed = hits.withColumn("__b", bucket(F.col(hit_time)))
    near = wide.join(placed, [key, "__b"]).withColumn("dt", F.col(hit_time) - F.col(ref_time)).where(F.abs("dt") <= tol)
    columns = [c for c in hits.columns if c not in (key, "hit_id")]
    best = near.groupBy("ref_id").agg(F.min(F.struct(F.abs("dt").alias("away"), "hit_id", "dt", *columns)).alias("m"))
    return reference.join(best.select("ref_id", "m.hit_id", "m.dt", *[f"m.{c}" for c in columns]), "ref_id", "left")


def verdict(found: Column, time_ok: Column, drop_ok: Column, size_ok: Column) -> Column:
    failed = F.concat_ws(",", F.when(~time_ok, F.lit("time")), F.when(~drop_ok, F.lit("drop")))
    return F.when(~found, F.lit("NOT FOUND")).when(time_ok & drop_ok & size_ok, F.lit("ok")).when(time_ok & drop_ok, F.lit("ok, size differs")).otherwise(F.concat(F.lit("FAIL "), failed, F.when(~size_ok, F.lit(" (+size)")).otherwise(F.lit(""))))


def spread(df: DataFrame, by: list[str], value: str, subsets: dict[str, Column]) -> DataFrame:
    """(by…, subset, n, least, most, mean, deviation, error) of a value, over subsets that may overlap, in one pass."""
    rows = df.select(*by, value, F.explode(F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in subsets.items()]), lambda x: x.isNotNull())).alias("subset"))
    return rows.groupBy(*by, "subset").agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), (F.stddev_pop(value) / F.sqrt(F.count("*"))).alias("error"))


def plane_fit(df: DataFrame, by: list[str]) -> DataFrame:
    """Least squares of offsets (px, py) in the plane by a constant (cx, cy) and a rotation with partials (dx, dy): cx, cy, angle, rms, and the unknowns'
    errors (1 sigma): const_sigma, cx_sigma, cy_sigma, angle_sigma, null where there aren't more values than unknowns.

    The normal equations need eight sums; the three unknowns and their covariance follow in closed form.
    """
    s = {
        "n": F.count("*").cast("double"),
        "sx": F.sum("px"),
        "sy": F.sum("py"),
        "sdx": F.sum("dx"),
        "sdy": F.sum("dy"),
        "sdd": F.sum(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")),
        "sdp": F.sum(F.col("dx") * F.col("px") + F.col("dy") * F.col("py")),
        "spp": F.sum(F.col("px") * F.col("px") + F.col("py") * F.col("py")),
    }
    sums = df.groupBy(*by).agg(*[v.alias(k) for k, v in s.items()])
    n, sx, sy, sdx, sdy, sdd, sdp, spp = (F.col(k) for k in s)
    den = sdd - (sdx * sdx + sdy * sdy) / n
    angle = F.when(den > 0, (sdp - (sdx * sx + sdy * sy) / n) / den).otherwise(num(0))
    fitted = sums.withColumns({"angle": angle, "den": den})
    cx, cy = (sx - F.col("angle") * sdx) / n, (sy - F.col("angle") * sdy) / n
    done = fitted.withColumns({"cx": cx, "cy": cy, "const_x": sx / n, "const_y": sy / n})
    left = spp - F.col("cx") * sx - F.col("cy") * sy - F.col("angle") * sdp
    flat = spp - (sx * sx + sy * sy) / n
    spare = lambda k: F.when(2 * n > k, 2 * n - k)
    unit = F.greatest(left, num(0)) / spare(3)
    turn_ = F.when(F.col("den") > 0, 1 / F.col("den"))
    sigmas = {
        "const_sigma": F.sqrt(F.greatest(flat, num(0)) / spare(2) / n),
        "cx_sigma": F.sqrt(unit * (1 / n + (sdx / n) ** 2 * F.coalesce(turn_, num(0)))),
        "cy_sigma": F.sqrt(unit * (1 / n + (sdy / n) ** 2 * F.coalesce(turn_, num(0)))),
        "angle_sigma": F.sqrt(unit * turn_),
    }
    done = done.withColumns(sigmas)
    return done.select(*by, *sigmas, "const_x", "const_y", F.sqrt(F.greatest(flat, num(0)) / (2 * n)).alias("const_rms"), "cx", "cy", "angle", F.sqrt(F.greatest(left, num(0)) / (2 * n)).alias("rms"))


def line_fit(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """(by…, intercept, slope, rms_before, rms_after) of y on x."""
    return df.groupBy(*by).agg(
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_slope(y, x).alias("slope"),
        F.stddev_pop(y).alias("rms_before"),
        F.sqrt(F.greatest(F.regr_syy(y, x) - F.regr_sxy(y, x) * F.regr_sxy(y, x) / F.regr_sxx(y, x), num(0)) / F.count("*")).alias("rms_after"),
    )


def occultations(records: DataFrame) -> DataFrame:
    """Past events of each body: n, first and last date, counts by quality, and the best profile (quality, then date) of those with
    quality 2 or more whose diameter isn't assumed. Records: number, date, quality, major, assumed."""
    good = (F.col("quality") >= 2) & ~F.col("assumed")
    counts = records.groupBy("number", "quality").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.max(F.when(good, F.struct("quality", "date", "major"))).alias("best"))
    return counts.groupBy("number").agg(
        F.sum("n").alias("n"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("quality", "n")))).alias("by_quality"),
        F.max("best").alias("best"),
    )


def path_offsets(points: DataFrame, half_s: float = 0.5) -> DataFrame:
    """Adds across_km, along_km, dt_s and away_km: where another program's point of a path (their_lat, their_lon) lies from ours at the same
    time (lat, lon), given where ours is `half_s` later (lat1, lon1). All on the ellipsoid, in space, not along the ground.

    Along is the way our point moves, across is to the left of it as seen from above; dt is how long our point takes for the part along.
    """
    zero = num(0)
    here, next_, there = (earth.earth_fixed(F.col(a), F.col(b), zero) for a, b in (("lat", "lon"), ("lat1", "lon1"), ("their_lat", "their_lon")))
    named = points.withColumns({f"__{n}{c}": getattr(v, c) for n, v in (("p", here), ("q", next_), ("t", there)) for c in "xyz"})
    at = lambda n: Vec(*(F.col(f"__{n}{c}") for c in "xyz"))
    step = at("q").minus(at("p"))
    moved = named.withColumns({"__sx": step.x, "__sy": step.y, "__sz": step.z}).withColumn("__len", at("s").norm())
    unit, off = at("s").times(1 / F.col("__len")), at("t").minus(at("p"))
    up = at("p").times(1 / at("p").norm())
    left = Vec(up.y * unit.z - up.z * unit.y, up.z * unit.x - up.x * unit.z, up.x * unit.y - up.y * unit.x)
    along = off.dot(unit)
    return moved.withColumns({"across_km": off.dot(left), "along_km": along, "dt_s": along / (F.col("__len") / half_s), "away_km": off.norm()}).select(*points.columns, "across_km", "along_km", "dt_s", "away_km")
