"""Known values, brute force, plans and round trips."""

from __future__ import annotations

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from umbra.functions import earth, light, sky, text
from umbra.functions.sky import Vec, num
from umbra.operators import backfill, catalog, cells, ephemeris, globe, ground_index, orbits, records, results, scan, shadow, solve, tracks
from umbra.plans import ephemerides, globes, solving
from umbra.plans.tables import table
from umbra.sources import files
from umbra.streaming import increments

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_known_values(spark):
    r = one(spark, light.drop_margin(0.1), light.normal(num(1)) - light.normal(num(-1)), light.blended_drop(num(12), num(99), F.array(num(12))), light.diameter_of(num(10), 0.14))
    assert r[0] == pytest.approx(2.539, abs=5e-4)
    assert r[1] == pytest.approx(0.6827, abs=1e-4)
    assert r[2] == pytest.approx(2.5 * math.log10(2), abs=1e-6)
    assert r[3] == pytest.approx(1329 / math.sqrt(0.14) * 10**-2)
    sun = sky.light_bend(Vec(num(math.cos(math.radians(90))), num(1.0), num(0)), Vec(num(-149597870.7), num(0), num(0)), Vec(num(0), num(1), num(0)), 1.32712440018e11)
    assert one(spark, sun.norm() * 180 / math.pi * 3.6e6)[0] == pytest.approx(4.07, abs=0.01)


def test_cell_join_equals_all_pairs(spark):
    random.seed(3)
    point = lambda i: (i, random.uniform(0, 360), math.degrees(math.asin(random.uniform(-1, 1))))
    seam = [(900, 0.05, 10.0), (901, 359.95, 10.0), (902, 10.0, 89.9), (903, 190.0, 89.95), (904, 200.0, -89.99)]
    a = spark.createDataFrame([point(i) for i in range(300)] + seam, "a bigint, ra double, dec double")
    b = spark.createDataFrame([point(i) for i in range(400)] + seam, "b bigint, star_ra double, star_dec double")
    got = {tuple(r) for r in cells.cell_join(a, b, 4.0, 1.5).select("a", "b").collect()}
    unit = lambda ra, dec: (math.cos(math.radians(dec)) * math.cos(math.radians(ra)), math.cos(math.radians(dec)) * math.sin(math.radians(ra)), math.sin(math.radians(dec)))
    limit = (2 * math.sin(math.radians(2.0))) ** 2
    want = {(x.a, y.b) for x in a.collect() for y in b.collect() if sum((p - q) ** 2 for p, q in zip(unit(x.ra, x.dec), unit(y.star_ra, y.star_dec), strict=True)) <= limit}
    assert got == want and any(x >= 900 and y >= 900 and x != y for x, y in got)


def test_spatial_joins_plan_as_equi_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        stars = table(spark, SF, "stars")
        found = scan.minima(tracks.with_directions(table(spark, SF, "path_samples")), stars.select("source_id", F.col("ra").alias("star_ra"), F.col("dec").alias("star_dec"), "g"), 4e6, 600, 1.0)
        others = stars.select(F.col("source_id").alias("other_id"), F.col("ra").alias("other_ra"), F.col("dec").alias("other_dec"), F.col("g").alias("other_g"))
        for df in (found, catalog.matched(stars, others, 0.5, F.lit(True)), catalog.companions(stars, stars, 10.0, 30.0)):
            assert "NestedLoop" not in plan_of(df) and "Cartesian" not in plan_of(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    catalog.write(catalog.encoded(catalog.admitted(table(spark, SF, "stars"), 16.0)), str(tmp_path / "c"))
    plan = plan_of(spark.read.parquet(str(tmp_path / "c")).where("g <= 12 AND band = 3").select("source_id"))
    assert "LessThanOrEqual(g,12.0)" in plan and "PartitionFilters: [isnotnull(band" in plan
    assert "ReadSchema: struct<source_id:bigint,g:double>" in plan


def test_interval_join_equals_all_pairs(spark):
    random.seed(4)
    span = lambda i: (i, x := random.uniform(0, 1000), x + random.uniform(0, 90))
    left, right = [span(i) for i in range(120)], [span(i) for i in range(120)]
    a = spark.createDataFrame(left, "a bigint, a0 double, a1 double")
    b = spark.createDataFrame(right, "b bigint, b0 double, b1 double")
    got = sorted(tuple(r) for r in cells.interval_join(a, b, ("a0", "a1"), ("b0", "b1"), 50.0).select("a", "b").collect())
    assert got == sorted((x[0], y[0]) for x in left for y in right if x[1] <= y[2] and y[1] <= x[2])


def test_greedy_rules(spark):
    rows = [(0, 1, 0.0), (1, 1, 200.0), (2, 1, 450.0), (3, 1, 1000.0), (4, 2, 10.0), (5, 1, 900.0)]
    df = spark.createDataFrame(rows, "id bigint, k bigint, t double")
    assert sorted(r.id for r in results.first_hits(df, ["k"], "t", "id").collect()) == [0, 2, 3, 4]
    # 1 takes the place of 0, then 2 that of 1; 5 that of 3.
    assert sorted(r.id for r in results.last_hits(df, ["k"], "t", "id").collect()) == [2, 4, 5]


def bodies_of(spark, epochs: dict[int, float] | None = None):
    """The table's bodies with heliocentric states at their epochs, other epochs by number modulo three."""
    rows = table(spark, SF, "asteroids")
    if epochs:
        rows = rows.withColumn("epoch_jd", F.element_at(F.array(*[num(epochs[k]) for k in range(3)]), (F.col("number") % 3 + 1).cast("int")))
    return orbits.two_body_states(rows, F.col("epoch_jd"))


def by_number(df) -> pd.DataFrame:
    return df.orderBy("number", "jd").toPandas()


def test_integration_runs_back_and_holds_two_bodies(spark):
    day, sky_ = 2460800.5, ephemerides.planets(spark, 2460780.0, 2460860.0)
    start = bodies_of(spark)
    there = ephemeris.integrated(start, sky_, [day + 20])
    # Heliocentric again, from the new time on.
    sun = sky_.where(f"body = 10 AND jd IN ({day + 19.5}, {day + 20.5})").groupBy().agg(*[F.avg(c).alias(f"s{c}") for c in ephemeris.STATE])
    again = there.crossJoin(sun).select("number", F.col("jd").alias("epoch_jd"), *[(F.col(c) - F.col(f"s{c}")).alias(c) for c in ephemeris.STATE])
    back, here = by_number(ephemeris.integrated(again, sky_, [day])), by_number(ephemeris.integrated(start, sky_, [day]))
    assert max(abs(back[c] - here[c]).max() for c in "xyz") < 1e-7
    alone = sky_.withColumns({"gm": F.when(F.col("body") == 10, F.col("gm")).otherwise(num(0))} | {c: F.when(F.col("body") == 10, num(0)).otherwise(F.col(c)) for c in ephemeris.STATE})
    free = by_number(ephemeris.integrated(start, alone, [day + 10, day + 30.3]))
    moved = pd.concat([orbits.two_body_states(table(spark, SF, "asteroids"), num(t)).select("number", num(t).alias("jd"), *ephemeris.STATE).toPandas() for t in (day + 10, day + 30.3)]).sort_values(["number", "jd"]).reset_index(drop=True)
    assert max(abs(free[c] - moved[c]).max() for c in ephemeris.STATE) < 1e-8


def test_integration_by_epochs(spark):
    """Epochs share a batch or not; one inside the window of times is an error, as is a table of planets that ends before."""
    sky_ = ephemerides.planets(spark, 2460780.0, 2460860.0)
    times = [2460830.5, 2460840.0, 2460850.25]
    mixed = bodies_of(spark, {0: 2460800.5, 1: 2460850.25, 2: 2460815.0})
    whole = by_number(ephemeris.integrated(mixed.coalesce(1), sky_, times))
    parts = by_number(ephemeris.integrated(mixed.repartition(7), sky_, times))
    alone = pd.concat([by_number(ephemeris.integrated(mixed.where(f"number % 3 = {k}"), sky_, times)) for k in range(3)]).sort_values(["number", "jd"]).reset_index(drop=True)
    for other in (parts, alone):
        assert max(abs(whole[c] - other[c]).max() for c in ephemeris.STATE) < 1e-12
    fine = by_number(ephemeris.integrated(mixed, sky_, times, step=0.125))
    assert max(abs(whole[c] - fine[c]).max() for c in "xyz") < 1e-8
    with pytest.raises(Exception, match="lies inside the window"):
        ephemeris.integrated(bodies_of(spark, {0: 2460835.0, 1: 2460800.5, 2: 2460800.5}), sky_, times).collect()
    with pytest.raises(Exception, match="ends before"):
        ephemeris.integrated(mixed, sky_, [2460900.0]).collect()
    with pytest.raises(ValueError, match="more than 100 rows"):
        ephemeris.integrated(mixed, sky_, times, most_rows=100)
    assert ephemeris.integrated(mixed.limit(0), sky_, times).collect() == []


def test_planets_balance_around_the_barycentre(spark):
    rows = ephemerides.planets(spark, 2460800.0, 2460803.0).groupBy("jd").agg(*[F.sum(F.col("gm") * F.col(c)).alias(c) for c in ephemeris.STATE], F.count("*").alias("n")).collect()
    assert len(rows) == 4 and all(r.n == 10 and max(abs(r[c]) for c in ephemeris.STATE) < 1e-15 for r in rows)
    earth_ = ephemerides.planets(spark, 2460800.0, 2460800.0).where("body IN (3, 10)").orderBy("body").collect()
    assert 0.98 < math.dist(earth_[0][3:6], earth_[1][3:6]) < 1.02


def test_windows_of_nodes_follow_eccentric_orbits(spark):
    off = F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))
    four, two = (ephemerides.windowed(spark, SF, size).select(F.max(off).alias("most"), F.percentile(off, F.lit(0.5)).alias("median"), F.count("*").alias("n")).first() for size in (4, 2))
    assert four.n == two.n == 10 * table(spark, SF, "asteroids").count()
    # Up to 0.9 of eccentricity, a node each quarter radian.
    assert four.most < 1e-3 and four.median < 1e-7 and two.median > 100 * four.median
    nodes = spark.createDataFrame([(t, float(k), *(float(k + c) ** 3 for c in range(3)), *(3 * float(k + c) ** 2 for c in range(3))) for t in (1, 2) for k in (0, 1, 4, 6, 7) if t == 1 or k < 3], "target int, et double, x double, y double, z double, vx double, vy double, vz double")
    asked = spark.createDataFrame([(1, t) for t in (0.0, 0.5, 4.0, 6.9, 7.0, -0.1, 7.1)] + [(2, 0.5), (3, 1.0)], "target int, et double")
    got = {r.et: r for r in ephemeris.hermite_states(nodes, asked, 4, 2.0).collect()}
    assert sorted(got) == [0.0, 0.5, 4.0, 6.9, 7.0] and all(r.target == 1 for r in got.values())
    assert all(r.x == pytest.approx(t**3, abs=1e-9) and r.vz == pytest.approx(3 * (t + 2) ** 2, abs=1e-9) for t, r in got.items())


def test_no_crossing_gives_null(spark):
    df = spark.createDataFrame(pd.DataFrame({"event_id": [1, 2], "et": [0.0, 0.0], "x0": [0.0, 9000.0], "y0": [0.0, 0.0], "vx": [10.0, 0.0], "vy": [0.0, 10.0], "ax": 0.0, "ay": 0.0, "t_ca": 0.0, "limit": [6000.0, 6000.0]}))
    found = {r.event_id: r for r in solve.crossings(df, "limit").collect()}
    assert found[1].t_in == pytest.approx(-600, abs=0.01) and found[2].t_in is None


def test_contacts_and_closest_approach_equal_a_fine_grid(spark):
    """To a millisecond, on curved tracks at turning sites; each place by plain Python with the observer's own light time."""
    pairs = solving.curved(spark, SF).where("number % 3 = 0")
    found = solve.contacts_at_sites(pairs, "limit")
    rows = {r.event_id: r for r in pairs.join(found.where("dt_in IS NOT NULL"), ["event_id", "site_id"]).limit(25).collect()}
    assert len(rows) == 25

    def distance(r, dt: float) -> float:
        jx, jy = (r.number % 7 - 3) * 1e-9, (r.number % 5 - 2) * 1e-9
        ra, dec, lat, lon = (math.radians(x) for x in (r.ra, r.dec, r.site_lat, r.site_lon))
        f = 1 / 298.257223563
        c = 6378.137 / math.sqrt(1 - f * (2 - f) * math.sin(lat) ** 2)
        x = 0.7790572732640 + 1.00273781191135448 * (r.et + dt) / 86400
        angle = 2 * math.pi * (x % 1) + lon
        rho, up = (c + r.ele_m / 1000) * math.cos(lat), (c * (1 - f) ** 2 + r.ele_m / 1000) * math.sin(lat)
        o = (rho * math.cos(angle), rho * math.sin(angle), up)
        s = (math.cos(dec) * math.cos(ra), math.cos(dec) * math.sin(ra), math.sin(dec))
        e = (-math.sin(ra), math.cos(ra), 0.0)
        n = (s[1] * e[2] - s[2] * e[1], s[2] * e[0] - s[0] * e[2], s[0] * e[1] - s[1] * e[0])
        dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
        t = dt + dot(o, s) / 299792.458
        return math.hypot(r.x0 + r.vx * t + r.ax * t * t + jx * t**3 - dot(o, e), r.y0 + r.vy * t + r.ay * t * t + jy * t**3 - dot(o, n))

    for r in rows.values():
        # Half a second around, then a tenth of a millisecond.
        coarse = min((distance(r, -r.half + k * 0.5), -r.half + k * 0.5) for k in range(int(4 * r.half) + 1))[1]
        best = min((distance(r, coarse + k * 1e-3), coarse + k * 1e-3) for k in range(-600, 601))
        assert abs(best[1] - r.dt_ca) < 2e-3 and r.miss_km - 1e-9 <= best[0] <= r.miss_km + 1e-3
        for t, sign in ((r.dt_in, -1), (r.dt_out, 1)):
            assert distance(r, t + sign * 5e-4) > r.limit > distance(r, t - sign * 5e-4)
    wide = solve.contacts_at_sites(pairs.withColumn("limit", num(1e6)), "limit").agg(F.count("dt_in").alias("a"), F.count("*").alias("n")).first()
    none = solve.contacts_at_sites(pairs.withColumn("limit", num(1e-9)), "limit").agg(F.count("dt_in").alias("a")).first()
    assert wide.a == none.a == 0 and wide.n > 100
    assert solve.contacts_at_sites(pairs.limit(0), "limit").collect() == []


def test_nutation_and_position_of_date(spark):
    """The worked example of 1987 April 10, 0 h, to what the left-out terms make, and a star's place then."""
    r = sky.with_nutation(spark.range(1), num(2446895.5)).first()
    assert r.nut_lon == pytest.approx(-3.788, abs=0.01) and r.nut_tilt == pytest.approx(9.443, abs=0.01)
    assert one(spark, sky.mean_tilt(num(2446895.5)))[0] == pytest.approx(23 + 26 / 60 + 27.407 / 3600, abs=1e-6)
    pole = sky.with_nutation(spark.range(1), num(2451545.0))
    x, y = pole.select(*(c.alias(n) for c, n in zip(sky.true_position(num(90), num(0), num(2451545.0)), "ad", strict=True))).first()
    assert x == pytest.approx(90 + (-13.9 * 0.9175) / 3600, abs=1e-3) and y == pytest.approx(-5.8 / 3600, abs=1e-3)


def test_day_side_has_the_area_of_its_phase(spark):
    """Half of one and the cosine between star and Sun of the disc's area, for any view, the Sun in line or opposite too."""
    events = table(spark, SF, "elements").select("event_id", "et", "ra", "dec").limit(60)
    jd = shadow.jd_of(F.col("et"))
    sun = shadow.sun_direction(jd)
    ra, dec = sky.position(sun)
    line = events.limit(2).withColumns({"ra": F.when(F.col("event_id") % 2 == 0, ra).otherwise(sky.turn(ra + 180.0)), "dec": F.when(F.col("event_id") % 2 == 0, dec).otherwise(-dec), "event_id": F.col("event_id") + 10**9})
    both = events.unionByName(line)
    cosine = {r.event_id: r.c for r in both.select("event_id", sky.direction(F.col("ra"), F.col("dec")).dot(sun).alias("c")).collect()}
    outline: dict[int, list] = {}
    for r in globe.day_polygon(both, 400).orderBy("event_id", "k").collect():
        outline.setdefault(r.event_id, []).append((r.x, r.y))
    for i, points in outline.items():
        area = abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(points, [*points[1:], points[0]], strict=True))) / 2
        assert area == pytest.approx(math.pi * (1 + cosine[i]) / 2, abs=1e-3)
        assert max(math.hypot(*q) for q in points) <= 1 + 1e-9
    assert len(outline) == 62 and min(cosine.values()) < -0.99 and max(cosine.values()) > 0.99


def test_clipped_land_closes_and_covers_what_its_corners_enclose(spark):
    """Pieces meet end to start; the area equals a count of disc points within the outline, corners behind the Earth included."""
    rng = random.Random(11)
    pairs, lands = globes.views(spark, SF).limit(40), globes.land(spark, SF)
    pieces = globe.clipped(pairs, lands)
    rows: dict[int, list] = {}
    for r in pieces.collect():
        rows.setdefault(r.view, []).append(r)
    area = {r.view: r for r in globe.visible_area(pieces).collect()}
    assert set(area) == set(rows) and any(r.arcs for r in area.values()) and any(not r.arcs for r in area.values())
    points = [(x, y) for x, y in ((rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(4000)) if math.hypot(x, y) < 1]
    for view, part in rows.items():
        starts, ends = (sorted((round(a, 7) + 0.0, round(b, 7) + 0.0) for a, b in ((getattr(r, p), getattr(r, q)) for r in part)) for p, q in (("x", "y"), ("to_x", "to_y")))
        assert all(math.dist(a, b) < 1e-5 for a, b in zip(starts, ends, strict=True))
        segments = []
        for r in part:
            steps = 1
            if r.kind == "limb":
                a, b = math.atan2(r.y, r.x), math.atan2(r.to_y, r.to_x)
                steps = 200
                arc = [(math.cos(a + (b - a) % (2 * math.pi) * k / steps), math.sin(a + (b - a) % (2 * math.pi) * k / steps)) for k in range(steps + 1)]
                segments += list(zip(arc, arc[1:], strict=False))
            else:
                segments.append(((r.x, r.y), (r.to_x, r.to_y)))
        inside = 0
        for x, y in points:
            odd = sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in segments) % 2
            inside += odd
        assert area[view].area == pytest.approx(math.pi * inside / len(points), abs=0.09) and area[view].area > 0
    assert globe.clipped(pairs.limit(0), lands).count() == 0


def test_instants_equal_a_grid(spark):
    events = table(spark, SF, "elements")
    found = {(r.event_id, r.instant): r.dt for r in solve.instants(events).collect()}
    rows = events.limit(60).collect()
    hit = 0
    for r in rows:
        k = math.sqrt(1 - (2 - 1 / 298.257223563) / 298.257223563 * math.cos(math.radians(r.dec)) ** 2)
        at = lambda t, r=r, k=k: (r.x0 + t * (r.vx + t * r.ax), (r.y0 + t * (r.vy + t * r.ay)) / k)
        off = lambda t, at=at: math.hypot(*at(t)) - 6378.137
        centre = found[r.event_id, "centre"]
        true = lambda t, at=at, k=k: math.hypot(at(t)[0], at(t)[1] * k)
        assert true(centre) <= min(true(centre + d) for d in (-5.0, -0.01, 0.01, 5.0)) + 1e-6
        assert ((r.event_id, "touch-down") in found) == ((r.event_id, "leaving") in found) == (off(centre) < 0)
        if off(centre) < 0:
            hit += 1
            for name, sign in (("touch-down", -1), ("leaving", 1)):
                t = found[r.event_id, name]
                assert off(t + sign * 0.01) > 0 > off(t - sign * 0.01) and all(off(centre + (t - centre) * q / 50) < 0 for q in range(50))
    assert 5 < hit < 60


@pytest.mark.parametrize(("given", "want"), [("48.5, 16.25", (48.5, 16.25)), ("N 48°30' E 16°15'", (48.5, 16.25)), ("16°15'0\" W 48°30' S", (-48.5, -16.25)), ("48.5", None), ("95, 10", None), ("", None), (None, None)])
def test_coordinates(spark, given, want):
    df = spark.createDataFrame([(given,)], "t string")
    c = text.coordinates(F.col("t"))
    r = df.select(c["lat"], c["lon"]).first()
    assert (r[0] is None) if want is None else (tuple(r) == pytest.approx(want))


def test_log_reader_is_tolerant(spark, tmp_path):
    (tmp_path / "log.csv").write_text('﻿id,name\n1,"a, b"\n\nid,name\n2,c\n3,d,extra\n4\n', encoding="utf-8")
    assert sorted(map(tuple, files.read_log(spark, str(tmp_path / "log.csv"), ["id", "name"]).collect())) == [("1", "a, b"), ("2", "c")]


def test_order_of_a_key_over_many_ranges(spark):
    """One key of nearly all rows, a null one, ties settled by id: places as one sort gives them, over several ranges."""
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), rng.choice([None, 1, 2, 3]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = results.ordered(df, ["k"], [F.asc_nulls_last("v"), F.col("id")])
        got = {(r.k, r.id): r.pos for r in done.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for key in ("hot", "b", None):
        want = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        assert [got[key, r[2]] for r in want] == list(range(1, len(want) + 1))
    assert len(got) == 3000 and results.ordered(df.limit(0), ["k"], [F.col("id")]).collect() == []


def test_log_headers_reach_over_splits(spark, tmp_path):
    """A header far before, in another split of the file, still holds; before the first one no row counts; another file's doesn't matter."""
    rng = random.Random(5)
    want, lines, header, skipped = [], ["1,too early"], None, 1
    for k in range(3000):
        if rng.random() < 0.01:
            header = rng.choice([["id", "a"], ["id", "b", "a"], ["id", "a", "c", "d"]])
            lines.append(",".join(header))
        width = len(header) if header and rng.random() < 0.9 else rng.randint(1, 5)
        row = [str(k + 10), *(f"v{k}{c}" for c in range(width - 1))]
        lines.append(",".join(row))
        if header and len(header) == width:
            want.append((row[0], row[header.index("a")], dict(zip(header, row, strict=True)).get("b")))
        else:
            skipped += 1
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.csv").write_text("\n".join(lines))
    (tmp_path / "logs" / "b.csv").write_text("7,x\nid,b\n8,y\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = files.log_lines(spark, str(tmp_path / "logs"), "id")
        got = sorted(map(tuple, files.read_log(spark, str(tmp_path / "logs"), ["id", "a", "b"]).collect()), key=str)
        assert spark.read.text(str(tmp_path / "logs")).rdd.getNumPartitions() > 4 and rows.where("NOT ok").count() == skipped + 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted([*want, ("8", None, "y")], key=str)


def test_label_gives_the_layout(spark, tmp_path):
    field_ = lambda n, a, w, t: f"<Field_Character><name> {n} </name><field_location unit='byte'>{a}</field_location><data_type>{t}</data_type><field_length>{w}</field_length></Field_Character>"
    label = tmp_path / "label.xml"
    label.write_text("<P>" + field_("N", 1, 4, "ASCII_Integer") + "\n" + field_("D", 6, 6, "ASCII_Real") + field_("T", 13, 5, "ASCII_String") + "</P>")
    (tmp_path / "t.tab").write_text("   7  12.50 ab c\n  12 -9.999 \n\nx    -0.5   é\n")
    assert files.labelled_layout(spark, str(label)) == {"N": (1, 4, "bigint"), "D": (6, 6, "double"), "T": (13, 5, "string")}
    rows = files.read_labelled(spark, str(tmp_path / "t.tab"), str(label), ["T", "N", "D"], -9.9)
    assert {tuple(r) for r in rows.collect()} == {("ab c", 7, 12.5), (None, 12, None), ("é", None, -0.5)}
    with pytest.raises(ValueError, match="no field X"):
        files.read_labelled(spark, str(tmp_path / "t.tab"), str(label), ["X"])
    label.write_text("<P><Field_Character><name>N</name></Field_Character></P>")
    with pytest.raises(ValueError, match="place, length"):
        files.labelled_layout(spark, str(label))


@pytest.mark.parametrize("killed_at", [(0, "todo"), (1, "screen"), (1, "events"), (2, "done")])
def test_a_killed_build_goes_on_to_the_same_events(spark, tmp_path, killed_at):
    """Killed anywhere in a batch, then run again: as one run, with no body in two batches; other settings are refused."""
    numbers = table(spark, SF, "asteroids").select("number").where("number < 40")
    source = str(tmp_path / "in")
    for k in range(3):
        numbers.where(f"number % 3 = {k} OR number % 10 = {k}").coalesce(1).write.mode("append").parquet(source)

    def run(name: str, kill: tuple[int, str] | None = None, settings: dict | None = None) -> None:
        calls = []

        def screen(bodies):
            calls.append(1)
            if kill and kill[1] == "screen" and len(calls) == kill[0] + 1:
                # Fails when the events are half written.
                return bodies.repartition(5).withColumn("event", F.when(F.col("number") % 4 == 1, F.raise_error(F.lit("killed")).cast("int")).otherwise(1))
            return bodies.select("number", F.explode(F.sequence(F.lit(0), (F.col("number") % 3).cast("int"))).alias("event"))

        def said(batch: int, step: str) -> None:
            if (batch, step) == kill:
                raise RuntimeError("killed")

        increments.build(source, numbers.schema, str(tmp_path / name), str(tmp_path / name / "ck"), screen, settings or {"g": 12}, spark, said=said)

    run("one")
    with pytest.raises(Exception, match="killed"):
        run("two", killed_at)
    run("two")
    run("two")
    one, two = (sorted(tuple(r) for r in increments.events_of(spark, str(tmp_path / n)).select("number", "event").collect()) for n in ("one", "two"))
    assert one == two == sorted((r.number, e) for r in numbers.collect() for e in range(r.number % 3 + 1))
    log = {r.batch: (r.bodies, r.events) for r in increments.batches_of(spark, str(tmp_path / "two")).collect()}
    assert sorted(log) == [0, 1, 2] and sum(b for b, _ in log.values()) == numbers.count() and sum(e for _, e in log.values()) == len(two)
    with pytest.raises(ValueError, match="other settings"):
        run("two", settings={"g": 13})


def test_filled_records_keep_what_they_have(spark):
    rows = spark.createDataFrame([(1, "a", 5.0), (2, None, None), (3, " ", 7.0), (4, "nan", None), (None, "", None)], "id int, name string, size double")
    sources = {"s": backfill.Source(spark.createDataFrame([(2, "two"), (3, None)], "k int, n string"), {"k": F.col("id")}), "t": backfill.Source(spark.createDataFrame([(3, "three", 1.5), (4, "", 2.5)], "k int, n string, z double"), {"k": F.col("id")})}
    done = backfill.filled(rows, sources, {"name": [("s", F.col("s.n")), ("t", F.col("t.n"))], "size": [("t", F.col("t.z")), ("name", F.length("name").cast("double"))]})
    got = {r.id: tuple(r)[1:] for r in done.select("id", "name", "size", "name_from", "size_from").collect()}
    assert got == {1: ("a", 5.0, "own", "own"), 2: ("two", None, "s", None), 3: ("three", 7.0, "t", "own"), 4: (None, 2.5, None, "t"), None: (None, 0.0, None, "name")}
    plan = plan_of(done)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_geodetic_round_trip(spark):
    v = earth.earth_fixed(num(-33.3), num(20), num(2500))
    lat, height = earth.geodetic(F.sqrt(v.x * v.x + v.y * v.y) / earth.EARTH_KM, v.z / earth.EARTH_KM)
    assert tuple(one(spark, lat, height)) == pytest.approx((-33.3, 2500.0), abs=1e-5)


def scanned_partitions(df) -> int:
    """Folders that the scans of a collected query have read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    todo, total = [plan], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            total += node.metrics().apply("numPartitions").value() if node.metrics().contains("numPartitions") else 0
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if "QueryStage" in name:
            todo.append(node.plan())
    return total


def test_index_reads_only_the_folders_it_needs(spark, tmp_path):
    path = f"{tmp_path}/index"
    ground_index.build(table(spark, SF, "elements"), path, 60.0, 5.0, -6.0)
    index = ground_index.load(spark, path, 60.0, 5.0, -6.0)
    folders = len(list((tmp_path / "index").glob("day=*/tile=*")))
    assert folders > 300
    box = ground_index.in_box(index, 34.0, 72.0, -25.0, 45.0)
    assert "PartitionFilters" in plan_of(box) and 0 < scanned_partitions(box) <= 0.2 * folders
    day = ground_index.at_times(index, 3 * 86400.0, 3.2 * 86400.0, 3600.0)
    assert 0 < scanned_partitions(day) <= folders / 3
    some = table(spark, SF, "sites").where("site_id = 3").select("site_id", "lat", "lon", "ele_m", "reach_km")
    pairs = ground_index.near_sites(index, some)
    assert "dynamicpruning" in plan_of(pairs) and 0 < scanned_partitions(pairs) <= 0.1 * folders
    with pytest.raises(ValueError, match="reach up to 60"):
        ground_index.load(spark, path, 61.0, 5.0, -6.0)


def test_empty_index_and_request_at_the_seam(spark, tmp_path):
    none = table(spark, SF, "elements").limit(0)
    ground_index.build(none, f"{tmp_path}/none", 60.0, 5.0, -6.0)
    assert ground_index.bounds(ground_index.load(spark, f"{tmp_path}/none", 60.0, 5.0, -6.0)).count() == 0
    rows = lambda lat, lon, km: {(r.row, r.col) for r in ground_index.with_cells(spark.range(1).select(num(lat).alias("lat"), num(lon).alias("lon"), num(km).alias("__km"))).collect()}
    assert rows(0.1, 179.9, 100.0) == {(5, 23), (5, 0), (6, 23), (6, 0)}
    assert {c for r, c in rows(88.5, 10.0, 100.0)} == set(range(24)) and max(r for r, _ in rows(88.5, 10.0, 100.0)) == 11
    assert tuple(spark.range(1).select(ground_index.cell(num(90), num(180)).alias("c")).first().c) == (11, 0)


def test_circles_of_cells_hold_all_places_within(spark):
    rng = random.Random(14)
    circles = [(rng.uniform(-90, 90), rng.uniform(-180, 180), rng.choice([1.0, 300.0, 2000.0])) for _ in range(150)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(circles)], "i int, lat double, lon double, km double")
    held: dict[int, set] = {}
    for r in ground_index.with_cells(df.withColumnRenamed("km", "__km")).collect():
        held.setdefault(r.i, set()).add((r.row, r.col))
    near = []
    for i, (lat, lon, km) in enumerate(circles):
        for _ in range(40):
            # A place at some distance in some direction, on the sphere.
            d, a, p = rng.uniform(0, km) / 6371.0, rng.uniform(0, 2 * math.pi), math.radians(lat)
            q = math.asin(math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(a))
            near.append((i, math.degrees(q), lon + math.degrees(math.atan2(math.sin(a) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(q)))))
    there = spark.createDataFrame(near, "i int, lat double, lon double").select("i", ground_index.cell(F.col("lat"), F.col("lon")).alias("c")).collect()
    assert all(tuple(r.c) in held[r.i] for r in there)


def test_regions_by_name_or_box():
    from umbra.operators import shadow

    assert len(shadow.REGIONS) == 11 and set(shadow.region(" Europe ")) == set(shadow.region("-10,10,170,-170"))
    for bad in ("atlantis", "1,2,3", "10,-10,0,5", "-91,0,0,5"):
        with pytest.raises(ValueError, match="no region"):
            shadow.region(bad)


def test_list_rows_and_settings(spark):
    from umbra.sources import files

    text = "Search Results for filter 35 km from shadow, StarMag: 13.5, MinDur: 0.2, DetectionFrames: 6\n(12) Victoria NALowMag\t2026-Mar-05, 01:02:03 ☼ -5°\t 12.5\t 3.1\t 4.2\t 45 x\n(7) No date\tsoon\t1\t2\t3\t4\n\nfree (text)\n(99) B\t2026-Dec-31, 23:59:59\t9\t0.5\t1\t7"
    df = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    assert [tuple(r)[1:] for r in files.read_list(df).collect()] == [(12, "Victoria NALowMag", "2026-03-05T01:02:03", -5.0, 12.5, 3.1, 4.2, 45.0), (99, "B", "2026-12-31T23:59:59", None, 9.0, 0.5, 1.0, 7.0)]
    first, none, _ = [r.asDict() for r in files.list_settings(df).collect()]
    assert first == {"starmag": 13.5, "mindur": 0.2, "aperture": 25.0, "detectionframes": 6.0, "minstaraltitude": 10.0, "km_from_shadow": 35.0}
    assert none["starmag"] == 15.0 and none["km_from_shadow"] == 20.0


def test_best_picks_equal_all_pairs(spark):
    import datetime

    random.seed(8)
    day = lambda: datetime.date(2026, 1, 1) + datetime.timedelta(random.randrange(6))
    picks = [(k, random.randrange(3), day(), random.randrange(1, 6), random.randrange(4), random.choice([None, 40.0, 40.02]), 10.0) for k in range(300)]
    asked = [(k, random.randrange(4), day(), random.randrange(1, 4), 40.0, 10.0) for k in range(300)]
    got = records.covering_pick(spark.createDataFrame(asked, "request bigint, site int, start date, days int, lat double, lon double"), spark.createDataFrame(picks, "pick bigint, site int, start date, days int, picked int, lat double, lon double"))
    want = {}
    for r, site, start, days, lat, _ in asked:
        fit = [(p[4], p[2], p[0]) for p in picks if p[1] == site and p[2] <= start and p[2] + datetime.timedelta(p[3]) >= start + datetime.timedelta(days) and (p[5] is None or abs(p[5] - lat) <= 0.01)]
        if fit:
            want[r] = max(fit)[2]
    assert {r.request: r.pick for r in got.collect()} == want
    # Many requests and picks of few days and places meet in few pairs.
    alike = spark.range(2000)
    many = records.covering_pick(alike.selectExpr("id AS request", "1 AS site", "DATE'2026-01-02' AS start", "1 AS days", "40D AS lat", "10D AS lon"), alike.selectExpr("id AS pick", "1 AS site", "DATE'2026-01-01' AS start", "3 AS days", "1 AS picked", "CAST(NULL AS DOUBLE) AS lat", "10D AS lon"))
    assert many.select("pick").distinct().collect() == [(1999,)] and many.count() == 2000


def test_roots_are_finer_than_the_last_half():
    import numpy as np

    at = np.array([0.3, -7.77, 12.34567])
    found = solve._root(lambda t: t - at[:, None], np.full(3, -30.0), np.full(3, 30.0), 1e-6)
    assert np.abs(found - at).max() < 1e-12
    # One whose sign stays the same ends at the border.
    assert solve._root(lambda t: t * 0 - 1.0, np.array([0.0]), np.array([8.0]), 1e-6)[0] == pytest.approx(8.0, abs=1e-5)


def test_minimum_of_a_flat_distance_is_exact(spark):
    # From the driver's 0.1 GB: sections alone were 1e-6 s off and so fell on the other side of half a second.
    x, y, vx, vy = 8000.0, -2890.0, 6.0, 3.1
    rows = [(k, 604800.0 + k, x + k * 7.3, y - k, vx, vy, 0.0, 0.0) for k in range(200)]
    found = solve.minimised(spark.createDataFrame(rows, "event_id bigint, et double, x0 double, y0 double, vx double, vy double, ax double, ay double"), 7200.0, 1e-6).collect()
    for r in found:
        _, et, a, b, *_ = rows[r.event_id]
        assert r.t_min - et == pytest.approx(-(a * vx + b * vy) / (vx * vx + vy * vy), abs=1e-9)


def test_moons_by_the_planet_that_is_given(spark):
    moons = spark.createDataFrame([(60003, 32.0, None), (603, 32.0, None)], "naif bigint, radius_km double, h double")
    by = lambda df: {r.naif: r.h for r in df.collect()}
    given, own = by(light.completed_moons(moons, F.expr("naif div 100"))), by(light.completed_moons(moons))
    assert given[60003] == pytest.approx(9.47) and own[60003] == pytest.approx(7.34) and given[603] == own[603] == pytest.approx(7.34)


def test_observatories_with_long_codes(spark, tmp_path):
    from umbra.plans import texts

    ids = (7, 999, 1083, 123456)
    spark.createDataFrame([(i, f"s{i}", i % 5, 1.0) for i in ids], "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r.code: r for r in texts.observatory_rows(spark, str(tmp_path)).collect()}
    sites = {r.site_id: r for r in table(spark, str(tmp_path), "sites").collect()}
    assert set(got) == {f"{i:03d}" for i in ids}
    for i in ids:
        assert got[f"{i:03d}"].lat == pytest.approx(sites[i].lat, abs=6e-4)
        # Rounded once: by way of five places 11.70449... would end as 11.705.
        assert got[f"{i:03d}"].lon == pytest.approx(round(sites[i].lon % 360, 3), abs=1e-9)


def test_circles_of_many_sizes_join_by_levels(spark):
    random.seed(5)
    point = lambda i: (i, random.uniform(0, 360), math.degrees(math.asin(random.uniform(-1, 1))))
    seam = [(900, 0.05, 10.0), (901, 359.95, 10.0), (902, 10.0, 89.9), (903, 190.0, 89.95), (904, 200.0, -89.99)]
    a = spark.createDataFrame([(*p, random.choice([0.4, 1.5, 4.0, 40.0, 170.0])) for p in [point(i) for i in range(200)] + seam] + [(950, 5.0, 5.0, None)], "a bigint, ra double, dec double, r double")
    b = spark.createDataFrame([point(i) for i in range(300)] + seam, "b bigint, star_ra double, star_dec double")
    want = {tuple(r) for r in cells.cell_join(a, b, F.col("r"), 1.5).select("a", "b").collect()}
    found = cells.cell_join(a, b, F.col("r"), 1.5, spread_right=True, right_u=("x", "y", "z")).select("a", "b", "z", "star_dec").collect()
    assert len(found) == len(want) and {(r.a, r.b) for r in found} == want and any(x >= 900 and y >= 900 and x != y for x, y in want)
    assert all(r.z == pytest.approx(math.sin(math.radians(r.star_dec))) for r in found)


def test_unfolded_rows_are_not_sent_to_all_tasks(spark):
    # Spark takes unfolded rows for as few as before: a join would gather all samples on the driver.
    from umbra.plans import registry

    for name in ("local_minima", "cone_cells", "windows_screen", "pick_slice_topk", "mag_cap", "pick_cap", "ephemeris_states", "hermite_window"):
        plan = plan_of(registry.queries()[name](spark, SF))
        assert "BroadcastHashJoin" not in plan and "NestedLoop" not in plan and "SortMergeJoin" in plan, name


def test_names_of_targets_are_no_column_of_each_row(spark):
    rows = [("p", "s", 2.5, k, k, f"O'Neil \\ {k}" if k % 2 else f"Body {k}", "n") for k in range(60)]
    picks = spark.createDataFrame(rows, "pick string, site string, days double, pos int, number bigint, name string, note string").withColumn("start", F.lit("2026-01-01").cast("date"))
    back = files.read_targets(files.targets_text(picks))
    assert sorted((r.pos, r.number, r.name) for r in back.collect()) == [(k, str(k), name) for _, _, _, k, _, name, _ in rows]
    assert "map<" not in back._jdf.queryExecution().analyzed().schema().json() and "map_from_entries" not in plan_of(back)
    own = spark.createDataFrame([(1, "# events 2026-01-01 + 1.0 d, site A\n\ntargets = [\n    '7',  # x\n    '8',  # y\n    '7',  # z\n]\n\ntarget_names = {\n    '7': 'one',\n    '7': 'two',\n}\n"), (2, "no window")], "id int, text string")
    assert sorted((r.id, r.pos, r.number, r.name) for r in files.read_targets(own).collect()) == [(1, 0, "7", "two"), (1, 1, "8", None), (1, 2, "7", "two")]


def test_index_has_one_row_for_an_event_in_a_cell(spark, tmp_path):
    path = f"{tmp_path}/index"
    events = table(spark, SF, "elements").where("event_id % 50 = 0")
    ground_index.build(events, path, 60.0, 5.0, -6.0)
    rows = ground_index.load(spark, path, 60.0, 5.0, -6.0)
    assert rows.count() == rows.select("event_id", "row", "col").distinct().count() > 0
    # The bits are the usable samples whose observers reach the cell.
    used = shadow.usable(shadow.samples(events, 41), 70.0, 4.0, -5.0).where("ok")
    spread = ground_index.with_cells(ground_index.with_margin(used, 70.0, 4.0)).select("event_id", "row", "col", F.expr("shiftleft(1L, k)").alias("bit"))
    want = {(r.event_id, r.row, r.col): r.ks for r in spread.groupBy("event_id", "row", "col").agg(F.sum("bit").alias("ks")).collect()}
    assert {(r.event_id, r.row, r.col): r.ks for r in rows.collect()} == want


def test_companions_are_added_up_without_lists(spark):
    rng = random.Random(9)
    stars = spark.createDataFrame([(k, rng.uniform(10, 12), rng.uniform(60, 61), rng.choice([None, 5.0, 90.0]), 3.0, rng.choice([None, 8.0, 12.0, 16.0])) for k in range(300)] + [(900, 200.0, -80.0, 0.0, 0.0, 9.0)], "source_id bigint, ra double, dec double, pmra double, pmdec double, g double")
    events = stars.where("source_id % 3 = 0").select("source_id", "ra", "dec", "g")
    lists = catalog.companions(events, stars, 10.0, 900.0).select("source_id", F.size("companions").alias("n"), F.get("companions", F.lit(0))["sep"].alias("nearest"), F.get("companions", F.lit(0))["g"].alias("near_g"), F.aggregate("companions", num(0), lambda a, c: a + F.pow(F.lit(10.0), c["g"] * -0.4)).alias("light"))
    want, found = {r.source_id: r for r in lists.collect()}, catalog.companion_light(events, stars, 10.0, 900.0)
    got = found.select("source_id", "n", "nearest", "near_g", "light").collect()
    assert len(got) == len(want) and max(r.n for r in got) > 20 and any(r.n == 0 for r in got)
    for r in got:
        w = want[r.source_id]
        assert (r.n, r.near_g) == (w.n, w.near_g) and r.light == pytest.approx(w.light) and r.nearest == pytest.approx(w.nearest, abs=1e-8)
    plan = plan_of(found)
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and "NestedLoop" not in plan


def test_unfolded_rows_are_grouped_where_they_stand(spark):
    """Only the events are shuffled, once: neither a join back to them nor the grouping of their many points moves any."""
    from umbra.plans import registry

    for name in ("axis_course",):
        plan = plan_of(registry.queries()[name](spark, SF))
        assert plan.count("Exchange ") == 1 and "Join" not in plan, name


def test_bodies_that_bend_light_are_added_up_on_the_row(spark):
    """No ray is shuffled or grouped, for few keys would be few tasks; a ray without bodies stays, one without the Sun has no plane."""
    rays = spark.createDataFrame([(1, "a", None, 0.6), (2, "a", 5, -0.8), (3, "none", None, 0.1), (4, "dark", None, 0.2)], "ray bigint, day string, centre int, px double").withColumns({"py": F.sqrt(1 - F.col("px") ** 2), "pz": num(0), "tx": 3e8 * F.col("px"), "ty": 3e8 * F.sqrt(1 - F.col("px") ** 2), "tz": num(1e4), "target_au": num(2)})
    bodies = spark.createDataFrame([("a", 10, 1.3e11, 1.4e8, 3e7, 2e7), ("a", 5, 1.3e8, -8e8, 1e7, 3e7), ("dark", 5, 1.3e8, -8e8, 1e7, 3e7)], "day string, body int, gm double, bx double, by_ double, bz double")
    found = ephemeris.deflected(rays, bodies)
    got = {r.ray: r for r in found.collect()}
    assert {k: [b.body for b in r["by"]] for k, r in got.items()} == {1: [5, 10], 2: [10], 3: [], 4: [5]} and got[3].bent_mas == 0
    both = rays.join(bodies, "day").where("NOT centre <=> body")
    p, t, b = (Vec(*(F.col(c) for c in names)) for names in (("px", "py", "pz"), ("tx", "ty", "tz"), ("bx", "by_", "bz")))
    bend = sky.light_bend(p, b.times(-1.0), p, F.col("gm")).minus(sky.light_bend(p, b.times(-1.0), t.minus(b).unit(), F.col("gm")))
    for r in both.groupBy("ray").agg(*[F.sum(c).alias(f"d{k}") for k, c in zip("xyz", bend, strict=True)]).collect():
        assert tuple(got[r.ray][c] for c in ("dx", "dy", "dz")) == pytest.approx((r.dx, r.dy, r.dz), rel=1e-6, abs=1e-18)
    _, curve = globe.system(rays, bodies, 5, 6)
    assert {(r.ray, r.k) for r in curve.collect()} == {(ray, k) for ray in (1, 2) for k in range(1, 12)}
    for df in (ephemerides.star_deflection(spark, SF), globes.star_ray(spark, SF)):
        # The days that have events are found by grouping, and listed; nothing else is.
        assert "SortMergeJoin" not in plan_of(df) and "ray" not in "".join(line for line in plan_of(df).splitlines() if "Aggregate" in line or "hashpartitioning" in line)


def test_bodies_of_one_file_are_dealt_to_all_tasks(spark):
    sky_ = ephemerides.planets(spark, 2460780.0, 2460860.0)
    found = ephemeris.integrated(bodies_of(spark).coalesce(1), sky_, [2460820.5])
    assert len({r.task for r in found.select(F.spark_partition_id().alias("task")).distinct().collect()}) == 4


def test_log_windows_are_short(spark, tmp_path):
    """A header holds over any number of pieces of a split."""
    lines = ["1,early", "id,a", *[f"{k},x{k}" for k in range(50)], "id,b,a", "60,y,z"]
    (tmp_path / "log.csv").write_text("\n".join(lines))
    want = sorted(map(tuple, files.log_lines(spark, str(tmp_path / "log.csv"), "id").select(F.array_join("header", ","), F.array_join("fields", ","), "ok").collect()), key=str)
    got = sorted(map(tuple, files.log_lines(spark, str(tmp_path / "log.csv"), "id", most=3).select(F.array_join("header", ","), F.array_join("fields", ","), "ok").collect()), key=str)
    assert got == want and len(got) == 52 and sum(r[2] for r in got) == 51


def test_points_of_paths_lose_no_digits_of_time(spark):
    """Points agree with SQL far below what a map shows, so that hardly one of millions is rounded otherwise."""
    import duckdb

    from umbra.plans.tables import filled

    events = table(spark, SF, "elements").withColumn("sigma_km", F.col("r_km") / 4)
    got = {(r.event_id, r.line, r.k): (r.lat, r.lon) for r in solve.path_lines(events, 21).collect()}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    want = {tuple(r[:3]): r[3:] for r in duck.execute(f"WITH {filled(solving.lines_sql(21))} SELECT event_id, line, k, lat, lon FROM pts").fetchall()}
    off = [abs(a - b) for k in want for a, b in zip(got[k], want[k], strict=True)]
    assert got.keys() == want.keys() and sum(off) / len(off) < 5e-14


def test_paths_meet_stars_in_blocks(spark, monkeypatch):
    """Minima over paths of several pieces and blocks equal those of all pairs; no pair of a sample and a star is a row, and none is refined by lambdas."""
    from umbra.operators import swath
    from umbra.plans import registry

    monkeypatch.setattr(swath, "SAMPLE_BLOCK", 70)
    monkeypatch.setattr(swath, "STAR_BLOCK", 40)
    rng = random.Random(11)
    # The last sample of one path, and a star, aren't known; paths cross the seam and pass near the pole.
    starts = [(1, 358.9, 10.0, 0.02, 0.003), (2, 100.0, -20.0, -0.03, 0.03), (3, 40.0, 89.0, 0.5, 0.004), (4, 2.0, 10.3, 0.0, 0.0)]
    rows = [(n, j, 600.0 * j, None if (n, j) == (2, 149) else (ra + vra * j) % 360, dec + vdec * j, 2.0) for n, ra, dec, vra, vdec in starts for j in range(150 if n < 4 else 1)]
    samples = tracks.with_directions(spark.createDataFrame(rows, "number bigint, j int, et double, ra double, dec double, delta_au double"))
    points = [(359.5 + rng.uniform(0, 4), 10.3 + rng.uniform(-1.5, 1.5)) for _ in range(150)] + [(97.0 + rng.uniform(-4, 4), -18.0 + rng.uniform(-3, 3)) for _ in range(150)] + [(rng.uniform(0, 360), rng.uniform(87.5, 90)) for _ in range(60)]
    stars = spark.createDataFrame([(k, ra % 360, dec) for k, (ra, dec) in enumerate(points)] + [(999, None, 10.0)], "source_id bigint, star_ra double, star_dec double")
    got = {(r.number, r.source_id, r.j) for r in scan.minima(samples, stars, 4e6, 600.0, 2.0).collect()}
    unit = lambda ra, dec: (math.cos(math.radians(dec)) * math.cos(math.radians(ra)), math.cos(math.radians(dec)) * math.sin(math.radians(ra)), math.sin(math.radians(dec)))
    limits = {r.number: r.limit_km for r in scan._ready(samples, 4e6, 600.0).groupBy("number").agg(F.max("limit_km").alias("limit_km")).collect()}
    want = set()
    for n in (1, 2, 3):
        path = [(r[1], unit(r[3], r[4]) if r[3] is not None else None) for r in rows if r[0] == n]
        for k, (ra, dec) in enumerate(points):
            s, km = unit(ra, dec), 2.0 * 149597870.7
            d2 = [math.inf] + [max(2 - 2 * sum(a * b for a, b in zip(s, u, strict=True)), 0) * km * km if u else math.inf for _, u in path] + [math.inf]
            want |= {(n, k, path[i - 1][0]) for i in range(1, len(d2) - 1) if d2[i] <= d2[i - 1] and d2[i] < d2[i + 1] and d2[i] < limits[n] ** 2}
    assert got == want and {n for n, _, _ in got} == {1, 2, 3} and {j for _, _, j in got} >= {63, 64} and len({r.k for r in spark.createDataFrame([(k,) for _, k, _ in got], "k int").collect()}) > 100
    near = scan.candidates(samples, stars, 4e6, 600.0, 2.0, 4.2e6).collect()
    assert {(r.number, r.source_id, r.j) for r in near} < got and all(r.d_km <= 4.2e6 and abs(r.et_guess - 600.0 * r.j) <= 600.0 for r in near)
    for name in ("candidates_refined", "refine_and_bracket", "candidates_order", "local_minima"):
        plan = plan_of(registry.queries()[name](spark, SF))
        joined = next(line for line in plan.splitlines() if "SortMergeJoin" in line)
        assert "MapInArrow" in plan and "121" not in plan and "__cell" in joined, name


def test_nearest_star_and_windows_make_no_rows_of_pairs(spark):
    """Both equal all pairs, over paths of several pieces; neither sorts nor shuffles pairs of a sample and a star."""
    from umbra.plans import registry

    rng = random.Random(12)
    rows = [(n, j, 600.0 * j, (359.0 + n + 0.01 * j) % 360, 5.0 + 0.004 * j, 2.0, 13.0 + 0.01 * j, 13.0 + (j % 5) - n) for n in range(4) for j in range(140)]
    samples = tracks.with_directions(spark.createDataFrame(rows, "number bigint, j int, et double, ra double, dec double, delta_au double, m_ast double, faintest double"))
    points = [(k, rng.uniform(-3, 6) % 360, rng.uniform(3, 8), rng.uniform(9, 18)) for k in range(200)]
    points += [(500 + k, ra, dec, g) for k, ra, dec, g in points[:100]]
    stars = spark.createDataFrame(points, "source_id bigint, star_ra double, star_dec double, g double")
    unit = lambda ra, dec: (math.cos(math.radians(dec)) * math.cos(math.radians(ra)), math.cos(math.radians(dec)) * math.sin(math.radians(ra)), math.sin(math.radians(dec)))
    gaps = [(r[0], r[1], p[0], math.dist(unit(r[3], r[4]), unit(p[1], p[2])), r[7] >= p[3]) for r in rows for p in points]
    for radius in (0.8, 0.02):
        widest = 2 * math.sin(math.radians(radius) / 2)
        got = {r.number: (r.source_id, r.j, r.sep) for r in scan.nearest(samples, stars, radius, 1.0).collect()}
        for n in range(4):
            near = [(math.degrees(2 * math.asin(c / 2)), k, j) for m, j, k, c, bright in gaps if m == n and c <= widest and bright]
            assert (n in got) == bool(near)
            if near:
                sep, k, j = min((round(s, 12), k, j) for s, k, j in near)
                assert got[n][:2] == (k, j) and got[n][2] == pytest.approx(sep, abs=1e-11)
        km = 2.0 * 149597870.7
        want: dict = {}
        for n, _, k, c, _ in gaps:
            if c <= widest and c * km < 2e6:
                want[n, k] = min(want.get((n, k), math.inf), c * km)
        found = {(r.number, r.source_id): math.sqrt(r.d2) for r in scan.closest(samples, stars, radius, 1.0, 2e6).collect()}
        assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], abs=50) for k in want)
    pick, windows = (plan_of(registry.queries()[n](spark, SF)) for n in ("pick_slice_topk", "windows_screen"))
    assert "MapInArrow" in pick and "row_number" not in pick and windows.index("MapInArrow") < windows.index("Aggregate")


def test_index_is_summed_up_without_writing_it(spark, tmp_path):
    """Bounds and loads equal those of the written index; neither they nor regions write it, sort all samples, or move more than the events."""
    from umbra.plans import registry, shadows

    events = table(spark, SF, "elements").where("event_id % 10 = 0")
    ground_index.build(events, f"{tmp_path}/index", 60.0, 5.0, -6.0)
    index, found = ground_index.load(spark, f"{tmp_path}/index", 60.0, 5.0, -6.0), ground_index.occupied(events, 60.0, 5.0, -6.0)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(ground_index.bounds_of(found)) == rows(ground_index.bounds(index)) != []
    stored = index.groupBy("row", "col").agg(F.count("*").alias("events"), F.sum(F.bit_count("ks")).alias("samples"))
    assert rows(ground_index.load_of_cells(found).select("row", "col", "events", "samples")) == rows(stored)
    before = dict(shadows._INDEXES)
    for name in ("track_bounds", "index_cells", "region_events", "region_numbers"):
        plan = plan_of(registry.queries()[name](spark, SF))
        assert "Window" not in plan and "/ground-" not in plan, name
    assert before == shadows._INDEXES
