"""Constants whose values results depend on. Fixed values."""

EARTH_KM = 6378.137
FLATTENING = 1 / 298.257223563
AU_KM = 149597870.7
LIGHT_KM_S = 299792.458
PARSEC_KM = 3.0856775814913673e13
CATALOG_YEAR = 2016.0
YEAR_DAYS = 365.25
DAY_S = 86400.0
EARTH_SPIN = 7.2921150e-5
TDB_UTC = 69.184
OBLIQUITY_ARCSEC = 84381.448
KM_PER_DEGREE = 111.2
POLAR_LAT = 80.0

#: GM in AU^3/day^2 of the Sun and the planet-system barycentres 1 to 9 (DE440).
GM_SUN = 2.9591220828411956e-04
GM_PLANETS = {
    1: 4.9125001948893182e-11,
    2: 7.2434523326441187e-10,
    3: 8.9970116036316091e-10,
    4: 9.5495488297258119e-11,
    5: 2.8253458252257917e-07,
    6: 8.4597059933762903e-08,
    7: 1.2920265649682399e-08,
    8: 1.5243573478851939e-08,
    9: 2.1750964648933581e-12,
}

#: Spin of the bright-star frame: G from, G to, rates about x, y, z in microarcseconds a year
#: (Cantat-Gaudin & Brandt 2021, table 1).
BRIGHT_SPIN = [
    (0.0, 9.0, 18.4, 33.8, -11.3),
    (9.0, 9.5, 14.0, 30.7, -19.4),
    (9.5, 10.0, 12.8, 31.4, -11.8),
    (10.0, 10.5, 13.6, 35.7, -10.5),
    (10.5, 11.0, 16.2, 50.0, 2.1),
    (11.0, 11.5, 19.4, 59.9, 0.2),
    (11.5, 11.75, 21.8, 64.2, 1.0),
    (11.75, 12.0, 17.7, 65.6, -1.9),
    (12.0, 12.25, 21.3, 74.8, 2.1),
    (12.25, 12.5, 25.7, 73.6, 1.0),
    (12.5, 12.75, 27.3, 76.6, 0.5),
    (12.75, 13.0, 34.9, 68.9, -2.9),
]

#: Typical errors of a catalog star: G, position in mas, proper motion in mas a year (Lindegren et al. 2021).
TYPICAL_ERRORS = [(12.0, 0.015, 0.02), (15.0, 0.02, 0.025), (17.0, 0.05, 0.07), (19.0, 0.15, 0.2), (20.0, 0.4, 0.5), (21.0, 1.0, 1.4)]

CELL_DEG = 0.25
FAST_MAS_YR = 1500.0
RUWE_GOOD = 1.4
UNKNOWN_PM_MAS_YR = 10.0
#: Star kinds: main catalog, high RUWE, two parameters without motion, motion from one or another catalog.
KIND_MAIN, KIND_RUWE, KIND_TWO, KIND_TWO_A, KIND_TWO_B = 0, 1, 2, 3, 4

#: The largest terms of nutation (IAU 1980): multiples of the Moon's elongation, the Sun's and the Moon's anomalies, the Moon's argument of latitude
#: and node; then longitude and its change a century, obliquity and its change, in units of 0.0001 arcseconds.
NUTATION = [
    (0, 0, 0, 0, 1, -171996, -174.2, 92025, 8.9),
    (-2, 0, 0, 2, 2, -13187, -1.6, 5736, -3.1),
    (0, 0, 0, 2, 2, -2274, -0.2, 977, -0.5),
    (0, 0, 0, 0, 2, 2062, 0.2, -895, 0.5),
    (0, 1, 0, 0, 0, 1426, -3.4, 54, -0.1),
    (0, 0, 1, 0, 0, 712, 0.1, -7, 0.0),
    (-2, 1, 0, 2, 2, -517, 1.2, 224, -0.6),
    (0, 0, 0, 2, 1, -386, -0.4, 200, 0.0),
    (0, 0, 1, 2, 2, -301, 0.0, 129, -0.1),
    (-2, -1, 0, 2, 2, 217, -0.5, -95, 0.3),
    (-2, 0, 1, 0, 0, -158, 0.0, 0, 0.0),
    (-2, 0, 0, 2, 1, 129, 0.1, -70, 0.0),
    (0, 0, -1, 2, 2, 123, 0.0, -53, 0.0),
    (2, 0, 0, 0, 0, 63, 0.0, 0, 0.0),
    (0, 0, 1, 0, 1, 63, 0.1, -33, 0.0),
    (2, 0, -1, 2, 2, -59, 0.0, 26, 0.0),
    (0, 0, -1, 0, 1, -58, -0.1, 32, 0.0),
    (0, 0, 1, 2, 1, -51, 0.0, 27, 0.0),
    (-2, 0, 2, 0, 0, 48, 0.0, 0, 0.0),
    (0, 0, -2, 2, 1, 46, 0.0, -24, 0.0),
    (2, 0, 0, 2, 2, -38, 0.0, 16, 0.0),
    (0, 0, 2, 2, 2, -31, 0.0, 13, 0.0),
    (0, 0, 2, 0, 0, 29, 0.0, 0, 0.0),
    (-2, 0, 1, 2, 2, 29, 0.0, -12, 0.0),
    (0, 0, 0, 2, 0, 26, 0.0, 0, 0.0),
    (-2, 0, 0, 2, 0, -22, 0.0, 0, 0.0),
    (0, 0, -1, 2, 1, 21, 0.0, -10, 0.0),
]
#: Their arguments: degrees at J2000, and by the first, second and third power of centuries.
NUTATION_ARGUMENTS = [
    (297.85036, 445267.111480, -0.0019142, 1 / 189474),
    (357.52772, 35999.050340, -0.0001603, -1 / 300000),
    (134.96298, 477198.867398, 0.0086972, 1 / 56250),
    (93.27191, 483202.017538, -0.0036825, 1 / 327270),
    (125.04452, -1934.136261, 0.0020708, 1 / 450000),
]
