"""The star, body, site, path and event tables derived from the driver's tables, as expressions that Spark and DuckDB read alike.

Each table is one source table and a list of expressions. A golden fraction of a key spreads values evenly without chance.
Literals are cast to DOUBLE, as bare ones are decimals and give other products in the two engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def frac(key: str, step: float) -> str:
    x = f"CAST({key} AS DOUBLE)*{d(step)}"
    return f"({x} - floor({x}))"


O, P, S, N = "o_orderkey", "p_partkey", "s_suppkey", "number"

TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "stars": (
        "orders",
        {
            "source_id": f"4295806720 + {O}*1000",
            "ra": f"{d(360)}*{frac(O, 0.7548776662)}",
            "dec": f"degrees(asin({d(2)}*{frac(O, 0.5698402909)} - {d(1)}))",
            "g": f"{d(6)} + {d(11.5)}*{frac(O, 0.8191725134)}",
            "parallax": f"CASE WHEN {O}%20=11 THEN NULL ELSE {d(0.1)} + {d(9.9)}*{frac(O, 0.6710436067)} END",
            "pmra": f"CASE WHEN {O}%20=11 THEN NULL WHEN {O}%1500=7 THEN {d(2500)} ELSE {d(40)}*({frac(O, 0.5497004779)} - {d(0.5)}) END",
            "pmdec": f"CASE WHEN {O}%20=11 THEN NULL ELSE {d(40)}*({frac(O, 0.4142135624)} - {d(0.5)}) END",
            "ruwe": f"CASE WHEN {O}%10=3 THEN {d(2.5)} ELSE {d(1.0)} END",
            "pos_err": f"{d(0.01)} + {d(0.19)}*{frac(O, 0.2451223338)}",
        },
    ),
    "asteroids": (
        "part",
        {
            "number": f"{P}+1",
            "h": f"{d(8)} + {d(9)}*{frac(P, 0.2360679775)}",
            "g_slope": f"CASE WHEN {P}%3=0 THEN NULL ELSE {d(0.15)} END",
            "diameter": f"CASE WHEN p_size%4=0 THEN {d(1)}*p_size*2 ELSE NULL END",
            "diameter_sigma": f"CASE WHEN p_size%8=0 THEN {d(0.05)}*p_size ELSE NULL END",
            "albedo": f"CASE WHEN {P}%5=1 THEN {d(0.04)} + {d(0.3)}*{frac(P, 0.5698402909)} ELSE NULL END",
            "a": f"{d(2.1)} + {d(1.2)}*{frac(P, 0.3247179572)}",
            "e": f"{d(0.3)}*{frac(P, 0.8191725134)}",
            "i": f"{d(20)}*{frac(P, 0.6710436067)}",
            "om": f"{d(360)}*{frac(P, 0.5497004779)}",
            "w": f"{d(360)}*{frac(P, 0.4503)}",
            "ma": f"{d(360)}*{frac(P, 0.7548776662)}",
            "epoch_jd": d(2460800.5),
        },
    ),
    "sites": (
        "supplier",
        {
            "site_id": S,
            "lat": f"{d(120)}*{frac(S, 0.5698402909)} - {d(60)}",
            "lon": f"{d(360)}*{frac(S, 0.7548776662)} - {d(180)}",
            "ele_m": f"{d(2000)}*{frac(S, 0.4142135624)}",
            "aperture_cm": f"{d(15)} + {d(5)}*({S}%8)",
            "frames": "4",
            "reach_km": f"{d(20)}+{d(10)}*({S}%5)",
        },
    ),
    "hits": (
        "events",
        {
            "id": "event_id",
            "target_id": "user_id",
            "star": "CAST(event_id % 7 AS BIGINT)",
            "run_id": "CAST(event_id % 3 AS BIGINT)",
            "best_et": f"CAST(floor(value) AS DOUBLE) * {d(60)}",
            "kind": "event_type",
            "record": "props",
        },
    ),
    "elements": (
        "orders",
        {
            "event_id": O,
            "number": "o_custkey + 1",
            "star": "4295806720 + o_orderkey*1000",
            "et": f"CAST(o_orderkey%7+1 AS DOUBLE)*{d(86400)} + {d(86400)}*{frac('o_orderkey', 0.7548776662)}",
            "g": f"{d(6)} + {d(11.5)}*{frac('o_orderkey', 0.8191725134)}",
            "x0": f"{d(16000)}*({frac('o_orderkey*3+o_custkey', 0.5698402909)} - {d(0.5)})",
            "y0": f"{d(16000)}*({frac('o_orderkey*7', 0.3247179572)} - {d(0.5)})",
            "vx": f"{d(4)} + {d(16)}*{frac('o_orderkey', 0.4142135624)}",
            "vy": f"{d(10)}*({frac('o_custkey', 0.7320508076)} - {d(0.5)})",
            "ax": f"{d(0.0002)}*({frac('o_orderkey', 0.2360679775)} - {d(0.5)})",
            "ay": f"{d(0.0002)}*({frac('o_custkey', 0.2360679775)} - {d(0.5)})",
            "half": f"{d(900)} + {d(900)}*{frac('o_custkey', 0.4503)}",
            "r_km": f"{d(5)} + CAST(o_orderkey%50+1 AS DOUBLE)",
            "m_ast": f"{d(11)} + {d(6)}*{frac('o_custkey', 0.6710436067)}",
            "ra": f"{d(360)}*{frac('o_orderkey', 0.7548776662)}",
            "dec": f"{d(120)}*{frac('o_orderkey', 0.5698402909)} - {d(60)}",
        },
    ),
}

STEPS, STEP_S = 49, 600
RA0 = f"{d(360)}*{frac(N, 0.71803398875)}"
RA = f"({RA0} + {d(0.02)}*{frac(N, 0.3)}*j + {d(0.004)}*j)"
PATH = {
    "number": N,
    "j": "j",
    "et": f"{d(600)}*j",
    "ra": f"{RA} - {d(360)}*floor({RA}/{d(360)})",
    "dec": f"{d(60)}*({frac(N, 0.4142135624)}-{d(0.5)}) + {d(0.002)}*j",
    "delta_au": f"{d(1.5)} + {frac(N, 0.7320508076)}",
}


def _exprs(named: dict[str, str]) -> list[str]:
    return [f"{e} AS {c}" for c, e in named.items()]


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "path_samples":
        numbers = base(spark, sf_dir, "part").selectExpr("p_partkey+1 AS number")
        # Dealt by number before they unfold: a small table's file is one task's, and windows along paths then need no shuffle of samples.
        spread = numbers.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "number")
        return spread.select("number", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("j")).selectExpr(*_exprs(PATH))
    source, named = TABLES[name]
    return base(spark, sf_dir, source).selectExpr(*_exprs(named))


def sql(name: str) -> str:
    """The same table as a DuckDB subquery."""
    if name == "path_samples":
        return f"(SELECT {', '.join(_exprs(PATH))} FROM (SELECT p_partkey+1 AS number FROM part) CROSS JOIN (SELECT CAST(unnest(range({STEPS})) AS INTEGER) AS j))"
    source, named = TABLES[name]
    return f"(SELECT {', '.join(_exprs(named))} FROM {source})"


def filled(statement: str) -> str:
    """Replaces {table} in a DuckDB statement by the derived table."""
    for name in [*TABLES, "path_samples"]:
        statement = statement.replace("{" + name + "}", sql(name))
    return statement
