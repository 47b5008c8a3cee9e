"""The derived tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.plans.registry import query
from umbra.plans.tables import table


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("stars_derived", "SELECT source_id, round(ra,6) AS ra, round(dec,6) AS dec, round(g,6) AS g, round(parallax,6) AS parallax, round(pmra,6) AS pmra, round(pmdec,6) AS pmdec, round(ruwe,6) AS ruwe, round(pos_err,6) AS pos_err FROM {stars}")
def stars_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "stars"))


@query("asteroids_derived", "SELECT number, round(h,6) AS h, g_slope, round(diameter,6) AS diameter, round(diameter_sigma,6) AS diameter_sigma, round(albedo,6) AS albedo, round(a,6) AS a, round(e,6) AS e, round(i,6) AS i, round(om,6) AS om, round(w,6) AS w, round(ma,6) AS ma, epoch_jd FROM {asteroids}")
def asteroids_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "asteroids"))


@query("sites_derived", "SELECT site_id, round(lat,6) AS lat, round(lon,6) AS lon, round(ele_m,6) AS ele_m, aperture_cm, frames, reach_km FROM {sites}")
def sites_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "sites"))


@query("path_samples_derived", "SELECT number, j, et, round(ra,6) AS ra, round(dec,6) AS dec, round(delta_au,6) AS delta_au FROM {path_samples}")
def path_samples_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "path_samples"))


@query("elements_derived", "SELECT event_id, number, star, round(et,3) AS et, round(x0,3) AS x0, round(vy,3) AS vy, round(r_km,3) AS r_km FROM {elements}")
def elements_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "elements").select("event_id", "number", "star", "et", "x0", "vy", "r_km"), 3)
