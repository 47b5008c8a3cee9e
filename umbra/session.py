"""A session with the settings the engine counts on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
}


def session(app: str = "umbra", **more: str) -> SparkSession:
    """Gets or makes a session. On a cluster the master and memory come from spark-submit; here, from the environment."""
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    if "UMBRA_MASTER" in os.environ:
        builder = builder.master(os.environ["UMBRA_MASTER"])
    return builder.getOrCreate()
