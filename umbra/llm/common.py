"""Shared helpers of the text operators."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints. A temporary one only in a local session that sets none, as in tests;
    on a cluster without the setting each executor would write to a disk of its own, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='umbra-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders of this process's tables, with their sessions.
_TABLES: dict[str, SparkSession] = {}


def written(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """`df` as a table in the shared folder: computed once, its lineage cut, safe when executors go. The table stays until
    `release`, or until the process ends, as results are read from it later on. Its folder is added to `made`."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/umbra/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES[path] = df.sparkSession
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(paths: list[str]) -> None:
    """Deletes tables that `written` made; frames that read them can't be used any more."""
    for path in paths:
        spark = _TABLES[path]
        # A folder that this process sees needs no session, which may have ended.
        if urlsplit(path).scheme in ("", "file") and os.path.isdir(urlsplit(path).path):
            shutil.rmtree(urlsplit(path).path, ignore_errors=True)
        else:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        del _TABLES[path]


@atexit.register
def _release_at_end() -> None:
    try:
        release(list(_TABLES))
    except Exception as e:  # noqa: BLE001 - the session may be gone by now; its folder then stays
        print(f"tables of this run stay in the shared folder: {type(e).__name__}", file=sys.stderr)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case by the fast built-in; the two other letters whose lower case has an ASCII letter keep to translate()."""
    odd = text.rlike("[İK]")
    return F.when(odd, F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())).otherwise(F.lower(text))


def words_by(text: Column, separators: str) -> Column:
    """The non-empty pieces of `text` between runs of a separator class, e.g. `[\\x20\\x09-\\x0D]`."""
    return F.array_remove(F.split(text, f"{separators}+", -1), "")


#: Texts that a Python worker holds at a time.
BATCH = 256


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, with its session handing Python workers few rows at a time: texts have no bound, and Spark's own batches of
    10,000 rows would hold 10,000 of them. Every operator that hands texts to Python calls this for itself, so what a
    worker holds doesn't depend on what ran before. A smaller setting is left as it is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH:
        conf.set(key, str(BATCH))
    return df
