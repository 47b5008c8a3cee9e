"""Resumable pre-screen builds: new files of bodies are screened once each, as they come.

A stream gives files in batches and remembers which are done. A batch leaves out bodies that an earlier batch has done, runs the real
build on the others, and writes its events, then which bodies it has done, then its line in the log; each goes to a folder of the batch's
number, overwritten if the batch comes again. So a run that was killed anywhere, and started again, ends with what one run gives.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.sources.files import exists

BATCH_LOG = "bodies bigint, events bigint"


def events_of(spark: SparkSession, out: str) -> DataFrame:
    """All events that a build has so far."""
    return spark.read.parquet(f"{out}/events")


def batches_of(spark: SparkSession, out: str) -> DataFrame:
    """(batch, bodies, events) of each batch done."""
    return spark.read.parquet(f"{out}/batches")


def _held(spark: SparkSession, out: str, settings: dict[str, object]) -> None:
    """Writes the settings beside a new build; another build's are an error, as its events would differ."""
    text = json.dumps(settings, sort_keys=True)
    if exists(spark, f"{out}/settings"):
        before = spark.read.text(f"{out}/settings", wholetext=True).first().value.strip()
        if before != text:
            raise ValueError(f"{out} was begun with other settings: {before}")
    else:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{out}/settings")


def build(source: str, schema: T.StructType, out: str, checkpoint: str, screen: Callable[[DataFrame], DataFrame], settings: dict[str, object], spark: SparkSession, key: str = "number", files_a_batch: int = 1, said: Callable[[int, str], None] = lambda batch, step: None) -> None:
    """Screens the bodies (rows of `schema` with `key`) in files under `source` that are new since the last call; `screen` makes events of bodies. Rows
    of one key are alike. `said` is told of each step that a batch has done."""
    _held(spark, out, settings)

    def add(batch: DataFrame, number: int) -> None:
        here = batch.sparkSession
        todo = batch.dropDuplicates([key])
        earlier = [f"{out}/done/batch={k}" for k in range(number)]
        if earlier:
            todo = todo.join(here.read.schema(f"{key} {schema[key].dataType.simpleString()}").parquet(*earlier), key, "left_anti")
        # Read twice below, and the second time after the events are written: what's to do is settled first.
        todo.select(key).write.mode("overwrite").parquet(f"{out}/todo/batch={number}")
        said(number, "todo")
        chosen = batch.dropDuplicates([key]).join(here.read.parquet(f"{out}/todo/batch={number}"), key, "left_semi")
        screen(chosen).write.mode("overwrite").parquet(f"{out}/events/batch={number}")
        said(number, "events")
        done = here.read.parquet(f"{out}/todo/batch={number}")
        done.write.mode("overwrite").parquet(f"{out}/done/batch={number}")
        said(number, "done")
        n_events = here.read.parquet(f"{out}/events/batch={number}").agg(F.count("*").alias("events"))
        done.agg(F.count("*").alias("bodies")).join(n_events).write.mode("overwrite").parquet(f"{out}/batches/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
