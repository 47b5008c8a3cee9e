"""The results store: runs, series, events and favourites as tables, with the rules for repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbra.sources.files import scratch


def current_series(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by…, series): the newest series of each list."""
    return runs.groupBy(*by).agg(F.max("series").alias("series"))


def next_series(runs: DataFrame) -> Column:
    """One above all series of all lists, as a scalar."""
    return F.coalesce(runs.agg(F.max("series").alias("m")).scalar(), F.lit(0)) + 1


def events_of(events: DataFrame, series: DataFrame, by: list[str]) -> DataFrame:
    """Events of each list's current series."""
    return events.join(series, [*by, "series"], "left_semi")


def merged(events: DataFrame, updates: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Events with fields replaced where an update of the same key has a value; of several updates, the last by `seq`."""
    newest = updates.groupBy(*key).agg(*[F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"__{f}") for f in fields])
    both = events.join(newest, key, "left")
    return both.withColumns({f: F.coalesce(f"__{f}", f) for f in fields}).drop(*[f"__{f}" for f in fields])


def _chains(events: DataFrame, key: list[str], time: str, tol: float) -> DataFrame:
    """Adds __chain: events of a key whose times lie within `tol` of a neighbour's. Only events of one chain can touch each other, so a
    key with very many events falls into many small groups."""
    w = W.partitionBy(*key).orderBy(time)
    fresh = F.coalesce(F.col(time) - F.lag(time).over(w) >= tol, F.lit(True)).cast("int")
    return events.withColumn("__fresh", fresh).withColumn("__chain", F.sum("__fresh").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__fresh")


def _folded(events: DataFrame, key: list[str], time: str, order: str, tol: float, replace: bool) -> DataFrame:
    """Goes through each chain in order and keeps the events that a greedy rule keeps. A task reads its chains one after the other, so
    it holds one chain and one batch; a chain that goes on over a batch's end is held until it ends."""
    chained = _chains(events, key, time, tol)
    names = [*key, "__chain"]

    def chain(times: np.ndarray) -> list[int]:
        kept: list[float] = []
        rows: list[int] = []
        for i, t in enumerate(times):
            at = next((k for k, x in enumerate(kept) if abs(x - t) < tol), None)
            if at is None:
                kept.append(t)
                rows.append(i)
            elif replace:
                kept[at], rows[at] = t, i
        return rows

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            now = b if held is None else pd.concat([held, b], ignore_index=True)
            codes = (now[names] != now[names].shift()).any(axis=1).cumsum().to_numpy()
            open_from = int(np.searchsorted(codes, codes[-1])) if len(codes) else 0
            yield done(now.iloc[:open_from], codes[:open_from])
            held = now.iloc[open_from:]
        if held is not None:
            yield done(held, np.zeros(len(held), int))

    def done(rows: pd.DataFrame, codes: np.ndarray) -> pd.DataFrame:
        times, edges = rows[time].to_numpy(float), np.flatnonzero(np.diff(codes, prepend=-1)) if len(codes) else np.array([], int)
        ends = [*edges[1:], len(codes)]
        return rows.iloc[[int(lo) + i for lo, hi in zip(edges, ends, strict=False) for i in chain(times[lo:hi])]]

    return chained.repartition(*names).sortWithinPartitions(*names, order).mapInPandas(fold, chained.schema).drop("__chain")


def first_hits(events: DataFrame, key: list[str], time: str, order: str, tol: float = 300.0) -> DataFrame:
    """In the order of `order`, events whose time is not within `tol` of any earlier kept one of their key."""
    return _folded(events, key, time, order, tol, False)


def last_hits(events: DataFrame, key: list[str], time: str, order: str, tol: float = 300.0) -> DataFrame:
    """In the order of `order`, each event takes the place of the first kept one of its key within `tol`, or is kept as a new one; later
    events are compared with what took the place."""
    return _folded(events, key, time, order, tol, True)


def ordered(rows: DataFrame, key: list[str], order: list[Column], out: str = "pos") -> DataFrame:
    """Adds `out`, each row's place from 1 in the order of its key's rows, however many those are; ties by `order` alone are settled at random, so it ends
    in an id.

    Rows are dealt by ranges of key and order, so a key of a third of all rows spreads over many tasks; each range is numbered by itself, and
    begins where the ranges of its key before it end. The dealt rows are written, as ranges that are read twice must be the same.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "ordered")
    rows.repartitionByRange(*[F.col(k) for k in key], *order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.schema(rows.schema.add("__part", "integer")).parquet(path)
    # A row for each range.
    before = W.partitionBy(*[F.col(k) for k in key]).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = dealt.groupBy(*key, "__part").agg(F.count("*").alias("__n")).select(*key, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    numbered = dealt.withColumn("__k", F.row_number().over(W.partitionBy(*key, "__part").orderBy(*order)))
    on = numbered["__part"] == starts["__part"]
    for k in key:
        on = on & numbered[k].eqNullSafe(starts[k])
    joined = numbered.join(starts.select("__part", "__first", *key), on)
    return joined.select(*[numbered[c] for c in rows.columns], (F.col("__k") + F.col("__first")).cast("bigint").alias(out))


def upserted(known: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Known rows, replaced by new ones of the same key, and the new rows of other keys; of several new ones the last by `seq`."""
    columns = [c for c in known.columns if c not in key]
    both = known.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in columns if c != "seq"]
    return both.groupBy(*key).agg(F.max(F.struct("__new", "seq", *rest)).alias("r")).select(*key, *[f"r.{c}" for c in columns])


def shown(c: Column) -> Column:
    """A value as exports write it: nothing for null and NaN."""
    return F.coalesce(F.when(F.isnan(c.try_cast("double")), F.lit("")).otherwise(c.cast("string")), F.lit(""))
