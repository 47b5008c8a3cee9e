"""The results store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbra.functions.sky import num
from umbra.operators import results
from umbra.plans.registry import query
from umbra.plans.tables import base, table

RUNS = "(SELECT n_nationkey AS id, n_regionkey AS list, n_nationkey % 4 AS series, CASE WHEN n_nationkey%6<>5 THEN n_name END AS summary FROM nation)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "n_regionkey AS list", "n_nationkey % 4 AS series", "CASE WHEN n_nationkey%6<>5 THEN n_name END AS summary")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "hits")


@query("series_current", f"SELECT list, max(series) AS series FROM {RUNS} GROUP BY list")
def series_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.current_series(runs(spark, sf_dir), ["list"])


@query("series_next", f"SELECT id, (SELECT max(series)+1 FROM {RUNS}) AS series FROM {RUNS} WHERE summary IS NULL")
def series_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    return r.where("summary IS NULL").select("id", results.next_series(r).alias("series"))


@query("last_runs", f"SELECT list, arg_max(summary, id) AS summary, max(id) AS id FROM {RUNS} WHERE summary IS NOT NULL GROUP BY list")
def last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).where("summary IS NOT NULL").groupBy("list").agg(F.max_by("summary", "id").alias("summary"), F.max("id").alias("id"))


@query("events_of_series", "WITH e AS (SELECT id, run_id AS list, star AS series, best_et FROM {hits}) SELECT id, list, series, best_et FROM e WHERE (list, series) IN (SELECT list, max(series) FROM e WHERE id % 5 = 0 GROUP BY list)")
def events_of_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = hits(spark, sf_dir).select("id", F.col("run_id").alias("list"), F.col("star").alias("series"), "best_et")
    return results.events_of(events, results.current_series(events.where("id % 5 = 0"), ["list"]), ["list"])


@query(
    "update_merge",
    """WITH u AS (SELECT id % 997 AS k, id AS seq, CASE WHEN id%3=0 THEN kind END AS kind, CASE WHEN id%2=0 THEN best_et END AS best_et FROM {hits} WHERE id % 4 = 1),
    n AS (SELECT k, arg_max(kind, seq) FILTER (kind IS NOT NULL) AS kind, arg_max(best_et, seq) FILTER (best_et IS NOT NULL) AS best_et FROM u GROUP BY k)
    SELECT h.id, coalesce(n.kind, h.kind) AS kind, coalesce(n.best_et, h.best_et) AS best_et FROM {hits} h LEFT JOIN n ON n.k = h.id""",
)
def update_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)
    updates = h.where("id % 4 = 1").selectExpr("id % 997 AS id", "id AS seq", "CASE WHEN id%3=0 THEN kind END AS kind", "CASE WHEN id%2=0 THEN best_et END AS best_et")
    return results.merged(h.select("id", "kind", "best_et"), updates, ["id"], ["kind", "best_et"]).select("id", "kind", "best_et")


@query("find_event_prefix", "SELECT user_id AS target_id, max(event_id) AS id, count(*) AS n FROM events WHERE starts_with(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '2024-01-1') GROUP BY user_id")
def find_event_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = base(spark, sf_dir, "events").withColumn("utc", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return stamped.where(F.col("utc").startswith("2024-01-1")).groupBy(F.col("user_id").alias("target_id")).agg(F.max("event_id").alias("id"), F.count("*").alias("n"))


@query("find_event_run", f"SELECT r.list, max(h.id) AS id FROM {{hits}} h JOIN {RUNS} r ON r.id = h.run_id WHERE r.summary IS NOT NULL GROUP BY r.list")
def find_event_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).where("summary IS NOT NULL").select(F.col("id").cast("bigint").alias("run_id"), "list")
    return hits(spark, sf_dir).join(r, "run_id").groupBy("list").agg(F.max("id").alias("id"))


ORDERED = "o AS (SELECT id, target_id, star, best_et, row_number() OVER (PARTITION BY target_id, star ORDER BY id) AS k FROM {hits})"


@query(
    "new_hit_first",
    f"""WITH RECURSIVE {ORDERED}, f AS (SELECT target_id, star, k, [best_et] AS kept, [id] AS ids FROM o WHERE k=1
      UNION ALL SELECT o.target_id, o.star, o.k, CASE WHEN len(list_filter(f.kept, lambda x: abs(x-o.best_et)<300))>0 THEN f.kept ELSE list_append(f.kept, o.best_et) END, CASE WHEN len(list_filter(f.kept, lambda x: abs(x-o.best_et)<300))>0 THEN f.ids ELSE list_append(f.ids, o.id) END FROM f JOIN o ON o.target_id=f.target_id AND o.star=f.star AND o.k=f.k+1)
    SELECT target_id, star, unnest(ids) AS id FROM (SELECT target_id, star, arg_max(ids, k) AS ids FROM f GROUP BY target_id, star)""",
)
def new_hit_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.first_hits(hits(spark, sf_dir).select("id", "target_id", "star", "best_et"), ["target_id", "star"], "best_et", "id").select("target_id", "star", "id")


@query(
    "dedupe_last",
    f"""WITH RECURSIVE {ORDERED}, f AS (SELECT target_id, star, k, [best_et] AS kept, [id] AS ids FROM o WHERE k=1
      UNION ALL SELECT target_id, star, k, CASE WHEN p IS NULL THEN list_append(kept, best_et) ELSE list_transform(kept, lambda x, i: CASE WHEN i=p THEN best_et ELSE x END) END, CASE WHEN p IS NULL THEN list_append(ids, id) ELSE list_transform(ids, lambda x, i: CASE WHEN i=p THEN id ELSE x END) END
      FROM (SELECT o.target_id, o.star, o.k, o.id, o.best_et, f.kept, f.ids, nullif(list_position(list_transform(f.kept, lambda x: abs(x-o.best_et)<300), true), 0) AS p FROM f JOIN o ON o.target_id=f.target_id AND o.star=f.star AND o.k=f.k+1))
    SELECT target_id, star, unnest(ids) AS id FROM (SELECT target_id, star, arg_max(ids, k) AS ids FROM f GROUP BY target_id, star)""",
)
def dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.last_hits(hits(spark, sf_dir).select("id", "target_id", "star", "best_et"), ["target_id", "star"], "best_et", "id").select("target_id", "star", "id")


@query("export_csv_strings", "SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id%7=0 THEN '' ELSE kind END AS kind, CASE WHEN id%5=0 THEN '' ELSE CAST(CAST(best_et AS BIGINT) AS VARCHAR) END AS et FROM {hits}")
def export_csv_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    et = F.when(F.col("id") % 10 == 0, num(float("nan"))).when(F.col("id") % 5 != 0, F.col("best_et"))
    return hits(spark, sf_dir).select(results.shown(F.col("id")).alias("id"), results.shown(F.when(F.col("id") % 7 != 0, F.col("kind"))).alias("kind"), F.when(results.shown(et) == "", F.lit("")).otherwise(results.shown(et.try_cast("bigint"))).alias("et"))


@query("run_averages", "SELECT run_id, count(*) AS n, count(DISTINCT target_id) AS targets, round(sum(best_et)/greatest(count(*),1),4) AS per_hit, round(sum(CASE WHEN star=0 THEN best_et ELSE 0 END)/greatest(count(*) FILTER (star=0),1),4) AS per_solve FROM {hits} GROUP BY run_id")
def run_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.col("star") == 0
    return hits(spark, sf_dir).groupBy("run_id").agg(
        F.count("*").alias("n"),
        F.count_distinct("target_id").alias("targets"),
        F.round(F.sum("best_et") / F.greatest(F.count("*"), F.lit(1)), 4).alias("per_hit"),
        F.round(F.sum(F.when(zero, F.col("best_et")).otherwise(0.0)) / F.greatest(F.count_if(zero), F.lit(1)), 4).alias("per_solve"),
    )


@query(
    "favorites_upsert",
    """WITH a AS (SELECT target_id, star, id AS seq, 0 AS fresh, kind FROM {hits} WHERE id%3=0 UNION ALL SELECT target_id, star, id, 1, kind FROM {hits} WHERE id%5=1), r AS (SELECT *, row_number() OVER (PARTITION BY target_id, star ORDER BY fresh DESC, seq DESC) AS k FROM a) SELECT target_id, star, seq, kind FROM r WHERE k=1""",
)
def favorites_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir).select("target_id", "star", F.col("id").alias("seq"), "kind")
    known = rows.where("seq % 3 = 0").groupBy("target_id", "star").agg(F.max(F.struct("seq", "kind")).alias("r")).select("target_id", "star", "r.*")
    return results.upserted(known, rows.where("seq % 5 = 1"), ["target_id", "star"])


@query("favorites_missing", "SELECT DISTINCT target_id, star FROM {hits} h WHERE id%2=0 AND NOT EXISTS (SELECT 1 FROM {hits} k WHERE k.id%9=0 AND k.target_id=h.target_id AND k.star=h.star)")
def favorites_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = hits(spark, sf_dir).where("id % 9 = 0").select("target_id", "star")
    return hits(spark, sf_dir).where("id % 2 = 0").select("target_id", "star").join(known, ["target_id", "star"], "left_anti").distinct()


@query("favorites_newest", "SELECT target_id, id, CAST(row_number() OVER (PARTITION BY target_id ORDER BY best_et DESC, id DESC) AS INTEGER) AS pos FROM {hits} WHERE best_et >= 3000")
def favorites_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = W.partitionBy("target_id").orderBy(F.desc("best_et"), F.desc("id"))
    return hits(spark, sf_dir).where("best_et >= 3000").select("target_id", "id", F.row_number().over(newest).alias("pos"))


@query("record_fields", """SELECT id, CAST(record->>'$.k' AS BIGINT) AS k, CAST(record->>'$.k' AS BIGINT) + 1 AS k_next FROM {hits}""")
def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open records: typed fields from their JSON, merged with later ones, the last winning."""
    known = F.from_json("record", "map<string,bigint>")
    later = F.create_map(F.lit("k_next"), known["k"] + 1)
    both = F.map_from_entries(F.concat(F.map_entries(known), F.map_entries(later)))
    return hits(spark, sf_dir).select("id", both["k"].alias("k"), both["k_next"].alias("k_next"))


@query("report_order", "SELECT run_id, id, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN id%4=0 THEN 1 ELSE 0 END, CASE WHEN id%4<>0 THEN star END, best_et, id) AS pos FROM {hits}")
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's report in whole: by magnitude, missing ones last, then by time."""
    mag = F.when(F.col("id") % 4 != 0, F.col("star"))
    rows = hits(spark, sf_dir).select("run_id", "id", "best_et", mag.alias("mag"))
    return results.ordered(rows, ["run_id"], [F.asc_nulls_last("mag"), F.col("best_et"), F.col("id")]).select("run_id", "id", "pos")


@query("rank_targets", "WITH b AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY best_et DESC, id) AS k FROM {hits}) SELECT target_id, id, best_et FROM b WHERE k=1 ORDER BY best_et DESC, target_id LIMIT 25")
def rank_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = hits(spark, sf_dir).withColumn("k", F.row_number().over(W.partitionBy("target_id").orderBy(F.desc("best_et"), "id"))).where("k = 1")
    return best.orderBy(F.desc("best_et"), "target_id").limit(25).select("target_id", "id", "best_et")
