"""Queries over timings, requests and caches, on the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.catalog import query
from tilewright.operators import ranks, replay
from tilewright.sources.tables import table

_OK = "isfinite(value) and value >= 0"


def timings(spark: SparkSession, folder: str) -> DataFrame:
    """Finite, non-negative samples."""
    return table(spark, folder, "events").where("value is not null and not isnan(value) and value >= 0 and value < double('Infinity')")


@query("timing_summary", f"select event_type, count(*) as n, arg_max(value, event_id) as last, round(avg(value), 6) as mean, max(value) as maximum, count(*) filter (value > 50) as over_50 from events where {_OK} group by event_type")
def timing_summary(spark: SparkSession, folder: str) -> DataFrame:
    return timings(spark, folder).groupBy("event_type").agg(F.count("*").alias("n"), F.max_by("value", "event_id").alias("last"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("maximum"), F.count_if(F.col("value") > 50).alias("over_50"))


@query("recent_percentiles", f"with r as (select event_type, value, row_number() over (partition by event_type order by ts desc, event_id desc) as n from events where {_OK}) select event_type, count(*) as n, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99, max(value) as p100 from r where n <= 240 group by event_type")
def recent_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest-rank percentiles of the last 240 samples of each series."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    recent = timings(spark, folder).withColumn("n", F.row_number().over(w)).where("n <= 240")
    p = [F.expr(f"percentile_disc({q}) within group (order by value)").alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    return recent.groupBy("event_type").agg(F.count("*").alias("n"), *p, F.max("value").alias("p100"))


@query("rolling_maximum", f"select event_id, max(value) over (partition by event_type order by ts, event_id rows between 239 preceding and current row) as top from events where {_OK}")
def rolling_maximum(spark: SparkSession, folder: str) -> DataFrame:
    """The largest of the last 240 samples of a series: few series, so slices of each are worked on apart."""
    rows = timings(spark, folder).select("event_type", "ts", "event_id", "value")
    return ranks.rolling(rows, ["event_type"], ["ts", "event_id"], 240, F.col("value"), "top").select("event_id", "top")


@query("shared_requests", "select event_id % 97 as key, count(*) as consumers, count(distinct user_id) as users, max(value) as priority, min(event_id) as first from events group by event_id % 97")
def shared_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests for the same key as one, with the highest priority."""
    return table(spark, folder, "events").groupBy((F.col("event_id") % 97).alias("key")).agg(F.count("*").alias("consumers"), F.countDistinct("user_id").alias("users"), F.max("value").alias("priority"), F.min("event_id").alias("first"))


@query("request_order", "select event_id, row_number() over (partition by user_id order by value desc nulls last, event_id)::int as place from events where event_type <> 'error'")
def request_order(spark: SparkSession, folder: str) -> DataFrame:
    """The order in which each consumer's eligible requests are served: by priority, then first come."""
    w = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("value"), "event_id")
    return table(spark, folder, "events").where("event_type <> 'error'").select("event_id", F.row_number().over(w).alias("place"))


@query("kept_requests", "select event_id from events e where exists (select 1 from events w where w.event_type = 'purchase' and w.user_id = e.user_id)")
def kept_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Cancel all but the wanted keys: a semi-join."""
    e = table(spark, folder, "events")
    return e.join(e.where("event_type = 'purchase'").select("user_id").distinct(), "user_id", "left_semi").select("event_id")


@query("coalesced_work", "select user_id as key, min(event_id % 1000) as due, arg_min(event_type, event_id) as first from events group by user_id")
def coalesced_work(spark: SparkSession, folder: str) -> DataFrame:
    """Work of the same key once, at the earliest time it is due."""
    return table(spark, folder, "events").groupBy(F.col("user_id").alias("key")).agg(F.min(F.col("event_id") % 1000).alias("due"), F.min_by("event_type", "event_id").alias("first"))


@query("ledger_totals", "select user_id as owner, event_type as phase, sum(event_id % 4096)::bigint as bytes, count(*) as entries from events group by user_id, event_type")
def ledger_totals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy(F.col("user_id").alias("owner"), F.col("event_type").alias("phase")).agg(F.sum(F.col("event_id") % 4096).alias("bytes"), F.count("*").alias("entries"))


@query("merged_demand", "with a as (select user_id as mesh, max(value) as old from events where event_type = 'view' group by user_id), b as (select user_id as mesh, max(value) as new from events where event_type = 'click' group by user_id) select mesh, old, new, case when new is null then 'kept' when old is null then 'added' when new <= old then 'retired' else 'both' end as action from a full join b using (mesh)")
def merged_demand(spark: SparkSession, folder: str) -> DataFrame:
    """Old and new demand of each mesh: kept, added, retired by a better one, or both."""
    e = table(spark, folder, "events")
    a = e.where("event_type = 'view'").groupBy(F.col("user_id").alias("mesh")).agg(F.max("value").alias("old"))
    b = e.where("event_type = 'click'").groupBy(F.col("user_id").alias("mesh")).agg(F.max("value").alias("new"))
    action = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "added").when(F.col("new") <= F.col("old"), "retired").otherwise("both")
    return a.join(b, "mesh", "full_outer").select("mesh", "old", "new", action.alias("action"))


@query("sampled_rate", "with r as (select l_orderkey, l_linenumber, l_quantity, row_number() over (partition by l_returnflag order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) as n, count(*) over (partition by l_returnflag) as total, l_returnflag as flag from lineitem) select flag, count(*) as sampled, round(avg(l_quantity), 6) as estimate from r where (n - 1) % greatest(total // 50, 1) = 0 group by flag")
def sampled_rate(spark: SparkSession, folder: str) -> DataFrame:
    """A mean estimated from a systematic sample of about fifty rows of each group."""
    rows = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = ranks.placed(rows, ["flag"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]).withColumnRenamed("place", "n")
    hit = rows.where((F.col("n") - 1) % F.greatest(F.expr("total div 50"), F.lit(1)) == 0)
    return hit.groupBy("flag").agg(F.count("*").alias("sampled"), F.round(F.avg("l_quantity"), 6).alias("estimate"))


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(F.col("user_id").alias("consumer"), F.col("event_id").alias("seq"), (F.col("event_id") * 31 % 97).alias("key"), (F.col("event_id") * 250).alias("ms"), F.when(F.col("event_id") % 3 == 0, -(F.col("event_id") % 500)).otherwise(F.col("event_id") % 700).alias("bytes"), "value")


@query(
    "lru_hits",
    # a key is still there if fewer others than the capacity came between
    "with l as (select user_id as c, event_id as s, event_id * 31 % 97 as k from events), p as (select *, lag(s) over (partition by c, k order by s) as prev from l) select c as consumer, s as seq, prev is not null and (select count(distinct x.k) from l x where x.c = p.c and x.s > p.prev and x.s < p.s) < 16 as hit from p",
)
def lru_hits(spark: SparkSession, folder: str) -> DataFrame:
    return replay.lru(request_log(spark, folder), 16)


_ASKS = "(select user_id as consumer, event_id as seq, event_type as kind, value, case when event_id % 13 = 0 then null else event_id % 1000 end as due from events)"


@query(
    "packet_status",
    f"select seq, case when due is null then 'no_time' when value is null or value < 0 then 'bad_value' when kind = 'error' then 'rejected' when due > 900 then 'late' else 'ok' end as status from {_ASKS}",
)
def packet_status(spark: SparkSession, folder: str) -> DataFrame:
    """The first check that a packet of the log fails."""
    e = table(spark, folder, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), "value", F.when(F.col("event_id") % 13 != 0, F.col("event_id") % 1000).alias("due"))
    status = F.when(F.col("due").isNull(), "no_time").when(F.col("value").isNull() | (F.col("value") < 0), "bad_value").when(F.col("kind") == "error", "rejected").when(F.col("due") > 900, "late").otherwise("ok")
    return e.select("seq", status.alias("status"))
