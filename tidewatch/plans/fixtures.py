"""Telemetry-shaped tables derived from the given event, order-line and supplier tables.

Each builder has a SQL twin registered as a block, so a query and its check
start from the same rows.  A user is a machine, an hour is a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.plans.registry import block
from tidewatch.session import materialise

HOUR = 3600
SLOTS = 24
WEEK = 7 * 86400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster_agg from events; sums run over whole cents so they are exact."""
    cents = F.round(F.col("value") * 100).cast("long")
    width = F.lit(HOUR * 1_000_000)
    return (table(spark, sf_dir, "events")
            .groupBy(F.col("user_id").alias("machine_id"),
                     F.floor(micros("ts") / width).cast("long").alias("bucket"))
            .agg(F.sum(cents).alias("_sum"), F.max(cents).alias("_max"),
                 F.count(F.lit(1)).alias("n_tasks"),
                 F.count_if(F.col("event_type") == "error").alias("_err"))
            .select("machine_id", "bucket", (F.col("bucket") * width).alias("time_us"),
                    (F.col("_sum") / 10000.0).alias("total_cpu"),
                    (F.col("_max") / 10000.0).alias("peak_cpu"),
                    F.least(F.col("_sum") / 50000.0 / F.col("n_tasks"), F.lit(1.0)).alias("total_mem"),
                    F.least(F.col("_max") / 50000.0, F.lit(1.0)).alias("peak_mem"),
                    (F.col("_err") / F.col("n_tasks")).alias("disk_io"), "n_tasks"))


def agg_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a written table, for plans that read them in several branches."""
    return materialise(agg(spark, sf_dir), "agg")


block("raw_agg", """
SELECT user_id AS machine_id, epoch_us(ts) // 3600000000 AS bucket,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS s,
       max(CAST(round(value * 100) AS BIGINT)) AS m, count(*) AS n_tasks,
       count(*) FILTER (WHERE event_type = 'error') AS e
FROM events GROUP BY 1, 2""")
block("agg", """
SELECT machine_id, bucket, bucket * 3600000000 AS time_us,
       s / 10000e0 AS total_cpu, m / 10000e0 AS peak_cpu,
       least(s / 50000e0 / n_tasks, 1e0) AS total_mem, least(m / 50000e0, 1e0) AS peak_mem,
       CAST(e AS DOUBLE) / n_tasks AS disk_io, n_tasks
FROM raw_agg""", "raw_agg")


def task_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw task records from order lines, with rows that each filter must drop."""
    start = micros("l_shipdate").cast("double")
    odd = F.col("l_orderkey") % 97 == 0
    return table(spark, sf_dir, "lineitem").select(
        start.alias("start_time"),
        F.when(odd, start).otherwise(start + F.col("l_quantity").cast("long") * F.lit(6e6)).alias("end_time"),
        F.when(F.col("l_linenumber") != 7, F.col("l_suppkey").cast("double")).alias("machine_id"),
        F.when(F.col("l_orderkey") % 101 == 0, F.lit(100.0)).otherwise(F.col("l_discount") * 10).alias("cpu_rate"),
        (F.col("l_discount") * 12).alias("max_cpu_rate"),
        F.col("l_tax").alias("canonical_mem_usage"),
        (F.col("l_tax") * 1.5).alias("max_mem_usage"),
        F.col("l_discount").alias("mean_disk_io_time"),
        F.lit(1.0).alias("sample_portion"),
        F.col("l_orderkey").alias("batch_key"))


block("task_usage", """
SELECT CAST(epoch_us(l_shipdate) AS DOUBLE) AS start_time,
       CASE WHEN l_orderkey % 97 = 0 THEN CAST(epoch_us(l_shipdate) AS DOUBLE)
            ELSE CAST(epoch_us(l_shipdate) AS DOUBLE) + CAST(l_quantity AS BIGINT) * 6e6 END AS end_time,
       CASE WHEN l_linenumber <> 7 THEN CAST(l_suppkey AS DOUBLE) END AS machine_id,
       CASE WHEN l_orderkey % 101 = 0 THEN 100e0 ELSE l_discount * 10 END AS cpu_rate,
       l_discount * 12 AS max_cpu_rate, l_tax AS canonical_mem_usage, l_tax * 1.5e0 AS max_mem_usage,
       l_discount AS mean_disk_io_time, 1e0 AS sample_portion, l_orderkey AS batch_key
FROM lineitem""")
block("usable_tasks", """
SELECT * FROM task_usage WHERE machine_id IS NOT NULL AND end_time > start_time AND cpu_rate <= 64""",
      "task_usage")
block("task_rollup", """
SELECT CAST(machine_id AS BIGINT) AS machine_id, CAST(floor(start_time / 604800e6) AS BIGINT) AS bucket,
       sum(cpu_rate * (end_time - start_time)) / 604800e6 AS total_cpu, max(max_cpu_rate) AS peak_cpu,
       sum(canonical_mem_usage) AS total_mem, max(max_mem_usage) AS peak_mem,
       max(mean_disk_io_time) AS disk_io, count(cpu_rate) AS n_tasks
FROM usable_tasks GROUP BY 1, 2""", "usable_tasks")

KINDS = {"view": ("cpu", 0), "click": ("mem", 1), "purchase": ("disk", 2), "signup": ("load", 3)}


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item readings: four items per user, one per event type; value kept as text."""
    kind = F.create_map(*[x for k, (_, i) in KINDS.items() for x in (F.lit(k), F.lit(i))])
    e = table(spark, sf_dir, "events").filter(F.col("event_type") != "error")
    return e.select((F.col("user_id") * 4 + kind[F.col("event_type")]).cast("long").alias("itemid"),
                    F.floor(micros("ts") / 1_000_000).cast("long").alias("clock"),
                    F.col("value").cast("string").alias("value"))


block("history", """
SELECT user_id * 4 + CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END
         AS itemid, epoch_us(ts) // 1000000 AS clock, value
FROM events WHERE event_type <> 'error'""")


def item_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalogue row per item with its last reading time; keys follow the kind."""
    key = {0: "system.cpu.util[,idle]", 1: "vm.memory.size[pused]", 2: "vfs.dev.util[sda]",
           3: "system.cpu.load[all,avg1]"}
    names = F.create_map(*[x for i, k in key.items() for x in (F.lit(i), F.lit(k))])
    return (history(spark, sf_dir).groupBy("itemid").agg(F.max("clock").alias("lastclock"))
            .select("itemid", F.floor(F.col("itemid") / 4).cast("long").alias("hostid"),
                    names[(F.col("itemid") % 4).cast("int")].alias("key_"), "lastclock",
                    F.lit("4").alias("lastvalue")))


block("catalog", """
SELECT itemid, itemid // 4 AS hostid,
       CASE itemid % 4 WHEN 0 THEN 'system.cpu.util[,idle]' WHEN 1 THEN 'vm.memory.size[pused]'
            WHEN 2 THEN 'vfs.dev.util[sda]' ELSE 'system.cpu.load[all,avg1]' END AS key_,
       max(clock) AS lastclock
FROM history GROUP BY itemid""", "history")

METRICS = {"view": "total_cpu", "click": "total_mem", "purchase": "disk_io", "signup": "load1",
           "error": "peak_cpu"}


def matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long metric samples on an hourly grid: metric, nodename, timestamp, value."""
    name = F.create_map(*[F.lit(x) for kv in METRICS.items() for x in kv])
    cents = F.round(F.col("value") * 100).cast("long")
    return (table(spark, sf_dir, "events")
            .groupBy(name[F.col("event_type")].alias("metric"),
                     F.concat(F.lit("node-"), F.col("user_id").cast("string")).alias("nodename"),
                     (F.floor(micros("ts") / (HOUR * 1_000_000)) * HOUR).cast("long").alias("timestamp"))
            .agg((F.sum(cents) / 100.0).alias("value")))


block("matrix", """
SELECT CASE event_type WHEN 'view' THEN 'total_cpu' WHEN 'click' THEN 'total_mem' WHEN 'purchase' THEN 'disk_io'
            WHEN 'signup' THEN 'load1' ELSE 'peak_cpu' END AS metric,
       'node-' || user_id AS nodename, epoch_us(ts) // 3600000000 * 3600 AS timestamp,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / 100e0 AS value
FROM events GROUP BY 1, 2, 3""")

# --- blocks shared by many checks ------------------------------------------

block("bounds", """
SELECT min(bucket) AS lo, max(bucket) AS hi,
       min(bucket) + CAST(floor((max(bucket) - min(bucket)) * 0.6e0) AS BIGINT) AS t1,
       min(bucket) + CAST(floor((max(bucket) - min(bucket)) * 0.8e0) AS BIGINT) AS t2
FROM agg""", "agg")
block("thr", """
SELECT machine_id, p95 AS threshold_p95,
       CASE WHEN p99 < p95 * 1.1e0 THEN p95 * 1.1e0 ELSE p99 END AS threshold_p99
FROM (SELECT m.machine_id, coalesce(o.p95, g.p95) AS p95, coalesce(o.p99, g.p99) AS p99
      FROM (SELECT DISTINCT machine_id FROM agg) m
      LEFT JOIN (SELECT machine_id, quantile_cont(total_cpu, 0.95) AS p95, quantile_cont(total_cpu, 0.99) AS p99
                 FROM agg WHERE bucket <= (SELECT t1 FROM bounds) GROUP BY 1) o USING (machine_id)
      CROSS JOIN (SELECT quantile_cont(total_cpu, 0.95) AS p95, quantile_cont(total_cpu, 0.99) AS p99
                  FROM agg WHERE bucket <= (SELECT t1 FROM bounds)) g)""", "agg", "bounds")
def series_blocks(p: str, a: str, t: str, until: str) -> None:
    """SQL for the whole feature plan over aggregate ``a`` and thresholds ``t``; names get prefix ``p``."""
    block(f"{p}dense", f"""
SELECT g.machine_id, g.bucket, a.machine_id IS NOT NULL AS observed,
       coalesce(a.total_cpu, 0) AS total_cpu, coalesce(a.peak_cpu, 0) AS peak_cpu,
       coalesce(a.total_mem, 0) AS total_mem, coalesce(a.peak_mem, 0) AS peak_mem,
       coalesce(a.disk_io, 0) AS disk_io, coalesce(a.n_tasks, 0) AS n_tasks,
       g.bucket - g.lo AS pos, t.threshold_p95, t.threshold_p99
FROM (SELECT machine_id, lo, unnest(range(lo, hi + 1)) AS bucket
      FROM (SELECT machine_id, min(bucket) AS lo, max(bucket) AS hi FROM {a} GROUP BY 1)) g
LEFT JOIN {a} a USING (machine_id, bucket) JOIN {t} t USING (machine_id)""", a, t)
    block(f"{p}flags", f"""
SELECT *, CASE WHEN total_cpu > threshold_p95 THEN 1e0 ELSE 0e0 END AS spike_now,
       CASE WHEN total_cpu > threshold_p99 THEN 1e0 ELSE 0e0 END AS spike_severe_now
FROM {p}dense""", f"{p}dense")
    block(f"{p}series", f"""
SELECT *, total_cpu - cpu_lag_1 AS cpu_delta_1, total_cpu - cpu_lag_1 - (cpu_lag_1 - lag_2) AS cpu_delta_2,
       CASE WHEN threshold_p95 > 0 THEN (total_cpu - cpu_lag_1) / threshold_p95 ELSE 0 END AS cpu_vs_p95_delta,
       CASE WHEN threshold_p95 > 0 THEN (total_cpu / threshold_p95 - lag_3 / threshold_p95) / 3 ELSE 0 END
         AS cpu_vs_p95_slope_3,
       CASE WHEN threshold_p95 > 0 THEN (total_cpu / threshold_p95 - lag_6 / threshold_p95) / 6 ELSE 0 END
         AS cpu_vs_p95_slope_6
FROM (
SELECT *, coalesce(lag(total_cpu, 1) OVER w, 0) AS cpu_lag_1, coalesce(lag(total_cpu, 12) OVER w, 0) AS cpu_lag_12,
       coalesce(lag(total_cpu, 24) OVER w, 0) AS cpu_lag_24, coalesce(lag(total_cpu, 2) OVER w, 0) AS lag_2,
       coalesce(lag(total_cpu, 3) OVER w, 0) AS lag_3, coalesce(lag(total_cpu, 6) OVER w, 0) AS lag_6,
       coalesce(stddev_samp(total_cpu) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 0) AS cpu_rolling_std_6,
       sum(total_cpu * CASE WHEN pos = 0 THEN 1e0 ELSE 1 - pow(2, -1 / 6e0) END * pow(2, pos / 6e0))
         OVER (w ROWS UNBOUNDED PRECEDING) * pow(2, -pos / 6e0) AS cpu_ewma_6,
       sum(total_cpu * CASE WHEN pos = 0 THEN 1e0 ELSE 1 - pow(2, -1 / 24e0) END * pow(2, pos / 24e0))
         OVER (w ROWS UNBOUNDED PRECEDING) * pow(2, -pos / 24e0) AS cpu_ewma_24,
       coalesce(max(spike_now) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) AS spike_in_last_1,
       coalesce(max(spike_now) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS spike_in_last_3,
       coalesce(max(spike_now) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0) AS spike_in_last_6,
       coalesce(max(spike_severe_now) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) AS spike_severe_in_last_1,
       coalesce(max(spike_severe_now) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS spike_severe_in_last_3,
       coalesce(max(spike_severe_now) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0) AS spike_severe_in_last_6,
       coalesce(sum(spike_now) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 0) / least(24, pos + 1)
         AS cpu_spike_rate_24,
       least(24, coalesce(pos - max(CASE WHEN spike_now = 1 THEN pos END)
         OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 24)) AS time_since_last_spike,
       CASE WHEN count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) = 3
            THEN max(spike_now) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) END AS spike_in_15m,
       CASE WHEN count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) = 6
            THEN max(spike_now) OVER (w ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) END AS spike_in_30m,
       CASE WHEN count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) = 9
            THEN max(spike_now) OVER (w ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) END AS spike_in_45m,
       sum(spike_now) OVER (w ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS ahead_95,
       sum(spike_severe_now) OVER (w ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS ahead_99,
       count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS ahead_rows
FROM {p}flags WINDOW w AS (PARTITION BY machine_id ORDER BY bucket))""", f"{p}flags")
    block(f"{p}cross_section", f"""
SELECT a.machine_id, a.bucket, (rank() OVER (PARTITION BY a.bucket ORDER BY a.total_cpu)
         + (count(*) OVER (PARTITION BY a.bucket, a.total_cpu) - 1) / 2e0) / count(*) OVER (PARTITION BY a.bucket)
         AS machine_rank_in_cluster,
       coalesce(p.p90, (SELECT quantile_cont(total_cpu, 0.9) FROM {a}{until}))
         AS cluster_cpu_p90
FROM {a} a LEFT JOIN (SELECT bucket, quantile_cont(total_cpu, 0.9) AS p90 FROM {a}{until}
                      GROUP BY 1) p USING (bucket)""", a, "bounds")
    block(f"{p}feat", f"""
SELECT s.machine_id, s.bucket, s.bucket * 3600000000 AS time_us,
       total_cpu, peak_cpu, total_mem, peak_mem, disk_io, n_tasks, total_cpu / greatest(n_tasks, 1) AS cpu_per_task,
       cpu_lag_1, cpu_lag_12, cpu_lag_24, cpu_ewma_6, cpu_ewma_24, cpu_delta_1, cpu_delta_2, cpu_rolling_std_6,
       CASE WHEN total_cpu > 0 THEN peak_cpu / total_cpu ELSE 0 END AS task_dominance,
       CASE WHEN threshold_p95 > 0 THEN total_cpu / threshold_p95 ELSE 0 END AS cpu_vs_p95,
       cpu_vs_p95_delta, cpu_vs_p95_slope_3, cpu_vs_p95_slope_6,
       CASE WHEN threshold_p95 > 0 THEN greatest(-24, least(24,
            CASE WHEN cpu_vs_p95_slope_3 > 0.01 THEN (1 - total_cpu / threshold_p95) / cpu_vs_p95_slope_3
                 WHEN 1 - total_cpu / threshold_p95 < 0 THEN -24 ELSE 24 END)) ELSE 0 END AS time_to_p95_3,
       CASE WHEN threshold_p95 > 0 THEN peak_cpu / threshold_p95 ELSE 0 END AS peak_cpu_vs_p95,
       spike_severe_now,
       CASE WHEN threshold_p99 > 0 THEN total_cpu / threshold_p99 ELSE 0 END AS cpu_vs_p99,
       CASE WHEN threshold_p99 > 0 THEN peak_cpu / threshold_p99 ELSE 0 END AS peak_cpu_vs_p99,
       greatest((total_cpu - threshold_p95) / greatest(threshold_p99 - threshold_p95, 1e-6), 0) AS band_position,
       greatest(threshold_p99 - threshold_p95, 1e-6) AS band_width,
       spike_severe_in_last_1, spike_severe_in_last_3, spike_severe_in_last_6,
       spike_now, spike_in_last_1, spike_in_last_3, spike_in_last_6, time_since_last_spike, cpu_spike_rate_24,
       cluster_cpu_p90, machine_rank_in_cluster,
       sin(2 * pi() * (s.bucket % 24) / 24) AS hour_sin, cos(2 * pi() * (s.bucket % 24) / 24) AS hour_cos,
       spike_in_15m, spike_in_30m, spike_in_45m,
       CASE WHEN ahead_rows = 12 THEN CASE WHEN ahead_99 >= 1 THEN 2e0 WHEN ahead_95 >= 1 THEN 1e0 ELSE 0e0 END END
         AS severity_in_60m,
       threshold_p95, threshold_p99
FROM {p}series s JOIN {p}cross_section c ON c.machine_id = s.machine_id AND c.bucket = s.bucket
WHERE observed""", f"{p}series", f"{p}cross_section")


series_blocks("", "agg", "thr", " WHERE bucket <= (SELECT t1 FROM bounds)")

# --- live window: the last 240 buckets, scored with thresholds learnt before -------------------

LIVE_BUCKETS = 240


def live(rows: DataFrame) -> DataFrame:
    from_here = rows.agg((F.max("bucket") - LIVE_BUCKETS).alias("b")).scalar()
    return rows.filter(F.col("bucket") > from_here)


block("live_agg", f"SELECT * FROM agg WHERE bucket > (SELECT hi - {LIVE_BUCKETS} FROM bounds)", "agg", "bounds")
series_blocks("live_", "live_agg", "thr", "")
