"""Queries over sources, sinks, validation, ingest joins and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.functions import scalar as X
from tidewatch.operators import inventory, joins, rollup
from tidewatch.plans import fixtures as fx
from tidewatch.plans.registry import block, query, sql
from tidewatch.session import fresh_path, materialise
from tidewatch.sources import adapters, contracts, readers, sinks

_TASK_COLS = [f.name for f in S.TASK_USAGE.fields]
_TASK_SELECT = ", ".join(_TASK_COLS)
_TASK_REALS = " ".join(c for c in _TASK_COLS if not c.endswith("_time") or c.startswith("mean"))
_AGG_REALS = " ".join(S.SIGNALS)
_AGG_SELECT = ", ".join(S.AGG_COLUMNS)
_BOUNDS_SQL = lambda src: " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, avg(CASE WHEN {c} {'>' if side == 'above' else '<'} {bound} THEN 1e0 ELSE 0 END) * 100"
    f" AS percent_beyond FROM {src}" for c, (side, bound) in S.INPUT_BOUNDS.items())


block("task_rollup_f", """
SELECT machine_id, bucket, bucket * 604800000000 AS time_us, CAST(total_cpu AS FLOAT) AS total_cpu,
       CAST(peak_cpu AS FLOAT) AS peak_cpu, CAST(total_mem AS FLOAT) AS total_mem, CAST(peak_mem AS FLOAT) AS peak_mem,
       CAST(disk_io AS FLOAT) AS disk_io, n_tasks FROM task_rollup""", "task_rollup")
block("agg_pct", """
SELECT machine_id, bucket, total_cpu * 40 AS total_cpu, peak_cpu * 40 AS peak_cpu, total_mem * 3 AS total_mem,
       peak_mem * 3 AS peak_mem, disk_io * 3 AS disk_io, n_tasks FROM agg AS src""", "agg")


# --- scans ---------------------------------------------------------------------

@query("s1_csv_scan", sql(f"SELECT {_TASK_SELECT} FROM task_usage", "task_usage", reals=_TASK_REALS))
def csv_scan(spark, sf):
    path = fresh_path(spark, "tasks") + ".csv"
    fx.task_usage(spark, sf).write.option("header", True).csv(path)
    return readers.task_usage_csv(spark, path)


_HOURS = 24 * 365 * 30


@query("s2_positional_parts", sql(f"SELECT {_TASK_SELECT} FROM task_usage WHERE start_time <= {_HOURS} * 3600000000.0",
                                  "task_usage", reals=_TASK_REALS))
def positional_parts(spark, sf):
    path = fresh_path(spark, "parts")
    raw = fx.task_usage(spark, sf)
    wide = raw.select(*[F.col(S.TRACE_POSITIONS[i]).alias(f"c{i}") if i in S.TRACE_POSITIONS
                        else F.lit(float(i)).alias(f"c{i}") for i in range(20)])
    wide.write.option("compression", "gzip").csv(path)
    return readers.trace_parts(spark, path, _HOURS)


@query("s3_agg_by_suffix", sql(f"""
SELECT 'csv' AS kind, {_AGG_SELECT} FROM agg UNION ALL SELECT 'parquet', {_AGG_SELECT} FROM agg""", "agg",
                               reals=_AGG_REALS))
def agg_by_suffix(spark, sf):
    agg = fx.agg(spark, sf)
    root = fresh_path(spark, "agg")
    agg.write.option("header", True).csv(root + ".csv")
    agg.write.parquet(root + ".parquet")
    both = [readers.cluster_agg(spark, f"{root}.{k}").select(F.lit(k).alias("kind"), *S.AGG_COLUMNS)
            for k in ("csv", "parquet")]
    return both[0].unionByName(both[1])


@query("s4_pruned_scan", sql("SELECT l_suppkey AS machine_id, l_quantity AS quantity FROM lineitem WHERE l_tax > 0.05",
                             reals="quantity"))
def pruned_scan(spark, sf):
    return (readers.columns(spark, f"{sf}/lineitem.parquet", ["l_suppkey", "l_quantity", "l_tax"])
            .filter(F.col("l_tax") > 0.05)
            .select(F.col("l_suppkey").alias("machine_id"), F.col("l_quantity").alias("quantity")))


@query("s5_matrix_json", sql("SELECT metric, timestamp, nodename, value FROM matrix", "matrix", reals="value"))
def matrix_json(spark, sf):
    """One response per metric and node group, landed as JSON lines, parsed back."""
    path = fresh_path(spark, "matrix")
    samples = fx.matrix_long(spark, sf)
    per_day = (samples.groupBy("metric", "nodename", F.floor(F.col("timestamp") / 86400).alias("day"))
               .agg(F.collect_list(F.array(F.col("timestamp").cast("string"), F.col("value").cast("string"))).alias("v")))
    label = F.when(F.pmod(F.xxhash64("nodename"), F.lit(2)) == 0, F.create_map(F.lit("nodename"), F.col("nodename"))) \
             .otherwise(F.create_map(F.lit("node"), F.col("nodename")))
    doc = F.struct(F.lit("success").alias("status"), F.struct(
        F.lit("matrix").alias("resultType"),
        F.array(F.struct(label.alias("metric"), F.col("v").alias("values"))).alias("result")).alias("data"))
    per_day.select("metric", F.to_json(doc).alias("value")).write.partitionBy("metric").text(path)
    raw = spark.read.text(path).select("metric", F.from_json("value", S.METRIC_MATRIX).alias("r"))
    return readers.parse_matrix(raw.select("metric", "r.*"))


@query("s6_item_history", sql("SELECT itemid, clock, value FROM history", "history", reals="value"))
def item_history(spark, sf):
    path = fresh_path(spark, "history")
    good = fx.history(spark, sf)
    bad = good.filter(F.col("clock") % 10 == 0).withColumn("value", F.lit("n/a"))
    good.unionByName(bad).write.json(path)
    return readers.item_history(spark, path)


@query("s7_parquet_sink", sql(f"SELECT {_AGG_SELECT} FROM agg", "agg", reals=_AGG_REALS))
def parquet_sink(spark, sf):
    return spark.read.parquet(sinks.write_table(fx.agg(spark, sf), fresh_path(spark, "agg")))


@query("s8_report_sink", sql(_BOUNDS_SQL("agg"), "agg", reals="percent_beyond"))
def report_sink(spark, sf):
    report = contracts.bounds_report(fx.agg(spark, sf))
    return spark.read.schema(report.schema).json(sinks.write_report(report, fresh_path(spark, "report")))


@query("s9_metric_csv_sink", sql("SELECT machine_id, avg(total_cpu) AS mean_cpu FROM agg GROUP BY 1", "agg", reals="mean_cpu"))
def metric_csv_sink(spark, sf):
    table = fx.agg(spark, sf).groupBy("machine_id").agg(F.avg("total_cpu").alias("mean_cpu"))
    path = sinks.write_metrics(table, fresh_path(spark, "metrics"))
    return spark.read.option("header", True).schema(table.schema).csv(path)


@query("s10_empty_input", sql("""
SELECT count(*) AS n_rows, CAST(9 AS BIGINT) AS n_columns FROM usable_tasks WHERE start_time < 0""", "usable_tasks"))
def empty_input(spark, sf):
    tasks = fx.task_usage(spark, sf)
    none = rollup.rollup(tasks.filter(F.col("start_time") < 0))
    return none.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(none.columns)))


@query("s11_stage_reuse", sql("SELECT machine_id, max(peak_cpu) AS peak_cpu, max(bucket) AS bucket FROM agg GROUP BY 1", "agg",
                              reals="peak_cpu"))
def stage_reuse(spark, sf):
    """Second pass finds both stages finished and only reads them."""
    root = fresh_path(spark, "stages")
    stages = [("agg", lambda _: fx.agg(spark, sf)),
              ("peaks", lambda a: a.groupBy("machine_id").agg(F.max("peak_cpu").alias("peak_cpu"),
                                                              F.max("bucket").alias("bucket")))]
    sinks.run_stages(spark, root, stages)
    return sinks.run_stages(spark, root, stages)


@query("u1_source_adapter", sql(f"SELECT {_AGG_SELECT} FROM task_rollup_f", "task_rollup_f", reals=_AGG_REALS))
def source_adapter(spark, sf):
    adapters.register_adapter("order_lines", lambda s, p: rollup.rollup(fx.task_usage(s, p), fx.WEEK))
    return adapters.read_with(spark, "order_lines", sf)


# --- validation and projection ---------------------------------------------------

@query("p1_required_columns", sql("""
SELECT (SELECT count(*) FROM agg) AS n_rows, unnest(['disk_io', 'n_tasks']) AS missing_column""", "agg"))
def required_columns(spark, sf):
    agg = contracts.require(fx.agg(spark, sf))
    gone = contracts.missing_columns(agg.drop("disk_io", "n_tasks"))
    return (agg.agg(F.count(F.lit(1)).alias("n_rows"))
            .select("n_rows", F.explode(F.array(*[F.lit(c) for c in gone])).alias("missing_column")))


@query("p2_coerce", sql("""
SELECT machine_id, bucket, CASE WHEN n_tasks = 3 THEN NULL ELSE total_cpu END AS total_cpu,
       (SELECT count(*) FROM agg WHERE n_tasks = 3) AS lost FROM agg""", "agg", reals="total_cpu"))
def coerce(spark, sf):
    text = fx.agg(spark, sf).withColumn(
        "total_cpu", F.when(F.col("n_tasks") == 3, "n/a").otherwise(F.col("total_cpu").cast("string")))
    lost = contracts.coercion_losses(text).filter("column_name = 'total_cpu'").select("lost").scalar()
    return contracts.coerce(text).select("machine_id", "bucket", "total_cpu").withColumn("lost", lost)


@query("p3_bounds_report", sql(_BOUNDS_SQL("agg_pct"), "agg_pct", reals="percent_beyond"))
def bounds(spark, sf):
    percent = fx.agg(spark, sf).withColumns({c: F.col(c) * 40 for c in ("total_cpu", "peak_cpu")}) \
        .withColumns({c: F.col(c) * 3 for c in ("total_mem", "peak_mem", "disk_io")})
    return contracts.bounds_report(percent)


@query("p4_filter_audit", sql("""
SELECT count(*) AS rows_in, count(*) FILTER (WHERE machine_id IS NULL) AS null_machine,
       count(*) FILTER (WHERE machine_id IS NOT NULL AND end_time <= start_time) AS bad_duration,
       count(*) FILTER (WHERE machine_id IS NOT NULL AND end_time > start_time AND cpu_rate > 64) AS bad_rate,
       count(*) FILTER (WHERE machine_id IS NOT NULL AND end_time > start_time AND cpu_rate <= 64) AS rows_out
FROM task_usage""", "task_usage"))
def filter_audit(spark, sf):
    return rollup.drop_audit(fx.task_usage(spark, sf))


@query("p5_bucketise", sql("""
SELECT event_id, epoch_us(ts) // 300000000 AS bucket, epoch_us(ts) // 300000000 * 300000000 AS time_us,
       epoch_us(ts) // 1000 // 300000 AS bucket_from_ms FROM events"""))
def bucketise(spark, sf):
    us = fx.micros("ts")
    return fx.table(spark, sf, "events").select(
        "event_id", X.bucket_of(us).alias("bucket"), X.bucket_start(X.bucket_of(us)).alias("time_us"),
        F.floor(F.floor(us / 1000) / (S.BUCKET_SECONDS * 1000)).alias("bucket_from_ms"))


@query("p6_unit_conversion", sql("""
SELECT machine_id, bucket, bucket * 3600000000 AS time_us, least(greatest(c / 100 * 4, 0), 4) AS total_cpu,
       least(greatest(c / 100 * 4, 0), 4) AS peak_cpu, least(greatest(m / 100, 0), 1) AS total_mem,
       least(greatest(m / 100, 0), 1) AS peak_mem, least(greatest(d / 100, 0), 1) AS disk_io,
       greatest(1, CAST(round_even(l, 0) AS BIGINT)) AS n_tasks FROM items""", "items", reals=_AGG_REALS))
def unit_conversion(spark, sf):
    rolled = rollup.item_rollup(_resolved(spark, sf), fx.HOUR)
    return rollup.percent_to_units(rolled, F.lit(4), fx.HOUR)


@query("p7_low_coverage", sql("""
SELECT machine_id, count(DISTINCT bucket) AS n_buckets FROM agg GROUP BY 1 HAVING count(DISTINCT bucket) < 60""", "agg"))
def low_coverage(spark, sf):
    return contracts.low_coverage(fx.agg(spark, sf), 60)


@query("p8_null_features", sql("""
SELECT 'total_cpu' AS feature, max(total_cpu IS NULL) AS has_null FROM agg UNION ALL
SELECT 'previous', true UNION ALL SELECT 'n_tasks', max(n_tasks IS NULL) FROM agg""", "agg"))
def null_features(spark, sf):
    lagged = fx.agg(spark, sf).withColumn(
        "previous", F.when(F.col("disk_io") == 0, F.col("total_cpu")))
    return contracts.null_features(lagged, ("total_cpu", "previous", "n_tasks"))


block("span", "SELECT min(timestamp) - 3600 AS lo, max(timestamp) AS hi FROM matrix", "matrix")
block("wide", """
SELECT nodename, timestamp, max(CASE WHEN metric = 'total_cpu' THEN value END) AS total_cpu,
       max(CASE WHEN metric = 'peak_cpu' THEN value END) AS peak_cpu,
       max(CASE WHEN metric = 'total_mem' THEN value END) AS total_mem,
       max(CASE WHEN metric = 'disk_io' THEN value END) AS disk_io,
       max(CASE WHEN metric = 'load1' THEN value END) AS load1
FROM matrix GROUP BY 1, 2 HAVING count(CASE WHEN metric = 'total_cpu' THEN value END) > 0""", "matrix")
block("grid", """
SELECT g.nodename, g.timestamp, total_cpu, peak_cpu, total_mem, disk_io, load1
FROM (SELECT nodename, unnest(range(lo + 3600, hi + 1, 3600)) AS timestamp
      FROM (SELECT DISTINCT nodename FROM wide), span) g LEFT JOIN wide USING (nodename, timestamp)""", "wide", "span")
block("filled", """
SELECT nodename, timestamp, coalesce(total_cpu, 0) AS total_cpu, coalesce(peak_cpu, 0) AS peak_cpu,
       coalesce(last_value(total_mem IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING),
                first_value(total_mem IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)
         AS total_mem, coalesce(disk_io, 0) AS disk_io, coalesce(load1, 0) AS load1
FROM grid WINDOW w AS (PARTITION BY nodename ORDER BY timestamp)""", "grid")
_WIDE = "total_cpu peak_cpu total_mem disk_io load1"


def _wide(spark, sf):
    return joins.pivot_metrics(fx.matrix_long(spark, sf))


def _grid(spark, sf):
    samples = materialise(fx.matrix_long(spark, sf), "matrix")
    low = samples.agg((F.min("timestamp") - fx.HOUR).alias("t")).scalar()
    high = samples.agg(F.max("timestamp").alias("t")).scalar()
    return joins.full_grid(joins.pivot_metrics(samples), low, high, fx.HOUR)


def _filled(spark, sf):
    return joins.fill_grid(materialise(_grid(spark, sf), "grid"), span=8192 * fx.HOUR)


@query("p9_fallback_fill", sql(f"""
SELECT nodename, timestamp, total_cpu, peak_cpu, total_mem, total_mem AS peak_mem, disk_io, load1,
       greatest(1, CAST(round_even(coalesce(load1, total_cpu), 0) AS BIGINT)) AS n_tasks FROM filled""", "filled",
                               reals=f"{_WIDE} peak_mem"))
def fallback_fill(spark, sf):
    return joins.apply_fallbacks(_filled(spark, sf))


@query("p11_labelled_rows", sql("""
SELECT machine_id, bucket, CAST(severity_in_60m AS BIGINT) AS severity_in_60m FROM feat
WHERE severity_in_60m IS NOT NULL""", "feat"))
def labelled_rows(spark, sf):
    from tidewatch.operators.splits import labelled
    from tidewatch.plans import features
    out = features.train(fx.agg_table(spark, sf), bucket_seconds=fx.HOUR, slots=fx.SLOTS)
    return labelled(out, "severity_in_60m").select("machine_id", "bucket", "severity_in_60m")


# --- joins ------------------------------------------------------------------------

@query("j2_pivot_metrics", sql("SELECT * FROM wide", "wide", reals=_WIDE))
def pivot_metrics(spark, sf):
    return _wide(spark, sf)


@query("j3_full_grid", sql("SELECT * FROM grid", "grid", reals=_WIDE))
def full_grid(spark, sf):
    return _grid(spark, sf)


@query("w14_memory_fill", sql("SELECT * FROM filled", "filled", reals=_WIDE))
def memory_fill(spark, sf):
    return _filled(spark, sf)


@query("j6_readings_with_labels", sql("""
SELECT a.machine_id, a.bucket, a.total_cpu, f.spike_in_15m FROM agg a
JOIN feat f ON f.machine_id = a.machine_id AND f.bucket = a.bucket""", "feat", reals="total_cpu spike_in_15m"))
def readings_with_labels(spark, sf):
    from tidewatch.plans import features
    agg = fx.agg_table(spark, sf)
    labels = features.train(agg, bucket_seconds=fx.HOUR, slots=fx.SLOTS).select("machine_id", "bucket", "spike_in_15m")
    return joins.readings_with_labels(agg.select("machine_id", "bucket", "total_cpu"), labels)


@query("j9_stable_ids", sql("""
SELECT name AS nodename, row_number() OVER (ORDER BY name) AS machine_id
FROM (SELECT DISTINCT n_name || '/' || s_name AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""))
def stable_ids(spark, sf):
    names = (fx.table(spark, sf, "supplier")
             .join(fx.table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
             .select(F.concat_ws("/", "n_name", "s_name").alias("nodename")))
    return joins.stable_ids(names)


def _items(spark, sf):
    """Only items that reported in the last three days are known, so some readings stay unmatched."""
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in fx.KINDS.values()]), (F.col("itemid") % 4 + 1).cast("int"))
    catalog = fx.item_catalog(spark, sf)
    recent = catalog.agg((F.max("lastclock") - 3 * 86400).alias("c")).scalar()
    return catalog.filter(F.col("lastclock") >= recent).select(
        "itemid", F.col("hostid").alias("machine_id"), kind.alias("kind"))


def _resolved(spark, sf):
    numeric = fx.history(spark, sf).withColumn("value", F.col("value").try_cast("double"))
    return joins.resolve_items(numeric, _items(spark, sf))


block("resolved", """
SELECT itemid, clock, value, itemid // 4 AS machine_id,
       CASE itemid % 4 WHEN 0 THEN 'cpu' WHEN 1 THEN 'mem' WHEN 2 THEN 'disk' ELSE 'load' END AS kind
FROM history WHERE itemid IN (SELECT itemid FROM catalog WHERE lastclock >= (SELECT max(lastclock) - 259200 FROM catalog))""",
      "history", "catalog")
block("items", """
SELECT machine_id, clock // 3600 AS bucket, avg(value) FILTER (WHERE kind = 'cpu') AS c,
       coalesce(avg(value) FILTER (WHERE kind = 'mem'), 0) AS m, coalesce(avg(value) FILTER (WHERE kind = 'disk'), 0) AS d,
       coalesce(avg(value) FILTER (WHERE kind = 'load'), 1) AS l
FROM resolved GROUP BY 1, 2 HAVING count(*) FILTER (WHERE kind = 'cpu') > 0""", "resolved")


@query("j10_item_lookup", sql("SELECT * FROM resolved", "resolved", reals="value"))
def item_lookup(spark, sf):
    return _resolved(spark, sf)


# --- rollups ------------------------------------------------------------------------

@query("a1_weighted_rollup", sql("""
SELECT machine_id, bucket, bucket * 604800000000 AS time_us, total_cpu, peak_cpu, total_mem, peak_mem, disk_io, n_tasks
FROM task_rollup""", "task_rollup", reals=_AGG_REALS))
def weighted_rollup(spark, sf):
    return rollup.rollup(fx.task_usage(spark, sf), fx.WEEK)


@query("a2_merge_partials", sql("""
SELECT machine_id, bucket, bucket * 604800000000 AS time_us, total_cpu, peak_cpu, total_mem, peak_mem, disk_io, n_tasks
FROM task_rollup""", "task_rollup", reals=_AGG_REALS))
def merge_partials(spark, sf):
    """Two batches rolled up separately, then merged."""
    tasks = fx.task_usage(spark, sf)
    even, parts = F.col("batch_key") % 2 == 0, rollup.parts_for(tasks)
    both = rollup.partial_rollup(tasks.filter(even), fx.WEEK, parts).unionByName(
        rollup.partial_rollup(tasks.filter(~even), fx.WEEK, parts))
    return rollup.finish_rollup(rollup.merge_partials(both), fx.WEEK)


@query("k5_union_parts", sql("""
SELECT machine_id, bucket, cpu_time, n_tasks FROM (
  SELECT CAST(machine_id AS BIGINT) AS machine_id, CAST(floor(start_time / 604800e6) AS BIGINT) AS bucket,
         sum(cpu_rate * (end_time - start_time)) AS cpu_time, count(*) AS n_tasks
  FROM usable_tasks GROUP BY 1, 2, batch_key % 2)""", "usable_tasks", reals="cpu_time"))
def union_parts(spark, sf):
    tasks = fx.task_usage(spark, sf)
    even, parts = F.col("batch_key") % 2 == 0, rollup.parts_for(tasks)
    return rollup.partial_rollup(tasks.filter(even), fx.WEEK, parts).unionByName(
        rollup.partial_rollup(tasks.filter(~even), fx.WEEK, parts)).select("machine_id", "bucket", "cpu_time", "n_tasks")


@query("k1_ordered_table", sql("""
SELECT machine_id, bucket, total_cpu FROM task_rollup ORDER BY machine_id, bucket""", "task_rollup", reals="total_cpu"))
def ordered_table(spark, sf):
    return rollup.rollup(fx.task_usage(spark, sf), fx.WEEK).select("machine_id", "bucket", "total_cpu") \
        .orderBy("machine_id", "bucket")


@query("a3_item_rollup", sql("SELECT machine_id, bucket, c AS cpu_pct, m AS mem_pct, d AS disk_pct, l AS load_avg FROM items",
                             "items", reals="cpu_pct mem_pct disk_pct load_avg"))
def item_rollup(spark, sf):
    return rollup.item_rollup(_resolved(spark, sf), fx.HOUR)


@query("a4_duplicate_buckets", sql("""
SELECT machine_id, bucket // 6 AS bucket, min(time_us) AS time_us, avg(total_cpu) AS total_cpu, avg(peak_cpu) AS peak_cpu,
       avg(total_mem) AS total_mem, avg(peak_mem) AS peak_mem, avg(disk_io) AS disk_io,
       greatest(1, CAST(round_even(avg(n_tasks), 0) AS BIGINT)) AS n_tasks
FROM agg GROUP BY 1, 2""", "agg", reals=_AGG_REALS))
def duplicate_buckets(spark, sf):
    return rollup.merge_duplicate_buckets(
        fx.agg(spark, sf).withColumn("bucket", F.floor(F.col("bucket") / 6).cast("long")))


@query("a5_latest_item", sql("""
SELECT hostid, arg_max(itemid, lastclock * 1000000 - itemid) AS itemid, max(lastclock) AS lastclock
FROM catalog WHERE contains(key_, 'system.cpu') GROUP BY 1""", "catalog"))
def latest_item(spark, sf):
    return rollup.latest_item(fx.item_catalog(spark, sf), "system.cpu").select("hostid", "itemid", "lastclock")


# --- inventory ------------------------------------------------------------------------

def _host_readings(spark, sf):
    return fx.history(spark, sf).withColumn("hostid", F.floor(F.col("itemid") / 4).cast("long"))


def _now(readings):
    return readings.agg(F.max("clock").alias("c")).scalar()


@query("a17_interval_statistics", sql("""
SELECT hostid, count(*) AS n_readings, avg(gap) AS mean_gap, stddev_samp(gap) AS std_gap, min(gap) AS min_gap,
       max(gap) AS max_gap, count(*) FILTER (WHERE gap > 600) AS long_gaps
FROM (SELECT *, clock - lag(clock) OVER (PARTITION BY hostid ORDER BY clock) AS gap
      FROM (SELECT itemid // 4 AS hostid, clock FROM history)) GROUP BY 1 HAVING count(*) >= 2""", "history", reals="mean_gap std_gap"))
def interval_statistics(spark, sf):
    return inventory.interval_statistics(_host_readings(spark, sf))


@query("a18_freshness", sql("""
SELECT itemid AS hostid, max(clock) AS last_clock,
       CASE WHEN ((SELECT max(clock) FROM history) - max(clock)) / 3600e0 <= 24 THEN 'active'
            WHEN ((SELECT max(clock) FROM history) - max(clock)) / 3600e0 <= 168 THEN 'stale' ELSE 'dead' END AS freshness
FROM history GROUP BY 1""", "history"))
def freshness(spark, sf):
    readings = fx.history(spark, sf).withColumn("hostid", F.col("itemid"))
    return inventory.freshness(readings, _now(readings))


@query("a19_key_coverage", sql("""
SELECT hostid, item, present FROM (SELECT hostid, unnest(['CPU util', 'CPU load', 'Memory', 'Disk util', 'Disk I/O',
         'Slurm state', 'GPU', 'Interrupts', 'Ctx switches']) AS item,
       unnest([bool_or(contains(key_, 'system.cpu.util')), bool_or(contains(key_, 'system.cpu.load')),
               bool_or(contains(key_, 'vm.memory')), bool_or(contains(key_, 'vfs.dev.util')), false, false, false, false,
               false]) AS present FROM catalog GROUP BY 1)""", "catalog"))
def key_coverage(spark, sf):
    return inventory.key_coverage(fx.item_catalog(spark, sf))


@query("a20_retention", sql("""
SELECT hosts, shortest_days, hosts * shortest_days * 288 AS row_estimate FROM (
  SELECT count(*) AS hosts, min(CASE WHEN days > 0 THEN days END) AS shortest_days FROM (
    SELECT itemid // 4 AS hostid, ((SELECT max(clock) FROM history) - min(clock)) // 86400 AS days
    FROM history GROUP BY 1))""", "history"))
def retention(spark, sf):
    readings = _host_readings(spark, sf)
    return inventory.row_estimate(inventory.retention(readings, _now(readings)))
