"""Structured Streaming forms of the rollup, look-back, cycle and alarm operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch import schemas as S
from tidewatch.operators import chunks, scoring
from tidewatch.session import discard, fresh_path, materialise

ALARM_STATE = "smoothed double, streak long, seen long"


def landed_files(spark: SparkSession, folder: str, schema, name: str = "*.parquet", per_trigger: int = 1) -> DataFrame:
    """File-source stream over Parquet files dropped into a folder."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", name)
            .option("maxFilesPerTrigger", per_trigger).parquet(folder))


def rollup_stream(events: DataFrame, aggregates: list[Column], *, time: str = "ts", key: str = "machine_id",
                  width: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Tumbling rollup per machine; rows later than the watermark are dropped."""
    seconds = F.unix_timestamp(F.col("window.end")) - F.unix_timestamp(F.col("window.start"))
    out = events.withWatermark(time, lateness).groupBy(F.window(time, width), key).agg(*aggregates)
    names = [c for c in out.columns if c not in ("window", key)]
    return out.select(key, F.floor(F.unix_timestamp(F.col("window.start")) / seconds).cast("long").alias("bucket"), *names)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], label: str, mode: str = "update",
                  checkpoint: str | None = None) -> None:
    """Process everything that has landed, then stop; the checkpoint makes a re-run resume.

    A stream with timers on processing time would run batches without data for ever, so it runs none here; its timers fire with
    the next batch that has data, or under a trigger that goes on.
    """
    spark, idle = stream.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before, timers = spark.conf.get(idle), "ProcessingTimeTimeout" in stream._jdf.queryExecution().logical().toString()
    if timers:
        spark.conf.set(idle, "false")
    try:
        query = (stream.writeStream.foreachBatch(sink).outputMode(mode)
                 .option("checkpointLocation", checkpoint or fresh_path(spark, f"{label}-checkpoint"))
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.set(idle, before)


def versioned_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to its own folder; replaying a batch overwrites only itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def newest(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Of every key the row of the largest ``batch``; partial aggregation keeps one row per key and task."""
    rest = [c for c in versions.columns if c not in (*keys, "batch")]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"), F.max("batch").alias("batch")).select(*keys, "_r.*", "batch")


def newest_version(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Latest update of every key from a versioned table."""
    return newest(spark.read.parquet(path), keys).drop("batch")


def compact(spark: SparkSession, path: str, keys: list[str]) -> None:
    """Fold all versions of a versioned table into that of its newest batch; later batches are written as before.

    The folded rows are written beside the table, then take the newest batch's place, then older batches go. A run that breaks off
    leaves all rows in one of the two places, and the next run completes it. Not while a batch is written or the table read.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs, beside = place(path).getFileSystem(conf), f"{path}-folded"
    if not fs.exists(place(f"{beside}/_SUCCESS")):
        fs.delete(place(beside), True)
        versions = spark.read.parquet(path)
        last = max(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(place(path)) if f.getPath().getName().startswith("batch="))
        newest(versions, keys).drop("batch").write.parquet(f"{beside}/batch={last}")
        fs.create(place(f"{beside}/_SUCCESS")).close()
    folded = next((f.getPath() for f in fs.listStatus(place(beside)) if f.isDirectory()), None)
    if folded is None:  # the rows had been moved already
        fs.delete(place(beside), True)
        return
    last = int(folded.getName().split("=")[1])
    for f in fs.listStatus(place(path)):
        name = f.getPath().getName()
        if name.startswith("batch=") and int(name.split("=")[1]) <= last:
            fs.delete(f.getPath(), True)
    fs.rename(folded, place(f"{path}/{folded.getName()}"))
    fs.delete(place(beside), True)


# --- look-back ---------------------------------------------------------------------------------

def lookback(agg: DataFrame, buckets: int = 24, value: str = "total_cpu", key: str = "machine_id",
             size: int = chunks.CHUNK_BUCKETS, changed: str | None = None) -> DataFrame:
    """Rows and mean of the last ``buckets`` buckets at every row, by bucket distance.

    With ``changed``, a flag of the rows, only those are given whose window holds a flagged row.
    """
    spread = agg.select(key, "bucket", value, *([changed] if changed else []), chunks.halo_copies(F.col("bucket"), size, buckets, 0).alias(chunks.CHUNK))
    w = Window.partitionBy(key, chunks.CHUNK).orderBy("bucket").rangeBetween(-(buckets - 1), 0)
    out = spread.withColumns({"rows_in_window": F.count(F.lit(1)).over(w), "mean_in_window": F.avg(value).over(w)})
    if changed:
        out = out.withColumn("_touched", F.max(changed).over(w)).filter("_touched")
    return (out.filter(F.floor(F.col("bucket") / size) == F.col(chunks.CHUNK))
            .select(key, "bucket", "rows_in_window", "mean_in_window"))


def lookback_sink(history: str, output: str, buckets: int = 24) -> Callable[[DataFrame, int], None]:
    """Per micro-batch: join the new buckets with the recent past of the table, then append both.

    Only the stored rows from ``buckets`` before the batch's first bucket on are read - the bucket filter reaches the Parquet
    scan. ``output`` is a change log: a row that comes late also writes the later rows whose window holds it anew, and a
    machine's bucket that comes again replaces the earlier row. Read it with ``newest_version``; ``compact`` folds it.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        low = batch.agg(F.min("bucket").alias("b")).first()["b"]
        if low is None:  # an empty batch leaves an empty part, so the table exists for the next
            batch.write.mode("overwrite").parquet(f"{history}/batch={batch_id}")
            return
        recent = batch.withColumn("batch", F.lit(batch_id))
        if batch_id > 0:
            older = spark.read.parquet(history).filter((F.col("batch") < batch_id) & (F.col("bucket") > low - buckets))
            recent = newest(older.unionByName(recent), ["machine_id", "bucket"])
        changed = lookback(recent.withColumn("_new", F.col("batch") == batch_id), buckets, changed="_new")
        changed.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
        batch.write.mode("overwrite").parquet(f"{history}/batch={batch_id}")
    return process


# --- cycles ---------------------------------------------------------------------------------------

def cycle_sink(valid: Column, accepted: str, quarantine: str, slo: str) -> Callable[[DataFrame, int], None]:
    """A cycle never stops on bad input: bad rows are set aside, the cycle is recorded either way."""
    def process(batch: DataFrame, batch_id: int) -> None:
        # the batch is read once; what follows reads the table of it
        read = materialise(batch.withColumn("_ok", F.coalesce(valid, F.lit(False))), "cycle")
        ok = F.col("_ok")
        read.filter(ok).drop("_ok").write.mode("overwrite").parquet(f"{accepted}/batch={batch_id}")
        read.filter(~ok).drop("_ok").write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        (read.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(ok).alias("rows_accepted"),
                  F.count_if(~ok).alias("rows_quarantined"))
         .withColumn("success", F.col("rows_accepted") > 0)
         .write.mode("overwrite").parquet(f"{slo}/batch={batch_id}"))
    return process


def scoring_cycle_sink(valid: Column, build: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame], root: str,
                       buckets: int = 24, latency: Column | None = None) -> Callable[[DataFrame, int], None]:
    """A whole cycle per micro-batch under ``root``: accepted, quarantine, features, scores, alarms and slo, each in its ``batch=<id>``.

    ``build`` makes features of the accepted rows of the last ``buckets`` buckets, one row per machine; ``score`` makes decisions of
    them (``machine_id``, ``status``, ``recommended_action``). Bad rows are set aside. A batch without good rows has no
    features, scores or alarms; it and one that ``build`` or ``score`` fails on are recorded as failed, and the stream goes on. All of a
    batch follows from it and from earlier batches, so a replay writes the same over it. Without ``latency`` the service-level
    row has the rows per thousand as its latency, which a replay repeats; a clock would not.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = lambda name: f"{root}/{name}/batch={batch_id}"
        put = lambda df, name: df.write.mode("overwrite").parquet(at(name))
        read = materialise(batch.withColumn("_ok", F.coalesce(valid, F.lit(False))), "cycle")  # the batch is read once
        put(read.filter("_ok").drop("_ok"), "accepted")
        put(read.filter("NOT _ok").drop("_ok"), "quarantine")
        counts = read.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if("_ok").alias("rows_accepted"), F.max(F.when(F.col("_ok"), F.col("bucket"))).alias("newest"))
        rows_in, accepted, newest_bucket = counts.first()
        problem = None if accepted else "no accepted rows"
        if accepted:
            recent = (spark.read.schema(read.drop("_ok").schema.add("batch", "long")).parquet(f"{root}/accepted")
                      .filter((F.col("batch") <= batch_id) & (F.col("bucket") > newest_bucket - buckets)))
            try:
                put(build(newest(recent, ["machine_id", "bucket"]).drop("batch")), "features")
                put(score(spark.read.parquet(at("features"))), "scores")
                put(scoring.alarming(spark.read.parquet(at("scores"))), "alarms")
            except Exception as error:  # the cycle is recorded, the stream goes on
                problem = type(error).__name__
        facts = [F.lit(batch_id).cast("long").alias("cycle"), F.lit(rows_in).alias("rows_in"), F.lit(accepted).alias("rows_accepted"),
                 F.lit(problem).cast("string").alias("problem")]
        one = spark.range(1).select(*facts)
        if problem is None:
            one = one.join(scoring.cycle_stats(spark.read.parquet(at("scores")).withColumn("cycle", F.lit(batch_id).cast("long"))), "cycle")
        else:
            one = one.withColumns({c: F.lit(None).cast("long") for c in ("machines_total", "machines_predicted", "machines_cold_start", "alarm_count")}
                                  | {c: F.lit(None).cast("double") for c in ("alarm_rate", "cold_start_rate")})
        took = latency if latency is not None else F.col("rows_in") / 1000.0
        record = scoring.slo_records(one, took, F.lit(problem is None))
        put(record.crossJoin(one.select("rows_in", "rows_accepted", "problem")).coalesce(1), "slo")  # one row
        discard(read)
    return process


# --- keyed alarm state ------------------------------------------------------------------------------

def step_alarms(rows: pd.DataFrame, smoothed: float | None, streak: int, alpha: float, at_least: int) -> tuple[pd.DataFrame, float | None, int]:
    """Smooth and debounce a machine's new rows, going on from a mean and a streak; the two after them come along.

    Rows without a probability have no mean but end or continue the streak; rows of a cold start are passed over.
    """
    cycle = rows["cycle"].to_numpy()
    if len(rows) > 1 and not (cycle[1:] >= cycle[:-1]).all():
        rows = rows.sort_values("cycle", ignore_index=True)
    # a call has few rows, so work on arrays: each step of pandas costs as much as all of them
    cells = {c: rows[c].to_numpy() for c in rows.columns}
    warm = cells["status"] != "cold_start"
    p = (rows["p_moderate"].to_numpy(dtype=float) + rows["p_severe"].to_numpy(dtype=float))
    known = warm & ~np.isnan(p)
    means = np.full(len(rows), np.nan)
    found = []
    for x in p[known].tolist():
        smoothed = x if smoothed is None else (1 - alpha) * smoothed + alpha * x
        found.append(smoothed)
    means[known] = found
    limit = rows["alarm_threshold"].to_numpy(dtype=float)
    below = known & (means < limit)
    spike = cells["is_spike"] if cells["is_spike"].dtype == bool else np.array([v is not None and v == True for v in cells["is_spike"].tolist()], bool)  # noqa: E712
    spiking = warm & spike & (~known | (means >= limit))
    counted = spiking[warm]
    at = np.arange(len(counted))
    stopped = np.maximum.accumulate(np.where(counted, -1, at)) if len(at) else at
    streaks = np.zeros(len(rows), np.int64)
    streaks[warm] = at - stopped + np.where(stopped < 0, streak, 0)
    after = int(streaks[warm][-1]) if len(at) else streak
    quiet = warm & (below | ((streaks > 0) & (streaks < at_least)))
    if quiet.any():
        for column, value in (("is_spike", False), ("is_severe", False), ("recommended_action", "normal")):
            cells[column] = cells[column].copy()
            cells[column][quiet] = value
    return pd.DataFrame({**cells, "p_spike_smoothed": means, "consecutive_alarms": streaks}, copy=False), smoothed, after


def alarm_states(predictions: DataFrame, alpha: float = S.SMOOTHING_ALPHA, at_least: int = S.MIN_CONSECUTIVE, silent: float = 86_400.0) -> DataFrame:
    """Smoothing and then debounce with state per machine, across micro-batches.

    A cycle has one row per machine, so a micro-batch holds few rows per key; cycles must arrive in order. The state of a machine
    that sends nothing for ``silent`` seconds is removed by a timer, and the machine starts afresh, also if its next rows
    come with the timer.
    """
    schema = predictions.schema.simpleString()[len("struct<"):-1].replace(":", " ")
    wait = max(1, int(silent * 1000))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        smoothed, streak, seen = state.get if state.exists else (None, 0, now)
        if now - seen > wait:
            smoothed, streak = None, 0
        frames = list(parts)
        done, smoothed, streak = step_alarms(frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True), smoothed, streak, alpha, at_least)
        if smoothed is not None or streak:
            state.update((smoothed, streak, now))
            state.setTimeoutDuration(wait)
        elif state.exists:
            state.remove()
        yield done

    return predictions.groupBy("machine_id").applyInPandasWithState(
        step, outputStructType=f"{schema}, p_spike_smoothed double, consecutive_alarms long", stateStructType=ALARM_STATE, outputMode="append",
        timeoutConf=GroupStateTimeout.ProcessingTimeTimeout)


def session_episodes(readings: DataFrame, above: Column, width_seconds: int, lateness: str = "1 hour",
                     time: str = "ts", key: str = "machine_id") -> DataFrame:
    """Runs of exceeding buckets as session windows; a gap of more than one bucket ends a run."""
    hot = readings.filter(above).withWatermark(time, lateness)
    return (hot.groupBy(F.session_window(time, f"{width_seconds + 1} seconds"), key)
            .agg(F.count(F.lit(1)).alias("n_rows"), F.min(time).alias("first_at"), F.max(time).alias("last_at"))
            .drop("session_window"))


def ingest_parts(spark: SparkSession, folder: str, table: str, checkpoint: str, hours: float) -> None:
    """Append newly landed headerless parts to a table; the checkpoint remembers which are done."""
    raw = (spark.readStream.schema(S.TRACE_RAW).option("mode", "DROPMALFORMED").csv(folder))
    kept = raw.filter(F.col("start_time") <= F.lit(hours * 3.6e9)).select(*[f.name for f in S.TASK_USAGE.fields])
    query = (kept.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
