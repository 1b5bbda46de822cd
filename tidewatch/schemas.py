"""Table schemas and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Names, limits and taxonomies that results must agree on.
# ---------------------------------------------------------------------------

BUCKET_SECONDS = 300
SLOTS_PER_DAY = 288
HORIZON = 12
SHORT_HORIZONS = {"spike_in_15m": 3, "spike_in_30m": 6, "spike_in_45m": 9}
LAGS = (1, 12, 24)
HALF_LIVES = (6, 24)
HISTORY_WINDOWS = (1, 3, 6)
HISTORY_CAP = 24
TRAIN_RATIO = 0.6
VAL_RATIO = 0.2
MIN_GAP_FACTOR = 1.10
MAX_CPU_RATE = 64.0
BOOTSTRAP_MIN_BUCKETS = 2016
COVERAGE_MIN_BUCKETS = 288

SIGNALS = ("total_cpu", "peak_cpu", "total_mem", "peak_mem", "disk_io")
AGG_COLUMNS = ("machine_id", "bucket", "time_us") + SIGNALS + ("n_tasks",)

MODEL_FEATURES = [
    "total_cpu", "peak_cpu", "total_mem", "peak_mem", "disk_io", "n_tasks",
    "cpu_per_task",
    "cpu_lag_1", "cpu_lag_12", "cpu_lag_24",
    "cpu_ewma_6", "cpu_ewma_24",
    "cpu_delta_1", "cpu_delta_2", "cpu_rolling_std_6",
    "task_dominance",
    "cpu_vs_p95", "cpu_vs_p95_delta", "cpu_vs_p95_slope_3", "cpu_vs_p95_slope_6",
    "time_to_p95_3", "peak_cpu_vs_p95",
    "spike_severe_now", "cpu_vs_p99", "peak_cpu_vs_p99", "band_position", "band_width",
    "spike_severe_in_last_1", "spike_severe_in_last_3", "spike_severe_in_last_6",
    "spike_now", "spike_in_last_1", "spike_in_last_3", "spike_in_last_6",
    "time_since_last_spike", "cpu_spike_rate_24",
    "cluster_cpu_p90", "machine_rank_in_cluster",
    "hour_sin", "hour_cos",
]

LABELS = ["spike_in_15m", "spike_in_30m", "spike_in_45m", "severity_in_60m"]

FEATURE_GROUPS = {
    "Raw Signal": ["total_cpu", "peak_cpu", "total_mem", "peak_mem", "disk_io", "n_tasks",
                   "cpu_per_task"],
    "Lag": ["cpu_lag_1", "cpu_lag_12", "cpu_lag_24"],
    "Trend": ["cpu_ewma_6", "cpu_ewma_24", "cpu_delta_1", "cpu_delta_2", "cpu_rolling_std_6"],
    "Machine-Relative": ["task_dominance", "cpu_vs_p95", "cpu_vs_p95_delta", "peak_cpu_vs_p95",
                         "cpu_vs_p99", "peak_cpu_vs_p99", "band_position", "band_width"],
    "Spike History": ["spike_now", "spike_in_last_1", "spike_in_last_3", "spike_in_last_6",
                      "time_since_last_spike", "cpu_spike_rate_24"],
    "Spike History (Severe)": ["spike_severe_now", "spike_severe_in_last_1",
                               "spike_severe_in_last_3", "spike_severe_in_last_6"],
    "Cluster": ["cluster_cpu_p90", "machine_rank_in_cluster"],
    "Time": ["hour_sin", "hour_cos"],
}

# column -> ("above" | "below", bound)
INPUT_BOUNDS = {
    "total_cpu": ("above", 10.0),
    "peak_cpu": ("above", 10.0),
    "total_mem": ("above", 1.0),
    "peak_mem": ("above", 1.0),
    "disk_io": ("above", 1.0),
    "n_tasks": ("below", 0.0),
}

# position in the headerless 20-column trace file -> column name
TRACE_POSITIONS = {
    0: "start_time", 1: "end_time", 4: "machine_id", 5: "cpu_rate", 6: "canonical_mem_usage",
    10: "max_mem_usage", 11: "mean_disk_io_time", 13: "max_cpu_rate", 17: "sample_portion",
}

EXPECTED_ITEM_KEYS = {
    "CPU util": "system.cpu.util",
    "CPU load": "system.cpu.load",
    "Memory": "vm.memory",
    "Disk util": "vfs.dev.util",
    "Disk I/O": "vfs.dev.read",
    "Slurm state": "slurm",
    "GPU": "gpu",
    "Interrupts": "system.cpu.intr",
    "Ctx switches": "system.cpu.switches",
}

PSI_STABLE, PSI_WARNING, PSI_EMERGENCY = 0.10, 0.25, 0.50
PSI_FLOOR = 1e-4
SYSTEM_ALERT_PSI, SYSTEM_ALERT_SHARE = 0.20, 0.10
STAGE_ONE_GATE = 0.15
SMOOTHING_ALPHA = 0.5
MIN_CONSECUTIVE = 2
SLO_WINDOW = 300
COLD_START_ROWS, FULL_HISTORY_ROWS = 12, 24
PASSIVE_ACTIONS = ("normal", "monitor")
URGENT_ACTIONS = ("preempt_now", "migrate_jobs")

# ---------------------------------------------------------------------------
# Spark schemas
# ---------------------------------------------------------------------------

TASK_USAGE = T.StructType([T.StructField(c, T.DoubleType()) for c in (
    "start_time", "end_time", "machine_id", "cpu_rate", "max_cpu_rate",
    "canonical_mem_usage", "max_mem_usage", "mean_disk_io_time", "sample_portion")])

TRACE_RAW = T.StructType([
    T.StructField(TRACE_POSITIONS.get(i, f"unused_{i}"), T.DoubleType()) for i in range(20)])

CLUSTER_AGG = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("machine_id", "bucket", "time_us")]
    + [T.StructField(c, T.DoubleType()) for c in SIGNALS]
    + [T.StructField("n_tasks", T.LongType())])

ITEM_HISTORY = T.StructType([
    T.StructField("itemid", T.LongType()),
    T.StructField("clock", T.LongType()),
    T.StructField("value", T.StringType())])

ITEM_CATALOG = T.StructType([
    T.StructField("itemid", T.LongType()),
    T.StructField("hostid", T.LongType()),
    T.StructField("key_", T.StringType()),
    T.StructField("value_type", T.IntegerType()),
    T.StructField("lastclock", T.LongType()),
    T.StructField("lastvalue", T.StringType())])

METRIC_MATRIX = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("resultType", T.StringType()),
        T.StructField("result", T.ArrayType(T.StructType([
            T.StructField("metric", T.MapType(T.StringType(), T.StringType())),
            T.StructField("values", T.ArrayType(T.ArrayType(T.StringType()))),
        ]))),
    ])),
])
