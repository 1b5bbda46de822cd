"""Worked cases for sources, rollups and ingest joins."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.operators import inventory, joins, rollup
from tidewatch.sources import adapters, contracts, readers, sinks

MIN5 = 300_000_000


def tasks(spark, rows):
    full = [(float(s), float(e), m, c, p, .1, .2, .01, 1.0) for s, e, m, c, p in rows]
    return spark.createDataFrame(full, S.TASK_USAGE)


BIG_ID = 6_301_942_525.0


def test_duration_weighting_filters_and_big_ids(spark):
    t = tasks(spark, [(0, MIN5, BIG_ID, .5, .6), (0, 2_000_000, BIG_ID, .5, .9), (MIN5, 2 * MIN5, 1.0, .2, .3),
                      (0, MIN5, None, .5, .5), (5, 5, 1.0, .5, .5), (0, MIN5, 1.0, 100.0, 1.0)])
    got = {(r.machine_id, r.bucket): r for r in rollup.rollup(t).collect()}
    assert set(got) == {(6_301_942_525, 0), (1, 1)}
    assert got[6_301_942_525, 0].total_cpu == pytest.approx(.5 + .5 * 2 / 300)
    assert got[6_301_942_525, 0].n_tasks == 2 and got[6_301_942_525, 0].peak_cpu == .9
    audit = rollup.drop_audit(t).first().asDict()
    assert audit == dict(rows_in=6, null_machine=1, bad_duration=1, bad_rate=1, rows_out=3)


def test_partials_merge_to_the_whole(spark):
    t = tasks(spark, [(i * 1e7, i * 1e7 + 5e6, float(i % 2), .1 * i, .2 * i) for i in range(1, 40)])
    cut = F.col("start_time") < 2e8
    parts = rollup.partial_rollup(t.filter(cut)).unionByName(rollup.partial_rollup(t.filter(~cut)))
    a = {(r.machine_id, r.bucket): r for r in rollup.rollup(t).collect()}
    b = {(r.machine_id, r.bucket): r for r in rollup.finish_rollup(rollup.merge_partials(parts)).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert list(a[k])[3:] == pytest.approx(list(b[k])[3:])


def test_positional_parts_skip_bad_lines(spark, tmp_path):
    def line(start, machine):
        cells = [str(i) for i in range(20)]
        cells[0], cells[1], cells[4] = str(start), str(start + 10), str(machine)
        return ",".join(cells)
    with gzip.open(tmp_path / "p.csv.gz", "wt") as f:
        f.write("\n".join([line(0, 5), line(10, BIG_ID), "junk,x,y", line(9e12, 5)]))
    got = readers.trace_parts(spark, str(tmp_path), 1).collect()
    assert sorted(r.machine_id for r in got) == [5.0, BIG_ID]
    assert {r.cpu_rate for r in got} == {5.0} and {r.max_cpu_rate for r in got} == {13.0}


def test_matrix_names_and_failure(spark, tmp_path):
    doc = {"status": "success", "data": {"resultType": "matrix", "result": [
        {"metric": {"nodename": "a"}, "values": [[300, "0.5"], [600, "0.75"]]},
        {"metric": {"node": "b"}, "values": [[300.9, "1"]]}, {"metric": {}, "values": [[300, "2"]]}]}}
    (tmp_path / "ok.json").write_text(json.dumps(doc))
    rows = sorted((r.nodename, r.timestamp, r.value) for r in readers.metric_matrix(spark, str(tmp_path)).collect())
    assert rows == [("a", 300, .5), ("a", 600, .75), ("b", 300, 1.0), ("unknown", 300, 2.0)]
    bad = spark.createDataFrame([("error", "timeout", None)], S.METRIC_MATRIX)
    with pytest.raises(Exception, match="query failed"):
        readers.parse_matrix(bad).collect()


def test_grid_fill_and_fallbacks(spark):
    wide = spark.createDataFrame(
        [("n1", 600, 1.0, None, None, .2, 2.5), ("n1", 1500, 3.0, None, .6, None, None), ("n2", 900, .4, None, None, None, None)],
        "nodename string, timestamp long, total_cpu double, peak_cpu double, total_mem double, disk_io double, load1 double")
    grid = joins.full_grid(wide, 300, 1500, 300, run=2)
    assert grid.count() == 8
    for span in (300, 600, 10_000):
        out = {(r.nodename, r.timestamp): r for r in joins.apply_fallbacks(joins.fill_grid(grid, span=span)).collect()}
        assert [out["n1", t].total_mem for t in (600, 900, 1200, 1500)] == [.6] * 4
        assert out["n2", 900].total_mem == 0.0 and out["n1", 900].total_cpu == 0.0
        assert out["n1", 600].peak_cpu == 1.0 and out["n1", 600].n_tasks == 2 and out["n1", 1500].n_tasks == 1


def test_forward_fill_crosses_spans(spark):
    rows = [("a", t, {3: 5.0, 40: 7.0}.get(t)) for t in range(60)]
    df = spark.createDataFrame(rows, "nodename string, timestamp long, v double")
    got = [r.v for r in joins.fill_forward_back(df, ["v"], span=7).orderBy("timestamp").collect()]
    assert got == [5.0] * 40 + [7.0] * 20


def test_history_rollup_defaults_and_half_even(spark):
    r = spark.createDataFrame([(1, "cpu", 10, 50.0), (1, "cpu", 20, 70.0), (1, "load", 20, 2.5), (2, "mem", 5, 10.0)],
                              "machine_id long, kind string, clock long, value double")
    out = rollup.percent_to_units(rollup.item_rollup(r), F.lit(4)).collect()
    assert len(out) == 1 and out[0].total_cpu == pytest.approx(2.4) and out[0].n_tasks == 2 and out[0].total_mem == 0.0


def test_stable_ids_follow_name_order(spark):
    names = spark.createDataFrame([(n,) for n in ["node-2", "node-10", "a", "zz", "node-2"]], "nodename string")
    got = {r.nodename: r.machine_id for r in joins.stable_ids(names, prefix=3).collect()}
    assert got == {"a": 1, "node-10": 2, "node-2": 3, "zz": 4}


def test_contracts(spark):
    df = spark.createDataFrame([("1", "2", "x")], "machine_id string, bucket string, total_cpu string")
    with pytest.raises(ValueError, match="missing columns"):
        contracts.require(df)
    with pytest.raises(ValueError, match="non-numeric"):
        contracts.coerce_strict(df)
    empty = spark.createDataFrame([], S.CLUSTER_AGG)
    with pytest.raises(ValueError, match="no rows"):
        contracts.require(empty)
    adapters.register_adapter("nothing", lambda s, p: empty)
    assert adapters.read_with(spark, "nothing", "").columns == list(S.AGG_COLUMNS)


def test_stage_reuse_runs_a_build_once(spark, tmp_path):
    calls = []

    def build(_):
        calls.append(1)
        return spark.range(3).withColumn("bucket", F.col("id")).withColumnRenamed("id", "machine_id")
    stages = [("one", build)]
    assert sinks.run_stages(spark, str(tmp_path), stages).count() == 3
    assert sinks.run_stages(spark, str(tmp_path), stages).count() == 3 and len(calls) == 1
    sinks.run_stages(spark, str(tmp_path), stages, force=True)
    assert len(calls) == 2


def test_newest_readings_only(spark):
    r = spark.createDataFrame([(1, 300 * i) for i in range(100)] + [(2, 5)], "hostid long, clock long")
    out = inventory.interval_statistics(r, newest=60).collect()
    assert len(out) == 1 and out[0].n_readings == 60 and out[0].mean_gap == 300.0 and out[0].long_gaps == 0


def test_merged_rollups_are_dealt_into_more_parts_for_more_records(spark, monkeypatch):
    t = spark.range(3000).selectExpr("cast(id % 50 as double) AS machine_id", "id * 1e6 AS start_time", "(id + 5) * 1e6 AS end_time", "0.5 AS cpu_rate", "1.0 AS max_cpu_rate",
                                     "0.25 AS canonical_mem_usage", "0.5 AS max_mem_usage", "0.0 AS mean_disk_io_time", "id AS batch_key")
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rollup.parts_for(t) == usual
    monkeypatch.setattr(rollup, "PART_ROWS", 100)
    parts = max(usual, 30)
    assert rollup.parts_for(t) == parts
    cut = F.col("batch_key") % 2 == 0
    even, odd = (rollup.partial_rollup(t.filter(c), 300, parts) for c in (cut, ~cut))
    assert even.rdd.getNumPartitions() == odd.rdd.getNumPartitions() == parts
    got = {(r.machine_id, r.bucket): r for r in rollup.finish_rollup(rollup.merge_partials(even.unionByName(odd)), 300).collect()}
    assert got == {(r.machine_id, r.bucket): r for r in rollup.rollup(t, 300).collect()}
