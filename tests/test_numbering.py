"""Numbering and running sums by ranges of the order."""

from pyspark.sql import functions as F

from tidewatch.operators import joins, ordered, splits


def test_names_of_one_prefix_are_numbered_by_many_tasks(spark):
    names = spark.range(4000).select(F.format_string("compute-node-%05d", F.col("id") * 7 % 4000).alias("nodename"))
    numbered = joins.stable_ids(names.unionByName(names))
    got = {r.nodename: r.machine_id for r in numbered.collect()}
    assert got == {name: i for i, name in enumerate(sorted(got), 1)} and len(got) == 4000
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_range" in plan and "windowspecdefinition(1" not in plan
    ranged = spark.read.parquet(numbered.inputFiles()[0].rsplit("/", 1)[0])
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 4000 / 4


def test_running_sums_of_odd_rows(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 5), (None, 1), ("c", 0), ("d", 9)], "k string, n int")
    assert {r.k: r.before for r in ordered.amount_before(rows, ["k"], F.col("n")).collect()} == {None: 0, "a": 1, "b": 6, "c": 8, "d": 8}
    assert ordered.amount_before(rows.limit(0), ["k"], F.col("n")).count() == 0
    assert joins.stable_ids(spark.createDataFrame([], "nodename string")).count() == 0


def test_row_order_folds_are_those_of_a_sorted_table(spark):
    rows = [(m, b) for m in (3, 1, 2) for b in range(10 * m)]
    got = sorted((r.machine_id, r.bucket, r.fold, r.role) for r in splits.walk_forward(spark.createDataFrame(rows, "machine_id long, bucket long"), folds=2, gap=3, by="row").collect())
    size, want = 60 // 3, []
    for at, key in enumerate(sorted(rows)):
        for fold in (1, 2):
            start = 60 - size * (3 - fold)
            want += [(*key, fold, "train")] if at < start - 3 else [(*key, fold, "test")] if start <= at < start + size else []
    assert got == sorted(want)
