"""The bootstrap against a loop over rows and replicates."""

import hashlib
import random

import pytest

from tidewatch.operators import metrics, resample

SCHEMA = "id long, g string, y int, score double"


def field(text, i):
    return int(hashlib.md5(text.encode()).hexdigest()[8 * i:8 * i + 8], 16) % resample.FIELD


def plain(rows, replicate, seed=42):
    """Average precision of one replicate; None with one class only."""
    drawn = [field(f"{replicate}|{seed}", i) for i in range(3)]
    steps = {}
    for i, _, y, score in rows:
        at = (field(str(i), 0) * drawn[0] + field(str(i), 1) * drawn[1] + drawn[2]) % resample.FIELD
        w = sum(c < at for c in resample.CUTS)
        pos, total = steps.get(score, (0, 0))
        steps[score] = pos + w * (y or 0), total + w
    p, n = (sum(v) for v in zip(*steps.values()))
    if not 0 < p < n:
        return None
    tp = seen = ap = 0
    for score in sorted(steps, reverse=True):
        tp, seen = tp + steps[score][0], seen + steps[score][1]
        ap += steps[score][0] / p * tp / seen if seen else 0
    return ap


@pytest.mark.parametrize("score", [lambda r, i: r.random(), lambda r, i: r.choice([0.5, 0.5, 0.5, r.random()]), lambda r, i: 0.25],
                         ids=["distinct", "one frequent score", "one score"])
def test_replicates_are_the_plain_ones(spark, score):
    rng = random.Random(4)
    rows = [(i, rng.choice("abb"), int(rng.random() < 0.3), score(rng, i)) for i in range(1500)]
    rows += [(2000, "one", 1, 0.5), (2001, "two", 1, 0.4), (2002, "two", None, 0.4), (2002, "two", 0, 0.9)]
    df = spark.createDataFrame(rows, SCHEMA)
    odd = spark.createDataFrame([(1, None, 1, 0.3), (2, "a", 1, None), (3, "a", 1, float("nan"))], SCHEMA)
    got = {(r.g, r.replicate): r.pr_auc for r in resample.replicated_precision(df.union(odd).repartition(5), ["g"], ["id"], replicates=130).collect()}
    assert len(got) == 4 * 130 and all(got["one", r] is None for r in range(1, 131))
    for g in ("a", "b", "two"):
        mine = [r for r in rows if r[1] == g]
        for r in (1, 2, 99, 100, 101, 130):
            want = plain(mine, r)
            assert got[g, r] is None if want is None else got[g, r] == pytest.approx(want, abs=1e-12)


def test_a_frequent_score_is_spread_and_no_row_is_multiplied(spark, capsys):
    df = spark.range(20_000).selectExpr("id", "cast(id % 3 = 0 as int) y", "0.5D score")
    ranges = resample.replicated_precision(df, [], ["id"], replicates=3)
    assert 0.31 < ranges.first().pr_auc < 0.36
    ranges.explain("extended")
    plan = capsys.readouterr().out
    assert "Generate" in plan and plan.index("Generate") < plan.index("MapInPandas")  # only the ranges' sums are spread out


def test_empty_rows_have_no_interval(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert metrics.bootstrap_interval(df, ["g"], ["id"], replicates=5).count() == 0
