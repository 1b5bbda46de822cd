"""Hard negatives and vector codes against plain versions on odd rows; the given tables are held against SQL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import codes, negatives

ROWS = "vec_id long, embedding array<float>, label int, row string, cell string, vector string"


def odd_vectors(n=400, width=8, seed=5):
    """Clusters, copies under several labels and ids, nulls, broken components, odd lengths, null and repeated ids."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = []
    for i in range(n):
        v = (centres[i % 6] + 0.2 * rng.normal(size=width)).astype(np.float32).tolist() if i % 11 else [0.5] * width
        rows.append((i, v, int(rng.integers(0, 4)) if i % 13 else None))
    rows += [(0, rows[0][1], 1), (20, [0.25] * width, 2), (None, [0.5] * width, 3), (None, None, 1), (9001, None, 1), (9002, [None] + [0.1] * (width - 1), 1),
             (9003, [math.nan] + [0.1] * (width - 1), 1), (9004, [math.inf] + [0.1] * (width - 1), 1), (9005, [], 1), (9006, [0.1] * 3, 1), (9007, [0.0] * width, 0)]
    return [(*r, "clash", "clash", "clash") for r in rows]


def kept(rows, width=8):
    return [r for r in rows if r[1] is not None and len(r[1]) == width and all(x is not None and math.isfinite(x) for x in r[1])]


def plain_negatives(rows, every, low=80):
    """Every anchor against every row; null ids come last among equal scores."""
    use = [(r[0], [math.floor(256 * x) for x in r[1]], r[2]) for r in kept(rows) if r[2] is not None]
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for i, (a, v, label) in enumerate(use):
        if a is None or a % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), b, other) for j, (b, w, other) in enumerate(use) if i != j]
        for score, positive, _ in sorted((s for s in scored if s[2] == label), key=key)[:5]:
            window = sorted((s for s in scored if s[2] != label and low * score <= 100 * s[0] <= 100 * score), key=key)[:5]
            out += [(a, positive, rank, s[1], score, s[0]) for rank, s in enumerate(window, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("page, leaf", [(2048, 24), (50, 4)])
def test_hard_negatives(spark, monkeypatch, page, leaf):
    """With small pages the tree has several levels, and equal vectors are cut into several pages."""
    build = negatives.build
    monkeypatch.setattr(negatives, "build", lambda held: build(held, page))
    monkeypatch.setattr(negatives, "LEAF", leaf)
    rows = odd_vectors()
    got = negatives.mine(spark.createDataFrame(rows, ROWS).repartition(3), F.col("id") % 20 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == plain_negatives(rows, 20)


def test_hard_negatives_of_few_rows(spark):
    empty = spark.createDataFrame([], ROWS)
    assert negatives.mine(empty, F.col("id") % 20 == 0).collect() == []
    one = spark.createDataFrame(odd_vectors(1), ROWS).filter("label = 1 and vec_id = 0")
    assert negatives.mine(one, F.col("id") % 20 == 0).count() == 0
    assert negatives.mine(spark.createDataFrame(odd_vectors(30), ROWS), F.col("id") == -1).collect() == []


def test_cover_tree():
    """Children's runs make up their parent's, lie within the radius, and their centres are apart; the level's radius halves."""
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(size=(300, 3)), np.zeros((60, 3))))
    away = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    order, nodes = negatives.cover_tree(away, np.zeros(len(x)))
    assert sorted(order.tolist()) == list(range(len(x)))
    radius = {0: away[order[nodes["centre"][0]]].max()}
    for i in range(len(nodes["begin"])):
        a, b, c, d = (int(nodes[k][i]) for k in ("begin", "end", "first", "last"))
        centre = order[nodes["centre"][i]]
        assert away[centre, order[a:b]].max() <= nodes["radius"][i] + 1e-9
        if d > c:
            assert nodes["begin"][c] == a and nodes["end"][d - 1] == b and (nodes["begin"][c + 1:d] == nodes["end"][c:d - 1]).all()
            middle = order[nodes["centre"][c:d]]
            apart = away[np.ix_(middle, middle)][np.triu_indices(d - c, 1)].min()
            assert apart > nodes["radius"][c:d].max() and nodes["radius"][c:d].max() <= radius[i] / 2 + 1e-9
            radius |= dict.fromkeys(range(c, d), radius[i] / 2)


def plain_codes(rows, parts, entries, rounds, scale):
    use = sorted((r for r in kept(rows)), key=lambda r: (r[0] is None, r[0] or 0))
    x = np.array([[math.floor(scale * c) for c in r[1]] for r in use], np.int64)
    first = sorted(range(len(use)), key=lambda i: (use[i][0] is None, use[i][0] or 0, np.asarray(x[i], "<i4").tobytes()))[:entries]
    each = x.shape[1] // parts
    code, error, books = np.empty((len(x), parts), int), np.zeros(len(x), np.int64), []
    for p in range(parts):
        own = x[:, p * each:(p + 1) * each]
        book = own[first].copy()
        for i in range(rounds + 1):
            away = ((own[:, None] - book) ** 2).sum(2)
            entry = away.argmin(1)
            if i < rounds:
                for e in np.unique(entry):
                    mine = own[entry == e]
                    book[e] = [int(s) // len(mine) for s in mine.sum(0)]
        code[:, p], error = entry, error + away.min(1)
        books.append(book)
    return sorted(((r[0], r[2], "".join(f"{e:02x}" for e in c), int(d)) for r, c, d in zip(use, code, error)), key=str), np.stack(books)


@pytest.mark.parametrize("entries, rounds", [(256, 4), (20, 6), (3, 0)])
def test_vector_codes(spark, monkeypatch, entries, rounds):
    monkeypatch.setattr(codes, "RING", 5)
    rows = odd_vectors()
    got, books = codes.encode(spark.createDataFrame(rows, ROWS).repartition(3), parts=2, entries=entries, rounds=rounds)
    want, plain = plain_codes(rows, 2, entries, rounds, codes.SCALE)
    assert np.array_equal(books, plain)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_stable_cores_and_rings_are_skipped():
    """Parts of far balls are compared with nothing else."""
    book = np.array([[0, 0], [1000, 0], [1010, 0]])
    near = codes.balls(book, np.array([20.0, 9.0, 9.0]))
    assert [b.order.tolist() for b in near] == [[], [2], [1]]
    entry, best = codes.nearest(np.array([[3, 4], [1006, 0], [1005, 0], [1001, 0]]), book, np.array([0, 1, 2, 1]), near)
    assert entry.tolist() == [0, 2, 1, 1] and best.tolist() == [25, 16, 25, 1]


def test_label_errors(spark):
    rows = odd_vectors()
    got = codes.digests(spark.createDataFrame(rows, ROWS)).collect()
    coded, _ = plain_codes(rows, codes.PARTS, codes.ENTRIES, codes.ROUNDS, codes.SCALE)
    sums = {}
    for _, label, _, error in coded:
        sums[label] = sums.get(label, 0) + error
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == sorted(((i, c, e, sums[label]) for i, label, c, e in coded), key=str)
    assert codes.digests(spark.createDataFrame([], ROWS)).collect() == []
    with pytest.raises(Exception, match="too large"):
        codes.encode(spark.createDataFrame([(1, [1e9] * 4, 1, "", "", "")], ROWS))
