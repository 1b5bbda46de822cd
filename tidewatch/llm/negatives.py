"""Hard negatives by exact search for inner products in a cover tree.

A candidate x of length |x| <= M becomes the point (x, sqrt(M**2 - |x|**2)), so all candidates have length M and a query q
is (q, 0). Then inner products and distances say the same, and a ball of points bounds both: with s the product of q
and the centre, d the distance of the two and R the covering radius, every product in the ball is at most
s + |q| R and (M**2 + |q|**2 - max(0, d - R)**2) / 2, and at least s - |q| R and (M**2 + |q|**2 - (d + R)**2) / 2.

The tree is kept in pages of about ``PAGE`` points in the shared folder. Rows are dealt to pages by their nearest sampled
centre; a page holds a cover tree whose covering radius halves from level to level. The roots of pages are the
points of pages above, up to one top page. Anchors search in blocks: pages and their nodes are opened best bound
first, those outside of every window an anchor still looks in are skipped, and rows of leaves are verified exactly.
"""

from __future__ import annotations

import heapq
import io
import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.arrays import read_whole, write_file
from tidewatch.llm.vectors import integers, matrix, width
from tidewatch.session import discard, fresh_path, materialise

SCALE, POSITIVES, NEGATIVES, LOW = 256, 5, 5, 80
#: Points of a page, centres that rows are dealt by (at most), points of a leaf, anchors of a task, and bits for parts of a cell.
PAGE, CELLS, LEAF, ANCHORS, PART_BITS = 2048, 1024, 24, 64, 40
_NODE = ("centre", "radius", "begin", "end", "first", "last", "low", "high")


class Index(NamedTuple):
    """Where the pages are, the squared length of the longest candidate, the vectors' length, and the top page."""

    root: str
    norm: int
    width: int
    top: tuple[int, int]


def cover_tree(away: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Order of the points, and nodes over runs of it, of a cover tree of points ``away`` from each other with radii ``own``.

    A node covers its run within ``radius`` of its ``centre``. Its children's centres, the node's own first, are chosen
    greedily more than the level's covering radius apart, half of that of the level above. Runs of ``LEAF`` points and nodes
    whose points are all one have no children.
    """
    order = np.arange(len(away))
    centre = int(away.max(1).argmin())
    order[0], order[centre] = centre, 0
    nodes = [[centre, float(np.max(away[centre] + own)), 0, len(away), 0, 0]]
    levels = [float(away[centre].max())]
    at = 0
    while at < len(nodes):
        c, _, a, b, _, _ = nodes[at]
        level = levels[at]
        if b - a > LEAF and float(away[c, order[a:b]].max()) > 0:
            left, runs = order[a:b], []
            while len(runs) < 2:  # a level at which all points stay together is passed over
                level, left, runs = level / 2, order[a:b], []
                while len(left):
                    near = away[left[0], left] <= level
                    runs.append(left[near])
                    left = left[~near]
            order[a:b] = np.concatenate(runs)
            nodes[at][4:] = len(nodes), len(nodes) + len(runs)
            for run in runs:
                nodes.append([int(run[0]), float(np.max(away[run[0], run] + own[run])), a, a + len(run), 0, 0])
                levels.append(level)
                a += len(run)
        at += 1
    cells = list(zip(*nodes))
    place = np.empty(len(away), np.int64)
    place[order] = np.arange(len(away))
    out = {name: np.array(c, np.int64) for name, c in zip(_NODE, cells) if name != "radius"} | {"radius": np.array(cells[1])}
    return order, out | {"centre": place[out["centre"]]}


def page_of(x: np.ndarray, norm: int, own: np.ndarray, low: np.ndarray, high: np.ndarray, more: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A page's arrays, its points in the order of its tree; ``low`` and ``high`` bound the labels of each point."""
    v = x.astype(np.float64)
    square = (v * v).sum(1)
    lift = np.sqrt(np.maximum(norm - square, 0))
    away = np.maximum(square[:, None] + square - 2 * v @ v.T, 0)
    away += (lift[:, None] - lift) ** 2
    np.fill_diagonal(away, 0)
    order, nodes = cover_tree(np.sqrt(away, out=away), own)
    runs = list(zip(nodes["begin"].tolist(), nodes["end"].tolist()))
    nodes |= {"low": np.array([low[order[a:b]].min() for a, b in runs]), "high": np.array([high[order[a:b]].max() for a, b in runs])}
    return {"x": x[order], "own": own[order], "plow": low[order], "phigh": high[order]} | {k: v[order] for k, v in more.items()} | nodes


def _name(root: str, level: int, ref: int) -> str:
    return f"{root}/{level}/{ref:016d}"


def _write(uri: str, page: dict[str, np.ndarray]) -> None:
    held = io.BytesIO()
    np.savez(held, **page)
    write_file(uri, np.frombuffer(held.getvalue(), np.uint8))


def build(held: DataFrame, page: int = PAGE) -> Index | None:
    """Index of the rows of ``vectors.integers`` whose labels are whole numbers; None without rows. Removes their table.

    Rows of another length than the commonest one are left out. A cell of more than ``page`` rows is cut into parts by row
    number, so many equal vectors make many pages.
    """
    spark = held.sparkSession
    size = width(held)
    rows = held.filter(F.col("size") == size)
    n, norm = rows.agg(F.count("*"), F.max("norm")).first()
    if not n:
        return None
    if norm >= 1 << 53:
        raise ValueError("components too large for exact inner products")
    cells = min(CELLS, -(-n // page))
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(cells).select("vector").collect()
    centres = np.stack([np.frombuffer(r["vector"], "<i4") for r in sample]).astype(np.float64)
    lift = np.sqrt(np.maximum(norm - (centres ** 2).sum(1), 0))
    root, level = fresh_path(spark, "tree"), 0

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vector"), size).astype(np.float64)
            own = np.sqrt(np.maximum(norm - (x * x).sum(1), 0))
            cell = (x @ centres.T + own[:, None] * lift).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    points = rows.select("row", "id", "label", "vector").withColumns({"radius": F.lit(0.0), "low": F.col("label"), "high": F.col("label")})
    fields = "row long, id long, label long, vector binary, radius double, low long, high long, cell long"
    points = materialise(points.mapInArrow(dealt, fields), "dealt")
    discard(held)
    names = ["row", "id", "label", "vector", "radius", "low", "high", "cell"]
    schema = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))))

    def maker(level: int) -> Callable[[pa.Table], pa.Table]:
        def made(table: pa.Table) -> pa.Table:
            x = matrix(table["vector"].combine_chunks(), size)
            whole = {c: table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("row", "radius", "low", "high", "cell", "part")}
            more = {"ref": whole["row"]}
            if not level:
                ids = table["id"].combine_chunks()
                more |= {"id": ids.fill_null(0).to_numpy(), "known": ids.is_valid().to_numpy(zero_copy_only=False)}
            got = page_of(x, norm, whole["radius"], whole["low"], whole["high"], more)
            cell, ref = int(whole["cell"][0]), int(whole["cell"][0]) << PART_BITS | int(whole["part"][0])
            _write(_name(root, level, ref), got)
            out = (ref, None, None, got["x"][got["centre"][0]].tobytes(), float(got["radius"][0]), int(got["low"][0]), int(got["high"][0]), cell)
            return pa.Table.from_pylist([dict(zip(names, out))], schema)
        return made

    while True:
        few = n <= page
        if few:
            points = points.withColumn("cell", F.lit(0).cast("long"))
        counts = points.groupBy("cell").count().withColumn("parts", F.ceil(F.col("count") / page)).select("cell", "parts")
        split = (points.join(F.broadcast(counts), "cell")  # a row for each cell, CELLS at most
                 .withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))))
        pages = materialise(split.groupBy("cell", "part").applyInArrow(maker(level), fields), "pages")
        discard(points)
        points, n, level = pages, pages.count(), level + 1
        if few:
            discard(pages)
            return Index(root, norm, size, (level - 1, 0))


class Nearest:
    """The first ``most`` rows of an anchor's label, itself left out: higher scores first, ties by smaller id."""

    def __init__(self, row: int, label: int, most: int):
        self.row, self.label, self.most, self.floor = row, label, most, -np.inf
        self.found: list[tuple[float, bool, int, int]] = []

    def wanted(self, lower: np.ndarray, upper: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (upper >= self.floor) & (low <= self.label) & (high >= self.label)

    def offer(self, score: np.ndarray, page: dict[str, np.ndarray], at: np.ndarray) -> None:
        take = np.flatnonzero((score >= self.floor) & (page["plow"][at] == self.label) & (page["ref"][at] != self.row))
        if len(take):
            self.found = first(self.found, score, page, at, take, self.most)
            if len(self.found) == self.most:
                self.floor = -self.found[-1][0]


class Windows:
    """For each top score, the first ``most`` rows of other labels from ``low`` percent of it up to it."""

    def __init__(self, label: int, tops: list[int], most: int, low: int):
        self.label, self.most = label, most
        self.tops = sorted({t for t in tops if low * t <= 100 * t}, reverse=True)
        self.low = np.array([-(-low * t // 100) for t in self.tops], np.float64)
        self.high, self.least = np.array(self.tops, np.float64), self.low.copy()
        self.found: list[list[tuple[float, bool, int, int]]] = [[] for _ in self.tops]
        self.floor = self.least.min() if self.tops else np.inf

    def wanted(self, lower: np.ndarray, upper: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        inside = ((upper[:, None] >= self.least) & (lower[:, None] <= self.high)).any(1)
        return inside & ((low != self.label) | (high != self.label))

    def offer(self, score: np.ndarray, page: dict[str, np.ndarray], at: np.ndarray) -> None:
        other = page["plow"][at] != self.label
        for i in range(len(self.tops)):
            take = np.flatnonzero(other & (score >= self.least[i]) & (score <= self.high[i]))
            if len(take):
                self.found[i] = first(self.found[i], score, page, at, take, self.most)
                if len(self.found[i]) == self.most:
                    self.least[i] = -self.found[i][-1][0]
        self.floor = self.least.min() if self.tops else np.inf


def first(found: list, score: np.ndarray, page: dict[str, np.ndarray], at: np.ndarray, take: np.ndarray, most: int) -> list:
    """The best ``most`` of ``found`` and of new rows, as (-score, no id, id, row)."""
    if len(take) > most:
        cut = np.partition(score[take], len(take) - most)[len(take) - most]
        take = take[score[take] >= cut]
    who = at[take]
    keys = np.lexsort((page["ref"][who], page["id"][who], ~page["known"][who], -score[take]))[:most]
    new = [(-float(score[take[k]]), not page["known"][who[k]], int(page["id"][who[k]]), int(page["ref"][who[k]])) for k in keys.tolist()]
    return sorted(found + new)[:most]


class Query(NamedTuple):
    row: int
    id: int
    label: int
    vector: np.ndarray
    square: float


def bounds(index: Index, query: Query, score: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most product with points within ``radius`` of centres that have the product ``score``."""
    both, length = index.norm + query.square, query.square ** 0.5
    away = np.sqrt(np.maximum(both - 2 * score, 0))
    slack = 1e-9 * both + 1e-6
    upper = np.minimum(score + length * radius, (both - np.maximum(away - radius, 0) ** 2) / 2)
    lower = np.maximum(score - length * radius, (both - (away + radius) ** 2) / 2)
    return lower - slack, upper + slack


def descend(index: Index, page: dict[str, np.ndarray], leaves: bool, query: Query, goal: Nearest | Windows) -> list[tuple[float, int]]:
    """Best-first through one page. Rows go to ``goal``; from a page of pages, those to open are returned with their bounds."""
    out, heap = [], [(-np.inf, 0)]

    def points(at: np.ndarray, score: np.ndarray) -> None:
        if leaves:
            goal.offer(score, page, at)
        else:
            lower, upper = bounds(index, query, score, page["own"][at])
            want = goal.wanted(lower, upper, page["plow"][at], page["phigh"][at])
            out.extend(zip(upper[want].tolist(), page["ref"][at[want]].tolist()))

    while heap:
        upper, node = heapq.heappop(heap)
        if -upper < goal.floor:
            break
        a, b = int(page["first"][node]), int(page["last"][node])
        if a == b:
            at = np.arange(page["begin"][node], page["end"][node])
            points(at, page["x"][at] @ query.vector)
            continue
        score = page["x"][page["centre"][a:b]] @ query.vector
        lower, high = bounds(index, query, score, page["radius"][a:b])
        want = goal.wanted(lower, high, page["low"][a:b], page["high"][a:b])
        single = page["end"][a:b] - page["begin"][a:b] == 1
        if (one := want & single).any():
            points(page["begin"][a:b][one], score[one])
        for i in np.flatnonzero(want & ~single).tolist():
            heapq.heappush(heap, (-high[i], a + i))
    return out


def search(index: Index, queries: list[Query], goals: list[Nearest] | list[Windows]) -> None:
    """Fill the goals of a block of queries; a page is loaded once for all of them."""
    count = itertools.count()
    heap = [(-np.inf, next(count), *index.top, [(np.inf, i) for i in range(len(queries))])]
    while heap:
        _, _, level, ref, wanting = heapq.heappop(heap)
        wanting = [i for upper, i in wanting if upper >= goals[i].floor]
        if not wanting:
            continue
        page = dict(np.load(io.BytesIO(read_whole(_name(index.root, level, ref)))))
        page["x"] = page["x"].astype(np.float64)
        below = defaultdict(list)
        for i in wanting:
            for upper, child in descend(index, page, level == 0, queries[i], goals[i]):
                below[child].append((upper, i))
        for child, who in below.items():
            heapq.heappush(heap, (-max(who)[0], next(count), level - 1, child, who))


def mine(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE,
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows that ``anchors`` (on ``id``) marks.

    Components become floor(scale * x), a score is the inner product with the anchor; higher scores come first, ties by smaller id
    (null ids last). An anchor's positives are its first other rows of the same label; each gets the first rows of other labels
    whose score is from ``low`` percent of the positive's up to it. So a positive with a negative score has none.

    Rows with a null label, a null vector or a null or non-finite component take no part, nor do those of another length than
    the commonest one. Equal vectors and repeated ids are rows of their own. A null id is a candidate but no anchor unless marked.
    An empty table, or one without anchors, gives no rows. Other columns are ignored. Labels are whole numbers.
    """
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark = rows.sparkSession
    held = integers(rows.withColumn(label_col, F.col(label_col).cast("long")).filter(F.col(label_col).isNotNull()), scale, id_col, vector_col, label_col)
    asked = materialise(held.filter(anchors).select("row", "id", "label", "size", "vector"), "anchors")
    index = build(held)
    if index is None:
        return spark.createDataFrame([], result)
    asked = asked.filter(F.col("size") == index.width)
    blocks = max(1, -(-asked.count() // ANCHORS))

    def answers(queries: list[Query]) -> pa.RecordBatch:
        near = [Nearest(q.row, q.label, positives) for q in queries]
        search(index, queries, near)
        windows = [Windows(q.label, [int(-f[0]) for f in goal.found], negatives, low) for q, goal in zip(queries, near)]
        search(index, queries, windows)
        out = []
        for q, goal, window in zip(queries, near, windows):
            held = dict(zip(window.tops, window.found))
            for score, unknown, positive, _ in goal.found:
                for rank, (s, none, negative, _) in enumerate(held.get(int(-score), []), 1):
                    out.append((q.id, None if unknown else positive, rank, None if none else negative, int(-score), int(-s)))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        cells = zip(*out) if out else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cells, kinds)], [f.split()[0] for f in result.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = []
        for batch in batches:
            x = matrix(batch.column("vector"), index.width).astype(np.float64)
            for row, id_, label, v in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "label")), x):
                queries.append(Query(row, id_, label, v, float(v @ v)))
                if len(queries) == 4 * ANCHORS:
                    yield answers(queries)
                    queries = []
        if queries:
            yield answers(queries)

    return asked.repartition(blocks, "row").mapInArrow(run, result)


def mine_sql() -> str:
    """The same over the table ``embeddings`` for the registered query, every row compared with every anchor."""
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS MATERIALIZED (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM kept a JOIN kept b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id) <= {POSITIVES})
SELECT p.anchor_id, p.other_id AS positive_id, (row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other_id))::INTEGER AS rank,
       n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor = p.anchor AND NOT n.same AND {LOW} * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= {NEGATIVES}"""
