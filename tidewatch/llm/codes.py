"""Vector codes: each part of a vector as the number of its nearest codebook entry, learnt by ball k-means.

An entry and the parts assigned to it form a ball. Its radius bounds which entries can be neighbours: beyond twice the
radius no part of the ball can be as near to another entry as to its own. After each update a part measures its distance
to its own entry first. If twice that distance is less than the way to the nearest neighbour, it lies in the stable core
and keeps its entry. Otherwise it lies in a ring between two neighbours' distances, and only those up to its ring
are compared. All numbers are whole and exact, so balls only save work and never change a code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.vectors import integers, matrix, width
from tidewatch.session import discard, materialise

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that a task handles at once, parts of a ball that share one comparison, and rows of a full comparison.
BLOCK, RING, FULL = 16_384, 64, 4096


class Ball(NamedTuple):
    """An entry's neighbours by distance; ``away`` are squared distances of entries, cut at twice the radius."""

    order: np.ndarray
    away: np.ndarray


def balls(book: np.ndarray, reach: np.ndarray) -> list[Ball]:
    """``reach``: for each entry a bound of its ball's radius."""
    square = (book * book).sum(1)
    away = square[:, None] + square - 2 * book @ book.T
    out = []
    for i in range(len(book)):
        order = np.lexsort((np.arange(len(book)), away[i]))
        order = order[order != i]
        order = order[away[i][order] <= (2 * reach[i]) ** 2 * (1 + 1e-9) + 1]
        out.append(Ball(order, away[i][order]))
    return out


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances, exact as all sums stay below 2**53."""
    return (x * x).sum(1)[:, None] + (book * book).sum(1) - 2 * (x @ book.T)


def nearest(x: np.ndarray, book: np.ndarray, own: np.ndarray | None = None, near: list[Ball] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part (ties: lower index) and its squared distance; without ``own`` all entries are compared."""
    x, book = x.astype(np.float64), book.astype(np.float64)
    if own is None:
        entry, best = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for a in range(0, len(x), FULL):
            all_ = _squares(x[a:a + FULL], book)
            entry[a:a + FULL] = all_.argmin(1)
            best[a:a + FULL] = all_.min(1)
        return entry, best
    entry, best = own.astype(np.int64), ((x - book[own]) ** 2).sum(1).astype(np.int64)
    order = np.argsort(own, kind="stable")
    edges = np.searchsorted(own[order], np.arange(len(book) + 1))
    for i in np.flatnonzero(np.diff(edges)).tolist():
        mine, ball = order[edges[i]:edges[i + 1]], near[i]
        ring = np.searchsorted(ball.away, 4 * best[mine], "right")  # neighbours that can be as near
        outside = np.flatnonzero(ring)
        outside = outside[np.argsort(ring[outside], kind="stable")]
        for a in range(0, len(outside), RING):
            run = outside[a:a + RING]
            to = np.sort(ball.order[:ring[run[-1]]])
            who = mine[run]
            away = _squares(x[who], book[to])
            least = away.min(1).astype(np.int64)
            first = to[away.argmin(1)]
            better = (least < best[who]) | ((least == best[who]) & (first < i))
            entry[who[better]], best[who[better]] = first[better], least[better]
    return entry, best


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _assigned(table: DataFrame, books: np.ndarray, near: list[list[Ball]] | None, sums: bool) -> DataFrame:
    """Rows of ``table`` with new codes and errors; with ``sums``, also each task's count, sums and radius of its part of every ball."""
    parts, entries, each = books.shape
    kind = table.schema["label"].dataType.simpleString()
    fields = f"id long, label {kind}, vector binary, code binary, error long, part int, entry int, n long, far long, sums array<long>"
    names = [f.split()[0] for f in fields.replace(", ", "|").split("|")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        total, count, far = np.zeros((parts, entries, each), np.int64), np.zeros((parts, entries), np.int64), np.zeros((parts, entries), np.int64)
        for block in _blocks(batches):
            x = matrix(block["vector"].combine_chunks(), parts * each).astype(np.int64)
            before = None if near is None else matrix(block["code"].combine_chunks(), parts, "u1")
            code, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                own = x[:, p * each:(p + 1) * each]
                entry, best = nearest(own, books[p], None if near is None else before[:, p], near and near[p])
                code[:, p] = entry
                error += best
                if sums:
                    np.add.at(total[p], entry, own)
                    np.maximum.at(far[p], entry, best)
                    count[p] += np.bincount(entry, minlength=entries)
            types = [block.schema.field(c).type for c in ("id", "label", "vector")]
            code = pa.array([c.tobytes() for c in code], pa.binary())
            cells = [*(block[c].combine_chunks() for c in ("id", "label", "vector")), code, pa.array(error)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*cells, *(pa.nulls(len(x), k) for k in kinds)], names)
        if sums and types:
            p, e = np.nonzero(count)
            kinds = (*types, pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(p), k) for k in kinds), pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]),
                                              pa.array(far[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names)

    return table.mapInArrow(run, fields)


def encode(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
           entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``id, label, code, error`` of every kept vector, and the codebooks (part, entry, component).

    Vectors are cut into ``parts`` equal runs of whole numbers floor(scale * x). Codebooks start as the parts of the vectors
    with the ``entries`` smallest ids (256 at most; null ids last, equal ids by their components' bytes) and are improved ``rounds``
    times. Each round reads the table of the round before and writes its own, with its codes and the sums for the next codebooks.

    Rows whose vector is null or holds null or non-finite components are dropped, and those of another length than the
    commonest one that ``parts`` divide. Null labels and ids stay null; repeated rows give a row each; equal entries
    leave the later ones unused; an empty table gives no rows and empty codebooks. Other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has to fit one byte")
    held = integers(rows, scale, id_col, vector_col, label_col)
    size = width(held, parts)
    table = held.filter(F.col("size") == size)
    first = table.orderBy(F.col("id").asc_nulls_last(), "vector", "row").limit(entries).select("vector").collect()
    each = size // parts
    books = np.stack([np.frombuffer(r["vector"], "<i4").astype(np.int64).reshape(parts, each) for r in first], 1) if first else np.empty((parts, 0, each), np.int64)
    if first and 4 * table.agg(F.max("norm")).first()[0] >= 1 << 53:
        raise ValueError("components too large for exact distances")
    near = None
    if first:
        for _ in range(rounds):
            before, table = table, materialise(_assigned(table, books, near, True), "codes")
            discard(before)
            sums = table.filter("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("far").alias("far"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(each)))
            moved, reach = books.copy(), np.zeros(books.shape[:2])
            for r in sums.collect():
                moved[r["part"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(each)]
                reach[r["part"], r["entry"]] = r["far"] ** 0.5
            reach += np.sqrt(((moved - books) ** 2).sum(2))
            near, books = [balls(book, far) for book, far in zip(moved, reach)], moved
            table = table.filter("part is null")
        coded = _assigned(table, books, near, False)
    else:
        coded = table.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
    return coded.select(F.col("id").alias(id_col), F.col("label").alias(label_col), F.lower(F.hex("code")).alias("code"), "error"), books


def digests(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id, code, error, label_error, codebooks_sha256``: codes with the error summed over each label (nulls together)."""
    coded, books = encode(rows, id_col, vector_col, label_col)
    coded = materialise(coded, "coded")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sums = coded.groupBy(F.col(label_col).alias("of")).agg(F.sum("error").alias("label_error"))
    return (coded.join(sums, F.col(label_col).eqNullSafe(F.col("of")))
            .select(id_col, "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))


def digests_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same over the table ``embeddings``, every entry compared with every part."""
    with_ = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""pieces AS MATERIALIZED (
  SELECT r, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS v FROM kept, range({parts}) AS t(p))""",
             f"c0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM pieces WHERE r <= {entries})"]
    for i in range(rounds + 1):
        with_.append(f"""a{i} AS MATERIALIZED (
  SELECT x.r, x.p, min((list_inner_product(x.v, x.v) + list_inner_product(c.v, c.v) - 2 * list_inner_product(x.v, c.v))::BIGINT * {entries} + c.e) AS m
  FROM pieces x JOIN c{i} c ON c.p = x.p GROUP BY x.r, x.p)""")
        if i < rounds:
            with_.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(u.v, c.v) AS v FROM c{i} c LEFT JOIN (
    SELECT p, e, list(s ORDER BY k) AS v FROM (
      SELECT p, e, k, floor(sum(x) / count(*)) AS s FROM (
        SELECT a.p, a.m % {entries} AS e, unnest(x.v) AS x, unnest(range(len(x.v))) AS k FROM a{i} a JOIN pieces x ON x.r = a.r AND x.p = a.p)
      GROUP BY p, e, k)
    GROUP BY p, e) u ON u.p = c.p AND u.e = c.e)""")
    with_.append(f"""coded AS MATERIALIZED (
  SELECT r, string_agg(lpad(printf('%x', m % {entries}), 2, '0'), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY r)""")
    with_.append(f"""books AS (
  SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, k)) AS codebooks_sha256 FROM (
    SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS k FROM c{rounds}))""")
    return "WITH " + ",\n".join(with_) + """
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), books"""
