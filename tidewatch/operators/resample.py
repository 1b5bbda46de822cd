"""Bootstrap of ranking quality without a row per row and replicate.

Rows are dealt to tasks by ranges of the score.  A task draws the weights of its rows for all replicates as one matrix at a
time and keeps vectors of sums, so what is shuffled is one narrow row per row and a few vectors per range, however many
replicates there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.ordered import ordered_rows
from tidewatch.session import materialise

# Cumulative probabilities of a Poisson variable with mean 1.
POISSON_ONE = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
               0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999898048033251,
               0.9999988747974020, 0.9999998885745217, 0.9999999899522336, 0.9999999991683892]

FIELD = 2 ** 31 - 1           # weights are drawn in the integers modulo this prime
CUTS = [int(c * FIELD) for c in POISSON_ONE]
BLOCK = 100                   # replicates that one task joins across ranges
ROWS_AT_ONCE = 1000           # rows of a weight matrix


def field_hash(text: Column, part: int) -> Column:
    """The ``part``-th eight hexadecimal digits of a text's md5, modulo ``FIELD``."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 8 * part + 1, 8), 16, 10).cast("long") % FIELD


def coefficients(spark, replicates: int, seed: int) -> np.ndarray:
    """Three field elements per replicate (1, 2, ...): a bounded table, computed once."""
    text = F.concat_ws("|", (F.col("id") + 1).cast("string"), F.lit(str(seed)))
    rows = spark.range(replicates).select("id", *[field_hash(text, i).alias(f"c{i}") for i in range(3)])
    return np.array([(r.c0, r.c1, r.c2) for r in rows.orderBy("id").collect()], dtype=np.int64).reshape(-1, 3)


def weights(h0: np.ndarray, h1: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Poisson weights, one row per row and one column per replicate; any two rows are independent within a replicate."""
    at = (h0[:, None] * drawn[None, :, 0] + h1[:, None] * drawn[None, :, 1] + drawn[None, :, 2]) % FIELD
    return np.searchsorted(np.array(CUTS), at, side="left").astype(np.float64)


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Slices of sorted frames that lie within one range and group."""
    for pdf in frames:
        if len(pdf):
            r, g = pdf["_range"].to_numpy(), pdf["_group"].to_numpy()
            cuts = np.flatnonzero((r[1:] != r[:-1]) | (g[1:] != g[:-1])) + 1
            for start, end in zip([0, *cuts], [*cuts, len(pdf)]):
                yield (int(r[start]), g[start]), pdf.iloc[start:end]


def _tied(piece: pd.DataFrame, drawn: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct scores in order with their summed weights, of all and of positive rows; a score may go on in the next."""
    score, y = piece["_score"].to_numpy(), piece["_y"].to_numpy(dtype=np.float64)
    h0, h1 = piece["_h0"].to_numpy(dtype=np.int64), piece["_h1"].to_numpy(dtype=np.int64)
    for i in range(0, len(score), ROWS_AT_ONCE):
        part = slice(i, i + ROWS_AT_ONCE)
        w, s = weights(h0[part], h1[part], drawn), score[part]
        starts = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1])
        yield s[starts], np.add.reduceat(w, starts), np.add.reduceat(w * y[part][:, None], starts)


def _sums_of_ranges(drawn: np.ndarray):
    """Per range, group and block of replicates: sums of weights, and those of the range's first score."""
    n = len(drawn)

    def rows(key, state) -> pd.DataFrame:
        vectors = np.stack([state["pos"], state["total"], state["head_pos"], state["head_total"]])
        return pd.DataFrame([(*key, i // BLOCK, state["head"], state["last"], vectors[:, i:i + BLOCK].ravel()) for i in range(0, n, BLOCK)],
                            columns=["_range", "_group", "_block", "_head", "_last", "_sums"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for key, piece in _pieces(frames):
            if key != current:
                if current is not None:
                    yield rows(current, state)
                current, state = key, {"head": piece["_score"].iloc[0]} | {k: np.zeros(n) for k in ("pos", "total", "head_pos", "head_total")}
            for scores, total, pos in _tied(piece, drawn):
                state["pos"] += pos.sum(axis=0)
                state["total"] += total.sum(axis=0)
                if scores[0] == state["head"]:
                    state["head_pos"] += pos[0]
                    state["head_total"] += total[0]
                state["last"] = scores[-1]
        if current is not None:
            yield rows(current, state)

    return run


def _places_of_ranges(pdf: pd.DataFrame) -> pd.DataFrame:
    """One group and block, all ranges: sums before each range, of its last score in later ranges, and of the whole group."""
    pdf = pdf.sort_values("_range").reset_index(drop=True)
    sums = np.stack(pdf["_sums"].to_numpy()).reshape(len(pdf), 4, -1)
    own, head = sums[:, :2], sums[:, 2:]
    after = np.zeros_like(own)
    for i in range(len(pdf) - 2, -1, -1):
        if pdf["_head"][i + 1] == pdf["_last"][i]:  # the score goes on, through the whole next range if that has no other
            after[i] = head[i + 1] + (after[i + 1] if pdf["_head"][i + 1] == pdf["_last"][i + 1] else 0)
    places = np.concatenate([np.cumsum(own, axis=0) - own, after, np.broadcast_to(own.sum(axis=0), own.shape)], axis=1)
    return pd.DataFrame({"_range": pdf["_range"], "_group": pdf["_group"], "_block": pdf["_block"], "_place": [p.ravel() for p in places]})


def _precision_of_ranges(drawn: np.ndarray):
    """Each range's part of the average precision in every replicate; a range's places come before its rows."""
    n = len(drawn)

    def shares(pos, tp, seen):
        return np.divide(pos * tp, seen, out=np.zeros(np.broadcast(pos, seen).shape), where=seen > 0)

    def close(key, state) -> pd.DataFrame:
        before, after, whole = state["place"][:2], state["place"][2:4], state["place"][4:]
        if state["open"] is not None:
            state["part"] += shares(state["open_pos"], before[0] + after[0], before[1] + after[1])
        valid = (whole[0] > 0) & (whole[1] > whole[0])
        return pd.DataFrame({"_group": [key[1]], "_part": [np.where(valid, state["part"] / np.where(valid, whole[0], 1), np.nan)]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for key, piece in _pieces(frames):
            if key != current:
                if current is not None:
                    yield close(current, state)
                current, state = key, {"place": np.zeros((6, n)), "part": np.zeros(n), "open": None, "open_pos": None}
            placed = piece["_place"].notna()
            for block, place in zip(piece["_block"][placed], piece["_place"][placed]):
                at = int(block) * BLOCK
                state["place"][:, at:at + BLOCK] = np.asarray(place).reshape(6, -1)
            tp, seen = state["place"][0], state["place"][1]
            for scores, total, pos in _tied(piece[~placed], drawn) if not placed.all() else ():
                through_pos, through_total = tp + np.cumsum(pos, axis=0), seen + np.cumsum(total, axis=0)
                first = 0
                if scores[0] == state["open"]:
                    state["open_pos"] = state["open_pos"] + pos[0]
                    first = 1
                if first < len(scores):  # the score that was open has ended
                    if state["open"] is not None:
                        ended = (through_pos[0], through_total[0]) if first else (tp, seen)
                        state["part"] += shares(state["open_pos"], *ended)
                    state["part"] += shares(pos[first:-1], through_pos[first:-1], through_total[first:-1]).sum(axis=0)
                    state["open"], state["open_pos"] = scores[-1], pos[-1]
                tp[:], seen[:] = through_pos[-1], through_total[-1]
        if current is not None:
            yield close(current, state)

    return run


def replicated_precision(df: DataFrame, keys: list[str], id_columns: list[str], y: str = "y", score: str = "score",
                         replicates: int = 1000, seed: int = 42) -> DataFrame:
    """``keys, replicate, pr_auc``: average precision under Poisson weights; null where a replicate has one class only.

    A row's weight is a hash of its id and the replicate, so a re-run task draws the same weights; rows of equal id share theirs.
    Equal scores are one step, also where a frequent score is spread over several ranges.  Rows without a place in the order
    (null keys, null or NaN scores) take no part; a null label counts as 0.
    """
    spark = df.sparkSession
    drawn = coefficients(spark, replicates, seed)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in id_columns])
    group = F.to_json(F.struct(*keys)) if keys else F.lit("{}")
    rows = ordered_rows(df, keys, score).select(
        group.alias("_group"), F.col(score).cast("double").alias("_score"), F.coalesce(F.col(y).cast("double"), F.lit(0.0)).alias("_y"),
        field_hash(text, 0).alias("_h0"), field_hash(text, 1).alias("_h1"))
    order = ["_group", F.desc("_score"), "_h0", "_h1"]
    rows = materialise(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "resample")
    sums = rows.repartition(ranges, "_range").sortWithinPartitions("_range", *order).mapInPandas(
        _sums_of_ranges(drawn), "_range int, _group string, _block int, _head double, _last double, _sums array<double>")
    places = sums.groupBy("_group", "_block").applyInPandas(
        _places_of_ranges, "_range int, _group string, _block int, _place array<double>")
    both = rows.unionByName(places, allowMissingColumns=True).repartition(ranges, "_range").sortWithinPartitions(
        "_range", "_group", F.desc(F.col("_place").isNotNull()), F.desc("_score"))
    parts = both.mapInPandas(_precision_of_ranges(drawn), "_group string, _part array<double>")
    each = (parts.select("_group", F.posexplode("_part").alias("_at", "_value")).groupBy("_group", (F.col("_at") + 1).alias("replicate"))
            .agg(F.sum("_value").alias("_value")))
    schema = T.StructType([df.schema[k] for k in keys])
    return each.withColumn("_keys", F.from_json("_group", schema) if keys else F.lit(None)).select(
        *[F.col(f"_keys.`{k}`").alias(k) for k in keys], "replicate", F.when(~F.isnan("_value"), F.col("_value")).alias("pr_auc"))
