"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the hashes of its distinct words, pairs of neighbouring words and pairs with one word between
them. Shards of the labelled rows are learnt side by side, each coordinate with its own rate and with L1
shrinkage, and their weights are averaged. What is left after the L1 shrinkage is a small sorted table of weights that
is sent to all workers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.words import IS_MARK, Block, long_view, mix, word_blocks, word_hashes

#: Rows of a shard; there are as many shards as the labelled rows make.
SHARD_ROWS, EPOCHS = 4_000, 6
#: L1 is near the number of epochs, so what occurs in one document alone gets no weight.
ALPHA, BETA, L1, L2 = 8.0, 1.0, 4.0, 0.01
THRESHOLD = 0.7
_HASH_BITS, _SIEVE_BITS = 40, 20
_NEXT, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BIAS = -1


class Model(NamedTuple):
    bias: float
    keys: np.ndarray       # sorted feature hashes
    weights: np.ndarray


def held_out(id_col: str) -> F.Column:
    """Rows that are never learnt from: crc32 of the id's text leaves 1 when divided by 3 (a null id: no)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature hash of every word, pair and skip-pair of a block, repeats included."""
    h, row = word_hashes(block), block.row
    two, three = row[1:] == row[:-1], row[2:] == row[:-2]
    keys = np.concatenate((h, mix(h[:-1] * _NEXT + h[1:])[two], mix(h[:-2] * _SKIP + h[2:])[three]))
    return np.concatenate((row, row[1:][two], row[2:][three])), keys >> np.uint64(64 - _HASH_BITS)


def learn(docs: list[np.ndarray], labels: np.ndarray) -> Model:
    """FTRL-proximal over the documents' distinct features, ``EPOCHS`` times in the given order."""
    keys = np.unique(np.concatenate([*docs, np.array([], np.uint64)]))
    rows = [np.append(np.searchsorted(keys, d), len(keys)) for d in docs]  # the last coordinate is the bias
    z, n = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)

    def weights(at) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(z[at]) <= L1] = 0
        return w

    for _ in range(EPOCHS):
        for at, y in zip(rows, labels):
            w = weights(at)
            w[-1] = -z[-1] / ((BETA + math.sqrt(n[-1])) / ALPHA + L2)  # no L1 on the bias
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()))))) - y
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    w = weights(np.arange(len(keys)))
    return Model(-z[-1] / ((BETA + math.sqrt(n[-1])) / ALPHA + L2), keys[w != 0], w[w != 0])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        fit_rows: int | None = None) -> Model:
    """A model from all labelled documents that are not held out (``fit_rows``: from about so many, chosen by a hash of their id).

    Of several labels of an id the largest counts; null ids and labels are left out; a label without a document is
    ignored. Without labelled documents the model scores every text 0.5.
    """
    known = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
             .filter(F.col("id").isNotNull() & F.col("y").isNotNull()).filter(~held_out("id")).groupBy("id").agg(F.max("y").alias("y")))
    total = known.count()
    if fit_rows is not None and total > fit_rows:
        known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / total))
    shards = max(1, round((total if fit_rows is None else min(total, fit_rows)) / SHARD_ROWS))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # hashed labels at every size: texts are sent once, are not sorted, and only labelled ones are sent again, to their shard
    chosen = (texts.join(known.hint("shuffle_hash"), "id")
              .select("id", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).alias("shard"), "y", "text"))

    def distinct(texts: pa.ChunkedArray) -> list[np.ndarray]:
        """Each text's sorted distinct features, which take about four times the room of the text and so are never shuffled."""
        docs = []
        for block in word_blocks(texts, separators=IS_MARK):
            row, keys = features(block)
            order = np.lexsort((keys, row))
            row, keys = row[order], keys[order]
            keep = np.append(True, (row[1:] != row[:-1]) | (keys[1:] != keys[:-1]))[:len(row)]
            docs += np.split(keys[keep], np.searchsorted(row[keep], np.arange(1, block.rows)))
        return docs

    def train(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        model = learn(distinct(group.column("text")), group.column("y").to_numpy())
        return pa.table({"key": np.append(long_view(model.keys), _BIAS), "weight": np.append(model.weights, model.bias)})

    parts = chosen.groupBy("shard").applyInArrow(train, "key long, weight double")
    found = dict(parts.groupBy("key").agg((F.sum("weight") / shards).alias("weight")).filter(F.abs("weight") > 1e-3)
                 .toPandas().itertuples(index=False, name=None))  # what L1 left of the shards' features
    bias = found.pop(_BIAS, 0.0)
    keys = np.array(sorted(found), np.int64)
    return Model(bias, keys.view(np.uint64), np.array([found[k] for k in keys.tolist()], np.float64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """``id, held_out, score, predicted`` of every whole text, without a shuffle.

    Null and empty texts have no features and get the bias alone. Null ids and repeated rows give a row each, no rows
    give none; other columns are ignored. ``keep`` returns instead the rows of ``docs`` as they are that are not predicted.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def probabilities(column: pa.Array) -> np.ndarray:
        bias, keys, weights = sent.value
        sums, mask = np.full(len(column), bias), np.uint64((1 << _SIEVE_BITS) - 1)
        sieve = np.zeros(1 << _SIEVE_BITS, bool)
        sieve[keys & mask] = True
        for block in word_blocks(column, separators=IS_MARK):
            row, found = features(block)
            maybe = np.flatnonzero(sieve[found & mask])
            row, found = row[maybe], found[maybe]
            at = np.minimum(np.searchsorted(keys, found), max(len(keys) - 1, 0))
            hit = keys[at] == found if len(keys) else np.zeros(len(found), bool)
            pairs = np.unique(np.stack((row[hit], at[hit])), axis=1)
            sums[block.first:block.first + block.rows] += np.bincount(pairs[0], weights[pairs[1]], minlength=block.rows)
        return 1 / (1 + np.exp(-np.clip(sums, -35, 35)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probabilities(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                             ["id", "held_out", "score", "predicted"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(probabilities(batch.column(text_col)) < threshold))

    if keep:
        return docs.mapInArrow(clean, docs.schema)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
