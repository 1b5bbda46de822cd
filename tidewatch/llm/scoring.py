"""Interpolated modified Kneser-Ney word bigrams, counted in Spark and memory-mapped by the workers that score.

Words are counted first; a word's row in the sorted array of word hashes is its number from then on. Pairs of numbers
are dealt by their first word, and the pairs of a frequent first word over several shards, so no word makes a task
larger than others. A shard keeps its pairs as a sorted hash array with counts. What smoothing needs of a
word (followers seen once, twice and more, distinct words before it) lies in arrays beside the word hashes. Scoring
maps those files, looks up the distinct words and pairs of a block of texts, and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.arrays import Arrays, Tally, add_up, batches_of, gather, lookup, publish, shard_of, unsigned, write_file
from tidewatch.llm.words import Block, long_view, mix, partitions, prepare, word_blocks, word_hashes
from tidewatch.session import fresh_path

_U = np.uint64
#: Numbers of the marks before and after every text, in place of word hashes.
BEGIN, END = _U(1), _U(2)
_BLOCK = 8 << 20
_SALT = _U(0x9E3779B97F4A7C15)


_AROUND = ("once", "twice", "more", "before")


class Model(NamedTuple):
    words: Arrays          # key, n: word hashes and how often each occurs
    pair_root: str         # key, n in shards: hashes of pairs of word numbers, and counts
    around: Arrays         # of each word number: followers seen once, twice, more often, and distinct words before it
    hot: int               # a first word's pairs get another shard for each so many occurrences
    shards: int
    tokens: int
    distinct: int
    pairs: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_kinds: tuple[int, int, int]


def held_out(id_col: str) -> F.Column:
    """Rows that are not learnt from: crc32 of the id's text leaves 2 when divided by 7 (a null id: no)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def discounts(kinds: tuple[int, int, int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many things occur once to four times, kept inside (0, count).

    Where the estimate has no denominator (small inputs), half a count is taken off.
    """
    n1, n2, n3, n4 = kinds
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [k - (k + 1) * y * above / below if below else 0.5 for k, below, above in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.1), k - 0.05) for k, d in enumerate(raw, 1))


def _sequence(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a block with an end after each text, and the row of each."""
    per = np.bincount(block.row, minlength=block.rows) + 1
    ends = np.cumsum(per) - 1
    tokens = np.full(int(per.sum()), END)
    inside = np.ones(len(tokens), bool)
    inside[ends] = False
    tokens[inside] = word_hashes(block)
    return tokens, np.repeat(np.arange(block.rows), per)


def _first(row: np.ndarray) -> np.ndarray:
    return np.append(True, row[1:] != row[:-1])[:len(row)]


def pair_place(first: np.ndarray, second: np.ndarray, count: np.ndarray, hot: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and hash of pairs of word numbers; ``count``: occurrences of the first word."""
    first, second = first.astype(_U), second.astype(_U)
    salt = mix(second) % (count.astype(_U) // _U(hot) + _U(1))
    return (mix(first * _SALT + salt) % _U(shards)).astype(np.int64), mix(mix(first + _SALT) ^ second)


def fit(texts: DataFrame, text_col: str = "text") -> Model:
    """A model of all rows of ``texts``. Null and empty texts are an end alone."""
    spark = prepare(texts.sparkSession)
    shards = max(2, partitions(spark))
    texts = texts.select(F.col(text_col).alias("text"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def hand_out() -> Iterator[pa.RecordBatch]:
            keys, counts = tally.flush()
            yield from batches_of({"shard": shard_of(keys, shards), "key": long_view(keys), "n": counts})

        for batch in batches:
            for block in word_blocks(batch.column("text"), _BLOCK):
                full = tally.add(word_hashes(block))
                tally.add(np.array([BEGIN, END]), np.array([block.rows] * 2))
                if full:
                    yield from hand_out()
        yield from hand_out()

    def build_words(_: int, got: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        keys, n = add_up(unsigned(got["key"]), got["n"])
        return {"key": keys, "n": n, "texts": n[keys == BEGIN]}

    words, total = publish(texts.mapInArrow(count_words, "shard long, key long, n long"), "lm-words", {"key": "<u8", "n": "<i8"}, shards, build_words, ("n", "texts"))
    number, texts_seen = int(words.offsets[-1]), total["texts"]
    tokens, distinct = total["n"] - texts_seen, max(number - 1, 0)
    if number >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")
    hot = max(1, tokens // (8 * shards))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def hand_out() -> Iterator[pa.RecordBatch]:
            keys, counts = tally.flush()
            first = (keys >> _U(32)).astype(np.int64)
            shard, _ = pair_place(first, keys & _U(0xFFFFFFFF), words.take("n", first), hot, shards)
            yield from batches_of({"shard": shard, "key": long_view(keys), "n": counts})

        for batch in batches:
            for block in word_blocks(batch.column("text"), _BLOCK):
                seen, row = _sequence(block)
                distinct_words, place = np.unique(np.append(seen, BEGIN), return_inverse=True)
                numbers = words.find(distinct_words)[place].astype(_U)
                second, begin = numbers[:-1], numbers[-1]
                first = np.append(begin, second[:-1])
                first[_first(row)] = begin
                if tally.add(first << _U(32) | second):
                    yield from hand_out()
        yield from hand_out()

    root = fresh_path(spark, "lm-pairs")

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes a shard's pairs, and hands on what they say of their words and of the counts of counts."""
        got = gather(batches)
        if not got:
            return
        for s in np.unique(got["shard"]).tolist():
            mine = got["shard"] == s
            keys, n = add_up(unsigned(got["key"][mine]), got["n"][mine])
            first, second = (keys >> _U(32)).astype(np.int64), (keys & _U(0xFFFFFFFF)).astype(np.int64)
            hashes = pair_place(first, second, np.zeros(len(first), np.int64), hot, shards)[1]
            order = np.argsort(hashes)
            write_file(f"{root}/{s:06d}.key", hashes[order])
            write_file(f"{root}/{s:06d}.n", n[order].astype("<u4"))
            begins = np.flatnonzero(_first(first))
            kinds = [np.add.reduceat(x.astype(np.int64), begins) for x in (n == 1, n == 2, n >= 3)]
            yield from around_rows(first[begins], *kinds, np.zeros(len(begins), np.int64))
            after, before = np.unique(second, return_counts=True)
            none = np.zeros(len(after), np.int64)
            yield from around_rows(after, none, none, none, before)
            each = [np.count_nonzero(n == k) for k in (1, 2, 3, 4)]
            yield from around_rows(*(np.array([x, y]) for x, y in zip((-1, *each), (-2, len(n), 0, 0, 0))))

    def around_rows(number: np.ndarray, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
        shard = np.maximum(np.searchsorted(words.offsets, number, "right") - 1, 0)
        return batches_of({"shard": shard, "number": number, **dict(zip(_AROUND, values))})

    def build_around(shard: int, got: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        own = got["number"] >= 0
        size, at = int(words.offsets[shard + 1] - words.offsets[shard]), got["number"][own] - words.offsets[shard]
        out = {c: np.bincount(at, got[c][own], minlength=size).astype(np.int64) for c in _AROUND}
        counts, whole = got["number"] == -1, got["number"] == -2
        return (out | {f"p{k}": got[c][counts] for k, c in enumerate(_AROUND, 1)} | {"pairs": got["once"][whole], "w5": np.array([np.count_nonzero(out["before"] >= 3)])}
                | {f"w{k}": np.array([np.count_nonzero(out["before"] == k)]) for k in (1, 2, 3, 4)})

    counted = texts.mapInArrow(count_pairs, "shard long, key long, n long").repartition(shards, "shard")
    sides = counted.mapInArrow(write_pairs, "shard long, number long, " + ", ".join(f"{c} long" for c in _AROUND))
    around, seen = publish(sides, "lm-around", {c: "<u4" for c in _AROUND}, shards, build_around,
                           ("pairs", "p1", "p2", "p3", "p4", "w1", "w2", "w3", "w4", "w5"))
    return Model(words, root, around._replace(offsets=words.offsets), hot, shards, tokens, distinct, seen["pairs"],
                 discounts(tuple(seen[f"p{k}"] for k in (1, 2, 3, 4))), discounts(tuple(seen[f"w{k}"] for k in (1, 2, 3, 4))), (seen["w1"], seen["w2"], seen["w5"]))


def score_block(model: Model, block: Block) -> dict[str, np.ndarray]:
    """Sums over the tokens of each text of a block."""
    seen, row = _sequence(block)
    keys, place = np.unique(np.append(seen, BEGIN), return_inverse=True)
    number = model.words.find(keys)
    n = model.words.take("n", number)
    n[keys == BEGIN] *= number[keys == BEGIN] >= 0
    once, twice, more, before = (model.around.take(c, number).astype(np.float64) for c in _AROUND)
    unknown = 1 / (model.distinct + 1)
    if model.pairs:
        off = np.where(before > 2, model.word_discounts[2], np.where(before > 1, model.word_discounts[1], np.where(before > 0, model.word_discounts[0], 0)))
        alone = (before - off + np.dot(model.word_discounts, model.word_kinds) * unknown) / model.pairs
    else:
        alone = np.full(len(keys), unknown)
    follows = once + twice + more > 0
    spare = np.where(follows, (np.stack((once, twice, more), 1) @ model.pair_discounts) / np.maximum(n, 1), 1.0)

    second, begin = place[:-1], place[-1]
    first = np.append(begin, second[:-1])
    first[_first(row)] = begin
    both = np.flatnonzero((number[first] >= 0) & (number[second] >= 0))
    pairs, back = np.unique(number[first[both]].astype(_U) << _U(32) | number[second[both]].astype(_U), return_inverse=True)
    a = (pairs >> _U(32)).astype(np.int64)
    count = np.zeros(len(pairs), np.int64)
    count[back] = n[first[both]]
    shard, hashes = pair_place(a, pairs & _U(0xFFFFFFFF), count, model.hot, model.shards)
    times = lookup(model.pair_root, "n", "<u4", hashes, shard).astype(np.float64)
    kept = times - np.where(times > 2, model.pair_discounts[2], np.where(times > 1, model.pair_discounts[1], np.where(times > 0, model.pair_discounts[0], 0)))
    p = spare[first] * alone[second]
    p[both] += (kept / np.maximum(count, 1))[back]
    c = n[second]
    add = lambda x: np.bincount(row, x, minlength=block.rows)
    return {"n_tokens": add(np.ones(len(row))).astype(np.int64), "n_known": add(c > 0).astype(np.int64),
            "base_score": add(np.log10((c + 1) / (model.tokens + model.distinct + 1))), "score": add(np.log10(p))}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every whole text, without a shuffle.

    Null and empty texts are an end alone; words never learnt share one place in the vocabulary. With nothing learnt every
    token has probability 1. Repeated rows and null ids give a row each, no rows give none, other columns are ignored.
    """
    names = ("n_tokens", "n_known", "base_score", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in word_blocks(batch.column("text"), _BLOCK):
                part, found = batch.slice(block.first, block.rows), score_block(model, block)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), *(pa.array(found[c]) for c in names)], ["id", "held_out", *names])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    scored = picked.mapInArrow(run, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
                         F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
