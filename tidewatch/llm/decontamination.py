"""Benchmark decontamination by latent semantic retrieval.

Benchmark items and documents are cut into passages of words. Passages are TF-IDF vectors over the terms of the items
(no other term has a share in an item's vector), with document frequencies counted over all documents. A randomised
SVD of all passages, whose products of terms are summed by Spark tasks, gives a latent space in which items are compared with every
passage, by cosine and by the share of the item that the passage holds. The share is measured against the item's own
length in the space, so neither a short item in a long passage nor what the space cannot hold makes it small.
Candidates are checked in place: the longest common subsequence of words has to cover most of the item, and of its
answer (its last sentence, if it is not a column of its own). Items of few words are searched word for word in the same pass.

Items are searched in blocks of about ``ITEM_BLOCK``, so what is sent to the workers does not grow with the benchmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.words import IS_MARK, Block, mix, prepare, word_blocks, word_hashes
from tidewatch.session import discard, materialise

ITEM_BLOCK = 500
#: Words of half a passage; passages overlap by half.
HALF = 32
#: The rank has to grow with ``ITEM_BLOCK``: what the space cannot hold of the items makes false candidates.
RANK, SPARE_RANK, POWER_ROUNDS, SEED = 256, 16, 1, 7
#: The latent space is fitted on the items and on all passages of the documents, which together weigh as much as so many at most.
PASSAGES_WEIGH, ITEM_WEIGHT = 20_000, 10.0
#: A candidate reaches one of ``COSINE`` and ``HELD`` (share of the item that the passage holds). Items of fewer than
#: ``LEAST_WORDS`` are searched word for word.
COSINE, HELD, COVERED, ANSWERED, LEAST_WORDS = 0.4, 0.5, 0.6, 0.5, 8
#: Half passages that are compared at once.
_AT_ONCE = 512
#: Sums of pairs of terms that a task holds as one array, and pairs that it makes at once; passages that a task adds up, at least.
_CELLS, _PAIRS, _TASK_PASSAGES = 1 << 25, 1 << 21, 2_000_000
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


class Item(NamedTuple):
    id: int
    words: list[bytes]
    answer: list[bytes]


class Index(NamedTuple):
    items: list[Item]      # of LEAST_WORDS or more
    terms: np.ndarray      # sorted hashes of the items' words
    weight: np.ndarray     # inverse document frequency of each term
    space: np.ndarray      # terms x rank
    passages: np.ndarray   # item passages in the space, of length 1
    norm: np.ndarray       # their lengths before
    owner: np.ndarray      # item of each
    places: list[np.ndarray]   # term of each word of an item
    short: dict[tuple[bytes, ...], list[Item]]   # items of fewer words


def split_words(text: str) -> list[bytes]:
    block = next(word_blocks(pa.array([text]), separators=IS_MARK), None)
    return [block.data[a:b] for a, b in zip(block.starts.tolist(), block.ends.tolist())] if block else []


def make_item(number: int, text: str | None, answer: str | None) -> Item:
    sentences = [s for s in _SENTENCE.split((text or "").strip()) if split_words(s)]
    return Item(number, split_words(text or ""), split_words(answer or (sentences[-1] if sentences else "")))


def _terms(hashes: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Number of each hash's term, -1 for others."""
    ends = (terms & np.uint64(0xFFFF)).astype(np.int64)
    first = np.full(1 << 16, -1, np.int32)  # a term with these low bits
    first[ends] = np.arange(len(terms))
    many = np.bincount(ends, minlength=1 << 16) > 1
    out = np.full(len(hashes), -1, np.int64)
    low = (hashes & np.uint64(0xFFFF)).astype(np.int64)
    at = first[low]
    maybe = np.flatnonzero(at >= 0)
    if len(maybe):
        at = at[maybe]
        hit = terms[at] == hashes[maybe]
        out[maybe[hit]] = at[hit]
        maybe = maybe[~hit]
        maybe = maybe[many[low[maybe]]]  # others end alike
        at = np.minimum(np.searchsorted(terms, hashes[maybe]), len(terms) - 1)
        hit = terms[at] == hashes[maybe]
        out[maybe[hit]] = at[hit]
    return out


def _halves(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Half passage of each word, counted through the block, and the text of each half."""
    per = np.bincount(block.row, minlength=block.rows)
    inside = np.arange(len(block.row)) - np.repeat(np.cumsum(per) - per, per)
    number = -(-per // HALF)
    return inside // HALF + np.repeat(np.cumsum(number) - number, per), np.repeat(np.arange(block.rows), number)


def _item_passages(items: list[Item]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all items' words, the passage of each, and the item of each passage: equal parts of at most two halves."""
    block = next(word_blocks(pa.array([b" ".join(i.words).decode() for i in items]), 1 << 30, IS_MARK))
    per = np.bincount(block.row, minlength=block.rows)
    parts = -(-per // (2 * HALF))
    inside = np.arange(len(block.row)) - np.repeat(np.cumsum(per) - per, per)
    return word_hashes(block), inside * parts[block.row] // per[block.row] + np.repeat(np.cumsum(parts) - parts, per), np.repeat(np.arange(block.rows), parts)


def _weights(counts: np.ndarray, passages: int) -> np.ndarray:
    return np.log((1 + passages) / (1 + counts)) + 1e-3


def _sparse(owner: np.ndarray, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, term and TF-IDF value of each different term of an owner, sorted."""
    pairs, n = np.unique(owner * len(weight) + term, return_counts=True)
    term = pairs % len(weight)
    return pairs // len(weight), term, n * weight[term]


def _product(owner: np.ndarray, term: np.ndarray, value: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Rows of the sparse matrix times ``matrix``, in the order of owners (those without terms are left out)."""
    begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.empty(0, np.int64)
    out = np.empty((len(begins), matrix.shape[1]), np.float32)
    for a in range(0, len(begins), 2000):
        low, high = begins[a], begins[a + 2000] if a + 2000 < len(begins) else len(owner)
        out[a:a + 2000] = np.add.reduceat(matrix[term[low:high]] * value[low:high, None].astype(np.float32), begins[a:a + 2000] - low, axis=0)
    return out


def _survey(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """``term, n`` passages of each task that hold a term (term -1: all passages), and the ``terms`` of every passage that holds one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for block in word_blocks(batch.column("text"), separators=IS_MARK):
                half, text = _halves(block)
                term = _terms(word_hashes(block), terms)
                total += len(text)
                held = np.flatnonzero(term >= 0)
                if len(held):
                    half, term = half[held], term[held]
                    pairs = np.sort(half * len(terms) + term)
                    counts += np.bincount(pairs[np.append(True, pairs[1:] != pairs[:-1])] % len(terms), minlength=len(terms))
                    ends = np.append(np.flatnonzero(half[1:] != half[:-1]) + 1, len(half)).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), pa.array(term.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(ends), pa.int64()), pa.nulls(len(ends), pa.int64()), lists], ["term", "n", "terms"])
        term = np.append(np.flatnonzero(counts), -1)
        n = np.append(counts[counts > 0], total)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n), pa.nulls(len(term), pa.list_(pa.int32()))], ["term", "n", "terms"])

    return materialise(docs.select("text").mapInArrow(run, "term long, n long, terms array<int>"), "leak-survey")


_ROW = "term int, others array<int>, sums array<double>"


def _row(term: list, others: list, sums: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(others, pa.list_(pa.int32())), pa.array(sums, pa.list_(pa.float64()))], ["term", "others", "sums"])


def _together(passages: DataFrame, weight: np.ndarray, tasks: int = 8) -> DataFrame:
    """``A' A`` of all passages (``terms``; rows of length 1): a row for each term, with the terms from it on that share a passage.

    A task adds up its passages in one array where the square of the terms allows, else a part of its passages at a time. At
    most ``tasks`` do so, as each hands in its own sums.
    """
    size = len(weight)

    def cut(keys: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        begins = np.flatnonzero(np.append(True, keys[1:] // size != keys[:-1] // size)) if len(keys) else np.empty(0, np.int64)
        for a in range(0, len(begins), 200):
            ends = np.append(begins, len(keys))[a:a + 201]
            parts = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
            yield _row((keys[ends[:-1]] // size).tolist(), [(keys[x:y] % size).astype(np.int32) for x, y in parts], [sums[x:y] for x, y in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(size * size) if size * size <= _CELLS else None
        for batch in batches:
            lists = batch.column("terms")
            owner, term, value = _sparse(np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy().astype(np.int64), weight)
            value = value / np.sqrt(np.bincount(owner, value ** 2))[owner]
            left = np.searchsorted(owner, owner, "right") - np.arange(len(owner))  # terms of the passage from this one on
            upto = np.cumsum(left)
            low = 0
            while low < len(owner):
                high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + _PAIRS, "right")))
                first = np.repeat(np.arange(low, high), left[low:high])
                second = first + np.arange(len(first)) - np.repeat(upto[low:high] - left[low:high] - (upto[low] - left[low]), left[low:high])
                keys, product = term[first] * size + term[second], value[first] * value[second]
                if whole is not None:
                    np.add.at(whole, keys, product)
                else:
                    keys, at = np.unique(keys, return_inverse=True)
                    yield from cut(keys, np.bincount(at, product))
                low = high
        if whole is not None:
            keys = np.flatnonzero(whole)
            yield from cut(keys, whole[keys])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, np.zeros(size)

        def done() -> pa.RecordBatch:
            others = np.flatnonzero(sums)
            return _row([at], [others.astype(np.int32)], [sums[others]])

        for batch in batches:  # sorted by term
            for term, others, values in zip(batch.column("term").to_pylist(), batch.column("others"), batch.column("sums")):
                if term != at:
                    if at is not None:
                        yield done()
                    at, sums = term, np.zeros(size)
                sums[others.values.to_numpy()] += values.values.to_numpy()
        if at is not None:
            yield done()

    rows = passages.coalesce(tasks).mapInArrow(run, _ROW).repartition(8, "term").sortWithinPartitions("term")
    return materialise(rows.mapInArrow(add, _ROW), "leak-together")


def _products(together: DataFrame, weight: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """``term, row``: each task's part of ``A' A matrix``. A part has as many rows as there are terms, so the number of tasks goes by
    the pairs of terms and not by the files that these lie in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(matrix.shape)
        step = max(1, (1 << 22) // len(weight))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                term, lists = part.column("term").to_numpy(), part.column("others")
                row, other = np.repeat(np.arange(len(term)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
                block = np.zeros((len(term), len(weight)))
                block[row, other] = part.column("sums").flatten().to_numpy()
                total[term] += block @ matrix
                block[np.arange(len(term)), term] = 0
                total += block.T @ matrix[term]
        held = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(list(total[held]), pa.list_(pa.float64()))], ["term", "row"])

    return together.coalesce(max(2, len(weight) ** 2 // _CELLS)).mapInArrow(run, "term long, row array<double>")


def _squared(together: DataFrame, share: float, weight: np.ndarray, items: tuple, matrix: np.ndarray) -> np.ndarray:
    """``A' A matrix`` for all passages, ``share`` of its value, summed by tasks, and the weighted items."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for term, row in zip(batch.column("term").to_pylist(), batch.column("row")):
                sums[term] = sums.get(term, 0.0) + row.values.to_numpy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["term", "row"])

    out = ITEM_WEIGHT ** 2 * _gram(*items, weight, matrix)
    rows = _products(together, weight, matrix).repartition(8, "term").mapInArrow(add, "term long, row array<double>")
    for r in rows.collect():  # a row for each term of an item block
        out[r["term"]] += share * np.asarray(r["row"])
    return out


def _gram(owner: np.ndarray, term: np.ndarray, weight: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    out = np.zeros(matrix.shape)
    if len(term):
        owner, term, value = _sparse(owner, term, weight)
        value = value / np.sqrt(np.bincount(owner, value ** 2))[owner]
        each = _product(owner, term, value, matrix)
        place = np.cumsum(np.append(False, owner[1:] != owner[:-1]))
        by = np.argsort(term, kind="stable")
        begins = np.flatnonzero(np.append(True, term[by][1:] != term[by][:-1]))
        for a in range(0, len(begins), 500):
            low, high = begins[a], begins[a + 500] if a + 500 < len(begins) else len(by)
            part = by[low:high]
            out[term[part][begins[a:a + 500] - low]] = np.add.reduceat(each[place[part]] * value[part, None], begins[a:a + 500] - low, axis=0)
    return out


def build(docs: DataFrame, items: list[Item]) -> Index:
    """The latent space of a block of items and all documents (``text``)."""
    short: dict[tuple[bytes, ...], list[Item]] = {}
    for item in items:
        if 0 < len(item.words) < LEAST_WORDS:
            short.setdefault(tuple(item.words), []).append(item)
    items = [i for i in items if len(i.words) >= LEAST_WORDS]
    if not items:
        none = np.empty(0, np.float32)
        return Index([], np.empty(0, np.uint64), none, none.reshape(0, 0), none.reshape(0, 0), none, np.empty(0, np.int64), [], short)
    hashes, passage, owner_ = _item_passages(items)
    terms = np.unique(hashes)
    survey = _survey(docs, terms)
    counts = np.zeros(len(terms), np.int64)
    passages = 0
    for r in survey.filter("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term
        if r["term"] < 0:
            passages = r["n"]
        else:
            counts[r["term"]] = r["n"]
    weight = _weights(counts, passages)
    held = survey.filter("terms is not null").select("terms")
    n = held.count()
    share = min(1.0, PASSAGES_WEIGH / max(n, 1))
    together = _together(held, weight, max(8, -(-n // _TASK_PASSAGES)))
    discard(survey)
    rows = (passage, np.searchsorted(terms, hashes))
    rank = min(RANK + SPARE_RANK, len(terms))
    basis = np.random.default_rng(SEED).standard_normal((len(terms), rank))
    for _ in range(1 + POWER_ROUNDS):
        basis = np.linalg.qr(_squared(together, share, weight, rows, basis))[0]
    values, turn = np.linalg.eigh(basis.T @ _squared(together, share, weight, rows, basis))
    discard(together)
    keep = np.argsort(values)[::-1][:RANK]
    space = (basis @ turn[:, keep[values[keep] > 1e-9 * max(values.max(), 1e-300)]]).astype(np.float32)
    owner, term, value = _sparse(*rows, weight)
    latent = _product(owner, term, value, space)
    norm = np.maximum(np.linalg.norm(latent, axis=1), 1e-12)
    places = np.split(rows[1], np.cumsum([len(i.words) for i in items])[:-1])
    return Index(items, terms, weight.astype(np.float32), space, latent / norm[:, None], norm, owner_, places, short)


def _halves_times(matrix: np.ndarray, ends: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The sum of ``value`` times the row of ``matrix`` over the terms of each half (from ``ends[i]`` to ``ends[i + 1]``): the
    first terms of all halves at once, then the second ones, and so on.

    Single precision, so the order counts: eights of the terms after the first are summed in eight lanes, which are added in pairs,
    then the terms left over, as ``np.add.reduceat`` does for up to 128.
    """
    per = np.diff(ends)
    order = np.argsort(-per, kind="stable")
    begins, rest = ends[:-1][order], per[order] - 1
    paired = rest - rest % 8
    n = len(per)
    x, sums, out = (np.zeros((n, matrix.shape[1]), np.float32) for _ in range(3))
    lanes = np.zeros((8, np.count_nonzero(paired > 0), matrix.shape[1]), np.float32)

    def rows(k: int, n: int) -> np.ndarray:
        at = begins[:n] + k
        np.take(matrix, term[at], axis=0, out=x[:n], mode="clip")
        x[:n] *= value[at, None]
        return x[:n]

    low = 0
    for k in range(rest.max(initial=-1) + 1):
        upto, eights = np.searchsorted(-rest, -k), np.searchsorted(-paired, -k)  # halves with more terms, with more eights
        new = rows(k + 1, upto)
        if k % 8 == 0:
            sums[eights:low] = _paired(lanes[:, eights:low])
            low = eights
        lanes[k % 8, :eights] += new[:eights]
        sums[eights:upto] += new[eights:]
    sums[:low] = _paired(lanes[:, :low])
    held = np.searchsorted(-per[order], 0)
    out[order[:held]] = rows(0, held) + sums[:held]
    return out


def _paired(r: np.ndarray) -> np.ndarray:
    return ((r[0] + r[1]) + (r[2] + r[3])) + ((r[4] + r[5]) + (r[6] + r[7]))


def common_words(item: dict[bytes, int], length: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence; ``item``: where each of its words stands, as bits."""
    full = v = (1 << length) - 1
    for w in words:
        if (m := item.get(w)) is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def _places(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def _sequences(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words."""
    n = max(len(hashes) - length + 1, 0)
    out = hashes[:n]
    for i in range(1, length):
        out = mix(out + hashes[i:i + n])
    return out


def _answered(item: Item, words: list[bytes]) -> float:
    answer = item.answer or item.words
    return common_words(_places(answer), len(answer), words) / len(answer)


def _words(block: Block, low: int, high: int) -> list[bytes]:
    return [block.data[x:y] for x, y in zip(block.starts[low:high].tolist(), block.ends[low:high].tolist())]


def _short_leaks(index: Index, block: Block, hashes: np.ndarray) -> Iterator[tuple[int, int, None, float, float]]:
    """The same as ``leaks_in`` for items of few words, which have no cosine."""
    found: dict[tuple[int, int], float] = {}
    for length in sorted({len(words) for words in index.short}):
        wanted = np.array([h for words in index.short if len(words) == length
                           for h in _sequences(word_hashes(next(word_blocks(pa.array([b" ".join(words).decode()]), separators=IS_MARK))), length)], np.uint64)
        for at in np.flatnonzero(_terms(_sequences(hashes, length), np.unique(wanted)) >= 0).tolist():
            row = int(block.row[at])
            if block.row[at + length - 1] != row:
                continue
            for item in index.short.get(tuple(_words(block, at, at + length)), ()):
                if found.get((row, item.id)) == 1.0:
                    continue
                low, high = np.searchsorted(block.row, (row, row + 1))
                answered = _answered(item, _words(block, max(int(low), at - HALF), min(int(high), at + length + HALF)))
                if answered >= ANSWERED:
                    found[row, item.id] = max(found.get((row, item.id), 0.0), answered)
    for (row, item), answered in sorted(found.items()):
        yield row, item, None, 1.0, answered


def leaks_in(index: Index, block: Block) -> Iterator[tuple[int, int, float | None, float, float]]:
    """Row of the block, item, cosine, covered part of the item and of its answer, at the best place of each pair."""
    hashes = word_hashes(block)
    yield from _short_leaks(index, block, hashes)
    if not index.items:
        return
    half, text = _halves(block)
    every = term = _terms(hashes, index.terms)
    held = np.flatnonzero(term >= 0)
    pairs, n = np.unique(half[held] * len(index.terms) + term[held], return_counts=True)
    owner, term = pairs // len(index.terms), pairs % len(index.terms)
    value = n.astype(np.float32) * index.weight[term]
    ends = np.searchsorted(owner, np.arange(len(text) + 1))
    joined = np.append(text[1:] == text[:-1], False)[:len(text)]
    square = np.bincount(owner, value ** 2, minlength=len(text))
    after = np.minimum(np.searchsorted(pairs, pairs + len(index.terms)), max(len(pairs) - 1, 0))  # the same term in the next half
    shared = pairs[after] == pairs + len(index.terms) if len(pairs) else np.zeros(0, bool)
    cross = np.bincount(owner[shared], value[shared] * value[after[shared]], minlength=len(text))
    length = np.sqrt(np.maximum(square + joined * (np.append(square[1:], 0)[:len(text)] + 2 * cross), 1e-12))
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    spans, firsts = np.searchsorted(block.row, np.arange(block.rows + 1)), np.searchsorted(half, np.arange(len(text)))
    seen = np.zeros(len(index.terms) + 1, bool)  # the last is for words that are no terms
    for a in range(0, len(text), _AT_ONCE):
        b = min(a + _AT_ONCE + 1, len(text))  # the last half of a part is the first of the next
        latent = _halves_times(index.space, ends[a:b + 1], term, value)
        whole = latent[:_AT_ONCE] + np.append(latent[1:], np.zeros((1, latent.shape[1]), np.float32), axis=0)[:_AT_ONCE] * joined[a:min(b, a + _AT_ONCE), None]
        dot = whole @ index.passages.T
        near = dot >= np.minimum(COSINE * length[a:a + len(whole), None], HELD * index.norm)
        for w, p in np.argwhere(near).tolist():
            row, item = int(text[a + w]), int(index.owner[p])
            chosen = index.items[item]
            low, high = spans[row], spans[row + 1]
            begin = int(firsts[a + w])
            low, high = max(int(low), begin - len(chosen.words)), min(int(high), begin + 2 * HALF + len(chosen.words))
            seen[every[low:high]] = True
            shared = np.count_nonzero(seen[index.places[item]])
            seen[every[low:high]] = False
            if shared < COVERED * len(chosen.words):  # no common subsequence is longer
                continue
            words = _words(block, low, high)
            covered = common_words(_places(chosen.words), len(chosen.words), words) / len(chosen.words)
            if covered < COVERED:
                continue
            answered = _answered(chosen, words)
            if answered >= ANSWERED:
                best = (covered, answered, float(dot[w, p] / length[a + w]))
                found[row, item] = max(found.get((row, item), best), best)
    for (row, item), (covered, answered, cos) in sorted(found.items()):
        yield row, index.items[item].id, cos, covered, answered


def indexes(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
            answer_col: str | None = None) -> Iterator[Index]:
    """An index for each block of items. Items without words are left out."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text"))
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    picked = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text"), answer.alias("answer")).filter("id is not null").distinct()
    blocks = -(-picked.count() // ITEM_BLOCK)
    for b in range(blocks):
        rows = picked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id", "text", "answer").collect()  # one block
        items = [i for i in (make_item(*r) for r in rows) if i.words]
        if items:
            yield build(texts, items)


_FOUND = "doc_id long, item_id long, cosine double, covered double, answered double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, item_id, cosine, covered, answered`` of every document that holds an item, once for each pair.

    Items of fewer than ``LEAST_WORDS`` words are found word for word and have a null cosine.
    Null and empty texts hold nothing; null document ids are kept, null item ids are left out; repeated documents give
    rows each, repeated items count once. Without documents or items there are no rows. Other columns are ignored.
    """
    out = docs.sparkSession.createDataFrame([], _FOUND)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    for index in indexes(docs, benchmark, text_col, **options):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in word_blocks(batch.column("text"), separators=IS_MARK):
                    rows = list(leaks_in(sent.value, block))
                    if rows:
                        row, *rest = zip(*rows)
                        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array([block.first + r for r in row])), *(pa.array(c) for c in rest)],
                                                         ["doc_id", "item_id", "cosine", "covered", "answered"])

        out = out.unionByName(texts.mapInArrow(run, _FOUND))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, as they are, that hold no item."""
    schema = docs.schema
    for index in indexes(docs, benchmark, text_col, **options):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for block in word_blocks(batch.column(text_col), separators=IS_MARK):
                    clean[[block.first + r for r, *_ in leaks_in(sent.value, block)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs
