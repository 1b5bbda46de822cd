"""Removal of repeated byte strings with a suffix sort in the deep-shallow manner.

Suffixes are sorted by their first ``LENGTH`` bytes: multikey quicksort, eight bytes a step, to a shallow depth, and a
blind trie for each group that is still together there. To sort only suffixes that can have a repetition, and to sort
them where their repetitions are, strings are dealt by their anchor (see ``anchors``):

1. Count the anchors of all texts; those that occur once are dropped.
2. Send each run of strings of a repeated anchor, as one piece of text, to the task of its anchor. A task that meets a
   piece a second time marks its strings at once and sends nothing. Pieces of an anchor that occurs very often
   are cut into single strings dealt by their own hash.
3. Equal pieces are marked but for the first. The strings of different pieces of an anchor are sorted; equal
   strings are marked but for the first.
4. Marked bytes are merged per text and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.anchors import BLOCK, LENGTH, runs
from tidewatch.llm.arrays import Arrays, Tally, add_up, batches_of, publish, shard_of, unsigned
from tidewatch.llm.words import byte_blocks, long_view, mix, partitions, prepare

SHALLOW = 32
#: Occurrences from which on an anchor's pieces are cut into strings.
HOT = 20_000
#: Pieces that a task remembers; beyond it starts afresh, which costs traffic only.
REMEMBERED = 200_000
_LEAST = -(1 << 63)
_U = np.uint64


class BlindTrie:
    """Strings of one length; inner nodes know only where their strings differ, leaves hold equal strings' numbers."""

    def __init__(self, text: bytes, number: int):
        self.root: list = [-1, text, [number]]

    def insert(self, text: bytes, number: int) -> None:
        node = self.root
        while node[0] >= 0:  # blindly to any leaf
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        if node[1] == text:
            node[2].append(number)
            return
        differ = int.from_bytes(text) ^ int.from_bytes(node[1])
        at, leaf = len(text) - (differ.bit_length() + 7) // 8, node
        parent, node = None, self.root
        while 0 <= node[0] < at:
            parent, node = node, node[1][text[node[0]]]
        if node[0] == at:
            node[1][text[at]] = [-1, text, [number]]
            return
        split = [at, {text[at]: [-1, text, [number]], leaf[1][at]: node}]
        if parent is None:
            self.root = split
        else:
            parent[1][text[parent[0]]] = split

    def groups(self) -> Iterator[list[int]]:
        """Numbers of equal strings, strings ascending."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[0] < 0:
                yield node[2]
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]


def deep_shallow(data: bytes, starts: np.ndarray, groups: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings of ``length`` bytes at ``starts`` by group, then bytes, and whether each equals the one before it.

    ``shallow`` is a multiple of eight below ``length``.
    """
    order = np.argsort(groups, kind="stable")
    mark = groups[order]
    same = np.append(False, mark[1:] == mark[:-1])[:len(order)]
    eight = np.ndarray((max(len(data) - 7, 0),), ">u8", buffer=data, strides=(1,))

    def together() -> np.ndarray:
        return np.flatnonzero(same | np.append(same[1:], False))

    for depth in range(0, shallow, 8):  # multikey quicksort; each group is sorted by its next eight bytes
        open_ = together()
        if not len(open_):
            break
        group = np.cumsum(~same[open_])
        symbol = eight[starts[order[open_]] + depth].astype(_U)
        by = np.lexsort((symbol, group))
        order[open_] = order[open_][by]
        same[open_] &= np.append(False, symbol[by][1:] == symbol[by][:-1])
    open_ = together()
    if len(open_):  # what is together over the shallow depth goes into blind tries
        begins = open_[~same[open_]]
        ends = np.append(begins[1:], 0)
        last = np.flatnonzero(~np.append(same[1:], False))
        ends = last[np.searchsorted(last, begins)] + 1
        at, numbers = (starts[order[open_]] + shallow).tolist(), order[open_].tolist()
        k = 0
        for a, b in zip(begins.tolist(), ends.tolist()):
            first = at[k]
            trie = BlindTrie(data[first:first + length - shallow], numbers[k])
            for i in range(k + 1, k + b - a):
                trie.insert(data[at[i]:at[i] + length - shallow], numbers[i])
            k += b - a
            for equal in trie.groups():
                order[a:a + len(equal)] = equal
                same[a] = False
                same[a + 1:a + len(equal)] = True
                a += len(equal)
    return order, same


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, byte of its text that the block begins with, offsets and bytes; texts over a block come in parts that
    share ``LENGTH - 1`` bytes."""
    for first, offsets, raw in byte_blocks(column, BLOCK):
        data = np.frombuffer(raw, np.uint8)
        if len(data) <= 2 * BLOCK:
            yield first, 0, offsets, data
        else:
            for at in range(0, max(len(data) - LENGTH + 1, 1), BLOCK):
                part = data[at:at + BLOCK + LENGTH - 1]
                yield first, at, np.array([0, len(part)]), part


def _document(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``given``, and ``doc, tie, text``: a document is known by its id and a hash of its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("given"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("doc"),
                       F.hash(text).cast("long").alias("tie"), text.alias("text"))


def _key(doc: np.ndarray, tie: np.ndarray) -> np.ndarray:
    return mix(unsigned(doc) ^ mix(unsigned(tie)))


def _merged(document: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that intervals of a document cover, in order."""
    order = np.lexsort((low, document))
    document, low, high = document[order], low[order], high[order]
    if not len(low):
        return document, low, high
    base = np.cumsum(np.append(False, document[1:] != document[:-1])).astype(np.int64) * (1 << 40)
    reach = np.maximum.accumulate(high + base)
    new = np.flatnonzero(np.append(True, low[1:] + base[1:] > reach[:-1]))
    return document[new], low[new], (reach - base)[np.append(new[1:], len(low)) - 1]


def repeated_anchors(docs: DataFrame) -> Arrays:
    """Hashes of the anchors that have two runs at least, with their number."""
    shards = max(2, partitions(docs.sparkSession))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def hand_out() -> Iterator[pa.RecordBatch]:
            keys, n = tally.flush()
            yield from batches_of({"shard": shard_of(keys, shards), "key": long_view(keys), "n": n})

        for batch in batches:
            for _, _, offsets, data in _pieces(batch.column("text")):
                if tally.add(runs(data, offsets).key):
                    yield from hand_out()
        yield from hand_out()

    def build(_: int, got: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        keys, n = add_up(unsigned(got["key"]), got["n"])
        return {"key": keys[n > 1], "n": n[n > 1]}

    return publish(docs.select("text").mapInArrow(count, "shard long, key long, n long"), "repeated-anchors", {"key": "<u8", "n": "<i8"}, shards, build)[0]


_SENT = ("key", "doc", "tie", "start", "off", "piece", "count")


def sent_pieces(docs: DataFrame, anchors: Arrays, hot: int = HOT) -> DataFrame:
    """The pieces of repeated anchors, and rows without a piece: strings that are known to be repeated."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[int, int, bytes], tuple[int, int, int]] = {}
        for batch in batches:
            docs_, ties = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tie"))
            for first, base, offsets, data in _pieces(batch.column("text")):
                found = runs(data, offsets)
                keys, back = np.unique(found.key, return_inverse=True)
                at = anchors.find(keys)
                number = anchors.take("n", at)[back]
                mine = np.flatnonzero(number > 1)
                doc, tie = docs_[first + found.row[mine]], ties[first + found.row[mine]]
                start = found.start[mine] - offsets[found.row[mine]] + base
                by = np.lexsort((start, tie, doc))
                mine, doc, tie, start = mine[by], doc[by], tie[by], start[by]
                raw, rows, marked = data.tobytes(), [], []
                if len(met) > REMEMBERED:
                    met.clear()
                for key, d, t, s, f, a, n, many in zip(long_view(found.key[mine]).tolist(), doc.tolist(), tie.tolist(), start.tolist(), found.start[mine].tolist(),
                                                       found.anchor[mine].tolist(), found.count[mine].tolist(), (number[mine] >= hot).tolist()):
                    piece = raw[f:f + n + LENGTH - 1]
                    before = met.get((key, a - f, piece))
                    if before is not None and before < (d, t, s):
                        marked.append((d, t, s, s + n + LENGTH - 1))
                        continue
                    if before is None:
                        met[key, a - f, piece] = (d, t, s)
                    if many:
                        rows += [(hash_of(piece[i:i + LENGTH]), d, t, s + i, 0, piece[i:i + LENGTH], 1) for i in range(n)]
                    else:
                        rows.append((key, d, t, s, a - f, piece, n))
                if rows:
                    yield from _rows(*zip(*rows))
                if marked:
                    d, t, low, high = (np.array(c, np.int64) for c in zip(*marked))
                    ids, back = np.unique(np.stack((d, t)), axis=1, return_inverse=True)
                    number_, low, high = _merged(back.reshape(-1), low, high)
                    d, t = ids[:, number_]
                    yield from _rows(long_view(mix(_key(d, t) + unsigned(low))), d, t, low, np.zeros(len(low), np.int64), [None] * len(low), high - low - LENGTH + 1)

    return docs.select("doc", "tie", "text").mapInArrow(send, "key long, doc long, tie long, start long, off long, piece binary, count long")


def hash_of(string: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little", signed=True)


def _rows(*columns) -> Iterator[pa.RecordBatch]:
    kinds = [pa.binary() if c == "piece" else pa.int64() for c in _SENT]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(_SENT))


def marked_strings(pieces: DataFrame) -> DataFrame:
    """``doc, tie, low, high``: bytes of the strings that start earlier elsewhere."""
    names = ["doc", "tie", "low", "high"]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables of whole groups of equal keys."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 30_000:
                whole = pa.Table.from_batches(held)
                keys = whole.column("key").to_numpy()
                cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
                if cut:
                    yield whole.slice(0, cut)
                held, size = whole.slice(cut).to_batches(), 0 if cut else 0
        if held:
            yield pa.Table.from_batches(held)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in groups(batches):
            if not got.num_rows:
                continue
            key, doc, tie, start, off, count = (got.column(c).to_numpy() for c in ("key", "doc", "tie", "start", "off", "count"))
            column = got.column("piece").combine_chunks()
            column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
            piece = column.cast(pa.large_binary())
            known = piece.is_null().to_numpy(zero_copy_only=False)
            ends = np.frombuffer(piece.buffers()[1], np.int64)[piece.offset:piece.offset + len(piece) + 1]
            data = bytes(piece.buffers()[2] or b"")
            texts = piece.to_pylist()
            equal = np.zeros(len(key), bool)  # the piece above is the same
            near = np.flatnonzero((key[1:] == key[:-1]) & (off[1:] == off[:-1]) & (count[1:] == count[:-1]) & ~known[1:]) + 1
            equal[near] = [texts[i] == texts[i - 1] for i in near.tolist()]
            leader = np.maximum.accumulate(np.where(equal, 0, np.arange(len(key))))
            later = equal & ((doc != doc[leader]) | (tie != tie[leader]) | (start != start[leader]))
            out = [(doc[m], tie[m], start[m], start[m] + count[m] + LENGTH - 1) for m in (known | later,)]
            first = np.flatnonzero(~equal & ~known)
            several = np.append(False, key[first][1:] == key[first][:-1])[:len(first)]
            first = first[several | np.append(several[1:], False)]
            if len(first):
                n = count[first]
                owner = np.repeat(first, n)
                step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                group = mix(unsigned(key[owner]) + unsigned(off[owner] - step))
                order, same = deep_shallow(data + bytes(8), ends[owner] + step, group)
                who, at = owner[order], (start[owner] + step)[order]
                block = np.cumsum(~same)
                by = np.lexsort((at, tie[who], doc[who], block))
                who, at, block = who[by], at[by], block[by]
                lead = np.maximum.accumulate(np.where(np.append(True, block[1:] != block[:-1]), np.arange(len(who)), 0))
                again = (doc[who] != doc[who[lead]]) | (tie[who] != tie[who[lead]]) | (at != at[lead])
                out.append((doc[who[again]], tie[who[again]], at[again], at[again] + LENGTH))
            d, t, low, high = (np.concatenate(c) for c in zip(*out))
            ids, back = np.unique(np.stack((d, t)), axis=1, return_inverse=True)
            number, low, high = _merged(back.reshape(-1), low, high)
            yield from batches_of(dict(zip(names, (*ids[:, number], low, high))))

    ordered = pieces.repartition(partitions(pieces.sparkSession), "key").sortWithinPartitions("key", "off", "count", "piece", "doc", "tie", "start")
    return ordered.mapInArrow(mark, "doc long, tie long, low long, high long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` (with ``keep_text`` also ``kept``, the bytes left) of every text.

    A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a smaller id, or before in the same
    text. Null texts are empty, texts below ``LENGTH`` bytes stay whole, null ids count as the smallest. Texts of one id
    are ordered by a hash; rows that repeat id and text are one document and give a row each. No rows give none.
    """
    prepare(docs.sparkSession)
    docs = _document(docs, id_col, text_col)
    shards = max(2, partitions(docs.sparkSession))
    marks = marked_strings(sent_pieces(docs, repeated_anchors(docs)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tie, low, high = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            key = _key(doc, tie)
            yield from batches_of({"shard": shard_of(key, shards), "key": long_view(key), "low": low, "high": high})

    def build(_: int, got: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        key, low, high = _merged(unsigned(got["key"]), got["low"], got["high"])
        begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
        return {"key": key[begins], "first": begins, "size": np.diff(np.append(begins, len(key))), "low": low, "high": high}

    kinds = {"key": "<u8", "first": "<i8", "size": "<i8", "low": "<i8", "high": "<i8"}
    spans = publish(marks.mapInArrow(deal, "shard long, key long, low long, high long"), "removed-spans", kinds, shards, build)[0]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _key(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tie")))
            keys, back = np.unique(key, return_inverse=True)
            at = spans.find(keys)
            shard = np.searchsorted(spans.offsets, at, "right") - 1
            rows = []
            for text, i in zip(batch.column("text").to_pylist(), back.tolist()):
                data, removed, parts, done, n = text.encode(), 0, [], 0, 0
                if at[i] >= 0:
                    s = int(shard[i])
                    first, n = (int(spans.column(c, s)[at[i] - spans.offsets[s]]) for c in ("first", "size"))
                    for low, high in zip(spans.column("low", s)[first:first + n].tolist(), spans.column("high", s)[first:first + n].tolist()):
                        parts.append(data[done:low])
                        removed += high - low
                        done = high
                kept = b"".join([*parts, data[done:]])
                rows.append((len(data), removed, n, hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("given"), *(pa.array(c) for c in zip(*rows))], names)

    names = ["given", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])]
    done = docs.mapInArrow(cut, "given long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
    return done.withColumnRenamed("given", id_col)
