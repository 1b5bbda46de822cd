"""Jaccard self-join of documents' sets of word n-grams by PartEnum signatures.

Sets are banded by size so that a set and a similar one are in the same band or in neighbouring ones; each set takes part in the
joins of its band and of the next. In a band's join, similar sets differ in at most ``errors`` elements. The domain of elements
is cut into parts and each part into pieces. Similar sets have a part in which few pieces differ, so enumerating the subsets of
pieces that may be left out gives a signature, of the elements in the other pieces, that both sets have.

Sets with a signature in common are compared with the first of them. Where that does not join them all, sets of different classes
are compared: first by counts of elements in buckets, whose difference is never more than that of the sets, then by the sets
themselves. Groups with many such pairs try the nearest of each class first and settle what is still apart inside the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.simhash import components, node_of, shingle_sets
from tidewatch.llm.words import mix, partitions, prepare, word_blocks
from tidewatch.session import discard, materialise

WORDS, SIMILAR = 5, 80
#: Bands with up to so many errors may have ``SMALL_COST`` signatures an error, others ``COST``; hash families tried before
#: signatures of no element are kept.
FEW_ERRORS, SMALL_COST, COST, FAMILIES = 11, 3, 1, 6
#: Smallest sketch, elements a bucket, members that are compared in one group, and pairs a member up to which a group tells them all.
BUCKETS, FILL, GROUP, FEW = 64, 2, 500, 4
#: Links told to Python memory of a task before equal ones are told apart; keys that may be broadcast (16 bytes each).
TOLD, SENT = 200_000, 1_000_000
#: Signatures that a task gathers before it sends them on, and those of one bucket, about; bits of a signature besides its bucket.
GATHERED, TOGETHER, BITS = 2_000_000, 2_000_000, 48
_U = np.uint64


class Scheme(NamedTuple):
    """Parts of the domain, pieces of a part, pieces that may differ, and parts that may have a signature of no element."""

    parts: int
    pieces: int
    left_out: int
    spare: int


@cache
def bands(similar: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """First size of each band up to that of ``largest`` and the one after, and the most elements in which similar sets differ
    if neither is larger than the band's last size."""
    starts, last = [1], []
    while len(starts) < 3 or starts[-3] <= largest:
        last.append(starts[-1] * 100 // similar)
        starts.append(last[-1] + 1)
    return np.array(starts[:-1]), np.array([2 * r * (100 - similar) // (100 + similar) for r in last])


@cache
def scheme(errors: int) -> Scheme:
    """The scheme with most elements in a signature, among those within the cost."""
    best, cost = None, SMALL_COST if errors <= FEW_ERRORS else COST
    for left_out in range(min(errors, 1), min(errors, 4) + 1):
        parts = -(-(errors + 1) // (left_out + 1))
        for pieces in range(left_out + 1, left_out + 5):
            share = (pieces - left_out) / (pieces * parts)
            if parts * comb(pieces, left_out) <= cost * (errors + 1) + left_out and (best is None or share > best[0]):
                best = share, Scheme(parts, pieces, left_out, 0)
    chosen = best[1]
    spare = -(-chosen.parts * 9 // 100) if chosen.parts > 5 else 0
    return chosen._replace(parts=chosen.parts + spare, spare=spare)


def signatures(row: np.ndarray, elements: np.ndarray, rows: int, similar: int = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """Row and signature, for sets given as the sorted rows of their elements.

    A part in which at most ``left_out`` pieces differ gives two sets an equal signature. There are ``spare`` more such parts than one,
    so a set with no more than ``spare`` parts with a signature of no element can do without these. Where signatures are of
    single pieces, more pieces with an element than errors do. A set with fewer also has signatures by other hashes of the
    elements, and in the end by no element.
    """
    size = np.bincount(row, minlength=rows)
    starts, errors = bands(similar, int(size.max(initial=1)))
    band = np.searchsorted(starts, size, "right") - 1
    out_row, out = [], []
    for step in (0, 1):
        left = size > 0
        for family in range(FAMILIES):
            if not left.any():
                break
            again = np.zeros(rows, bool)
            for b in np.unique(band[left] + step).tolist():
                plan = scheme(int(errors[b]))
                mine = np.flatnonzero(left & (band + step == b))
                number = np.full(rows, -1)
                number[mine] = np.arange(len(mine))
                held = np.flatnonzero(number[row] >= 0)
                h = mix(elements[held] ^ _U(family * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1))
                cells = plan.parts * plan.pieces
                cell = number[row[held]] * cells + (((h >> _U(32)) * _U(cells)) >> _U(32)).astype(np.int64)
                total, count = np.zeros(len(mine) * cells, _U), np.bincount(cell, minlength=len(mine) * cells)
                np.add.at(total, cell, mix(h + _U(family)))
                total, count = total.reshape(-1, plan.parts, plan.pieces), count.reshape(-1, plan.parts, plan.pieces)
                empty = np.zeros((len(mine), plan.parts), bool)
                found = []
                for i, subset in enumerate(combinations(range(plan.pieces), plan.pieces - plan.left_out)):
                    none = count[:, :, subset].sum(2) == 0
                    place = ((_U(b) * _U(FAMILIES) + _U(family)) * _U(plan.parts) + np.arange(plan.parts, dtype=_U)) * _U(1000) + _U(i)
                    found.append((none, mix(total[:, :, subset].sum(2, dtype=_U) + mix(place + _U(1)))))
                    empty |= none
                fails = empty.sum(1) > plan.spare if plan.pieces - plan.left_out > 1 else (count > 0).sum((1, 2)) <= int(errors[b])
                again[mine[fails]] = True
                last = fails[:, None] & (family == FAMILIES - 1)
                for none, signature in found:
                    who, part = np.nonzero(~none | last)
                    out_row.append(mine[who])
                    out.append(signature[who, part])
            left = again
    return (np.concatenate(out_row), np.concatenate(out)) if out else (np.empty(0, np.int64), np.empty(0, _U))


def sketch(elements: np.ndarray) -> bytes:
    """Elements in each bucket, 15 for more, two buckets a byte; the number of buckets is a power of two and grows with the set."""
    buckets = max(BUCKETS, 1 << max(0, len(elements) // FILL - 1).bit_length())
    counts = np.minimum(np.bincount((mix(elements) & _U(buckets - 1)).astype(np.int64), minlength=buckets), 15).astype(np.uint8)
    return (counts[:buckets // 2] | counts[buckets // 2:] << 4).tobytes()


def folded(sketch_: bytes, buckets: int) -> np.ndarray:
    """A sketch in fewer buckets."""
    two = np.frombuffer(sketch_, np.uint8)
    return np.concatenate((two & 15, two >> 4)).reshape(-1, buckets).sum(0, dtype=np.int32)


def _marks(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """``id, size, node, sketch`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, sketches = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
            for block in word_blocks(batch.column("text")):
                row, elements = shingle_sets(block, words)
                edges = np.searchsorted(row, np.arange(block.rows + 1))
                sizes.append(np.diff(edges))
                nodes.append(node_of(row, elements, block.rows))
                sketches += [sketch(elements[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(nodes)), pa.array(sketches, pa.binary())],
                                             ["id", "size", "node", "sketch"])

    return docs.mapInArrow(run, "id long, size long, node long, sketch binary")


def _new_nodes(node: np.ndarray, seen: dict[int, None], most: int = 100_000) -> np.ndarray:
    """Which nodes a task has not met lately, so that copies are sent on once a task."""
    new = np.zeros(len(node), bool)
    for i, n in enumerate(node.tolist()):
        if n and n not in seen:
            new[i] = True
            seen[n] = None
            if len(seen) > most:
                del seen[next(iter(seen))]
    return new


def _packed(signature: np.ndarray, node: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket of signatures: the nodes (8 bytes), how many signatures each has there (2 bytes), and these (6 bytes)."""
    bucket = (((signature >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")  # rows of a node stay together
    bucket, node = bucket[order], node[order]
    low = (signature[order] & _U((1 << BITS) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BITS // 8]
    new = np.append(True, (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1]))[:len(node)]
    new[::60_000] = True  # a count has 2 bytes
    runs = np.flatnonzero(new)
    counts, nodes = np.diff(np.append(runs, len(node))).astype("<u2"), node[runs]
    begins = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[:len(bucket)])
    edges, places = np.append(begins, len(bucket)).tolist(), np.searchsorted(runs, np.append(begins, len(bucket))).tolist()
    return pa.RecordBatch.from_arrays([pa.array(bucket[begins]), pa.array([nodes[a:b].tobytes() for a, b in zip(places, places[1:])], pa.binary()),
                                       pa.array([counts[a:b].tobytes() for a, b in zip(places, places[1:])], pa.binary()),
                                       pa.array([low[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())], ["bucket", "nodes", "counts", "low"])


def _told(bucket: int, signature: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """``signature, node, first, several`` of the signatures of a bucket that more than one node has."""
    order = np.argsort(signature)
    key = signature[order]
    same = key[1:] == key[:-1]
    held = order[np.append(same, False)[:len(key)] | np.append(False, same)[:len(key)]]
    key, node = signature[held], node[held]
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))[:len(key)]  # else a copy told by another task
    key, node = key[new], node[new]
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    count = np.diff(np.append(begins, len(key)))
    first, size = np.repeat(node[begins], count), np.repeat(count, count)
    keep = (size > 2) | (node != first)
    named = key[keep] | np.uint64(bucket << BITS & (1 << 64) - 1)
    return pa.RecordBatch.from_arrays([pa.array(named.view(np.int64)), pa.array(node[keep]), pa.array(first[keep]), pa.array(size[keep] > 2)],
                                      ["signature", "node", "first", "several"])


def _shared(docs: DataFrame, text_col: str, words: int, similar: int, elements_: int) -> DataFrame:
    """``signature, node, first, several``: sets whose signature others have too, the first of these, and whether they are more than
    two. Of two there is a row of the other, of more one of each.

    Signatures are sent as a row for each bucket of them and some thousands of texts, which names a set once for all its
    signatures there. ``elements_``, those of all sets (there are about 0.6 signatures for one), say how many buckets there are.
    """
    buckets = min(1 << 64 - BITS, max(partitions(docs.sparkSession), -(-elements_ // TOGETHER)))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, None] = {}
        parts, n = [], 0
        for batch in batches:
            for block in word_blocks(batch.column("text")):
                row, elements = shingle_sets(block, words)
                node = node_of(row, elements, block.rows)
                keep = _new_nodes(node, seen)[row]
                who, signature = signatures(row[keep], elements[keep], block.rows, similar)
                order = np.argsort(who, kind="stable")
                parts.append((signature[order], node[who[order]]))
                n += len(who)
                if n >= GATHERED:
                    yield _packed(*map(np.concatenate, zip(*parts)), buckets)
                    parts, n = [], 0
        if n:
            yield _packed(*map(np.concatenate, zip(*parts)), buckets)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:  # sorted by bucket
            for bucket, nodes, counts, low in zip(*(batch.column(c).to_pylist() for c in ("bucket", "nodes", "counts", "low"))):
                if bucket != at:
                    if parts:
                        yield _told(at, *map(np.concatenate, zip(*parts)))
                    at, parts = bucket, []
                wide = np.zeros((len(low) * 8 // BITS, 8), np.uint8)
                wide[:, :BITS // 8] = np.frombuffer(low, np.uint8).reshape(-1, BITS // 8)
                parts.append((wide.view("<u8").ravel(), np.repeat(np.frombuffer(nodes, np.int64), np.frombuffer(counts, "<u2"))))
        if parts:
            yield _told(at, *map(np.concatenate, zip(*parts)))

    return (docs.select("text").mapInArrow(made, "bucket long, nodes binary, counts binary, low binary").repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(told, "signature long, node long, first long, several boolean"))


def similar_sizes(a: Column, b: Column, similar: int) -> Column:
    return similar * F.greatest(a, b) <= 100 * F.least(a, b)


def within(a: bytes, b: bytes, most: int) -> bool:
    """Whether sketches allow sets that differ in at most ``most`` elements."""
    buckets = 2 * min(len(a), len(b))
    return int(np.abs(folded(a, buckets) - folded(b, buckets)).sum()) <= most


def _likely(pairs: DataFrame, nodes: DataFrame, similar: int) -> DataFrame:
    """The pairs ``a, b`` of sets that sizes and sketches do not tell apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (batch.column("na").to_numpy() + batch.column("nb").to_numpy()) * (100 - similar) // (100 + similar)
            keep = [within(a, b, m) for a, b, m in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), most.tolist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (nodes.select(F.col("node").alias(x), F.col("size").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in ("a", "b"))
    both = pairs.join(one.drop("sa"), "a").join(two.drop("sb"), "b").filter(similar_sizes(F.col("na"), F.col("nb"), similar)).select("a", "b")
    return both.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def _with_sets(errands: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """``errands`` (a table with ``node``) with the ``elements`` of the node's set; copies of a text are read once a task."""
    fields = [c for c in errands.columns if c != "node"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, None] = {}
        for batch in batches:
            for block in word_blocks(batch.column("text")):
                row, elements = shingle_sets(block, words)
                node = node_of(row, elements, block.rows)
                new = _new_nodes(node, seen)
                edges = np.searchsorted(row, np.arange(block.rows + 1))
                yield pa.RecordBatch.from_arrays([pa.array(node[new]), pa.array([elements[edges[i]:edges[i + 1]].tobytes() for i in np.flatnonzero(new).tolist()], pa.binary())],
                                                 ["node", "elements"])

    sets = docs.select("text").mapInArrow(made, "node long, elements binary")
    if errands.count() > SENT:
        return sets.join(errands, "node").select("node", *fields, "elements")
    needed = errands.groupBy("node").agg(F.collect_list(F.struct(*fields)).alias("errands"))
    return sets.join(F.broadcast(needed), "node").select("node", F.explode("errands").alias("errand"), "elements").select("node", "errand.*", "elements")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, similar: int) -> DataFrame:
    """The pairs ``a, b`` whose sets have the similarity. Sets are sent to groups of a set ``b`` and at most about ``GROUP`` sets ``a``."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    split = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"))
    group = F.xxhash64("b", "part").alias("group")
    members = split.select(F.col("a").alias("node"), group, F.lit(1).alias("kind"))
    leads = parts.select(F.col("b").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "b")
    errands = materialise(members.unionByName(leads.select("node", group, F.lit(0).alias("kind"))), "errands")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lead, lead_set = None, 0, np.empty(0, _U)
        for batch in batches:
            a, b = [], []
            for node, group, kind, elements in zip(*(batch.column(c).to_pylist() for c in ("node", "group", "kind", "elements"))):
                own = np.frombuffer(elements, _U)
                if kind == 0:
                    at, lead, lead_set = group, node, own
                elif group == at and node != lead:
                    place = np.minimum(np.searchsorted(lead_set, own), len(lead_set) - 1)
                    shared = int((lead_set[place] == own).sum())
                    if (100 + similar) * shared >= similar * (len(own) + len(lead_set)):
                        a.append(node)
                        b.append(lead)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    sent = _with_sets(errands, docs, words)
    return materialise(sent.repartition("group").sortWithinPartitions("group", "kind", "node").mapInArrow(run, "a long, b long"), "linked")


class Member(NamedTuple):
    """A set of a group; of a group cut into parts, a pair of parts is compared, or one (``same``) with itself."""

    node: int
    class_: int
    part: int
    same: bool
    size: int
    held: bytes


def _compared(members: list[Member], similar: int, shared: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sorts ``members`` by size and gives, for each not in the commonest class, the places of those of other classes it may
    link with and their distances: by sketches, or exactly if ``shared`` says that whole sets are held."""
    members.sort(key=lambda m: (m.size, m.node))
    size, class_, part = (np.array([getattr(m, f) for m in members]) for f in ("size", "class_", "part"))
    names, counts = np.unique(class_, return_counts=True)
    if len(names) < 2:
        return
    if shared:
        ids = np.unique(np.concatenate([np.frombuffer(m.held, _U) for m in members]), return_inverse=True)[1]
        ends, mark = np.append(0, np.cumsum(size)), np.zeros(len(ids), bool)
    else:
        buckets = 2 * min(len(m.held) for m in members)
        held = np.stack([folded(m.held, buckets) for m in members])
    common = names[counts.argmax()]
    for i in np.flatnonzero(class_ != common).tolist():
        low = int(np.searchsorted(size, -(-similar * size[i] // 100)))
        high = int(np.searchsorted(size, size[i] * 100 // similar, "right"))
        j = np.arange(low, high)
        if shared:
            own = ids[ends[i]:ends[i + 1]]
            mark[own] = True
            away = size[i] + size[low:high] - 2 * np.add.reduceat(mark[ids[ends[low]:ends[high]]], ends[low:high] - ends[low], dtype=np.int64)
            mark[own] = False
        else:
            away = np.abs(held[low:high] - held[i]).sum(1)
        near = (class_[j] != class_[i]) & ((class_[j] == common) | (j > i)) & (members[i].same | (part[j] != part[i]))
        near &= (100 + similar) * away <= (100 - similar) * (size[i] + size[j])
        yield i, j[near], away[near]


def _pairs(members: list[Member], similar: int) -> tuple[list[tuple[int, int]], set[int], dict[int, tuple[int, int, int]]]:
    """Pairs of different classes that sketches allow, as long as they are few; who is in one; and the nearest of each class but the commonest."""
    pairs: list[tuple[int, int]] = []
    there: set[int] = set()
    best: dict[int, tuple[int, int, int]] = {}
    n = 0
    for i, others, away in _compared(members, similar, False):
        n += len(others)
        there.update([i, *others.tolist()] if len(others) else [])
        for k, d in zip(others.tolist(), away.tolist()):
            a, b = members[i], members[k]
            pair = max(a.node, b.node), min(a.node, b.node)
            if n <= FEW * len(members):
                pairs.append(pair)
            for c in (a.class_, b.class_):
                best[c] = min(best.get(c, (d, *pair)), (d, *pair))
    return pairs if n <= FEW * len(members) else [], there, best


def _linked(members: list[Member], similar: int) -> set[tuple[int, int]]:
    """Links that join the classes of the members as all their similar pairs do."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = set()
    for i, others, _ in _compared(members, similar, True):
        for k in others.tolist():
            x, y = top(members[i].class_), top(members[k].class_)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.add((members[i].node, members[k].node))
    return out


def _grouped(batches: Iterator[pa.RecordBatch], held: str) -> Iterator[tuple[int, list[Member]]]:
    at, members = None, []
    for batch in batches:  # sorted by group and node
        for group, *cells in zip(*(batch.column(c).to_pylist() for c in ("group", "node", "class", "part", "same", "size", held))):
            if group != at:
                if members:
                    yield at, members
                at, members = group, []
            if not members or members[-1].node != cells[0]:  # else another task has read it too
                members.append(Member(*cells))
    if members:
        yield at, members


def _some(rows: DataFrame) -> DataFrame:
    return materialise(rows.filter("b != 0").select("a", "b").distinct(), "likely")


def _dealt(shared: DataFrame, roots: DataFrame, nodes: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Members of the groups whose sets are of several classes. Groups of the same sets are one; a group is cut into parts of about
    ``GROUP`` sets, and two parts each are dealt to be compared."""
    rows = materialise(shared.filter("several").join(roots.withColumnRenamed("root", "class"), "node", "left").select("signature", "node", F.coalesce("class", "node").alias("class")), "classed")
    groups = (rows.groupBy("signature").agg(F.count("*").alias("n"), F.min("class").alias("c0"), F.max("class").alias("c1"), F.sum(F.hash("node").cast("long")).alias("h0"),
                                            F.bit_xor(F.xxhash64("node")).alias("h1")).filter("c0 != c1"))  # of two sets the first and the other were compared
    groups = groups.groupBy("n", "h0", "h1").agg(F.min("signature").alias("signature")).select("signature", F.ceil(F.col("n") / GROUP).alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: F.struct(F.least(p, part).alias("low"), F.greatest(p, part).alias("high")))
    dealt = (rows.join(groups, "signature").withColumn("part", part).select("signature", "node", "class", "part", F.explode(pairs).alias("pair"))
             .select("node", "class", "part", F.xxhash64("signature", "pair.low", "pair.high").alias("group"), (F.col("pair.low") == F.col("pair.high")).alias("same")))
    if only is not None:
        dealt = dealt.join(only, "group", "left_semi")
    return dealt.join(nodes.select("node", "size", "sketch"), "node").repartition("group").sortWithinPartitions("group", "node")


def _first_pairs(dealt: DataFrame, similar: int) -> DataFrame:
    """``a, b``: pairs to verify. Groups with few give all; others the nearest pair of each class, and a row of the group and 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        for group, members in _grouped(batches, "sketch"):
            pairs, _, best = _pairs(members, similar)
            told.update(pairs if pairs or not best else [*(p[1:] for p in best.values()), (group, 0)])
            if len(told) > TOLD:
                yield _rows(told, ("a", "b"))
                told = set()
        yield _rows(told, ("a", "b"))

    return dealt.mapInArrow(run, "a long, b long")


def _unsettled(dealt: DataFrame, similar: int) -> DataFrame:
    """All pairs that are left of groups with few (``node, b``); of others the members that are in one, with 0 as ``b``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = set()
        for group, members in _grouped(batches, "sketch"):
            pairs, there, _ = _pairs(members, similar)
            out.update((a, b, 0, 0, 0, False, 0) for a, b in pairs)
            if not pairs:
                out.update((m.node, 0, group, m.class_, m.part, m.same, m.size) for m in (members[i] for i in there))
            if len(out) > TOLD:
                yield _rows(out, names)
                out = set()
        yield _rows(out, names)

    names = ("node", "b", "group", "class", "part", "same", "size")
    return dealt.mapInArrow(run, "node long, b long, group long, class long, part long, same boolean, size long")


def _settled(unsettled: DataFrame, docs: DataFrame, words: int, similar: int) -> DataFrame:
    """Links between classes of a group, from the whole sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, members in _grouped(batches, "elements"):
            yield _rows(_linked(members, similar), ("a", "b"))

    sent = _with_sets(unsettled, docs, words)
    return materialise(sent.repartition("group").sortWithinPartitions("group", "node").mapInArrow(run, "a long, b long"), "linked")


def _rows(rows: set[tuple] | list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    cells = list(zip(*sorted(rows))) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if n == "same" else pa.int64()) for n, c in zip(names, cells)], list(names))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of sets of different classes."""
    for c in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    return pairs.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def classes(docs: DataFrame, nodes: DataFrame, words: int = WORDS, similar: int = SIMILAR, known: DataFrame | None = None) -> DataFrame:
    """``node, root`` of every set that links with another: the smallest node it can reach.

    ``docs`` has the ``text`` of every set, copies may repeat; ``nodes`` has ``node, size, sketch`` of each set but the empty one.
    ``known`` are verified links ``a, b``; sets that these join are not compared again.
    """
    elements = nodes.agg(F.sum("size")).first()[0] or 0
    shared = materialise(_shared(docs, "text", words, similar, elements), "shared")
    pairs = shared.filter("node != first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    if known is not None:
        roots = components(known)
        pairs = _apart(pairs, roots)
    likely = materialise(_likely(pairs, nodes, similar), "likely")
    if known is None:
        links = _verified(likely, docs, words, similar)
        roots = components(links)
    elif likely.isEmpty():
        links = known
    else:
        links = known.unionByName(_verified(likely, docs, words, similar))
        roots = components(links)
    tried = materialise(_first_pairs(_dealt(shared, roots, nodes), similar), "tried")
    if not tried.isEmpty():
        links = links.unionByName(_verified(_some(tried), docs, words, similar))
        roots = components(links)
        many = tried.filter("b = 0").select(F.col("a").alias("group"))
        if not many.isEmpty():
            left = materialise(_unsettled(_dealt(shared, roots, nodes, many), similar), "unsettled")
            pairs, dense = _some(left.withColumnRenamed("node", "a")), left.filter("b = 0").drop("b")
            if not pairs.isEmpty():
                links = links.unionByName(_verified(pairs, docs, words, similar))
            if not dense.isEmpty():
                links = links.unionByName(_settled(dense, docs, words, similar))
            roots = components(links)
    discard(shared)
    return roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """``id, n_shingles, component_id`` of every row.

    A text's set holds its different runs of ``words`` words, lower-cased; a text of fewer words is one run, null or no words none.
    Sets link if 100 times their intersection is at least ``similar`` times their union; ``component_id`` is the smallest id
    reachable by links, itself included. Empty sets link with nothing, so each has its own id. Equal texts are one set with
    several ids; null ids are never the smallest, and a class of null ids alone has a null component. Repeated rows give a row
    each, no rows give none, other columns are ignored. Ids are whole numbers.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marks = materialise(_marks(docs, "text", words), "marks")
    nodes = materialise(marks.filter("node != 0").groupBy("node").agg(F.min("id").alias("id"), F.first("size").alias("size"), F.first("sketch").alias("sketch")), "nodes")
    roots = classes(docs, nodes, words, similar)
    rooted = nodes.select("node", "id").join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("node", "component_id")
    known = marks.filter("node != 0").select("id", "size", "node").join(named, "node").select("id", "size", "component_id")
    return (known.unionByName(marks.filter("node = 0").select("id", "size", F.col("id").alias("component_id")))
            .select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id"))
