"""SimHash near-duplicates by a self-join of binary tries.

Two fingerprints of 64 bits that differ in at most ``ERRORS`` bits agree in one of ``ERRORS + 1`` parts. For each part
in turn the fingerprints are grouped by it, and each group is a trie over the other bits. Pairs of its nodes are
traversed together from the root, the differing bits are added up, and a pair is dropped as soon as they exceed the
budget. Links within a group are joined at once, so a group gives one row for each linked fingerprint whatever the
number of its pairs. Groups too large for one task are cut into pairs of subtrees that the budget allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.words import Block, mix, prepare, word_blocks, word_hashes
from tidewatch.session import materialise

ERRORS, WORDS, SEED = 3, 3, 42
#: Fingerprints that one task's group may hold before it is cut, and the bits it is cut by.
GROUP_ROWS, CUT_BITS = 100_000, 8
_FRONTIER, _SMALL = 1 << 19, 32
_U = np.uint64


def fingerprint(text: str, words: int = WORDS, length: int = 1) -> list[int]:
    """``length`` numbers of 64 bits; a bit is set if it is set in more than half of the shingles' hashes.

    The first number is of the shingles' XXH64 (seed 42), later ones of hashes made from it. Without words: zeros.
    """
    tokens = text.encode().lower().split()
    if not tokens:
        return [0] * length
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        starts = np.concatenate(([0], ends[:-words])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1:] - 1).tolist())]
    bits = np.zeros(64 * length, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[at:at + (1 << 14)], "<u8")
        for i in range(length):
            bits[64 * i:64 * i + 64] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            part = mix(part + _U(i + 1))
    return np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8").tolist()


def _marks(column: pa.Array, words: int, length: int) -> list[pa.Array]:
    marks = np.array([fingerprint(t or "", words, length) for t in column.to_pylist()], _U).reshape(-1, length)
    return [pa.array(np.ascontiguousarray(m).view(np.int64)) for m in marks.T]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``id, fingerprint`` (as a signed long) of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), *_marks(batch.column("text"), words, 1)], ["id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fingerprint long")


def trie_pairs(keys: np.ndarray, roots: list[tuple[int, int, int, int]], bits: int, errors: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted ``keys`` whose low ``bits`` differ in at most ``errors``, from pairs of trie nodes (each once).

    A node is a range of the sorted keys. ``roots`` are pairs of ranges, each range with equal bits above ``bits``; a
    range paired with itself gives each pair once. Pairs of small nodes are compared outright.
    """
    ones: dict[int, np.ndarray] = {}

    def middles(lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((keys >> _U(bit)) & _U(1))), dtype=np.int32, casting="unsafe")
        return hi - (ones[bit][hi] - ones[bit][lo])

    start = np.array(roots, np.int64).reshape(-1, 4)
    stack = [(bits - 1, *start[i:i + _FRONTIER].T, np.zeros(len(start[i:i + _FRONTIER]), np.int8)) for i in range(0, len(start), _FRONTIER)]
    while stack:
        bit, a, b, c, d, spent = stack.pop()
        small = ((b - a) * (d - c) <= _SMALL) | (bit < 0)
        if small.any():
            sa, sb, sc, sd = a[small], b[small], c[small], d[small]
            sizes = (sb - sa) * (sd - sc)
            for part in _runs(sizes, _FRONTIER):
                n = sizes[part]
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                width = np.repeat((sd - sc)[part], n)
                x, y = np.repeat(sa[part], n) + k // width, np.repeat(sc[part], n) + k % width
                near = (x < y) & (np.bitwise_count((keys[x] ^ keys[y]) & _U((1 << bits) - 1)) <= errors)
                if near.any():
                    yield x[near], y[near]
            a, b, c, d, spent = (v[~small] for v in (a, b, c, d, spent))
        if not len(a):
            continue
        m, n = middles(a, b, bit), middles(c, d, bit)
        same = (a == c) & (b == d)
        other = ~same
        children = [np.concatenate(v) for v in zip(
            (a, m, c, n, spent), (m, b, n, d, spent), (a, m, n, d, spent + 1),
            tuple(v[other] for v in (m, b, c, n, spent + 1)))]
        keep = (children[0] < children[1]) & (children[2] < children[3]) & (children[4] <= errors)
        children = [v[keep] for v in children]
        stack += [(bit - 1, *(v[i:i + _FRONTIER] for v in children)) for i in range(0, len(children[0]), _FRONTIER)]


def _runs(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices whose sizes add up to about ``limit``."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield slice(at, last)
        at = last


class Classes:
    """Union of pairs of indices with the smallest index as root, arrays at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            a, b = self.root[x], self.root[y]
            apart = a != b
            if not apart.any():
                return
            x, y = x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while True:
                above = self.root[self.root]
                if np.array_equal(above, self.root):
                    break
                self.root = above


def _group_links(keys: np.ndarray, groups: np.ndarray, left: np.ndarray, marks: np.ndarray, bits: int, errors: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a task's groups as rows: (fingerprint, first one it is joined with). ``left``: subtree of a cut group's
    pair that a key belongs to; keys of a whole group are all in subtree 0."""
    order = np.lexsort((keys, left, groups))
    keys, groups, left, marks = keys[order], groups[order], left[order], marks[:, order]
    new = np.append(True, (groups[1:] != groups[:-1]) | (left[1:] != left[:-1]))
    begins = np.flatnonzero(new[:len(keys)])
    ends = np.append(begins[1:], len(keys))
    roots = [(a, b, a, b) for a, b in zip(begins.tolist(), ends.tolist()) if b - a > 1 and left[a] == 0]
    roots += [(a, b, c, d) for a, b, c, d in zip(begins[:-1].tolist(), ends[:-1].tolist(), begins[1:].tolist(), ends[1:].tolist())
              if groups[a] == groups[c] and left[c] == 2]
    found = Classes(len(keys))
    for x, y in trie_pairs(keys, roots, bits, errors):
        near = sum(np.bitwise_count(m[x] ^ m[y]).astype(np.int16) for m in marks) <= limit
        found.join(x[near], y[near])
    linked = np.flatnonzero(found.root != np.arange(len(keys)))
    return order[linked], order[found.root[linked]]


def _turned(mark: Column, shift: int, width: int, by: int) -> Column:
    """``width`` bits of a fingerprint from bit ``shift`` on, turned left by ``by``, in the low bits of a long."""
    ones = F.lit((1 << width) - 1 if width < 64 else -1)
    part = F.shiftrightunsigned(mark, shift).bitwiseAND(ones) if width < 64 else mark
    return F.shiftleft(part, by).bitwiseOR(F.shiftrightunsigned(part, width - by)).bitwiseAND(ones) if by else part


def links(marks: DataFrame, columns: tuple[str, ...] = ("fingerprint",), width: int = 64, errors: int = ERRORS, limit: int = ERRORS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``a, b``: links of nodes that join the same ones as all pairs do which the tries find.

    ``marks`` has different ``node`` numbers and their fingerprints. They are cut into slices of ``width`` bits; a pair is found
    if a slice differs in at most ``errors`` bits, and linked if the whole fingerprints differ in at most ``limit``. With one
    slice of 64 bits and ``limit = errors`` these are all pairs within the limit. Each trie gives one row at most
    per node, a group that is cut one for each subtree pair of the node.
    """
    parts = errors + 1
    if 64 % width or width % parts:
        raise ValueError("width has to divide 64, and errors + 1 the width")
    head_bits, slices = width // parts, [(c, s) for c in columns for s in range(0, 64, width)]
    keys = F.array(*(_turned(F.col(c), s, width, i * head_bits) for c, s in slices for i in range(parts)))
    rows = marks.select("node", *columns, F.posexplode(keys).alias("part", "key")).withColumn("head", F.shiftrightunsigned("key", width - head_bits))
    sizes = rows.groupBy("part", "head").count().filter(F.col("count") > group_rows).select("part", "head", F.lit(True).alias("large"))
    cut = min(CUT_BITS, width - head_bits)
    masks = F.array(*(F.lit(m) for m in range(1 << cut) if bin(m).count("1") <= errors))
    sub = F.shiftrightunsigned(F.col("key"), width - head_bits - cut).bitwiseAND(F.lit((1 << cut) - 1)).cast("int")
    pair = F.explode(F.when(F.col("large"), masks).otherwise(F.array(F.lit(-1)))).alias("mask")
    rows = (rows.join(sizes, ["part", "head"], "left").select("node", *columns, "part", "head", "key", sub.alias("sub"), pair)
            .withColumn("low", F.when(F.col("mask") < 0, -1).otherwise(F.least(F.col("sub"), F.col("sub").bitwiseXOR(F.col("mask")))))
            .withColumn("left", F.when(F.col("mask") <= 0, 0).when(F.col("low") == F.col("sub"), 1).otherwise(2))
            .withColumn("group", F.xxhash64("part", "head", "low", "mask")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)  # the groups of one task
        if not batches:
            return
        got = pa.Table.from_batches(batches)
        key, group, left, node = (got.column(c).to_numpy() for c in ("key", "group", "left", "node"))
        fingers = np.stack([got.column(c).to_numpy().view(_U) for c in columns])
        x, y = _group_links(key.view(_U), group, left, fingers, width - head_bits, errors, limit)
        yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], ["a", "b"])

    return rows.select("node", *columns, "key", "group", "left").repartition("group").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each node of the links ``a, b`` can reach.

    In each round every node is mapped to a smaller neighbour, or on along these, and links are drawn anew between what
    their ends are mapped to. Links inside of what has become one go, so rounds soon are small; the smallest node of a
    class is never mapped. Each round's tables lie in the shared folder.
    """
    low, high = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    links_ = materialise(edges.select(low, high).filter("low != high").distinct(), "links")
    roots = materialise(links_.select(F.explode(F.array("low", "high")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    while not links_.isEmpty():
        step = links_.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("to"))
        for _ in range(2):
            step = materialise(step, "step")
            further = step.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
            step = step.join(further, "to", "left").select("node", F.coalesce("beyond", "to").alias("to"))
        step = materialise(step, "step")

        def mapped(df: DataFrame, name: str, step=step) -> DataFrame:
            return df.join(step.withColumnRenamed("node", name), name, "left").withColumn(name, F.coalesce("to", name)).drop("to")

        roots = materialise(mapped(roots, "root"), "roots")
        both = mapped(mapped(links_, "low"), "high").select(F.col("low").alias("a"), F.col("high").alias("b"))
        links_ = materialise(both.select(low, high).filter("low != high").distinct(), "links")
    return roots.select("node", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, errors: int = ERRORS) -> DataFrame:
    """``id, fingerprint, component_id`` of every document.

    ``component_id`` is the smallest id reachable over links of at most ``errors`` differing bits, itself included.
    Null and empty texts have fingerprint zero and link like any other; null ids are never the smallest, so a class of
    null ids alone has a null component. Repeated rows give a row each, no rows give none, other columns are ignored.
    """
    prepare(docs.sparkSession)
    marks = materialise(fingerprints(docs, id_col, text_col, words), "simhash")
    classes = marks.groupBy("fingerprint").agg(F.min("id").alias("first"))
    roots = components(links(classes.select(F.col("fingerprint").alias("node"), "fingerprint"), errors=errors, limit=errors))
    classes = classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    classes = classes.withColumn("root", F.coalesce("root", "fingerprint"))
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(smallest, "root").select("fingerprint", "component_id")
    return (marks.join(named, "fingerprint")
            .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"))


#: Near-duplicates share so much of their shingles of so many words. First candidates have one of ``BANDS`` keys in common, each of
#: ``BAND_ROWS`` minimal hashes; of pairs at the limit one in 150,000 has none (fewer above it) and is left to the exact join of
#: ``jaccard``. Texts verified by one task.
SHINGLE, SIMILAR, BANDS, BAND_ROWS, CHUNK = 5, 0.8, 30, 5, 1000


def shingle_sets(block: Block, words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the different shingles of each text, sorted; a text of fewer words is one shingle, without words none."""
    hashes, row = word_hashes(block), block.row
    out = mix(hashes[:max(len(hashes) - words + 1, 0)])
    for i in range(1, words):
        out = mix(out + hashes[i:i + len(out)])
    whole = np.flatnonzero(row[:len(out)] == row[words - 1:words - 1 + len(out)])
    first = np.searchsorted(row, np.arange(block.rows + 1))
    few, rest = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < words)), []
    for a, b in zip(first[few].tolist(), first[few + 1].tolist()):
        h = mix(hashes[a:a + 1])
        for i in range(a + 1, b):
            h = mix(h + hashes[i:i + 1])
        rest.append(mix(h + _U(b - a)))
    row, out = np.concatenate((row[whole], few)), np.concatenate((out[whole], *rest))
    order = np.lexsort((out, row))
    row, out = row[order], out[order]
    new = np.append(True, (row[1:] != row[:-1]) | (out[1:] != out[:-1]))[:len(row)]
    return row[new], out[new]


def node_of(row: np.ndarray, elements: np.ndarray, rows: int) -> np.ndarray:
    """A number of each set, 0 for the empty one; of 64 bits, so different sets have different ones as surely as different n-grams."""
    node = np.zeros(rows, _U)
    if len(row):
        begins = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        node[row[begins]] = mix(np.add.reduceat(mix(elements ^ _U(7)), begins) + _U(3)) | _U(1)
    return node.view(np.int64)


def _band_keys(row: np.ndarray, shingles: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """``node_of`` each text's set of shingles, and its band keys; zeros without shingles."""
    node, keys = node_of(row, shingles, rows), np.zeros((rows, BANDS), _U)
    if len(row):
        begins = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        held = row[begins]
        seeds = np.random.default_rng(SEED).integers(0, 1 << 64, (BANDS, BAND_ROWS, 2), _U)
        for band in range(BANDS):
            key = np.full(len(held), band, _U)
            for flip, factor in seeds[band]:
                key = mix(key + np.minimum.reduceat((shingles ^ flip) * (factor | _U(1)), begins))
            keys[held, band] = key
    return node, keys


def _candidates(nodes: DataFrame) -> DataFrame:
    """``a, b``: links that join all nodes with a band key in common; one at most for each node and key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)  # the keys of one task
        if not batches:
            return
        got = pa.Table.from_batches(batches)
        node, key = got.column("node").to_numpy(), got.column("key").to_numpy()
        order = np.lexsort((node, key))
        node, key = node[order], key[order]
        begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        first = np.repeat(node[begins], np.diff(np.append(begins, len(key))))
        pairs = np.unique(np.stack((node, first))[:, node != first], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return nodes.select("node", F.explode("keys").alias("key")).repartition("key").mapInArrow(run, "a long, b long")


def similar_classes(sets: list[np.ndarray], similar: float = SIMILAR) -> np.ndarray:
    """First of the class of each set; sets link from a Jaccard similarity of ``similar`` on, all pairs are compared."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size, found = size[order], Classes(len(sets))
    ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    ends = np.append(0, np.cumsum(size))
    mark = np.zeros(len(ids) + 1, bool)
    for i in range(1, len(sets)):
        low = int(np.searchsorted(size[:i], similar * size[i] - 1e-9))
        if low < i:
            own = ids[ends[i]:ends[i + 1]]
            mark[own] = True
            shared = np.add.reduceat(mark[ids[ends[low]:ends[i]]], ends[low:i] - ends[low], dtype=np.int64)
            mark[own] = False
            near = low + np.flatnonzero(shared >= similar * (size[i] + size[low:i] - shared) - 1e-9)
            found.join(near, np.full(len(near), i))
    out = np.empty(len(sets), np.int64)
    out[order] = order[found.root]
    return out


def _verified(texts: DataFrame, words: int) -> DataFrame:
    """``a, b``: links of the similar texts (``node, root, text``) of each candidate class. Classes of more than ``CHUNK`` texts
    are cut into parts, and each pair of parts is a task's group."""
    sizes = texts.groupBy("root").count().filter(F.col("count") > CHUNK).select("root", F.ceil(F.col("count") / CHUNK).alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    pairs = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: F.struct(F.least(p, part).alias("low"), F.greatest(p, part).alias("high"))))
    rows = texts.join(sizes, "root", "left").select("root", "node", "text", F.explode(pairs).alias("pair"))
    rows = rows.select("node", "text", F.xxhash64("root", "pair.low", "pair.high").alias("group"))

    def links_of(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        node = np.array(nodes, np.int64)
        root = similar_classes(sets) if sets else np.empty(0, np.int64)
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, sets = None, [], []
        for batch in batches:  # sorted by group
            for block in word_blocks(batch.column("text")):
                row, shingles = shingle_sets(block, words)
                ends = np.searchsorted(row, np.arange(block.rows + 1))
                for i in range(block.rows):
                    group = batch.column("group")[block.first + i].as_py()
                    if group != at:
                        yield links_of(nodes, sets)
                        at, nodes, sets = group, [], []
                    nodes.append(batch.column("node")[block.first + i].as_py())
                    sets.append(shingles[ends[i]:ends[i + 1]].copy())
        yield links_of(nodes, sets)

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(run, "a long, b long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, as they are, without near-duplicates: of each class the one with the smallest id stays.

    Two texts link if their sets of shingles of ``words`` words have a Jaccard similarity of at least ``SIMILAR``; classes are
    of such links only, and of all of them. Minimal hashes, not fingerprints, give the first candidates: 64 bits and a budget of
    three would miss most, and a budget for nearly all is too wide for the tries. Every candidate is verified on its words. Links
    between texts without a band key in common come from the exact join of ``jaccard``, which compares what is not joined by then.
    Null texts count as empty; a null id stays only where its class has no other; of repeated rows one stays.
    """
    from tidewatch.llm import jaccard  # which imports this module

    prepare(docs.sparkSession)
    names = docs.columns
    taken = {n.lower() for n in names}
    marks, row = [next(c for c in (f"{n}{'_' * k}" for k in range(len(taken) + 1)) if c not in taken) for n in ("mark", "row")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, keys, size, sketches = [np.empty(0, np.int64)], [np.empty((0, BANDS), _U)], [np.empty(0, np.int64)], []
            for block in word_blocks(batch.column(text_col)):
                owner, shingles = shingle_sets(block, words)
                one, many = _band_keys(owner, shingles, block.rows)
                edges = np.searchsorted(owner, np.arange(block.rows + 1))
                node.append(one)
                keys.append(many)
                size.append(np.diff(edges))
                sketches += [jaccard.sketch(shingles[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            node, keys, size = np.concatenate(node), np.concatenate(keys).view(np.int64), np.concatenate(size)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            cells = pa.StructArray.from_arrays([pa.array(node), lists, pa.array(size), pa.array(sketches, pa.binary())], ["node", "keys", "size", "sketch"])
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*names, marks])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    kinds = f"{marks} struct<node: bigint, keys: array<bigint>, size: bigint, sketch: binary>"
    held = materialise(docs.mapInArrow(run, f"{fields}, {kinds}").withColumn(row, F.monotonically_increasing_id()), "marked")
    small = held.select(F.col(id_col).alias("id"), F.col(row).alias("row"), F.col(f"{marks}.*"))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    nodes = materialise(small.groupBy("node").agg(F.min(order).alias("first"), *(F.first(c).alias(c) for c in ("keys", "size", "sketch"))), "nodes")
    near = components(_candidates(nodes)).join(nodes.select("node", F.col("first.row").alias("row")), "node")
    texts = held.select(F.col(row).alias("row"), F.col(text_col).alias("text")).join(near, "row")
    known = materialise(_verified(materialise(texts.select("node", "root", "text"), "candidates"), words), "known")
    roots = jaccard.classes(held.select(F.col(text_col).alias("text")), nodes.filter("node != 0").select("node", "size", "sketch"), words, round(100 * SIMILAR), known)
    kept = (nodes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first"))
            .select(F.col("first.row").alias(row)))
    return held.join(kept, row, "left_semi").select(*names)
