"""Removal of repeated strings against a set of all strings; the sort against Python's."""

import hashlib
import random

import numpy as np
from tidewatch.llm import anchors, queries, suffixes

from tests.llm.helpers import SF, documents, frame, odd_rows


def expected(rows):
    seen: dict[bytes, tuple] = {}
    rows = sorted(((d, (t or "").encode()) for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for d, b in rows:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 99):
            if seen.setdefault(b[i:i + 100], (d, i)) != (d, i):
                gone[i:i + 100] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        yield d, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()


def test_sort_equals_python():
    rng = random.Random(3)
    data = bytes(rng.choice(b"ab") for _ in range(300)) * 3 + b"a" * 400 + bytes(rng.randrange(256) for _ in range(500))
    starts = np.arange(len(data) - 99)
    groups = np.array([rng.randrange(3) for _ in starts])
    order, same = suffixes.deep_shallow(data + bytes(8), starts, groups)
    key = lambda i: (groups[i], data[i:i + 100])
    assert sorted(order.tolist()) == starts.tolist()
    walk = order.tolist()
    assert all(key(a) <= key(b) and (key(a) == key(b)) == s for a, b, s in zip(walk, walk[1:], same[1:].tolist()))


def test_equal_strings_have_equal_anchors():
    rng = random.Random(4)
    shared = bytes(rng.randrange(256) for _ in range(400))
    texts = [bytes(rng.randrange(256) for _ in range(n)) + shared + bytes(rng.randrange(256) for _ in range(n)) for n in (0, 37, 250)] + [b"a" * 500, b"short"]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    data = b"".join(texts)
    found = anchors.runs(np.frombuffer(data, np.uint8), offsets)
    places: dict[bytes, set] = {}
    for start, count, anchor, key in zip(found.start.tolist(), found.count.tolist(), found.anchor.tolist(), found.key.tolist()):
        for i in range(start, start + count):
            places.setdefault(data[i:i + 100], set()).add((anchor - i, key))
    assert all(len(p) == 1 for p in places.values())
    assert found.count.sum() == sum(max(len(t) - 99, 0) for t in texts)


def test_query_equals_a_set_of_strings(spark):
    got = {r.doc_id: tuple(r) for r in queries.op10_suffix_array_dedup(spark, SF).collect()}
    assert got == {r[0]: r for r in expected(documents(spark))}


def odd_texts():
    rng = random.Random(5)
    line = "".join(rng.choice("abcdefgh ") for _ in range(140))
    body = lambda n: "".join(rng.choice("ijklmnop 日") for _ in range(n))
    return [(10, line), (3, body(300) + line + body(50)), (4, line[:99]), (5, line[:100]), (6, (line + "!") * 40), (7, "x" * 3000), (8, "xy" * 900 + line), (2, None), (1, ""),
            (None, body(20) + line[20:] + body(20)), (11, body(5000)), (12, line[:60] + "#" + line[60:]), (13, line + line)]


def test_odd_rows_whole_and_in_parts(spark, monkeypatch):
    rows = odd_texts()
    want = sorted(map(str, expected(rows)))
    docs = frame(spark, [(i, t, "", 0, 0, "") for i, t in rows])
    assert sorted(str(tuple(r)) for r in suffixes.remove_repeats(docs).collect()) == want
    docs_ = suffixes._document(docs, "doc_id", "text")
    marks = suffixes.marked_strings(suffixes.sent_pieces(docs_, suffixes.repeated_anchors(docs_), hot=2))  # every repeated anchor as a frequent one
    gone = {}
    for r in marks.collect():
        gone.setdefault(r.doc, set()).update(range(r.low, r.high))
    assert {d: len(g) for d, g in gone.items()} == {-(1 << 63) if r[0] is None else r[0]: r[2] for r in expected(rows) if r[2]}
    kept = {r.doc_id: bytes(r.kept) for r in suffixes.remove_repeats(docs, keep_text=True).collect()}
    assert kept[4] == rows[2][1].encode() and len(kept[13]) < 140
    assert suffixes.remove_repeats(frame(spark, [])).count() == 0
    assert len(suffixes.remove_repeats(frame(spark)).collect()) == len(odd_rows())


def test_texts_over_a_block_are_cut_with_overlap(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffixes, "BLOCK", 1000)
    text = "".join(random.Random(6).choice("abcdefgh") for _ in range(5000))
    parts = list(suffixes._pieces(pa.array([text])))
    strings = [base + i for _, base, _, data in parts for i in range(len(data) - 99)]
    assert strings == list(range(4901)) and all(bytes(data).decode() == text[base:base + len(data)] for _, base, _, data in parts)
