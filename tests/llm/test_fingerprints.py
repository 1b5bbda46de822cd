"""Document fingerprints against a plain walk over the documents."""

import hashlib
import random

from tidewatch.llm import fingerprints, queries

from tests.llm.helpers import SF, documents, frame, odd_rows


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for i, (number, text) in enumerate(rows):
        text, other = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + other[:half]
        a, b, c = (fingerprints.fingerprint(t.encode()) for t in (text, edited, other))
        yield number, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, fingerprints.likeness(a, b), fingerprints.likeness(a, c)


def test_query_equals_a_walk(spark):
    assert sorted(map(tuple, queries.op2_document_fingerprints(spark, SF).collect())) == sorted(expected(documents(spark)))


def test_odd_rows(spark):
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    rows = [(i, t) for i, t, *_ in odd_rows() if (i, t) != (9, "another text of the same number")]  # equal ids are ordered by a hash
    got = fingerprints.compare_with_edits(frame(spark, [(i, t, "", 0, 0, "") for i, t in rows])).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows), key=key)
    assert fingerprints.compare_with_edits(frame(spark)).count() == len(odd_rows())
    assert fingerprints.compare_with_edits(frame(spark, [])).count() == 0
    one = fingerprints.compare_with_edits(frame(spark, [(5, "alone here", "", 0, 0, "")])).first()
    assert one.near_next == 1.0 and one.n_chars == 10


def test_likeness_follows_edits():
    rng = random.Random(5)
    text = " ".join(str(rng.random()) for _ in range(400))
    at = len(text) // 2
    own = fingerprints.fingerprint(text.encode())
    near = fingerprints.fingerprint((text[:at] + "inserted" + text[at:]).encode())
    other = fingerprints.fingerprint(" ".join(str(rng.random()) for _ in range(400)).encode())
    assert fingerprints.likeness(own, own) == 1 and fingerprints.likeness(own, near) > 0.9 and fingerprints.likeness(own, other) < 0.2
    assert fingerprints.likeness(own, near) == fingerprints.likeness(near, own)
    assert fingerprints.likeness("64:AABB:AA", "16:AABB:AA") == 0 and fingerprints.likeness("32:AA:BBCC", "64:BBCC:DD") == 1
