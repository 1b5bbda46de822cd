"""Personal data: plain patterns against regular expressions, bootstrapping on planted contexts, odd rows."""

import hashlib
import random
import re

from tidewatch.llm import pii, queries

from tests.llm.helpers import SF, documents, frame, odd_rows

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(a, b, pii.KINDS[k]) for a, k, b in sorted(out)]


def test_plain_patterns_on_random_texts():
    rng = random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choice("a1@.+- ()0459-@.b%é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain(text)


def test_long_runs_stay_linear():
    for text in ("9" * 300_000, "a" * 300_000, "1." * 100_000, "a@" * 100_000, "+1" + " " * 200_000, "a." * 100_000 + "@b"):
        pii.base_spans(text)
        pii.candidates(text, [])


def test_query_equals_plain_patterns(spark):
    docs, got = documents(spark), {r.doc_id: r for r in queries.op6_pii(spark, SF).collect()}
    for d, text in docs:
        spans = plain(text)
        said = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        assert got[d].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in spans) for k in pii.KINDS]
        assert set(said.split(",")) <= set(got[d].spans.split(","))


def contexts():
    rows = [(i, f"please reach us via mail{i}@host{i}.example.org for all details") for i in range(8)]
    rows += [(10 + i, f"now write to our person{i}@other{i}.example.com today please") for i in range(8)]
    # the first unseen address stands in a known context and, elsewhere, in one that only it shares with further ones
    rows += [(30, "please reach us via someone@intranet99 for all details"), (40, "version 1234 of nothing"), (41, "code 98765 of nothing"), (42, "total 55555 of nothing")]
    return rows


def test_trusted_contexts_find_unseen_identifiers(spark):
    rows = [(i, t, "", 0, 0, "") for i, t in contexts()]
    found = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in pii.find(frame(spark, rows)).collect()}
    assert found[30] == [(20, 38, "email")] and found[40] == found[41] == found[42] == [] and len(found[3]) == 1
    masked = {r.doc_id: r.text for r in pii.masked(frame(spark, rows)).collect()}
    assert masked[30] == "please reach us via [EMAIL] for all details" and masked[40] == "version 1234 of nothing"


def test_rounds_reach_further_contexts(spark):
    seen = [(i, "email", "via _") for i in range(9)] + [(100 + i, None, "via _") for i in range(1)] + [(100, None, "box _")]
    seen += [(i, "email", "box _") for i in range(4)] + [(200, None, "box _")]
    rows = spark.createDataFrame(seen, "instance long, kind string, pattern string")
    one = {r.pattern for r in pii.trusted_patterns(rows, rounds=1).collect()}
    two = {r.pattern for r in pii.trusted_patterns(rows, rounds=2).collect()}
    assert one == {"via _"} and two == {"via _", "box _"}


def test_odd_rows(spark):
    got = pii.find(frame(spark)).collect()
    assert len(got) == len(odd_rows()) and all(not r.base and not r.spans for r in got)
    kept = pii.masked(frame(spark))
    assert kept.columns == frame(spark).columns
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, frame(spark).select("doc_id", "text").collect()))
    assert pii.find(frame(spark, [])).count() == 0
    twice = [(1, "x a@b.co y", "", 0, 0, "")] * 2
    assert [r.text for r in pii.masked(frame(spark, twice)).collect()] == ["x [EMAIL] y"] * 2


def test_a_number_beside_a_span_takes_only_the_patterns_that_hold_it():
    text = "reach us via someone@intranet99 for 24 hours"
    begin = text.index("someone")
    assert pii.contexts(text, begin, begin + len("someone@intranet99")) == ["us via _", "via _ for"]
    assert pii.contexts("call 5 at x1y2z3 or write", 10, 16) == ["at _ or", "_ or write"]
    assert pii.contexts(f"call at x1y2z3 {'w' * 50} now", 8, 14) == ["call at _"]


def test_masked_goes_by_row_not_by_id(spark):
    known = [f"please write to the desk at person{i}@mail{i}.example.org whenever you like" for i in range(12)]
    rows = [(i, t) for i, t in enumerate(known)]
    hidden = "write to the desk at agent.q7@intranet whenever you like"
    rows += [(None, hidden), (50, f"first of two texts of one id: {hidden}"), (50, hidden), (50, "nothing to find in this one")]
    got = pii.masked(frame(spark, [(i, t, "", 0, 0, "") for i, t in rows]))
    assert got.columns == frame(spark).columns
    texts = sorted(r.text for r in got.filter("doc_id is null or doc_id = 50").collect())
    clean = "write to the desk at [EMAIL] whenever you like"
    assert texts == sorted([clean, f"first of two texts of one id: {clean}", clean, "nothing to find in this one"])


def test_columns_with_the_names_of_helpers(spark):
    names = ["_id", "_extra", "number", "Found", "found_in", "row", "base", "spans", "extra", "kind"]
    rows = spark.createDataFrame([(1, "x a@b.co y", *names), (2, None, *names)], ["doc_id", "text", *names])
    kept = pii.masked(rows)
    assert kept.columns == rows.columns
    assert sorted(map(tuple, kept.collect())) == [(1, "x [EMAIL] y", *names), (2, None, *names)]
    found = pii.find(spark.createDataFrame([(7, "x a@b.co y")], "row long, text string"), "row")
    assert found.columns == ["row", "base", "spans"] and [(r.row, len(r.base)) for r in found.collect()] == [(7, 1)]
