"""Leaks: exact and paraphrased passages, recall against brute force, odd rows."""

import random
import re

import numpy as np
from tidewatch.llm import decontamination as leaks
from tidewatch.llm import queries

from tests.llm.helpers import SF, frame, odd_rows

SMALL = "/root/testdata/sf0.01"
WORDS = ["".join(random.Random(i).choice("abcdefghijk") for _ in range(3 + i % 7)) for i in range(3000)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string, doc_id long")


def test_exact_and_paraphrased_items_are_found_others_are_not(spark):
    rng = random.Random(6)
    items = [(i, f"{text(rng, 25)}. {text(rng, 8)}.", 0) for i in range(30)]
    docs, want = [], set()
    for d in range(60):
        body = text(rng, rng.choice((0, 40, 400)))
        if d % 3 == 0:
            body += " " + items[d % 30][1].upper().replace(" ", " -- ")
            want.add((d, d % 30))
        elif d % 3 == 1:  # every sixth word replaced
            words = items[d % 30][1].split()
            words[::6] = [rng.choice(WORDS) for _ in words[::6]]
            body = f"{' '.join(words)} {body}"
            want.add((d, d % 30))
        else:  # half an item, without its answer
            body += " " + " ".join(items[d % 30][1].split()[:12])
        docs.append((d, f"{body} {text(rng, 30)}", "", 0, 0, ""))
    got = leaks.find_leaks(frame(spark, docs), benchmark(spark, items))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    kept = leaks.without_leaks(frame(spark, docs), benchmark(spark, items))
    assert {r.doc_id for r in kept.collect()} == set(range(60)) - {d for d, _ in want} and kept.columns == frame(spark).columns


def test_query_finds_every_passage(spark):
    plain = lambda t: f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} "
    docs = [(r.doc_id, plain(r.text)) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in docs for i, b in items if b in t}
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, SMALL).collect()}
    assert want and len(want & got) >= 0.9 * len(want) and len(got - want) <= 0.02 * len(docs)


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    want = {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, SF).collect()}
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 15)
    assert {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, SF).collect()} == want


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd").encode() for _ in range(rng.randint(1, 12))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert leaks.common_words(leaks._places(a), len(a), b) == table[-1, -1]


def test_odd_rows(spark):
    items = [(1, "The cat sat on the mat, and it was a fine mat indeed.", 0), (1, "The cat sat on the mat, and it was a fine mat indeed.", 0), (2, None, 0), (3, "", 0),
             (4, "too short", 0), (None, "no item number but words enough for a passage here", 0)]
    got = sorted((r.doc_id, r.item_id) for r in leaks.find_leaks(frame(spark), benchmark(spark, items)).collect())
    assert got == [(1, 1), (8, 1), (8, 1)]
    assert leaks.find_leaks(frame(spark, []), benchmark(spark, items)).count() == 0
    assert leaks.find_leaks(frame(spark), benchmark(spark, [])).count() == 0
    assert leaks.without_leaks(frame(spark), benchmark(spark, [])).count() == len(odd_rows())


def test_a_full_block_of_planted_items_is_found_at_every_length(spark):
    rng = random.Random(12)
    rows = [r.text.split() for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text", "doc_id").orderBy("doc_id").collect()]
    hosts, items, docs = [w for w in rows if 150 <= len(w) <= 600], [], []
    for i in range(leaks.ITEM_BLOCK):
        n = (8, 10, 12, 16, 20, 30, 45, 59)[i % 8]
        source = rng.choice([w for w in rng.sample(rows, 40) if len(w) > n + 1])
        at = rng.randrange(len(source) - n)
        items.append((i, " ".join(source[at:at + n]), 0))
        host = rng.choice(hosts)
        at = rng.randrange(len(host))
        docs.append((i, " ".join([*host[:at], items[-1][1], *host[at:]]), "", 0, 0, ""))
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(frame(spark, docs), benchmark(spark, items)).collect()}
    for k in range(8):
        whole = [i for i in range(k, len(items), 8) if len(leaks.split_words(items[i][1])) >= leaks.LEAST_WORDS]
        assert sum((i, i) in got for i in whole) >= 0.9 * len(whole)


def test_short_items_are_found_word_for_word(spark):
    items = [(1, "Mount Kenya, 5199 m", 0), (2, "zebra", 0), (3, "one two three four five six seven", 0), (4, "Mount Kenya, 5199 m", 0), (5, "...", 0)]
    docs = [(1, "We saw mount KENYA (5199 m) there", "", 0, 0, ""), (2, "mount kenya is 5199 m high, zebras", "", 0, 0, ""), (3, "mount", "", 0, 0, ""),
            (4, "kenya 5199 m", "", 0, 0, ""), (5, "a zebra. one two three four five six seven eight zebra", "", 0, 0, ""), (6, "...", "", 0, 0, "")]
    want = [(1, 1), (1, 4), (5, 2), (5, 3)]
    assert sorted((r.doc_id, r.item_id) for r in leaks.find_leaks(frame(spark, docs), benchmark(spark, items)).collect()) == want
    assert {r.doc_id for r in leaks.without_leaks(frame(spark, docs), benchmark(spark, items)).collect()} == {2, 3, 4, 6}
    long = [*items, (6, "a longer item with words enough to be in the latent space", 0)]
    assert sorted((r.doc_id, r.item_id) for r in leaks.find_leaks(frame(spark, docs), benchmark(spark, long)).collect()) == want


def test_the_latent_space_is_fitted_on_every_passage(spark, monkeypatch):
    rng = random.Random(3)
    texts = [text(rng, 200) for _ in range(400)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    words = sorted({w.encode() for w in WORDS[::3]})
    terms = np.unique(leaks.word_hashes(next(leaks.word_blocks(leaks.pa.array([b" ".join(words).decode()]), separators=leaks.IS_MARK))))
    weight = np.linspace(0.5, 2.0, len(terms))
    want, held = np.zeros((len(terms), len(terms))), 0
    for t in texts:
        found = leaks._terms(leaks.word_hashes(next(leaks.word_blocks(leaks.pa.array([t]), separators=leaks.IS_MARK))), terms)
        for a in range(0, len(found), leaks.HALF):
            row = weight * np.bincount(found[a:a + leaks.HALF][found[a:a + leaks.HALF] >= 0], minlength=len(terms))
            if row.any():
                want += np.outer(row, row) / (row @ row)
                held += 1
    passages = leaks._survey(docs, terms).filter("terms is not null").select("terms")
    assert passages.count() == held > 2000
    matrix = np.random.default_rng(1).standard_normal((len(terms), 5))
    none = (np.empty(0, np.int64), np.empty(0, np.int64))
    for cells in (leaks._CELLS, 1):
        monkeypatch.setattr(leaks, "_CELLS", cells)
        assert np.allclose(leaks._squared(leaks._together(passages, weight), 0.5, weight, none, matrix), 0.5 * want @ matrix)


def test_parts_of_a_product_do_not_grow_with_the_files(spark):
    """Each task hands in as many rows as there are terms, so 40 files of sums may not be 40 tasks."""
    size = 50
    rows = [(t, list(range(t, size)), [float(1 + t + o) for o in range(t, size)]) for t in range(size)]
    together = spark.createDataFrame(rows, leaks._ROW).repartition(40)
    matrix = np.random.default_rng(1).standard_normal((size, 3))
    weight = np.ones(size)
    assert leaks._products(together, weight, matrix).count() <= 2 * size
    whole = np.array([[1.0 + a + b for b in range(size)] for a in range(size)])
    none = (np.empty(0, np.int64), np.empty(0, np.int64))
    assert np.allclose(leaks._squared(together, 1.0, weight, none, matrix), whole @ matrix)


def test_sums_of_halves_and_terms_by_lookup():
    rng = np.random.default_rng(2)
    matrix, per = rng.standard_normal((90, 7)).astype(np.float32), rng.integers(0, 33, 200)
    ends = np.append(0, np.cumsum(per)) + 4
    term, value = rng.integers(0, 90, ends[-1]), rng.random(ends[-1]).astype(np.float32)
    full = per > 0
    want = np.add.reduceat(matrix[term] * value[:, None], ends[:-1][full], axis=0)
    got = leaks._halves_times(matrix, ends, term, value)
    assert np.array_equal(got[full], want) and not got[~full].any()
    assert leaks._halves_times(matrix, np.zeros(3, np.int64), term, value).tolist() == np.zeros((2, 7)).tolist()
    hashes = rng.integers(0, 1 << 18, 50_000).astype(np.uint64)  # many end in the same 16 bits
    terms = np.unique(hashes[:9000])
    place = {h: i for i, h in enumerate(terms.tolist())}
    assert leaks._terms(hashes, terms).tolist() == [place.get(h, -1) for h in hashes.tolist()]
    assert leaks._terms(hashes, terms[:0]).tolist() == [-1] * len(hashes)
