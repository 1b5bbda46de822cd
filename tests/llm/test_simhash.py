"""SimHash links and classes against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from tidewatch.llm import queries, simhash

from tests.llm.helpers import SF, documents, frame, odd_rows
from tests.llm.test_jaccard import plain, template_rows


def plain_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_roots(marks, limit=3):
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= limit:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(marks))]


def clouds(seed, bits=64):
    rng, out = random.Random(seed), set()
    for _ in range(60):
        at = rng.getrandbits(bits)
        out.add(at)
        for _ in range(rng.randint(0, 12)):
            at ^= sum(1 << rng.randrange(bits) for _ in range(rng.randint(1, 4)))
            out.add(at)
    return sorted(out)


def test_trie_finds_every_pair_once():
    keys = np.array(clouds(1, 48), np.uint64)
    found = [(a, b) for x, y in simhash.trie_pairs(keys, [(0, len(keys), 0, len(keys))], 48, 3) for a, b in zip(x.tolist(), y.tolist())]
    want = [(i, j) for j in range(len(keys)) for i in range(j) if int(keys[i] ^ keys[j]).bit_count() <= 3]
    assert sorted(found) == sorted(want) and len(want) > 50


def classes_of(spark, marks, **options):
    rows = spark.createDataFrame([(np.uint64(m).astype(np.int64).item(),) for m in marks], "node long").selectExpr("node", "node fingerprint")
    roots = {r.node: r.root for r in simhash.components(simhash.links(rows, **options)).collect()}
    return [roots.get(n, n) for n in (np.uint64(m).astype(np.int64).item() for m in marks)]


def same_classes(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_links_give_the_classes_of_all_pairs_whole_or_cut(spark):
    marks = clouds(2) + [(0xABCD << 48) + i * 0x1111 for i in range(80)]
    want = plain_roots(marks)
    assert same_classes(classes_of(spark, marks), want)
    assert same_classes(classes_of(spark, marks, group_rows=4), want)


def test_query_equals_all_pairs(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in queries.op4_simhash_near_dedup(spark, SF).collect()}
    marks = [plain_fingerprint(t) for _, t in docs]
    for (d, _), m, root in zip(docs, marks, plain_roots(marks)):
        assert (got[d].fingerprint, got[d].component_id) == (f"{m:016x}", docs[root][0])


def test_odd_rows(spark):
    got = simhash.near_duplicates(frame(spark)).collect()
    assert len(got) == len(odd_rows())
    part = {}
    for r in got:
        part.setdefault(r.doc_id, set()).add(r.component_id)
    assert part[5] == {4} and part[8] == {1} and part[2] == part[3] == part[6] == {2} and part[None] == {None}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_one_of_each_keeps_whole_rows(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    near = list(words)
    near[150] = "changed"
    rows = [*odd_rows(), (20, " ".join(words), "", 0, 0, ""), (21, " ".join(near), "", 0, 0, ""), (22, " ".join(reversed(words)), "", 0, 0, "")]
    kept = simhash.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 2, 4, 7, 9, 9, 20, 22)] + [(True, 0)]
    assert simhash.one_of_each(frame(spark, [])).count() == 0


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def changed(rng, words, share, spread):
    """A copy with that share of the words new, in one run or scattered."""
    n = max(1, round(share * len(words)))
    at = rng.sample(range(len(words)), n) if spread else range(len(words) - n, len(words))
    out = list(words)
    for i in at:
        out[i] = f"new{rng.randrange(10 ** 9)}"
    return out


def test_one_of_each_drops_what_all_pairs_by_jaccard_drop(spark, monkeypatch):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    texts = ["a few words", "a few words", "a few", ""]
    for i in range(150):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((20, 60, 150, 400)))]
        texts.append(" ".join(base))
        for _ in range(2):
            spread = rng.random() < 0.5
            texts.append(" ".join(changed(rng, base, rng.uniform(0.005, 0.04) if spread else rng.uniform(0.02, 0.3), spread)))
    base = [rng.choice(vocabulary) for _ in range(100)]  # one large class of copies, linked in chains
    texts += [" ".join(changed(rng, base, 0.02, True)) for _ in range(60)]
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] == sets[j] or shared and shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared) - 1e-9:
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = sorted({find(i) for i in range(len(texts))})
    assert len(want) < 0.8 * len(texts)
    rows = [(i, t, "", 0, 0, "") for i, t in enumerate(texts)]
    assert sorted(r.doc_id for r in simhash.one_of_each(frame(spark, rows)).collect()) == want
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert sorted(r.doc_id for r in simhash.one_of_each(frame(spark, rows)).collect()) == want


def test_pairs_at_the_limit_share_a_band_key_of_five_word_shingles():
    rng = random.Random(5)
    for i in range(200):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randint(60, 400))]
        other = words[:len(words) - len(words) // 10 + 2] + [f"v{rng.randrange(10 ** 6)}" for _ in range(len(words) // 10 - 2)]
        a, b = shingles(" ".join(words)), shingles(" ".join(other))
        assert 0.8 <= len(a & b) / len(a | b) < 0.9
        block = next(simhash.word_blocks(pa.array([" ".join(words), " ".join(other)])))
        row, found = simhash.shingle_sets(block)
        assert (np.bincount(row) == (len(a), len(b))).all() and len(np.intersect1d(found[row == 0], found[row == 1])) == len(a & b)
        _, keys = simhash._band_keys(row, found, 2)
        assert (keys[0] == keys[1]).any()


def test_one_of_each_drops_similar_texts_without_a_band_key_in_common(spark):
    """Pairs exactly at the limit; of 600,000 like these, five have no key in common."""
    rows = []
    for i in (3311, 237638, 343533, 545176, 554556):
        same = [f"{c}{i}" for c in "abcdefghijkl"]
        a, b = (" ".join([*same, f"{c}{i}"]) for c in "mn")
        assert len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) == 0.8
        block = next(simhash.word_blocks(pa.array([a, b])))
        _, keys = simhash._band_keys(*simhash.shingle_sets(block), 2)
        assert not (keys[0] == keys[1]).any()
        rows += [(i, b, "", 0, 0, ""), (i + 10 ** 6, a, "", 0, 0, "")]
    assert sorted(r.doc_id for r in simhash.one_of_each(frame(spark, rows)).collect()) == [3311, 237638, 343533, 545176, 554556]


def test_one_of_each_needs_no_band_keys(spark, monkeypatch):
    """Texts of one template, chains of links and short texts, with half of the candidates or none."""
    rows = [(i, t, "", 0, 0, "") for i, t in template_rows()]
    want = sorted({root for _, _, root in plain([r[:2] for r in rows])})
    assert 50 < len(want) < 0.8 * len(rows)
    found = simhash._candidates
    for given in (lambda nodes: found(nodes).filter("a % 2 = 0"), lambda nodes: found(nodes).limit(0)):
        monkeypatch.setattr(simhash, "_candidates", given)
        assert sorted(r.doc_id for r in simhash.one_of_each(frame(spark, rows)).collect()) == want
