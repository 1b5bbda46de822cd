"""The n-gram Jaccard join against all pairs of sets of plain strings."""

import random
import re

import numpy as np
import pytest

from tidewatch.llm import jaccard
from tests.llm.helpers import SF, documents, frame, odd_rows

UPPER = {c: c + 32 for c in range(65, 91)}


def plain(rows, words=5, similar=80):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and similar * max(len(a), len(b)) <= 100 * min(len(a), len(b)) and 100 * len(a & b) >= similar * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            least[top(i)] = min(least.get(top(i), id_), id_)
    return sorted(((id_, len(s), least.get(top(i))) for i, ((id_, _), s) in enumerate(zip(rows, sets))), key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def template_rows(seed=2):
    """Texts of one template, chains of edits near the limit, copies, short texts and passages that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    template, rows = [word() for _ in range(60)], []
    for _ in range(60):
        rows.append(template + [word() for _ in range(rng.choice((8, 15, 30, 60)))])
    for size in (5, 6, 7, 9, 12, 20, 50, 400):
        text = [word() for _ in range(size)]
        for _ in range(9):
            rows.append(list(text))
            if size > 6 and rng.random() < 0.7:
                text[rng.randrange(size)] = word()
    rows += [rng.choice(rows) for _ in range(40)] + [[word()] for _ in range(5)] + [["a", "b"]] * 3
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("group, few", [(500, 4), (7, 0)])
def test_all_pairs(spark, monkeypatch, group, few):
    """Also with groups cut into many parts and settled inside, and without broadcasts."""
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "SENT", 1_000_000 if group > 7 else 0)
    rows = template_rows()
    assert result(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == plain(rows)


def test_given_documents(spark):
    assert result(jaccard.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet"))) == plain(documents(spark))


def test_odd_rows(spark):
    rows = [r[:2] for r in odd_rows()]
    assert result(jaccard.near_duplicates(frame(spark))) == plain(rows)
    assert jaccard.near_duplicates(frame(spark, [])).collect() == []
    alone = [(None, "a b c d e f g"), (None, "a b c d e f g"), (3, None), (None, "")]
    assert result(jaccard.near_duplicates(spark.createDataFrame(alone, "doc_id long, text string"))) == plain(alone)


@pytest.mark.parametrize("similar", [80, 60])
def test_similar_sets_share_a_signature(similar):
    """Random pairs of sets exactly at the limit, of all sizes."""
    rng = np.random.default_rng(4)
    for _ in range(400):
        shared = int(rng.choice([1, 2, 3, 4, 5, 7, 9, 14, 30, 90, 400]))
        rest = shared * (100 - similar) // similar
        own = int(rng.integers(0, rest + 1))
        pool = np.sort(rng.integers(1, 1 << 63, shared + rest).astype(np.uint64))
        rng.shuffle(pool)
        a, b = pool[:shared + own], np.concatenate((pool[:shared], pool[shared + own:]))
        row, found = jaccard.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate((np.sort(a), np.sort(b))), 2, similar)
        assert set(found[row == 0].tolist()) & set(found[row == 1].tolist())


def test_sketches_never_part_similar_sets():
    rng = np.random.default_rng(6)
    for size in (3, 90, 3000):
        pool = rng.integers(1, 1 << 63, 2 * size).astype(np.uint64)
        for other in (0, size // 9, size // 2):
            a, b = pool[:size], np.concatenate((pool[:size - other], pool[size:size + other // 2]))
            apart = len(set(a.tolist()) ^ set(b.tolist()))
            assert jaccard.within(jaccard.sketch(a), jaccard.sketch(b), apart)


def test_signatures_are_sent_in_few_bytes():
    """74 million rows of 14 bytes were half of what the join wrote to disk. Each set is named once in a bucket, so 64 bytes of 176
    signatures and a name are not sent 176 times."""
    rng = np.random.default_rng(5)
    node = np.repeat(rng.integers(-1 << 62, 1 << 62, 300), 200)
    signature = rng.integers(0, 1 << 63, len(node)).astype(np.uint64) * np.uint64(2)
    signature[200:230] = signature[:30]          # two sets
    signature[400:410] = signature[600:610] = signature[:10]  # four, one of them twice
    signature[1000] = signature[1001] = signature[0]
    batch = jaccard._packed(signature, node, 40)
    assert batch.num_rows == 40 and sum(len(x) for c in ("nodes", "counts", "low") for x in batch.column(c).to_pylist()) <= 9 * len(node)
    got = set()
    for bucket, nodes, counts, low in zip(*(batch.column(c).to_pylist() for c in ("bucket", "nodes", "counts", "low"))):
        wide = np.zeros((len(low) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(low, np.uint8).reshape(-1, 6)
        told = jaccard._told(bucket, wide.view("<u8").ravel(), np.repeat(np.frombuffer(nodes, np.int64), np.frombuffer(counts, "<u2")))
        for key, n, first, several in zip(*(told.column(c).to_pylist() for c in ("signature", "node", "first", "several"))):
            got.add((key & (1 << 48) - 1, n, first, several))
    groups = {}
    for k, n in zip(signature.tolist(), node.tolist()):
        groups.setdefault(k & (1 << 48) - 1, set()).add(n)
    want = {(k, n, min(g), len(g) > 2) for k, g in groups.items() if len(g) > 1 for n in g if len(g) > 2 or n != min(g)}
    assert got == want and len(want) > 30


@pytest.mark.parametrize("gathered, together", [(50, 40), (2_000_000, 2_000_000)])
def test_small_buckets_give_the_same(spark, monkeypatch, gathered, together):
    monkeypatch.setattr(jaccard, "GATHERED", gathered)
    monkeypatch.setattr(jaccard, "TOGETHER", together)
    rows = template_rows(8)[:150]
    assert result(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == plain(rows)
