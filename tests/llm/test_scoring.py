"""Kneser-Ney scores against dictionaries."""

import collections
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F
from tidewatch.llm import queries, scoring

from tests.llm.helpers import SF, documents, frame


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), "end"]


def scorer(texts):
    words, pairs = collections.Counter(), collections.Counter()
    for w in map(tokens, texts):
        words.update(w)
        pairs.update(zip(["begin", *w], w))
    total, kinds, before = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0]), collections.Counter()
    for (a, b), n in pairs.items():
        total[a] += n
        kinds[a][min(n, 3) - 1] += 1
        before[b] += 1
    high, low = (scoring.discounts(tuple(sum(n == k for n in c.values()) for k in (1, 2, 3, 4))) for c in (pairs, before))
    off = lambda n, d: n - (d[min(n, 3) - 1] if n else 0)
    spare = sum(low[min(n, 3) - 1] for n in before.values()) / len(pairs)

    def p(a, b):
        alone = off(before[b], low) / len(pairs) + spare / (len(words) + 1)
        return off(pairs[a, b], high) / total[a] + sum(x * y for x, y in zip(high, kinds[a])) / total[a] * alone if total[a] else alone

    return words, p


def test_query_equals_dictionaries(spark):
    docs = documents(spark)
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    words, p = scorer([t for d, t in docs if not held[d]])
    for probe in (b"the", "begin", b"never seen"):
        assert sum(p(probe, w) for w in words) + p(probe, b"never seen") == pytest.approx(1)
    got = {r.doc_id: r for r in queries.op3_lm_scoring(spark, SF).collect()}
    n, v = sum(words.values()), len(words)
    for d, text in docs:
        w, r = tokens(text), got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(w), sum(words[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w))
        assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["begin", *w], w)))


def test_pairs_of_a_hot_word_are_spread(spark):
    texts = [f"the w{i} the v{i % 50} other{i % 7} thing" for i in range(3000)]
    model = scoring.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    got = scoring.score(spark.createDataFrame(list(enumerate(texts[:20])), "doc_id long, text string"), model).collect()
    _, p = scorer(texts)
    for r in got:
        w = tokens(texts[r.doc_id])
        assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["begin", *w], w)))
    assert model.tokens // model.hot >= 8


def test_odd_rows(spark):
    docs = frame(spark)
    model = scoring.fit(docs.filter(~scoring.held_out("doc_id")))
    got = scoring.score(docs, model).collect()
    assert len(got) == docs.count() and all(r.score <= 0 and r.n_tokens >= 1 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 6)} == {1}
    assert scoring.score(frame(spark, []), model).count() == 0
    nothing = scoring.fit(docs.filter(F.lit(False)))
    assert {r.score for r in scoring.score(docs, nothing).collect()} == {0.0} and nothing.tokens == 0
