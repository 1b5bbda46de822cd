"""Toxicity scores: held-out accuracy, sparsity, odd rows."""

import random

import numpy as np
from tidewatch.llm import queries, toxicity

from tests.llm.helpers import frame, odd_rows

SMALL = "/root/testdata/sf0.01"


def labelled(n=600):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(60)]
        if i % 4 == 0:
            text[rng.randrange(60)] = "vile"
            text[rng.randrange(60)] = "rotten"
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    return rows


def test_held_out_rows_are_told_apart_by_few_weights(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (99_999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    out = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(out) > 150 and np.mean([p == y for p, y in out]) > 0.98
    assert len(model.keys) < 300 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    again = toxicity.fit(docs, labels)
    assert np.array_equal(model.keys, again.keys) and np.allclose(model.weights, again.weights)
    kept = toxicity.score(docs, model, keep=True)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    few = toxicity.fit(docs, labels, fit_rows=100)  # the bound on labelled rows
    assert len(few.keys) < 300


def test_query_on_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, SMALL).collect()}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels if got[r.doc_id].held_out]
    toxic, clean = [p for p, y in held if y == 1], [p for p, y in held if y == 0]
    assert len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    # a few dozen toxic rows in four languages: words that are in none of those learnt from cannot be known
    assert np.mean(toxic) >= 0.4 and np.mean(clean) <= 0.02


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (9, 1)], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark), labels)
    got = toxicity.score(frame(spark), model).collect()
    assert len(got) == len(odd_rows()) and len({r.score for r in got if r.doc_id in (2, 3, 6)}) == 1
    assert toxicity.score(frame(spark, []), model).count() == 0
    nothing = toxicity.fit(frame(spark, []), labels.limit(0))
    assert {r.score for r in toxicity.score(frame(spark), nothing).collect()} == {0.5}


def test_every_labelled_row_is_learnt_from(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(50)]
    ids = spark.range(33_000).selectExpr("id", "pmod(xxhash64(id), 1 << 30) / (1 << 30) as place").filter("crc32(cast(cast(id as string) as binary)) % 3 <> 1").collect()
    rows = []
    for r in ids:  # the word stands only in rows that no sample of 20,000 has
        toxic = r.place > 20_000 / len(ids)
        rows.append((r.id, " ".join([rng.choice(words), rng.choice(words), "vile" if toxic else rng.choice(words)]), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    texts = spark.createDataFrame([(1, "vile"), (2, words[0])], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(texts, model).collect()} == {1: 1, 2: 0}


def test_features_are_not_shuffled(spark, monkeypatch):
    """Labelled texts go to their shards as texts; their features take several times the room."""
    sent = []
    docs = spark.createDataFrame([(i, "a few words and a few more") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    frames = type(docs)
    grouped = frames.groupBy
    monkeypatch.setattr(frames, "groupBy", lambda df, *by: (sent.append(df) if by == ("shard",) else None, grouped(df, *by))[1])
    toxicity.fit(docs, labels)
    assert [dict(df.dtypes) for df in sent] == [{"id": "bigint", "shard": "bigint", "y": "int", "text": "string"}]
    plan = sent[0]._jdf.queryExecution().executedPlan().toString()  # the same strategy for small and large labels, without a sort of texts
    assert "ShuffledHashJoin" in plan and "Sort " not in plan
