"""The corpus pipeline against its stages' own rules, stage by stage."""

import random

import corpus_pipeline
import sentencepiece
from tidewatch.llm import queries

SMALL = "/root/testdata/sf0.01"


def test_stages_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SMALL), "test")
        kept[name] = {r.doc_id: r.asDict() for r in docs.collect()}
        assert name == "encoding" or docs.columns == names
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    clean, toxic = ([d for d, y in labels.items() if y == k] for k in (0, 1))
    gone = set(labels) - set(kept["toxicity"])
    assert len(gone & set(clean)) <= 0.01 * len(clean) and len(gone & set(toxic)) >= 0.6 * len(toxic)
    texts = [r["text"] for r in kept["near duplicates"].values()]
    assert len(set(texts)) == len(texts) and len(texts) >= 0.75 * len(kept["toxicity"])
    left = {r["text"] for r in kept["benchmark decontamination"].values()}
    for item in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        assert not any(item.text in t for t in left)
    assert set(kept["personal data"]) == set(kept["benchmark decontamination"]) == set(kept["encoding"])
    library = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    for d in random.Random(1).sample(sorted(kept["encoding"]), 50):
        row = kept["personal data"][d]
        assert row["n_chars"] == len(row["text"]) and kept["encoding"][d]["ids"] == library.encode(row["text"])
        assert not ("@mail" in row["text"] and ".example." in row["text"])


def test_stages_take_odd_and_no_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, "en", None, None), (None, "a text without a number", None, "s", 3), (3, "", "en", "s", 0), (4, "one more text of some words", "en", "s", 9)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialise(stage(spark, docs, "/root/testdata/sf0.001"), "test")
        assert docs.count() == (3 if given else 0)  # null and empty text are one
