"""Shared small tables of odd rows."""

import random

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, fingerprint string, id long, row long, words string"


def odd_rows():
    """Nulls, empty and long texts, repeated rows and ids; the extra columns clash with the operators' own names."""
    rng = random.Random(3)
    long = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(9000))
    rows = [(1, "The cat sat on the mat, and it was a fine mat indeed."), (2, None), (3, ""), (4, long), (5, long), (6, "   \t\n "), (7, "x" * 30_000),
            (8, "The cat sat on the mat, and it was a fine mat indeed."), (8, "The cat sat on the mat, and it was a fine mat indeed."), (None, "no number here at all"),
            (9, "Grüße aus Köln 日本語 😀 ▁ end"), (9, "another text of the same number")]
    return [(i, t, "clash", 0, 0, "clash") for i, t in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, DOCS)


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
