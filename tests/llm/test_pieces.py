"""SentencePiece pieces against the library."""

import hashlib
import random

import pytest
import sentencepiece
from tidewatch.llm import pieces, queries

from tests.llm.helpers import SF, documents, frame, odd_rows

PATH = queries.vocabulary("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def said(text):
    ids = LIBRARY.encode(text)
    return len(ids), ",".join(map(str, ids)), LIBRARY.decode(ids)


def test_random_texts():
    rng, encoder = random.Random(1), pieces.Encoder(pieces.load(PATH))
    for _ in range(3000):
        text = "".join(rng.choice(" ▁ab\n\t\0é日😀thein<s></s>0x0A ​.,  ") for _ in range(rng.randint(0, 30)))
        assert next(encoder.texts([text])) == said(text)


def test_whole_texts_without_word_cuts():
    found = pieces.load(PATH)
    for text in ("the  quick brown fox", "", "ß日本 😀"):
        assert found.merge("▁" + text.replace(" ", "▁")) == LIBRARY.encode(text) or not text


def test_decoding_odd_ids():
    found = pieces.load(PATH)
    b = found.byte
    for ids in ([b[0xE2], b[0x82]], [b[0xF0], b[0x9F], b[0x98], b[0x80]], [b[0xFF], b[0x41]], [b[0xC3], b[0x28]], LIBRARY.encode("  a b")):
        assert found.decode(ids) == LIBRARY.decode(ids)


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 5)
    encoder = pieces.Encoder(pieces.load(PATH))
    for text in ["one two three four five six ▁ seven", "日 😀 x", "one two eight nine ten", "", "one 日 two"] * 3:
        assert next(encoder.texts([text])) == said(text)


def test_a_difference_is_raised():
    encoder = pieces.Encoder(pieces.Pieces(PATH))
    encoder.pieces.number["▁the"] = 5
    with pytest.raises(ValueError):
        list(encoder.texts(["the other"]))


def test_query_equals_library(spark):
    got = {r.doc_id: r for r in queries.op7_sentencepiece(spark, SF).collect()}
    for d, text in documents(spark):
        n, ids, decoded = said(text)
        assert tuple(got[d])[1:] == (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_odd_rows(spark):
    got = pieces.encode(frame(spark), PATH).collect()
    want = sorted((str(i), *said(t or "")[1:]) for i, t, *_ in odd_rows())
    assert sorted((str(r.doc_id), ",".join(map(str, r.ids)), r.decoded) for r in got) == want
    assert pieces.encode(frame(spark, []), PATH).count() == 0
