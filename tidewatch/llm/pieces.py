"""SentencePiece encoding and decoding for merge-type vocabularies.

Symbols of a text sit in a linked list; an agenda ordered by score (then position) holds the adjacent pairs whose join is
a piece, and the best pair is merged until none is left. What is no piece falls back to bytes. Where no piece of the
vocabulary joins a space marker to a symbol before it (runs of markers apart), no merge crosses the start of a word,
so words are encoded once per worker and kept; other vocabularies are encoded text by text. Every newly
encoded word of an Arrow batch is checked against the sentencepiece library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words a worker keeps, and as many older ones; which it keeps changes no result.
KEPT_WORDS = 750_000


class Pieces:
    """A merge-type vocabulary with byte fallback, as its model file says."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("a merge-type vocabulary with byte fallback is needed")
        rules = proto.normalizer_spec
        if rules.name != "identity" or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces):
            raise ValueError("only the identity normaliser with a leading space marker is supported")
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.surface = [p.piece for p in proto.pieces]
        self.number = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.cost = {p.piece: -p.score for p in proto.pieces if p.type == 1}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.value = {i: b for b, i in self.byte.items()}
        crossing = any(MARK in p.lstrip(MARK) for p in self.number)
        self.cut = None if crossing else re.compile(" +[^ ]*|[^ ]+")

    def merge(self, text: str) -> list[int]:
        """Ids of a text (spaces already marked) by the agenda."""
        symbols = list(text)
        n = len(symbols)
        cost = self.cost.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(c, i, i + 1, pair) for i in range(n - 1) if (c := cost(pair := symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, joined = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != len(joined):
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = joined, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (c := cost(pair := joined + symbols[k])) is not None:
                    heapq.heappush(agenda, (c, i, k, pair))
            h = before[i]
            if h >= 0 and (c := cost(pair := symbols[h] + joined)) is not None:
                heapq.heappush(agenda, (c, h, i, pair))
        number = self.number.get
        ids: list[int] = []
        for s in filter(None, symbols):
            found = number(s)
            if found is None:
                ids += [self.byte[b] for b in s.encode()]
            else:
                ids.append(found)
        return ids

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids; ``first``: they begin a text, so that one leading space goes.

        Runs of byte pieces are read as UTF-8; each byte that fits no character becomes U+FFFD.
        """
        if self.value.keys().isdisjoint(ids):
            text = "".join([self.surface[i] for i in ids]).replace(MARK, " ")
            return text[1:] if first and text.startswith(" ") else text
        parts: list[str] = []
        raw = bytearray()
        for i in (*ids, -1):
            if i in self.value:
                raw.append(self.value[i])
                continue
            if raw:
                parts.append(_characters(bytes(raw)))
                raw.clear()
            if i >= 0:
                piece = self.surface[i]
                parts.append((piece[1:] if first and piece.startswith(MARK) else piece).replace(MARK, " "))
            first = False
        return "".join(parts)


def _characters(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        size = 1 if raw[at] < 0x80 else 2 if raw[at] >> 5 == 6 else 3 if raw[at] >> 4 == 14 else 4 if raw[at] >> 3 == 30 else 0
        try:
            out.append(raw[at:at + size].decode() if size else "�")
            at += size or 1
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


class Encoder(dict):
    """Encodes texts word by word: a dictionary from words, which begin with their spaces, to comma-joined ids."""

    def __init__(self, pieces: Pieces, check: bool = True, kept_words: int | None = None):
        super().__init__()
        self.pieces, self.check, self.kept_words = pieces, check, kept_words or KEPT_WORDS
        self.older: dict[str, str] = {}
        self.spoken: dict[str, str] = {}      # what words decode to, where it is not the word
        self.fresh: list[tuple[str, list[int]]] = []

    def __missing__(self, word: str) -> str:
        if word in self.older:
            made = self[word] = self.older[word]
            return made
        ids = self.pieces.merge(word.replace(" ", MARK))
        said = self.pieces.decode(ids, first=False)
        if said != word:
            self.spoken[word] = said
        if self.check and word[0] == " ":
            self.fresh.append((word, ids))
        made = self[word] = ",".join(map(str, ids))
        return made

    def _checked(self) -> None:
        """Compares the words met since the last time with the library, which puts the first space there itself."""
        fresh = [(w[1:], ids) for w, ids in self.fresh if w != " "]
        for (text, ids), theirs in zip(fresh, self.pieces.library.encode([text for text, _ in fresh], num_threads=1)):
            if ids != theirs:
                raise ValueError(f"{text!r} is encoded as {ids}, by the library as {theirs}")
        self.fresh.clear()

    def texts(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Count and comma-joined list of the ids, and their decoded text, of each text."""
        if len(self) > self.kept_words:
            self.older = dict(self)
            self.clear()
            self.spoken = {w: s for w, s in self.spoken.items() if w in self.older}
        for text in texts:
            if not text:
                yield 0, "", ""
                continue
            text = " " + text.replace(MARK, " ")
            if self.pieces.cut is None:
                ids = self.pieces.merge(text.replace(" ", MARK))
                if self.check and ids != self.pieces.library.encode(text[1:]):
                    raise ValueError(f"a text is not encoded as by the library: {text[:80]!r}")
                yield len(ids), ",".join(map(str, ids)), self.pieces.decode(ids)
                continue
            words = self.pieces.cut.findall(text)
            ids = ",".join([self[w] for w in words])
            spoken = self.spoken.get
            said = "".join([spoken(w, w) for w in words] if self.spoken else words)
            yield ids.count(",") + 1, ids, said[1:] if said.startswith(" ") else said
        self._checked()


@lru_cache(2)
def load(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(2)
def _encoder(path: str, check: bool, kept_words: int | None) -> Encoder:
    return Encoder(load(path), check, kept_words)


def _over(docs: DataFrame, model_path: str, id_col: str, text_col: str, check: bool, kept_words: int | None, row, schema: str, kinds: list) -> DataFrame:
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_path, check, kept_words)
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                texts = [t or "" for t in part.column("text").to_pylist()]
                rows = [row(n, ids, decoded) for n, ids, decoded in encoder.texts(texts)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))],
                                                 ["id", *(x.split()[0] for x in schema.split(", "))])

    return picked.mapInArrow(run, f"id long, {schema}").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True, kept_words: int | None = None) -> DataFrame:
    """``id, ids, decoded``: the ids of every whole text and the text they decode to, without a shuffle.

    Null texts count as empty and have no ids; rows with null ids are kept, repeated rows give a row each, other columns
    are ignored, no rows give none. ``kept_words`` is what a worker remembers (``KEPT_WORDS``), for jobs that need its memory
    otherwise; it changes no result. ``check`` compares every newly met word with the library and raises on a difference.
    """
    return _over(docs, model_path, id_col, text_col, check, kept_words, lambda n, ids, decoded: ([int(i) for i in ids.split(",")] if n else [], decoded),
                 "ids array<int>, decoded string", [pa.list_(pa.int32()), pa.string()])


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True, kept_words: int | None = None) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256``: as ``encode``, with hashes in place of ids and text."""
    def row(n: int, ids: str, decoded: str) -> tuple[int, str, str]:
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return _over(docs, model_path, id_col, text_col, check, kept_words, row, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                 [pa.int64(), pa.string(), pa.string()])
