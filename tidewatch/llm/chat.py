"""Chat formatting with offset-aligned loss masks.

Conversations are rendered whole, encoded once with offsets, and the sorted spans of the trained turns are intersected
with the token spans by binary search. Control strings inside roles and texts are escaped reversibly: every backslash
is doubled and a backslash is put after the first character of each control string, which no longer occurs then.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = ("n_turns long, formatted string, input_ids array<int>, loss_mask array<boolean>, "
          "loss_spans array<struct<start:long,end:long>>")


@dataclass(frozen=True)
class Template:
    """How a turn is marked: ``open role middle text close``."""

    open: str = "<|start|>"
    middle: str = "<|message|>"
    close: str = "<|end|>"
    trained: tuple[str, ...] = ("assistant",)
    #: Control strings of common chat formats that a text must not be able to imitate.
    reserved: tuple[str, ...] = ("<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|")

    def __post_init__(self):
        if any(len(c) < 2 or "\\" in c for c in self.controls):
            raise ValueError("control strings need two characters at least and no backslash")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.middle, self.close, *self.reserved)

    def escape(self, text: str) -> str:
        return _escaper(self.controls).sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a rendered conversation."""
        if not formatted:
            return []
        turns = formatted.removeprefix(self.open).removesuffix(self.close).split(self.close + self.open)
        return [tuple(self.unescape(x) for x in turn.split(self.middle, 1)) for turn in turns]


@lru_cache(8)
def _escaper(controls: tuple[str, ...]) -> re.Pattern:
    return re.compile("(?=" + "|".join(re.escape(c) for c in sorted(controls, key=len, reverse=True)) + ").", re.S)


def render(turns: list[tuple[str, str]], template: Template) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text and the spans of its trained texts, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        body = template.escape(text)
        head = f"{template.open}{template.escape(role)}{template.middle}"
        if role in template.trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{template.close}")
        at += len(parts[-1])
    return "".join(parts), spans


def intersect(token_ends: np.ndarray, spans: list[tuple[int, int]], token_begins: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Mask of the tokens that meet a span, and the characters they share with it.

    Token ``i`` covers what lies between its begin (by default the end of token ``i-1``) and its end; tokens and spans are sorted,
    so each span finds its first and last token by binary search. A token across a border is masked, but only its part inside
    counts; all tokens of a character inside are masked.
    """
    mask, kept = np.zeros(len(token_ends), bool), []
    if spans and len(token_ends):
        if token_begins is None:
            token_begins = np.append(0, token_ends[:-1])
        begins, ends = np.array(spans, np.int64).T
        first, beyond = np.searchsorted(token_ends, begins, "right"), np.searchsorted(token_begins, ends, "left")
        for a, b, i, j in zip(begins.tolist(), ends.tolist(), first.tolist(), beyond.tolist()):
            if a < b and i < j:
                mask[i:j] = True
                kept.append((max(a, int(token_begins[i])), min(b, int(token_ends[j - 1]))))
    return mask, kept


def read_back(mask: np.ndarray, token_begins: np.ndarray, token_ends: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the masked tokens cover of the spans by the tokenizer's own offsets, in order; parts of a span that touch are one.

    Begins and ends are sorted. A character of several tokens counts once, one of no masked token is left out.
    """
    begins, ends = token_begins[mask], token_ends[mask]
    kept = []
    for a, b in spans:
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(begins, b, "left"))
        if i < j:
            low, high = np.maximum(begins[i:j], a), np.maximum.accumulate(np.minimum(ends[i:j], b))
            cuts = np.flatnonzero(low[1:] > high[:-1])
            kept += zip(low[np.append(0, cuts + 1)].tolist(), high[np.append(cuts, -1)].tolist())
    return kept


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


def format_chats(chats: DataFrame, tokenizer_path: str, template: Template = Template(), id_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: turns, rendered text, token ids, loss mask per token, loss spans in code points.

    Turns are ordered by number, then role and text, so ties and repeated rows (which are all kept) have one result;
    null turn numbers come first, null roles and texts are empty, rows with a null id form one conversation. No rows give
    no rows. Other columns are ignored. ``loss_spans`` is read back from the masked tokens and their offsets: each trained text
    once, in order, without its neighbours, but for characters that the tokenizer drops.
    A conversation is one example and has to fit into a row.
    """
    turns = F.sort_array(F.collect_list(F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                                                 F.coalesce(F.col(text_col), F.lit("")).alias("text"))))
    whole = chats.groupBy(F.col(id_col).cast("long").alias("id")).agg(turns.alias("turns"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _tokenizer(tokenizer_path)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                talks = [[(t["role"], t["text"]) for t in turns] for turns in part.column("turns").to_pylist()]
                drawn = [render(t, template) for t in talks]
                rows = []
                for talk, (text, spans), found in zip(talks, drawn, made.encode_batch([t for t, _ in drawn], add_special_tokens=False)):
                    begins, ends = np.maximum.accumulate(np.array(found.offsets, np.int64).reshape(-1, 2), axis=0).T
                    mask, _ = intersect(ends, spans, begins)
                    rows.append((len(talk), text, found.ids, mask.tolist(), [{"start": a, "end": b} for a, b in read_back(mask, begins, ends, spans)]))
                kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))],
                                                 ["id", "n_turns", "formatted", "input_ids", "loss_mask", "loss_spans"])

    return whole.mapInArrow(encode, f"id long, {SCHEMA}").withColumnRenamed("id", id_col)
