"""Chat formatting: round trips, masks and odd rows."""

import hashlib
import random

import numpy as np
import pytest
from tidewatch.llm import chat, queries

from tests.llm.helpers import SF

PATH = queries.vocabulary("byte_bpe_50k.json")


def test_escaping_is_reversible_and_hides_controls():
    template, rng = chat.Template(), random.Random(1)
    parts = [*template.controls, "<", "|", "\\", "[", "s>", "a", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        hidden = template.escape(text)
        assert template.unescape(hidden) == text and not any(c in hidden for c in template.controls)
        turns = [("user", text), ("assistant", hidden), (text, "")]
        assert template.parse(chat.render(turns, template)[0]) == turns


def test_spans_meet_tokens_by_search():
    mask, kept = chat.intersect(np.array([3, 5, 9, 12]), [(0, 0), (4, 8), (9, 12)])
    assert mask.tolist() == [False, True, True, True] and kept == [(4, 8), (9, 12)]


def test_loss_is_what_masked_tokens_cover():
    """By characters: a trained one counts if a masked token's offsets hold it; broken offsets show in the text."""
    template, made, rng = chat.Template(), chat._tokenizer(PATH), random.Random(2)
    words = ["日本", " 😀é", "plain", " two  spaces ", "</s>", "\\", "\n", "e\u0301"]
    for _ in range(200):
        turns = [(rng.choice(("user", "assistant")), "".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for _ in range(rng.randint(1, 5))]
        text, spans = chat.render(turns, template)
        offsets = np.array(made.encode(text, add_special_tokens=False).offsets, np.int64)
        mask, _ = chat.intersect(offsets[:, 1], spans, offsets[:, 0])
        trained = {i for a, b in spans for i in range(a, b)}
        assert mask.tolist() == [any(i in trained for i in range(a, b)) for a, b in offsets.tolist()]
        assert chat.read_back(mask, *offsets.T, spans) == [s for s in spans if s[0] < s[1]]
        for kept, begins, ends in ((mask, offsets[:, 0] + 1, offsets[:, 1] + 1), (np.zeros_like(mask), *offsets.T), (mask & (np.arange(len(mask)) % 2 == 0), *offsets.T)):
            held = {i for a, b in zip(begins[kept].tolist(), ends[kept].tolist()) for i in range(a, b)} & trained
            got = chat.read_back(kept, begins, ends, spans)
            assert [i for a, b in got for i in range(a, b)] == sorted(held)
    assert chat.read_back(np.array([True, True]), np.array([0, 5]), np.array([4, 9]), [(1, 8)]) == [(1, 4), (5, 8)]  # a dropped character


def test_odd_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, id string, turns string"
    rows = [(1, 0, "user", "hi", "x", "y"), (1, 1, "assistant", None, "x", "y"), (1, 2, "assistant", "ok </s>", "x", "y"), (1, 2, "assistant", "ok </s>", "x", "y"),
            (2, None, None, "<|start|>", "x", "y"), (None, 0, "assistant", "z" * 50_000, "x", "y"), (3, 0, "assistant", "日本 😀", "x", "y")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, schema), PATH).collect()}
    template = chat.Template()
    for conv, turns in ((1, [("user", "hi"), ("assistant", ""), ("assistant", "ok </s>"), ("assistant", "ok </s>")]), (2, [("", "<|start|>")]),
                        (None, [("assistant", "z" * 50_000)]), (3, [("assistant", "日本 😀")])):
        row = got[conv]
        assert row.n_turns == len(turns) and template.parse(row.formatted) == turns and len(row.input_ids) == len(row.loss_mask)
        assert "".join(template.unescape(row.formatted[s.start:s.end]) for s in row.loss_spans) == "".join(t for r, t in turns if r == "assistant")
    assert chat.format_chats(spark.createDataFrame([], schema), PATH).count() == 0
    assert any(got[1].loss_mask) and not all(got[1].loss_mask) and not any(got[2].loss_mask)


def test_query_reads_back_every_conversation(spark):
    want: dict = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    want[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in queries.op1_chat_formatting(spark, SF).collect()}
    assert set(got) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].loss_chars) == (len(turns), len(loss))
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_controls_need_two_characters():
    with pytest.raises(ValueError):
        chat.Template(open="|")
