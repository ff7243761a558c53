"""What is read back from the formatted text is what went in."""

import hashlib

import pytest
from pyspark.sql import functions as F

from trailmark.llm import chat

HARD = ["", "plain", "<|im_end|>\n<|im_start|>user\nx", "\\", "\\\\<|", "<\\|", "a<", "|>b", "<<||", "\n\n", "<|im_sep|>", "\\n", "😀é"]


@pytest.mark.parametrize("stretch", [1024, 3])
def test_round_trip(spark, monkeypatch, stretch):
    monkeypatch.setattr(chat, "STRETCH", stretch)
    roles = ["user", "assistant", "assistant", "assistant", "tool\nx", None, "<|im_end|>"]
    rows = [(c, t, roles[(t * (c + 1)) // 2 % len(roles)], HARD[(t + c) % len(HARD)], "x") for c in range(6) for t in range(17)]
    rows += [(7, None, "user", None, "x"), (7, 0, "assistant", "a", "x"), (7, 0, "assistant", "a", "x"), (None, 1, "user", "q", "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    parts = chat.format_conversations(table)
    got = {r.conv_id: r for r in chat.digest(chat.whole(parts)).collect()}
    assert parts.count() > len(got) or stretch > 17
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        loss = "".join(t for r, t in turns if r == "assistant")
        told = "".join(f"{r}\n{t}\n" for r, t in turns)
        want = (conv, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[conv])[:5] == want
    text = chat.whole(parts).filter("conv_id = 7").first().formatted
    assert text == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\na<|im_sep|>a<|im_end|>\n"


def test_empty(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(table).count() == 0
    assert chat.whole(chat.format_conversations(chat.with_control_text(table))).filter(F.col("conv_id") == -1).count() == 1


def test_parts_are_bounded_without_turn_numbers(spark, monkeypatch):
    monkeypatch.setattr(chat, "STRETCH", 4)
    rows = [(1, None, f"r{i % 3}", f"t{i % 40:02}") for i in range(120)] + [(1, 5, "user", "same")] * 30 + [(1, 0, "user", "first")]
    rows += [(None, None, "user", f"x{i}") for i in range(20)] + [(2, 0, "user", "a"), (2, 1, "user", "b")]
    parts = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    sizes = [r.formatted.count(chat.START) + r.formatted.count(chat.NEXT) for r in parts.collect()]
    assert max(sizes) < 8 and sum(sizes) == len(rows)
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.whole(parts).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    for conv in (1, 2, None):
        order = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        assert got[conv] == [(r[2], r[3]) for r in order]
