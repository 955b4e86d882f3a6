"""Chat formatting round trip on awkward content."""

import hashlib
import random

from pyspark.sql import functions as F

from flowloom.llm import op8_chat

PARTS = ["<|im_start|>", "<|im_end|>", "\n", "<|", "<\\|", "<\\\\|", "|", "\\", "<", "assistant", "é🙂", " ", ""]


def rows_of(seed=3, n=60):
    rng = random.Random(seed)
    out = [(None, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", None), (2, 5, "a\n|b\\n\\p", "x"), (3, 0, "assistant", "y" * 200_000)]
    for conv in range(10, 10 + n):
        for turn in range(rng.randrange(1, 6)):
            text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(6)))
            out.append((conv, turn, rng.choice(["user", "assistant", "sys\\n", "<|im_end|>\n"]), text))
    return out


def test_round_trip_and_mask(spark):
    rows = rows_of()
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    formatted = op8_chat.format_conversations(frame)
    got = {r.conv_id: r for r in op8_chat.digest(formatted).collect()}
    texts = {r.conv_id: r for r in formatted.collect()}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        want = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        row = got[conv]
        assert row.turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (row.n_turns, row.loss_chars, row.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        text = texts[conv].formatted
        assert row.formatted_chars == len(text) and text.count("<|") == 2 * len(turns)
        spans = [text[s.start : s.end] for s in texts[conv].loss_spans]
        undo = spark.createDataFrame([(s,) for s in spans], "s string").select(op8_chat.unescape_text(F.col("s"))).collect() if spans else []
        assert "".join(r[0] for r in undo) == loss


def test_malformed_text_is_not_a_turn(spark):
    bad = spark.createDataFrame([("<|im_start|>user\na<|im_start|>b<|im_end|>\n",), ("junk<|im_end|>\n",)], "t string")
    assert all(r[0][0].role is None for r in bad.select(op8_chat.parse(F.col("t"))).collect())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op8_chat.digest(op8_chat.format_conversations(empty)).count() == 0
