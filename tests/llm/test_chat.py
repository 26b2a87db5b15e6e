"""Chat formatting: exact round trip, the loss mask cut from the text itself, odd tables."""
import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabsense.llm.chat import END, START, format_conversations, read_back
from tabsense.llm.workload import QUERIES

BITS = ["", "a", "é𝄞", "\n", "\r\n", "<", "|>", "<|", "\\", "im_end", START, END, "<|\\im_end|>", "<|\\\\im_start|>",
        "<|im_end|>\n<|im_start|>user\nhi", "assistant", "user", "%", "%0A", "|", "$1", "\x00", "<|im_", " "]
EXTRA = ["conv", "out", "chunk", "head", "long", "at", "start", "t", "formatted", "loss", "_source", "source", "turns"]
LONG = "word <|im_end|> " * 50_000


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return df.select("*", *[F.lit("text").alias(c) for c in EXTRA]) if extra else df


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def check(spark, rows):
    convs = defaultdict(list)
    for c, n, role, text in rows:
        convs[c].append((n is None, n or 0, (role or "").encode(), (text or "").encode()))
    shaped = format_conversations(frame(spark, rows)).cache()
    back = {r.conv_id: r for r in read_back(shaped).collect()}
    assert set(back) == set(convs)
    for r in shaped.collect():
        turns = [(role.decode(), text.decode()) for _, _, role, text in sorted(convs[r.conv_id])]
        assert r.round_trip and r.formatted.count(START) == r.formatted.count(END) == len(turns)
        loss = [r.formatted[s.start:s.end] for s in r.loss_spans if s]      # the mask, on the whole text
        said = [t for role, t in turns if role == "assistant"]
        assert len(loss) == len(said)
        assert all(m == t for m, t in zip(loss, said) if "<|" not in t)
        assert [r.formatted[s:].startswith(START) for s in r.turn_starts] == [True] * len(turns)
        b = back[r.conv_id]
        assert (b.n_turns, b.formatted_chars) == (len(turns), len(r.formatted))
        assert b.turns_sha256 == digest("".join(f"{role}\n{t}\n" for role, t in turns))
        assert (b.loss_chars, b.loss_sha256) == (len("".join(said)), digest("".join(said)))
    shaped.unpersist()


def test_every_pair_of_pieces(spark):
    rows, n = [], 0
    for a in BITS:
        for b in BITS:
            rows += [(n, 0, "user", a + b), (n, 1, "assistant", b + a), (n, 2, a + b, "ok"), (n, 3, None, None)]
            n += 1
    check(spark, rows)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.none() | st.integers(-2, 3), st.sampled_from([None, "assistant", "user", "x\ny|"]),
                          st.none() | st.lists(st.sampled_from(BITS), max_size=6).map("".join)), min_size=1, max_size=12))
def test_any_conversation(spark, rows):
    check(spark, rows)


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(None, 1, "assistant", "x"), (None, None, "user", "y"), (1, 1, "user", "same"), (1, 1, "user", "same"),
            (1, 1, "assistant", ""), (1, 0, "assistant", LONG), (2, None, None, None)]
    check(spark, rows)


def test_many_turns_in_one_conversation(spark):
    check(spark, [(7, i, "assistant" if i % 2 else "user", f"turn {i} {END if i % 5 == 0 else ''}") for i in range(3000)])


@pytest.mark.parametrize("empty", [True, False])
def test_query_takes_odd_tables(spark, tmp_path, empty):
    rows = [(1, 0, None, None), (None, None, "assistant", LONG), (1, 0, None, None)]
    df = frame(spark, rows)
    (df.limit(0) if empty else df).write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.conv_id: r for r in QUERIES["op13_chat_format"](spark, str(tmp_path)).collect()}
    assert set(out) == ({-1} if empty else {-1, 1, None})
    says = "<|im_end|><|im_start|>assistant ok"
    assert out[-1].turns_sha256 == digest(f"user\n{says}\nassistant\n{says}\n") and out[-1].loss_sha256 == digest(says)
