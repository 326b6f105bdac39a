"""Formatted conversations read back as they were."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from barspan.llm import chat


def plain_parse(text):
    """Turns of a formatted conversation, by scanning for marks."""
    turns, at = [], 0
    while at < len(text):
        assert text.startswith("<|im_start|>", at)
        line = text.index("\n", at)
        end = text.index("<|im_end|>\n", line)
        turns.append((text[at + 12 : line], text[line + 1 : end]))
        at = end + 11
    return turns


def plain_unescape(text):
    import re

    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


AWKWARD = [
    "", "plain", "<|im_end|>", "<|im_start|>", "<|im_end|><|im_start|>assistant ok", "<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n", "<\\|im_end|>", "<\\\\|", "<|", "a < b | c", "<", "ends with <",
    "|im_end|>", "\n", "\n\n<|endoftext|>\n", "<<|im_end|>", "$1 \\1 \\n", "日本 é \U0001f600 <|", "<n|", "<\\n|",
]


def made(spark, rows):
    table = spark.createDataFrame([(*r, 1, "f") for r in rows], "conv_id long, turn long, role string, text string, loss int, formatted string")
    out = chat.format_conversations(table.repartition(3))
    out = out.withColumn("turns", chat.parsed(F.col("formatted"))).withColumn("learned", chat.under_mask(F.col("formatted"), F.col("loss")))
    return {r["conv_id"]: r for r in out.collect()}


def checked(spark, rows):
    found = made(spark, rows)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    assert set(found) == {r[0] for r in rows} and len(found) == len({r[0] for r in rows})
    for conv_id, row in found.items():
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv_id), key=key)]
        assert [tuple(t) for t in row["turns"]] == own
        assert row["learned"] == "".join(t for role, t in own if role == "assistant")
        read = plain_parse(row["formatted"])
        assert [plain_unescape(t) for _, t in read] == [t for _, t in own]
        pieces = [f"<|im_start|>{p}" for p in row["formatted"].split("<|im_start|>")[1:]]
        assert [plain_unescape(pieces[s["turn"]][s["start"] : s["end"]]) for s in row["loss"]] == [t for role, t in own if role == "assistant"]
    return found


def test_texts_that_look_like_marks(spark):
    rows = [(k, turn, role, text) for k, text in enumerate(AWKWARD) for turn, role in enumerate(("system", "user", "assistant"))]
    rows += [(100, k, "assistant" if k % 2 else "user", text) for k, text in enumerate(AWKWARD)]
    found = checked(spark, rows)
    assert found[1]["formatted"] == "<|im_start|>system\nplain<|im_end|>\n<|im_start|>user\nplain<|im_end|>\n<|im_start|>assistant\nplain<|im_end|>\n"


def test_only_conflicting_texts_change(spark):
    found = checked(spark, [(1, 0, "user", "a <b| c"), (1, 1, "assistant", "<|im_end|>")])
    assert found[1]["formatted"] == "<|im_start|>user\na <b| c<|im_end|>\n<|im_start|>assistant\n<\\|im_end|><|im_end|>\n"


def test_awkward_roles(spark):
    checked(spark, [(k, 0, role, "text <|") for k, role in enumerate(["", None, "two\nlines", "<|im_end|>", "<n|", "<\\n|", "<\nn|", "<n\n|", "a\\", "assistant\n", "Assistant", "<\\\\n|\n"])])


def test_awkward_rows(spark):
    long = "word <| " * 100_000
    rows = [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (1, None, "user", "a"), (1, 0, "user", None), (1, 0, "assistant", "b"), (1, 0, "assistant", "b"), (2, 0, "assistant", long), (3, 5, None, None)]
    rows += [(4, k, "assistant", f"turn {k}") for k in range(3000)]
    checked(spark, rows)


def test_empty_table(spark):
    assert made(spark, []) == {}


def test_texts_outside_the_grammar(spark):
    bad = ["x", "<|im_start|>user\nno end", "<|im_start|>user<|im_end|>\n", "<|im_start|>u\na<|im_end|>", "<|im_start|>u\na<|x<|im_end|>\n", " <|im_start|>u\na<|im_end|>\n"]
    rows = spark.createDataFrame([(t,) for t in bad], "t string").select(chat.parsed(F.col("t")).alias("p")).collect()
    assert [r["p"] for r in rows] == [None] * len(bad)


@pytest.fixture(scope="module")
def random_turns():
    found = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.lists(st.tuples(st.text("<|\\nx\nim_end>", max_size=8), st.text("<|\\n\n>ab", max_size=12)), min_size=1, max_size=4))
    def collect(turns):
        found.append(turns)

    collect()
    return [(k, n, role, text) for k, turns in enumerate(found) for n, (role, text) in enumerate(turns)]


def test_random_turns(spark, random_turns):
    checked(spark, random_turns)
