import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vicinage.llm import chat

CASES = {
    1: [("user", "hello"), ("assistant", "hi\nthere")],
    2: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")],
    3: [("system", "<</SYS>>"), ("user", "\\l \\s \\\\b"), ("assistant", "a\\"), ("tool", "<<TEXT>>x<</ROLE>>"), (None, None), ("assistant", "")],
    4: [("assistant", "<<A>>"), ("user", "x[/INST]<<A>>y</s>"), ("user", ""), ("a<b[c\\", "<s>")],
    5: [("assistant", "[INST]"), ("user", "plain [/INST] text")],
    6: [("user", "漢字 😀 <3 [ok] 50% \\o/")],
}


def rows(cases):
    return [(c, k, r, t, "x") for c, turns in cases.items() for k, (r, t) in enumerate(turns)]


def check(spark, cases):
    df = spark.createDataFrame(rows(cases), "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_conversations(df)
    assert all(r["exact"] for r in formatted.collect())
    for r in chat.digest(formatted).collect():
        turns = [(a or "", b or "") for a, b in cases[r["conv_id"]]]
        said = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_chars"] == len(said) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    return formatted


def test_round_trip(spark):
    levels = {r["conv_id"]: r["level"] for r in check(spark, CASES).collect()}
    assert levels[1] == 0 and levels[2] > 0 and levels[6] == 0


def test_loss_spans_hold_the_answers(spark):
    for r in check(spark, CASES).select("conv_id", "formatted", chat.loss_spans(chat.F.col("formatted")).alias("s")).collect():
        said = []
        for s in r["s"]:
            text = r["formatted"][s["start"] : s["start"] + s["length"]]
            for mark, code in reversed(chat.CODES):
                text = text.replace(code, mark)
            said.append(text)
        assert said == [t or "" for role, t in CASES[r["conv_id"]] if role == "assistant"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool"]), st.text(alphabet="<>[]/\\slbINTASY ", max_size=14)), min_size=1, max_size=4), min_size=30, max_size=60))
def test_any_text(spark, turns):
    check(spark, dict(enumerate(turns)))


def test_empty_and_order(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.digest(chat.format_conversations(spark.createDataFrame([], schema))).count() == 0
    same = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 1, "user", "x")], schema)
    assert {r["conv_id"]: r["n_turns"] for r in chat.digest(chat.format_conversations(same)).collect()} == {1: 3, None: 1}


@pytest.mark.parametrize("text", ["\\", "<", "[", "\\s\\l\\b", "a\\sb<[\\\\"])
def test_escape_is_reversible(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(chat.escape(chat.F.col("t")).alias("e"), chat.unescape(chat.escape(chat.F.col("t"))).alias("u"))
    r = df.first()
    assert r["u"] == text and "<" not in r["e"] and "[" not in r["e"]
