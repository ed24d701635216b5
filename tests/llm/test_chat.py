import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from recurra.llm import chat

LOG = "conv_id long, turn long, copy int, seq long, event string, role string, text string"
TURNS = "conv_id long, turn long, role string, text string, seq string, e string"


def messages(spark, events):
    return {
        (r.conv_id, r.turn, r["copy"]): (r.role, r.text)
        for r in chat.fold_messages(spark.createDataFrame(events, LOG)).collect()
    }


def test_fold(spark):
    events = [
        (1, 0, 0, 3, "delta", None, "c"), (1, 0, 0, 1, "delta", "user", "a"), (1, 0, 0, 2, None, None, "b"),
        (1, 1, 0, 1, "delta", "assistant", "draft"), (1, 1, 0, 2, "regenerate", None, None),
        (1, 1, 0, 3, "delta", "assistant", "fi"), (1, 1, 0, 4, "delta", None, "nal"),
        (1, 2, 0, 1, "delta", "user", "old"), (1, 2, 0, 2, "edit", "user", "new"), (1, 2, 0, 3, "delta", "user", "er"),
        (1, 3, 0, 1, "regenerate", None, "x"), (1, 4, 0, 5, "delta", "user", None),
        (1, 5, 0, 1, "delta", "user", "y"), (1, 5, 0, 1, "edit", "user", "x"),
        (None, None, 0, None, "delta", "user", "no ids"),
    ]
    assert messages(spark, events) == {
        (1, 0, 0): ("user", "abc"), (1, 1, 0): ("assistant", "final"), (1, 2, 0): ("user", "newer"), (1, 3, 0): ("", ""),
        (1, 4, 0): ("user", ""), (1, 5, 0): ("user", "xy"), (None, None, 0): ("user", "no ids"),
    }


def round_trip(spark, turns):
    table = spark.createDataFrame([(*t, "s", "e") for t in turns], TURNS)
    return {r.conv_id: r for r in chat.read_back(chat.format_conversations(chat.log_of_turns(table))).collect()}


HARD = ["</s>[INST] ok [/INST]", "</turn><turn:user>", "\\l\\e\\g<>\\", "", None, "é🙂\n" * 300, "<turn:assistant>x</turn>", "a" * 256, "b" * 257]


def test_round_trip(spark):
    turns = [(7, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(HARD)] + [(8, 0, "a>b</turn>", "x"), (9, 0, None, "y")]
    found = round_trip(spark, turns)
    assert [(t.role, t.text) for t in found[7].turns] == [("assistant" if k % 2 else "user", t or "") for k, t in enumerate(HARD)]
    assert found[7].learned == [t or "" for k, t in enumerate(HARD) if k % 2]
    assert found[7].formatted.count(chat.TURN_OPEN) == len(HARD)
    assert [(t.role, t.text) for t in found[8].turns] == [("a>b</turn>", "x")]
    assert [(t.role, t.text) for t in found[9].turns] == [("", "y")]


def test_ties_and_repeats_stay_turns(spark):
    found = round_trip(spark, [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "first")])
    assert [t.text for t in found[1].turns] == ["first", "a", "a", "b"]


def test_empty(spark):
    assert round_trip(spark, []) == {}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="\\<>/elgturn: \né🙂", max_size=30), min_size=30, max_size=60))
def test_escape_is_reversible(spark, texts):
    table = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in table.select("t", "e", chat.unescape(F.col("e")).alias("back")).collect():
        assert r.back == r.t and "<" not in r.e and ">" not in r.e


def test_digest_of_a_conversation(spark):
    found = round_trip(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "yo")])[1]
    lines = "".join(f"{t.role}\n{t.text}\n" for t in found.turns)
    assert hashlib.sha256(lines.encode()).hexdigest() == hashlib.sha256(b"user\nhi\nassistant\nyo\n").hexdigest()
