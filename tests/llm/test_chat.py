"""Chat formatting: exact round trips."""

import random

import brute
import pytest
from knowspark.llm import chat_format as C

TEMPLATE = C.Template()
PIECES = [*TEMPLATE.controls, "\\", "\\:", "\\\\", "<", "[", "</", "/s>", "S>>", "\n", " ", "ok", "é", ":"]


def test_escape_round_trip():
    rnd, pattern = random.Random(1), TEMPLATE.pattern()
    for _ in range(3000):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 8)))
        for closing in (" [/INST]", "</s>", "[/ROLE] "):
            out = TEMPLATE.escape(text, closing, pattern)
            assert TEMPLATE.unescape(out) == text
            assert pattern.search(out + closing).start() == len(out) + closing.index(
                closing.strip()[0])


def test_read_back(spark):
    rnd = random.Random(2)
    roles = ["user", "assistant", "system", "tool", "", None, "odd [/ROLE] role"]
    rows = [(c, t, rnd.choice(roles), rnd.choice([None, "", "".join(
        rnd.choice(PIECES) for _ in range(rnd.randint(1, 6)))])) for c in range(40) for t in range(c % 6)]
    rows += [(None, 1, "user", "nobody's"), (None, None, "user", "first"), (50, 2, "user", "b"),
             (50, 2, "user", "a"), (50, 2, "user", "a"), (51, 0, "user", "w " * 200_000)]
    frame = spark.createDataFrame([(*r, 7) for r in rows],
                                  "conv_id long, turn long, role string, text string, valid int")
    formatted = C.format_turns(frame.repartition(5))
    got = {r.conv_id: r for r in C.read_back(formatted).collect()}
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for conv, turns in groups.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        lost = "".join(t for _, _, r, t in turns if r == "assistant")
        assert got[conv][1:5] == (len(turns), brute.sha(said), len(lost), brute.sha(lost))


def test_turn_order(spark):
    orders = {1: "user assistant user", 2: "system user assistant", 3: "assistant user",
              4: "user user", 5: "system", 6: "user system", 7: "user assistant assistant user"}
    rows = [(c, t, r, "x") for c, o in orders.items() for t, r in enumerate(o.split())]
    got = C.read_back(C.format_turns(spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string"))).collect()
    assert {r.conv_id for r in got if r.valid} == {1, 2, 5}


def test_segments_put_the_turn_together(spark):
    frame = spark.createDataFrame(
        [(1, 0, "user", "a </s> b"), (1, 1, "assistant", "é[INST]")],
        "conv_id long, turn long, role string, text string")
    formatted = C.format_turns(frame)
    parts = C.segments(formatted).orderBy("turn", "place").collect()
    for r in formatted.collect():
        mine = [p for p in parts if p.turn == r.turn]
        assert "".join(p.text for p in mine) == r.formatted
        assert [p.loss for p in mine] == [False, r.turn == 1, False]


def test_empty_table_and_bad_template(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.read_back(C.format_turns(none)).collect() == []
    with pytest.raises(ValueError):
        C.Template(turns={"user": ("no control", "</s>", False)})
