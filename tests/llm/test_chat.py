"""Layouts, and exact round trips of hostile texts."""

import hashlib
import json
import random

import pytest

from modgauge.llm import chat


def turns_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_layouts_give_the_same_turns(spark):
    listed = "conv_id bigint, {0} array<struct<{1}: string, {2}: string>>"
    said = [("user", "q"), ("assistant", "a")]
    tables = [
        turns_of(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "a")]),
        spark.createDataFrame([(1, said, "x")], listed.format("messages", "role", "content") + ", source string"),
        spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], listed.format("conversations", "from", "value")),
        spark.createDataFrame([("q", "a", 1, 5)], "prompt string, response string, conv_id bigint, messages int"),
        spark.createDataFrame([("q", "a", 1)], "prompt string, completion string, conv_id bigint"),
        spark.createDataFrame([(1, "q", "", "a")], "conv_id bigint, instruction string, input string, output string"),
    ]
    for table in tables:
        got = sorted(map(tuple, chat.canonical_turns(table).collect()))
        assert got == [(1, 0, "user", "q"), (1, 1, "assistant", "a")], table.schema
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_turns(spark.createDataFrame([(1, "q")], "conv_id bigint, question string"))


def test_only_one_layout_has_role_names_of_its_own(spark):
    said = [("human", "q"), ("model", "a")]
    plain = turns_of(spark, [(1, 0, *said[0]), (1, 1, *said[1])])
    messages = spark.createDataFrame([(1, said)], "conv_id bigint, messages array<struct<role: string, content: string>>")
    for table in (plain, messages):
        assert [r.role for r in chat.canonical_turns(table).orderBy("turn").collect()] == ["human", "model"]
    own = spark.createDataFrame([(1, said)], "conv_id bigint, conversations array<struct<`from`: string, value: string>>")
    assert [r.role for r in chat.canonical_turns(own).orderBy("turn").collect()] == ["user", "assistant"]


def test_json_records_of_mixed_layouts(spark):
    records = [
        {"conv_id": 1, "messages": [{"role": "user", "content": "q"}], "extra": {"a": 1}},
        {"conv_id": 2, "prompt": "p", "completion": "c"},
        {"conv_id": 3, "conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": None}]},
        {"conv_id": 4, "unheard": "of"},
    ]
    lines = [(json.dumps(r),) for r in records] + [("no json",), (None,)]
    got = chat.json_turns(spark.createDataFrame(lines, "json string")).collect()
    known = sorted((r.conv_id, r.layout, r.turn, r.role, r.text) for r in got if r.layout)
    assert known == [
        (1, "messages", 0, "user", "q"),
        (2, "prompt and completion", 0, "user", "p"),
        (2, "prompt and completion", 1, "assistant", "c"),
        (3, "from and value", 0, "human", "h"),
        (3, "from and value", 1, "gpt", None),
    ]
    assert sum(r.layout is None for r in got) == 3


def test_everything_comes_back(spark):
    rng = random.Random(11)
    parts = ["\\", "###", "#", "</turn>", "</", ": ", ":", "\n", "é漢🙂", " user", "assistant", "\\\\", "$1"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        role = rng.choice(["user", "assistant", "assistant", "a: \\b</turn>", None, ""])
        rows.append((i % 7 if i % 9 else None, i // 7, role, text if i % 11 else None))
    rows += [(50, 0, "assistant", "\\" * 100_000 + "###" * 50_000), (51, None, "x:" * 20_000, "t"), (51, None, "x:" * 20_000, "t")]
    output = chat.formatted(chat.canonical_turns(turns_of(spark, rows)))
    back = chat.read_back(output).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2], r[3])
    expected = sorted(((a, b, c or "", d or "") for a, b, c, d in rows), key=key)
    assert sorted((tuple(r)[:4] for r in back), key=key) == expected
    assert all(r.learned == (r.text if r.role == "assistant" else None) for r in back)
    digests = {r.conv_id: r for r in chat.digests(chat.read_back(output)).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in expected if r[0] == conv), key=order)
        everything = "".join(f"{r[2]}\n{r[3]}\n" for r in own)
        learned = "".join(r[3] for r in own if r[2] == "assistant")
        d = digests[conv]
        assert (d.n_turns, d.loss_chars) == (len(own), len(learned))
        assert d.turns_sha256 == hashlib.sha256(everything.encode()).hexdigest()
        assert d.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    # No piece holds a control string that is not the template's own.
    for r in output.collect():
        inner = r.piece[4 : -len("</turn>\n")].replace("\\\\", "")
        assert "</turn>" not in inner.replace("\\</turn>", "") and "###" not in inner.replace("\\###", "")


def test_empty_table(spark):
    none = turns_of(spark, [(1, 1, "user", "x")]).limit(0)
    assert chat.digests(chat.read_back(chat.formatted(chat.canonical_turns(none)))).collect() == []
