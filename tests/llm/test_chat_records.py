"""Records that cannot be read as turns end no job; they are counted as unmapped."""

from __future__ import annotations

import json

from loomframe.llm import chat

GOOD = json.dumps({"messages": [{"role": "user", "content": "c \\ 😀"}]})
PAIRED = '{"prompt": "\\ud83d\\ude00"}'
ODD = [
    "[" * 100_000 + "]" * 100_000, '{"prompt": "\\ud800"}', '{"messages": [{"role": "u", "content": "c"}, []]}', '{"messages": [{"role": "u", "content": "c"}, {}]}',
    '{"a": ' * 900 + "1" + "}" * 900, "{", None, "3", '{"messages": {"role": "u", "content": "c"}}',
]


def test_unreadable_records(spark):
    records = [GOOD, PAIRED, *ODD]
    df = spark.createDataFrame(list(enumerate(records)), "n int, record string")
    found = {(r.n, r.role, r.text) for r in chat.canonical_turns(df, "record").collect()}
    assert found == {(0, "user", "c \\ 😀"), (1, "user", "😀"), (5, "u", "c"), (5, "", "")}
    assert sum(r.records for r in chat.unmapped(df, "record").collect()) == len(ODD) - 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "n int, record string")
    assert chat.canonical_turns(df, "record").count() == 0 and chat.unmapped(df, "record").count() == 0
