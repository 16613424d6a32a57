"""Tool calls on inputs that JSON, UTF-8 or the stack can't hold, and long chains of references."""

import json
import random
from collections import Counter

import pytest

from slipspark.llm import tool_calls

CALL = "conv_id long, turn long, call_id string, name string, arguments string"
RESULT = "conv_id long, turn long, call_id string, content string"
DEEP = '{"query": ' + "[" * 3000 + "]" * 3000 + "}"
#: arguments of a search, and what must be wrong with them
ODD = {
    '{"query": NaN}': ["$: no JSON"],
    '{"query": -Infinity}': ["$: no JSON"],
    '{"query": 1e400}': ["$: no JSON"],
    '{"query": "\\ud800"}': ["$: not text"],
    '{"\\udfff": 1, "query": "x"}': ["$: not text"],
    DEEP: ["$: nested too deep"],
    '{"query": ' + "[" * 120 + "]" * 120 + "}": ["$: nested too deep"],
    '{"query": ' + '{"a":' * 90 + "1" + "}" * 90 + "}": ["$.query: not of type string"],
    "[" * 100_000: ["$: no JSON", "$: nested too deep"],
    "1" * 5000: ["$: no JSON"],
    '{"query": "x", "limit": 3.0}': [],
    '{"query": "x", "limit": 3.5}': ["$.limit: not of type integer"],
    '{"query": "x", "limit": true}': ["$.limit: not of type integer"],
    '{"query": "x", "limit": 51.0}': ["$.limit: above maximum"],
    '{"query": "x", "other": 1}': ["$.other: not known"],
    "null": ["$: no object"],
    "": ["$: no JSON"],
    '{"query": "\\u0000 \\ud83d\\ude00"}': [],
}


def linked(spark, calls, results=(), schemas=tool_calls.SCHEMAS):
    return tool_calls.link(spark.createDataFrame(list(calls), CALL), spark.createDataFrame(list(results), RESULT), schemas)


def test_no_input_ends_the_job(spark):
    rows = [(1, i, f"c{i}", "search", text) for i, text in enumerate(ODD)]
    got = {r.turn: r for r in linked(spark, rows).collect()}
    assert len(got) == len(ODD)
    for i, (text, errors) in enumerate(ODD.items()):
        r = got[i]
        assert r.errors == errors or r.errors in [[e] for e in errors], text[:60]
        value, _ = tool_calls.parsed(text)
        body = {"id": f"c{i}", "status": "open", "name": "search", "arguments": value, "errors": r.errors}
        assert r.line == json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert (value is None) == (r.arguments is None)


def test_schemas_are_checked_first(spark):
    for schema in ({"type": "date"}, {"type": "object", "properties": {"a": {"type": "text"}}}, {"items": "x"}):
        with pytest.raises(ValueError):
            linked(spark, [], schemas={"t": schema})


def brute_levels(refs):
    """Level of each call: longest way down its references; none in or behind a cycle."""
    level = {}
    for _ in range(len(refs) + 1):
        level = {c: 1 + max((level[n] for n in needs), default=-1) for c, needs in refs.items() if all(n in level for n in needs)}
    return level


@pytest.mark.parametrize("one_pass", [100_000, 0, 30])
def test_levels(spark, monkeypatch, one_pass):
    monkeypatch.setattr(tool_calls, "ONE_PASS", one_pass)
    rng = random.Random(one_pass)
    rows, want = [], Counter()
    for conv in range(6):
        refs = {f"c{i}": {f"c{rng.randrange(12 if conv % 2 else max(1, i))}" for _ in range(rng.randrange(4))} - ({f"c{i}"} if conv % 2 else set()) for i in range(12)}
        refs["c0"] = set() if conv % 3 else {"c11"}
        rows += [(conv, i, c, "search", json.dumps({"query": "q", "after": [{"$ref": n} for n in sorted(needs)]})) for i, (c, needs) in enumerate(refs.items())]
        level = brute_levels(refs)
        want.update((conv, c, level.get(c, -1)) for c in refs)
    got = linked(spark, rows).select("conv_id", "call_id", "level").collect()
    assert Counter(tuple(r) for r in got) == want


def test_a_long_chain_is_one_pass(spark):
    refs = [(1, i, f"c{i}", "search", json.dumps({"query": "q", "after": {"$ref": f"c{i - 1}"}} if i else {"query": "q"})) for i in range(3000)]
    got = linked(spark, refs).select("turn", "level").collect()
    assert all(r.turn == r.level for r in got) and len(got) == 3000
