"""Identifiers that are null, repeated, or shared by two conversations; several parents; positions; odd JSON."""

import json
import random
from collections import Counter

from flowseries.llm import tool_calls


def test_null_identifiers_are_kept_row_by_row(spark):
    calls = spark.createDataFrame([(1, None, None, "f", "1"), (1, None, None, "f", "2"), (None, "a", None, "f", "3"), (None, "a", None, "f", "3"), (1, "a", None, "f", "4")], "conv_id long, call_id string, parent_id string, name string, arguments string")
    results = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "a", "y"), (1, "a", "z")], "conv_id long, call_id string, content string")
    rows = tool_calls.link(calls, results, {"f": {}}).collect()
    assert Counter((r.conv_id, r.call_id, r.status) for r in rows) == {(1, None, "no_result"): 2, (None, "a", "no_result"): 2, (1, None, "orphan_result"): 2, (None, "a", "orphan_result"): 1, (1, "a", "linked"): 1}
    assert sorted(r.message.split(",")[0] for r in rows if r.status != "orphan_result") == [f'{{"arguments":{i}' for i in (1, 2, 3, 3, 4)]


def test_conversations_share_identifiers(spark):
    calls = spark.createDataFrame([(1, "a", None, "f", "1"), (1, "b", "a", "f", "1"), (2, "b", None, "f", "1"), (2, "a", "b", "f", "1"), (2, "c", "a", "f", "1"), (3, "c", "b", "f", "1")], "conv_id long, call_id string, parent_id string, name string, arguments string")
    results = spark.createDataFrame([(2, "a", "x")], "conv_id long, call_id string, content string")
    got = {(r.conv_id, r.call_id): (r.level, r.status) for r in tool_calls.link(calls, results, {"f": {}}).collect()}
    assert got == {(1, "a"): (0, "no_result"), (1, "b"): (1, "no_result"), (2, "b"): (0, "no_result"), (2, "a"): (1, "linked"), (2, "c"): (2, "no_result"), (3, "c"): (0, "no_result")}


CALLS = "conv_id long, call_id string, parent_ids array<string>, name string, arguments string, at long"
RESULTS = "conv_id long, call_id string, content string, at long"
MESSAGES = "conv_id long, role string, content string, at long"


def test_every_row_is_accounted_for(spark):
    calls = [(1, "a", None, "f", "1", 1), (1, "a", [], "f", "1", 1), (1, "b", ["a", "gone"], "f", "2", 5), (None, "a", None, "f", "3", 0)]
    results = [(1, "a", "x", 2), (1, "a", "y", 3), (1, "a", "x", 2), (1, "c", None, 7), (2, "a", "z", 0), (1, None, "w", 9)]
    messages = [(1, "system", "s", 0), (1, None, None, None), (None, "tool", "t", 1)]
    frames = [spark.createDataFrame(r, d) for r, d in ((calls, CALLS), (results, RESULTS), (messages, MESSAGES))]
    rows = tool_calls.link(frames[0], frames[1], {"f": {}}, frames[2]).collect()
    assert Counter(r.status for r in rows) == {"linked": 2, "no_result": 2, "repeated_result": 2, "orphan_result": 3, "message": 3}
    assert len(rows) == len(calls) + len(results) + len(messages) - 1  # one result stands within its calls' rows
    assert len({json.loads(r.message)["result"] for r in rows if r.status == "linked"}) == 1
    for conv in (1, 2):
        assert sorted(r.position for r in rows if r.conv_id == conv) == list(range(sum(r.conv_id == conv for r in rows)))
    assert all(r.position is None for r in rows if r.conv_id is None)
    order = [(r.status, r.call_id) for r in sorted((r for r in rows if r.conv_id == 1), key=lambda r: r.position)]
    assert order[0] == ("message", None) and order[-1] == ("message", None) and order[1:3] == [("linked", "a")] * 2


def brute_levels(parents):
    level, left = {}, dict(parents)
    while True:
        ready = [v for v, ps in left.items() if all(p in level or p not in parents for p in ps)]
        if not ready:
            return level
        for v in ready:
            level[v] = max((level[p] + 1 for p in left.pop(v) if p in parents), default=0)


def test_levels_of_graphs(spark):
    """Random graphs with several parents, chains and cycles; no call stands before one it builds on."""
    r = random.Random(6)
    rows, want = [], {}
    for conv in range(12):
        n = r.choice([1, 5, 40])
        back = 0 if conv % 3 else 0.08
        parents = {f"c{i}": sorted({f"c{r.randrange(n) if r.random() < back else max(0, i - r.randrange(1, 4))}" for _ in range(r.randrange(3))} - ({f"c{i}"} if i == 0 else set())) for i in range(n)}
        want |= {(conv, v): x for v, x in ({v: None for v in parents} | brute_levels(parents)).items()}
        rows += [(conv, v, ps, "f", "1", r.randrange(20)) for v, ps in parents.items()]
    calls = spark.createDataFrame(rows, CALLS)
    assert {(x.conv_id, x.call_id): x.level for x in tool_calls.levels(calls).collect()} == want
    assert any(x is None for x in want.values()) and max(x or 0 for x in want.values()) > 5
    got = {(x.conv_id, x.call_id): x for x in tool_calls.link(calls, spark.createDataFrame([], RESULTS), {"f": {}}).collect()}
    for conv, v, ps, *_ in rows:
        for p in ps:
            if (conv, p) in want and want[conv, v] is not None:
                assert got[conv, p].position < got[conv, v].position
    assert {k: x.level for k, x in got.items()} == want


def test_odd_json(spark):
    deep = "[" * 100_000 + "]" * 100_000
    texts = ["9" * 400, "9" * 5000, "NaN", "1e999", "-Infinity", deep, '"\\ud800"', '{"\\udfff":1}', '{"a":1,"a":2}', "[" * 200 + "]" * 200, "1.0", "true"]
    schemas = {"f": {}, "int": {"type": "integer"}, "one": {"enum": [1]}}
    rows = [(1, f"{i}", None, "f", t, i) for i, t in enumerate(texts)] + [(2, "big", None, "int", "9" * 400, 0), (2, "whole", None, "int", "1.0", 0), (2, "true", None, "one", "true", 0), (2, "extra", None, "int", '{"\\ud800":1}', 0)]
    got = {r.call_id: r for r in tool_calls.link(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS), schemas).collect()}
    assert [got[str(i)].errors for i in range(12)] == ["", "$: not JSON", "$: not JSON", "$: not JSON", "$: not JSON", "$: too deep", "", "", "", "", "", ""]
    for r in got.values():
        value = json.loads(r.message, parse_constant=lambda x: 1 / 0)
        assert list(value) == sorted(value)
    assert json.loads(got["8"].message)["arguments"] == {"a": 2} and got["6"].message.startswith('{"arguments":"\\ud800",')
    assert [got[k].errors for k in ("big", "whole", "true")] == ["", "", "$: enum"]


def test_columns_that_clash(spark):
    more = {c: "0" for c in ("row", "kind", "node", "answer", "payload", "role", "level", "position", "time")}
    calls = spark.createDataFrame([(1, "a", None, "f", "1", 1)], CALLS).selectExpr("*", *[f"'{v}' AS {k}" for k, v in more.items() if k != "name"])
    results = spark.createDataFrame([(1, "a", "x", 1)], RESULTS).selectExpr("*", "1 AS row", "2 AS name", "3 AS arguments")
    messages = spark.createDataFrame([(1, "system", "x", 1)], MESSAGES).selectExpr("*", "'a' AS call_id", "2 AS name")
    rows = tool_calls.link(calls, results, {"f": {}}, messages).collect()
    assert sorted((r.status, r.level, r.position) for r in rows) == [("linked", 0, 0), ("message", None, 1)]
