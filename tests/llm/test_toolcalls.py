from __future__ import annotations

import json
import random

import pytest

from tokentally.llm import toolcalls

SCHEMAS = [("f", "a", "string", True), ("f", "n", "number", False)]


def schemas(spark):
    return spark.createDataFrame(SCHEMAS, "name string, property string, type string, required boolean")


def messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def call(i, needs=(), name="f", args=None):
    return {"id": i, "name": name, "arguments": {"a": "x"} if args is None else args, "depends_on": list(needs)}


def longest(needs):
    """Levels by brute force; None on or behind a cycle."""
    out = {}

    def walk(c, path):
        if c in path:
            return None
        if c not in out:
            below = [walk(d, path | {c}) for d in needs[c] if d in needs]
            value = None if None in below else 1 + max(below, default=-1)
            if path and value is None:
                return None
            out[c] = value
        return out[c]

    return {c: walk(c, frozenset()) for c in needs}


@pytest.mark.parametrize("most", [1, 3])
def test_levels(spark, most):
    rng = random.Random(most)
    rows, want = [], {}
    for conv in range(12):
        n = rng.randrange(1, 25)
        needs = {f"c{i}": rng.sample([f"c{j}" for j in range(-1, n) if j != i], min(n, rng.randrange(0, most + 1))) for i in range(n)}
        if conv == 0:  # a long chain
            needs = {f"c{i}": [f"c{i - 1}"] for i in range(40)}
        rows += [(conv, i, "assistant", json.dumps({"tool_calls": [call(c, d)]})) for i, (c, d) in enumerate(needs.items())]
        want |= {(conv, c): level for c, level in longest(needs).items()}
    got = {(r.conv_id, r.call_id): r.level for r in toolcalls.levels(toolcalls.parse_calls(messages(spark, rows))).collect()}
    assert got == want


def test_links_and_errors(spark):
    rows = [
        (1, 0, "assistant", json.dumps({"tool_calls": [call("a", args={"n": 1, "a": "é\n"}), call("b", ["a"], args={"n": "1", "z": None}), call("c", name="g"), call(None), call("d", args='["no object"]')]})),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "ok"})), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "late"})), (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": "orphan"})),
        (1, 4, "assistant", json.dumps({"tool_calls": [call("a", args={"a": "again"})]})), (1, 5, "assistant", "plain words"), (1, 6, "assistant", None), (None, 1, "assistant", json.dumps({"tool_calls": [call("q")]})), (2, 0, "assistant", '{"tool_calls": broken'),
    ]
    df = messages(spark, rows).selectExpr("*", "1 AS level", "'x' AS record")  # clashing names
    got = {r.call_no: r for r in toolcalls.link_tool_calls(df, schemas(spark)).collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    assert (got[0].result, got[0].result_turn, got[0].valid, got[0].level) == ("ok", 1, True, 0)
    assert (got[1].errors, got[1].level, got[1].result) == ("missing:a;type:n;unknown:z", 1, None)
    assert got[2].errors == "tool" and got[3].call_id is None and got[3].valid and got[4].errors == "json"
    assert got[0].record == '{"arguments":{"a":"é\\n","n":1},"conv_id":1,"errors":"","id":"a","level":0,"name":"f","result":"ok","turn":0}'


def test_nothing_is_dropped(spark):
    one = lambda *calls: json.dumps({"tool_calls": list(calls)})
    result = lambda i, text: json.dumps({"tool_call_id": i, "content": text})
    rows = [
        (1, 0, "assistant", one(call("a"), call("b", ["a"]))), (1, 1, "tool", result("a", "r1")), (1, 1, "tool", result("a", "r1")), (1, 2, "tool", result("a", "late")), (1, 3, "tool", result("zz", "lost")),
        (1, 4, "assistant", one(call("a", ["b"], args={"a": "again"}))), (1, 4, "assistant", one(call("a", ["b"], args={"a": "again"}))), (1, 5, "tool", result("a", "r2")),
        (1, 6, "assistant", one(call("a", args={"a": 1}), call("a", args={"a": "x", "n": 2}))), (1, 7, "tool", result("a", "r3")), (1, 8, "tool", result("a", "r4")),
        (2, None, "assistant", one(call("a", args={"n": 1}))), (2, 3, "assistant", one(call("b", ["b"]))), (2, 1, "tool", result("b", "early")),
    ]
    got = toolcalls.link_all(messages(spark, rows), schemas(spark)).collect()
    want = {
        (1, 0, 0, "a", 0, "", "r1", 1), (1, 0, 1, "b", 1, "", None, 1), (1, 4, 0, "a", 2, "", "r2", 2), (1, 6, 0, "a", 0, "type:a", "r3", 3), (1, 6, 1, "a", 0, "", "r4", 4),
        (1, None, None, "a", None, "duplicate", "late", None), (1, None, None, "zz", None, "orphan", "lost", None), (2, None, 0, "a", 0, "missing:a", None, 1), (2, 3, 0, "b", None, "", "early", 1),
    }
    assert {(r.conv_id, r.turn, r.call_no, r.call_id, r.level, r.errors, r.result, r.occurrence) for r in got} == want and len(got) == len(want)
    lost = next(r for r in got if r.errors == "orphan")
    assert lost.record == '{"arguments":null,"conv_id":1,"errors":"orphan","id":"zz","level":null,"name":null,"result":"lost","turn":null}' and not lost.valid and lost.result_turn == 3


def test_empty(spark):
    assert toolcalls.link_tool_calls(messages(spark, []), schemas(spark)).count() == 0
    assert toolcalls.link_tool_calls(messages(spark, [(1, 1, "user", "x"), (1, 1, "user", "x")]), schemas(spark)).count() == 0


def kind_of(v):
    return next(n for n, t in (("boolean", bool), ("integer", int), ("number", float), ("string", str), ("null", type(None)), ("object", dict), ("array", list)) if isinstance(v, t))


def broken(name, text):
    """What a call's arguments break, said plainly."""
    own = {p: (t, r) for n, p, t, r in SCHEMAS if n == name}
    if not own:
        return "tool"
    try:
        given = json.loads(text)
    except ValueError:
        return "json"
    if not isinstance(given, dict):
        return "json"
    out = [f"unknown:{p}" for p in given if p not in own]
    for p, (t, required) in own.items():
        if p not in given:
            out += [f"missing:{p}"] * required
        elif kind_of(given[p]) != t and (kind_of(given[p]), t) != ("integer", "number"):
            out.append(f"type:{p}")
    return ";".join(sorted(out))


def linked(rows):
    """link_all() by brute force: (conv, turn, call_no, id, level, errors, result, occurrence) of every call and every result left over."""
    first = -(10**9)
    calls, results = [], []
    for conv, turn, role, text in sorted(set(rows), key=repr):
        if role == "assistant" and conv is not None:
            calls += [{"conv": conv, "turn": turn, "no": n, "of": first if turn is None else turn, "result": None, **c} for n, c in enumerate(json.loads(text)["tool_calls"])]
        elif role == "tool" and conv is not None:
            results.append((conv, turn, first if turn is None else turn, *json.loads(text).values()))
    out = []
    for c in calls:
        c["arguments"] = json.dumps(c["arguments"])
        c["seen"] = 1
    groups = {}
    for c in calls:
        if c["id"] is not None:
            groups.setdefault((c["conv"], c["id"]), []).append(c)
    for own in groups.values():
        own.sort(key=lambda c: (c["of"], c["no"], c["name"]))
        for k, c in enumerate(own, 1):
            c["seen"] = k
    waiting = {}
    for conv, _, at, i, content in sorted(results, key=lambda r: (r[2], r[4])):
        own = groups.get((conv, i))
        if not own:
            out.append((conv, None, None, i, None, "orphan", content, None))
            continue
        turn = max([c["of"] for c in own if c["of"] <= at], default=own[0]["of"])
        waiting.setdefault((conv, i, turn), []).append(content)
    for (conv, i, turn), contents in waiting.items():
        own = [c for c in groups[conv, i] if c["of"] == turn]
        for c, content in zip(own, contents, strict=False):
            c["result"] = content
        out += [(conv, None, None, i, None, "duplicate", content, None) for content in contents[len(own) :]]
    needs = {}
    for n, c in enumerate(calls):
        c["n"] = n
    for c in calls:
        needs[c["n"]] = []
        for d in c["depends_on"]:
            own = groups.get((c["conv"], d), [])
            if own:
                needs[c["n"]].append(([o for o in own if (o["of"], o["no"]) < (c["of"], c["no"])] or own[:1])[-1]["n"])
    level = longest(needs)
    return sorted(map(repr, out + [(c["conv"], c["turn"], c["no"], c["id"], level[c["n"]], broken(c["name"], c["arguments"]), c["result"], c["seen"]) for c in calls]))


@pytest.mark.parametrize("largest", [toolcalls.LARGEST_GROUP, 2])
def test_against_a_plain_linker(spark, largest):
    """Also with ids that more rows name than one task orders."""
    rng = random.Random(17)
    arguments = [{"a": "x"}, {"a": 1}, {"n": 1.5, "a": "y"}, {"a": "x", "n": "1"}, {"z": None}, {"a": None}, [1], "text", {"a": "x", "n": 3}, {"a": {"b": 1}, "n": [1]}]
    rows = []
    for conv in range(25):
        for k in range(rng.randrange(1, 14)):
            turn = rng.choice([None, k // 2, k])
            own = [call(rng.choice([None, "a", "b", "c", f"u{k}"]), rng.sample(["a", "b", "c", "u0", "u1", "u2", "u3", "gone"], rng.choice([0, 0, 1, 1, 2])), f"{rng.choice('fffg')}", rng.choice(arguments)) for _ in range(rng.randrange(1, 3))]
            # The order among calls of one id, turn and number is free: their names and arguments tell them apart.
            text = json.dumps({"tool_calls": own})
            if not any(t == turn and json.loads(x)["tool_calls"][n]["id"] == c["id"] is not None for v, t, r, x in rows if v == conv and r == "assistant" for n, c in enumerate(own) if n < len(json.loads(x)["tool_calls"])):
                rows += [(conv, turn, "assistant", text)] * rng.choice([1, 1, 2])
            rows += [(conv, rng.choice([None, k, k + 1]), "tool", json.dumps({"tool_call_id": rng.choice(["a", "b", "c", f"u{k}", "gone"]), "content": f"r{conv}.{k}"}))] * rng.choice([0, 1, 2])
    rows.append((None, 1, "assistant", json.dumps({"tool_calls": [call("a")]})))
    rng.shuffle(rows)
    got = toolcalls.link_all(messages(spark, rows), schemas(spark), largest).collect()
    assert sorted(repr((r.conv_id, r.turn, r.call_no, r.call_id, r.level, r.errors, r.result, r.occurrence)) for r in got) == linked(rows)
    assert all(r.valid == (r.errors == "") for r in got)


def test_one_id_for_all_rows(spark):
    """One conversation calls one id in all its turns, many times in one of them: the ranges it is cut into split turns too, and go on counting."""
    rng = random.Random(3)
    rows = []
    for k in range(150):
        turn = 7 if k % 3 else k
        rows.append((1, turn, "assistant", json.dumps({"tool_calls": [call("call_0", ["call_0"], args={"a": str(k)}), call("call_0", name=f"g{k}")]})))
        rows += [(1, rng.choice([None, 7, 8, k]), "tool", json.dumps({"tool_call_id": rng.choice(["call_0", "call_0", "gone"]), "content": f"r{k}.{n}"})) for n in range(2)]
    got = toolcalls.link_all(messages(spark, rows), schemas(spark), largest=20).collect()
    whole = toolcalls.link_all(messages(spark, rows), schemas(spark)).collect()
    shown = lambda rs: sorted(repr((r.turn, r.call_no, r.level, r.errors, r.result, r.occurrence)) for r in rs)
    assert shown(got) == shown(whole) and sorted(r.occurrence for r in got if r.call_no is not None) == list(range(1, 301))
    assert sorted(r.result for r in got if r.result) == sorted(json.loads(t)["content"] for _, _, role, t in rows if role == "tool")


def test_equal_places_and_missing_ids(spark):
    """Calls of two messages of one turn keep their own errors; a call without an id has a level, and counts once however often its message comes."""
    one = lambda *calls: json.dumps({"tool_calls": list(calls)})
    lone = (1, 3, "assistant", one(call(None, ["b"], args={"a": 1})))
    rows = [(1, None, "assistant", one(call("a", args={"a": 1}))), (1, 2, "assistant", one(call("b", ["a"]))), (1, 2, "assistant", one(call("c", args={"n": "x"}))), lone, lone, (1, 9, "assistant", one(call("long", args={"a": "word " * 60_000}))), (1, 10, "tool", json.dumps({"tool_call_id": "long", "content": "out " * 60_000}))]
    got = {r.call_id: r for r in toolcalls.link_all(messages(spark, rows), schemas(spark)).collect()}
    assert {k: (r.level, r.errors) for k, r in got.items()} == {"a": (0, "type:a"), "b": (1, ""), "c": (0, "missing:a;type:n"), None: (2, "type:a"), "long": (0, "")}
    assert json.loads(got["long"].record)["arguments"]["a"] == "word " * 60_000 and got["long"].result == "out " * 60_000
    assert toolcalls.link_all(messages(spark, rows), schemas(spark)).count() == 5


def test_a_deep_graph_with_one_joint(spark):
    """Chains are looked through by doubling also where a call of theirs has several dependencies."""
    needs = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(200)}
    needs["c100"] = ["c99", "c3"]
    needs |= {"x": ["y"], "y": ["x"], "z": ["x", "c5"], "after": ["z"]}
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": [call(c, d) for c, d in needs.items()]}))]
    got = {r.call_id: r.level for r in toolcalls.levels(toolcalls.parse_calls(messages(spark, rows))).collect()}
    assert got == {**{f"c{i}": i for i in range(200)}, "x": None, "y": None, "z": None, "after": None}


def test_query_keeps_results_without_a_call(spark, tmp_path):
    """The registered query against its SQL, with a null turn, orphans and a gap in the turns."""
    import duckdb

    rows = [(1, 0, "user", "hello you"), (1, 1, "assistant", "one two three"), (1, 2, "user", "thanks"), (1, 5, "user", "nobody asked"), (1, None, "assistant", "out of turn"), (1, None, "user", "lost"), (2, 4, "user", "alone"), (2, 3, "system", "rules"), (3, 1, "assistant", None), (3, 2, "user", "late"), (None, 1, "assistant", "no conversation")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    df = toolcalls.tool_calls_query(spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({toolcalls.SQL})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)) and sum(r[7] == "orphan" for r in want) == 4
