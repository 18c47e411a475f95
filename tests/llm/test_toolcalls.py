import json
import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from octetloom.llm import toolcalls as tc

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, level int, content string"
RESULTS = "conv_id long, call_id string, turn long, content string, name string"
SCHEMA = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}


@given(st.dictionaries(st.sampled_from("abcdefg"), st.lists(st.sampled_from("abcdefgz"), max_size=3)))
def test_levels_are_longest_chains(calls):
    def depth(c, path=()):
        if c in path:
            return None
        below = [depth(d, (*path, c)) for d in calls[c] if d in calls]
        return None if None in below else 1 + max(below, default=-1)

    assert tc.levels(calls) == {c: depth(c) for c in calls}


@pytest.mark.parametrize(
    "value,schema,n",
    [
        ({"x": 1}, SCHEMA["f"], 0),
        ({"x": True}, SCHEMA["f"], 1),
        ({"x": 1.0}, SCHEMA["f"], 0),
        ({"x": -1, "y": 0}, SCHEMA["f"], 2),
        ({}, SCHEMA["f"], 1),
        ({"x": {"$ref": "a"}}, SCHEMA["f"], 0),
        ([], SCHEMA["f"], 1),
        ([1, "a"], {"type": "array", "items": {"type": "string"}}, 1),
        ("abc", {"type": ["string", "null"], "pattern": "^b", "maxLength": 2}, 2),
        (1, {"enum": [True, 2]}, 1),
    ],
)
def test_schema_errors(value, schema, n):
    assert len(tc.errors(value, schema)) == n


def depth_of(call, deps, path=()):
    """The longest chain below a call by walking all of them; None where one comes back."""
    if call in path:
        return None
    below = [depth_of(d, deps, (*path, call)) for d in deps[call] if d in deps]
    return None if None in below else 1 + max(below, default=-1)


def plain(calls, results):
    """What link_calls returns for SCHEMA and arguments {"x": …, "r": [references]}, said over again."""
    out, names = [], {(c[0], c[1]) for c in calls}
    for conv, i in names:
        mine = min((c[2:] for c in calls if c[:2] == (conv, i)), key=lambda c: (c[0], c[1], c[2]))
        met = sorted((r[2], r[3]) for r in results if r[:2] == (conv, i))
        deps = {}
        for other in {k[1] for k in names if k[0] == conv}:
            raw = min((c[2:] for c in calls if c[:2] == (conv, other)), key=lambda c: (c[0], c[1], c[2]))[2]
            deps[other] = re.findall(r'"\$ref": "(\w+)"', raw)
        turn, name, raw = mine
        if raw == "{":
            args, wrong = '"{"', ["$: not JSON"]
        else:
            value = json.loads(raw)
            args, wrong = json.dumps(value, sort_keys=True, separators=(",", ":")), []
            wrong += [] if isinstance(value["x"], int) else ["$.x: not integer"]
            wrong = (["$.r: not allowed"] if "r" in value else []) + wrong
        content = json.dumps(met[0][1]) if met else "null"
        message = f'{{"arguments":{args},"id":"{i}","name":"f","result":{content}}}'
        out.append((conv, i, turn, depth_of(i, deps), len(met), not wrong, "; ".join(wrong), message))
    for conv, i in {r[:2] for r in results} - names:
        met = sorted((r[2], r[3]) for r in results if r[:2] == (conv, i))
        out.append((conv, i, met[0][0], None, len(met), False, "$: no call", f'{{"arguments":null,"id":"{i}","name":null,"result":"{met[0][1]}"}}'))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [50_000, 3])
def test_links_and_levels_match_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(tc, "GROUP_CALLS", group)
    rng = random.Random(group)
    calls, results = [], []
    for conv in range(12):
        for t in range(rng.randrange(1, 8)):
            refs = [{"$ref": f"c{rng.randrange(9)}"} for _ in range(rng.randrange(0, 2))]
            args = rng.choice([json.dumps({"x": t, "r": refs}), json.dumps({"x": refs}), "{", json.dumps({"x": t})])
            calls.append((conv, f"c{rng.randrange(7)}", t, "f", args))
            if rng.random() < 0.7:
                results.append((conv, f"c{rng.randrange(8)}", t, f"r{t}"))
    got = tc.link_calls(spark.createDataFrame([(*c, None, None) for c in calls], CALLS), spark.createDataFrame([(*r, None) for r in results], RESULTS), SCHEMA)
    assert sorted(((r.conv_id, r.call_id, r.turn, r.level, r.n_results, r.valid, r.errors, r.message) for r in got.collect()), key=str) == plain(calls, results)


def test_messages_are_canonical_and_odd_rows_stay(spark):
    calls = [(1, "a", 0, "f", '{ "x": 1 }'), (1, "b", 1, "f", '{"z":NaN}'), (1, "é", 2, "g", '{"b":[1.50,null],"a":"\\u00e9"}'), (None, "n", 0, "f", None), (2, None, 0, "f", '{"x":2}')]
    results = [(1, "a", 5, "second"), (1, "a", 4, "first"), (1, "lost", 9, None), (None, "n", 3, "kept")]
    rows = tc.link_calls(spark.createDataFrame([(*c, None, None) for c in calls], CALLS), spark.createDataFrame([(*r, None) for r in results], RESULTS), SCHEMA).collect()
    got = sorted((str(r.conv_id), str(r.call_id), r.valid, r.n_results, r.message) for r in rows)
    assert got == sorted(
        [
            ("1", "a", True, 2, '{"arguments":{"x":1},"id":"a","name":"f","result":"first"}'),
            ("1", "b", False, 0, '{"arguments":"{\\"z\\":NaN}","id":"b","name":"f","result":null}'),
            ("1", "é", False, 0, '{"arguments":{"a":"é","b":[1.5,null]},"id":"é","name":"g","result":null}'),
            ("1", "lost", False, 1, '{"arguments":null,"id":"lost","name":null,"result":null}'),
            ("None", "n", False, 0, '{"arguments":null,"id":"n","name":"f","result":null}'),
            ("None", "n", False, 1, '{"arguments":null,"id":"n","name":null,"result":"kept"}'),
            ("2", "None", True, 0, '{"arguments":{"x":2},"id":null,"name":"f","result":null}'),
        ]
    )
    none = spark.createDataFrame([], CALLS)
    assert tc.link_calls(none, spark.createDataFrame([], RESULTS), SCHEMA).count() == 0


def test_halves_of_surrogate_pairs_stay_escaped(spark):
    odd = '{"x":"\\ud800","\\udfff":[{"$ref":"\\ud800"},{"$ref":"b"}],"ok":"\\ud83d\\ude00"}'
    calls = [(1, "a", 0, "f", odd), (1, "b", 1, "f", '{"x":1}'), (1, "\\ud800", 2, "f", '{"x":1}')]
    rows = tc.link_calls(spark.createDataFrame([(*c, None, None) for c in calls], CALLS), spark.createDataFrame([(1, "a", 3, "\\ud800", None)], RESULTS), SCHEMA).collect()
    a = next(r for r in rows if r.call_id == "a")
    assert a.level == 1 and not a.valid and a.errors.startswith("$.ok: not allowed; $.x: not integer; $.\\udfff: not allowed")
    said = json.loads(a.message)
    assert said["arguments"] == json.loads(odd) and said["result"] == "\\ud800" and "😀" in a.message


def test_a_chain_of_200_000_calls(spark):
    rows = spark.range(200_000).selectExpr("1L AS conv_id", "cast(id AS string) AS call_id", "CASE WHEN id > 0 THEN array(cast(id - 1 AS string)) ELSE array() END AS deps")
    levels = tc._levels_by_joins(rows)
    assert levels.count() == 200_000 and levels.where("level IS NULL OR level <> cast(call_id AS int)").count() == 0


def test_deep_chains_keep_their_order(spark, monkeypatch):
    monkeypatch.setattr(tc, "GROUP_CALLS", 3)
    monkeypatch.setattr(tc, "MAX_ROUNDS", 5, raising=False)
    chain = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(3000)}
    ring = {f"r{i}": [f"r{(i + 1) % 5}"] for i in range(5)} | {"above": ["r0", "c7"], "self": ["self"]}
    ladder = {f"l{i}": [f"l{j}" for j in (i - 1, i - 2) if j >= 0] for i in range(9)} | {"fork": ["l8", "c2000"], "onto": ["fork"]}
    calls = chain | ring | ladder
    rows = spark.createDataFrame([(1, c, deps) for c, deps in calls.items()], "conv_id long, call_id string, deps array<string>")
    assert {r.call_id: r.level for r in tc._levels_by_joins(rows).collect()} == tc.levels(calls)
