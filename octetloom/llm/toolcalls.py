"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

Calls and results meet in a hash join by conversation and identifier. A call may
refer to another's result by ``{"$ref": identifier}`` anywhere in its arguments;
its level is the length of the longest chain of such references, so that level,
turn and identifier give a topological order. Arguments are checked against the
schema of the called tool and written as canonical JSON: sorted keys, no blanks,
characters as they are.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octetloom.llm.common import materialised

#: Calls of one conversation that a task may order at a time; larger conversations are ordered by joins.
GROUP_CALLS = 50_000

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


_LONE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """Canonical JSON; halves of surrogate pairs, which UTF-8 cannot hold, stay escaped."""
    return _escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _escaped(text: str) -> str:
    return _LONE.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def _constant(name: str):
    raise ValueError(f"{name} is not JSON")


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    return isinstance(value, _TYPES[kind])


def errors(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value by a JSON schema (type, enum, bounds, lengths, pattern, required, properties, additionalProperties, items). A reference stands for any value."""
    if isinstance(value, dict) and set(value) == {"$ref"} and at != "$":
        return []
    out = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and not any(value == e and type(value) is type(e) for e in schema["enum"]):
        out.append(f"{at}: not one of those allowed")
    if _is(value, "number"):
        if value < schema.get("minimum", value):
            out.append(f"{at}: below {schema['minimum']}")
        if value > schema.get("maximum", value):
            out.append(f"{at}: above {schema['maximum']}")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: too long")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: does not match")
    if isinstance(value, dict):
        named = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in named:
                out += errors(value[k], named[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += errors(v, schema["items"], f"{at}[{i}]")
    return out


def references(value) -> list[str]:
    """The identifiers that a value refers to, each once, sorted; one with half a surrogate pair can name no call."""
    found, todo = set(), [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if set(v) == {"$ref"} and isinstance(v["$ref"], str):
                found.add(v["$ref"])
            todo += v.values()
        elif isinstance(v, list):
            todo += v
    return sorted(f for f in found if not _LONE.search(f))


def levels(calls: dict[str, list[str]]) -> dict[str, int | None]:
    """The longest chain of references below each call; None on a cycle or above one. Unknown identifiers don't count."""
    waits = {c: sum(d in calls for d in set(deps)) for c, deps in calls.items()}
    users: dict[str, list[str]] = {}
    for c, deps in calls.items():
        for d in set(deps):
            if d in calls:
                users.setdefault(d, []).append(c)
    level: dict[str, int | None] = dict.fromkeys(calls)
    ready = [(0, c) for c, n in waits.items() if not n]
    heapq.heapify(ready)
    while ready:
        n, c = heapq.heappop(ready)
        level[c] = n
        for u in users.get(c, []):
            waits[u] -= 1
            if not waits[u]:
                heapq.heappush(ready, (1 + max(level[d] for d in calls[u] if d in calls), u))
    return level


def _parsed(schemas: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            args, deps, wrong = [], [], []
            for name, raw in zip(b.column("name").to_pylist(), b.column("arguments").to_pylist()):
                try:
                    value = json.loads(raw or "", parse_constant=_constant)
                    args.append(canonical(value))
                    deps.append(references(value))
                    wrong.append([_escaped(e) for e in errors(value, schemas[name])] if name in schemas else ["$: unknown tool"])
                except (ValueError, RecursionError):
                    args.append(canonical(raw))
                    deps.append([])
                    wrong.append(["$: not JSON"])
            keep = [b.column(c) for c in ("conv_id", "call_id", "turn", "name")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(args, pa.string()), pa.array(deps, pa.list_(pa.string())), pa.array(["; ".join(w) for w in wrong], pa.string())], ["conv_id", "call_id", "turn", "name", "arguments", "deps", "errors"])

    return run


def _level_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation to a level for each of its identifiers."""

    def out(conv, group) -> pa.RecordBatch:
        found = levels(group)
        return pa.RecordBatch.from_arrays([pa.array([conv] * len(found), pa.int64()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int32())], ["conv_id", "call_id", "level"])

    now, group, held = None, {}, []
    for b in batches:
        for conv, call, deps in zip(*(c.to_pylist() for c in b.columns)):
            if conv != now and group:
                held.append(out(now, group))
                group = {}
                if len(held) >= 500:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held = []
            now = conv
            group[call] = deps
    if group:
        held.append(out(now, group))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _fresh(df: DataFrame) -> DataFrame:
    """``df`` materialised without its size estimate, which checkpoints keep: as a product over joins it would double its digits each round."""
    return materialised(df.sparkSession.createDataFrame(df.rdd, df.schema, verifySchema=False))


def _levels_by_joins(nodes: DataFrame) -> DataFrame:
    """The same for conversations of any size.

    A call's level is the greatest of its ``floor`` and of ``steps`` plus the
    level of each call it still waits for. Each round puts the levels found into
    the floors, and where a call waits for one that itself waits for a single
    other, skips to that other: steps add up, so chains and trees halve and take
    as many rounds as the log of their depth. A round that finds no call without
    waits leaves only calls on or above a cycle.
    """
    key = ["conv_id", "call_id"]
    edges = nodes.select(*key, F.explode(F.array_distinct("deps")).alias("dep"), F.lit(1).cast("long").alias("steps"))
    edges = materialised(edges.join(nodes.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_semi").select(*key, "dep", "steps"))
    state, done, n = materialised(nodes.select(*key, F.lit(0).cast("long").alias("floor"))), None, 0
    # Steps around a cycle double without end; no chain is as long as the bound.
    bounded = lambda c: F.when(c > 1 << 40, 1 << 40).otherwise(c)
    while True:
        waits = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("dep").alias("next"), F.max("steps").alias("more"))
        state = _fresh(state.select(*key, "floor").join(waits, key, "left"))
        found = state.where(F.col("n").isNull()).select("conv_id", F.col("call_id").alias("dep"), F.col("floor").alias("level"))
        if found.isEmpty():
            break
        ready = found.select("conv_id", F.col("dep").alias("call_id"), F.col("level").cast("int").alias("level"))
        done = ready if done is None else done.unionByName(ready)
        n += 1
        if n % 32 == 0:
            done = materialised(done)
        state = state.where(F.col("n").isNotNull())
        single = state.where("n = 1").select("conv_id", F.col("call_id").alias("dep"), F.col("floor").alias("via"), "next", "more")
        met = edges.join(found, ["conv_id", "dep"], "left").join(single, ["conv_id", "dep"], "left")
        # A skip also hands on the floor of the call it passes; what it leads to may be ready by now.
        met = met.select(*key, bounded(F.col("steps") + F.coalesce("level", "via")).alias("least"), F.when(F.col("level").isNull(), F.coalesce("next", "dep")).alias("dep"), bounded(F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        met = met.join(found.withColumnRenamed("level", "end"), ["conv_id", "dep"], "left")
        met = _fresh(met.select(*key, F.greatest("least", F.col("steps") + F.col("end")).alias("least"), F.when(F.col("end").isNull(), F.col("dep")).alias("dep"), "steps"))
        state = state.select(*key, "floor").join(met.groupBy(*key).agg(F.max("least").alias("least")), key, "left").select(*key, F.greatest("floor", "least").alias("floor"))
        edges = _fresh(met.where(F.col("dep").isNotNull()).groupBy(*key, "dep").agg(F.max("steps").alias("steps")))
    rest = state.select(*key, F.lit(None).cast("int").alias("level"))
    return rest if done is None else done.unionByName(rest)


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call and per result without a call.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON); ``results``:
    conv_id, call_id, turn, content. Returned: conv_id, call_id, turn, name, level
    (null on or above a cycle), n_results, valid, errors and message (canonical
    JSON of arguments, id, name and result). Of calls that repeat an identifier
    the first by turn, name and arguments stays; of several results the first by
    turn and content is linked and all are counted; a result without a call has no
    name and is not valid. Null conversations or identifiers match nothing but are
    kept; arguments that are null or not JSON are kept as a string and not valid;
    of a key that repeats in an object the last counts; an empty table gives an
    empty result. Other columns are ignored.
    """
    calls = calls.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("call_id").cast("string").alias("call_id"), F.col("turn").cast("long").alias("turn"), F.col("name").cast("string").alias("name"), F.col("arguments").cast("string").alias("arguments"))
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = F.min(F.struct("turn", "name", "arguments")).alias("c")
    once = calls.where(known).groupBy("conv_id", "call_id").agg(first).select("conv_id", "call_id", "c.*").unionByName(calls.where(~known))
    parsed = materialised(once.mapInArrow(_parsed(schemas), "conv_id long, call_id string, turn long, name string, arguments string, deps array<string>, errors string"))
    nodes = parsed.where(known).select("conv_id", "call_id", "deps")
    big = materialised(nodes.groupBy("conv_id").count().where(F.col("count") > GROUP_CALLS).select("conv_id"))
    small, found = nodes, None
    if not big.isEmpty():
        small = nodes.join(big, "conv_id", "left_anti")
        found = _levels_by_joins(materialised(nodes.join(big, "conv_id", "left_semi")))
    level = small.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(_level_rows, "conv_id long, call_id string, level int")
    level = level if found is None else level.unionByName(found)
    results = results.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("call_id").cast("string").alias("call_id"), F.col("turn").cast("long").alias("r_turn"), F.col("content").cast("string").alias("content"))
    met = results.where(known).groupBy("conv_id", "call_id").agg(F.min(F.struct("r_turn", "content")).alias("r"), F.count("*").alias("n_results"))
    alone = results.where(~known).select("conv_id", "call_id", F.struct("r_turn", "content").alias("r"), F.lit(1).cast("long").alias("n_results"))
    joined = parsed.join(level, ["conv_id", "call_id"], "left").join(met, ["conv_id", "call_id"], "full").unionByName(alone, allowMissingColumns=True)
    joined = joined.select("conv_id", "call_id", F.coalesce("turn", "r.r_turn").alias("turn"), "name", "arguments", "errors", "level", F.coalesce("n_results", F.lit(0)).alias("n_results"), F.col("r.content").alias("content"))

    def serialised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for call_id, name, args, content in zip(*(b.column(c).to_pylist() for c in ("call_id", "name", "arguments", "content"))):
                out.append(f'{{"arguments":{"null" if args is None else args},"id":{canonical(call_id)},"name":{canonical(name)},"result":{canonical(content)}}}')
            keep = [b.column(c) for c in ("conv_id", "call_id", "turn", "name", "level", "n_results")]
            wrong = [e if e is not None else "$: no call" for e in b.column("errors").to_pylist()]
            yield pa.RecordBatch.from_arrays([*keep, pa.array([not w for w in wrong], pa.bool_()), pa.array(wrong, pa.string()), pa.array(out, pa.string())], ["conv_id", "call_id", "turn", "name", "level", "n_results", "valid", "errors", "message"])

    return joined.mapInArrow(serialised, "conv_id long, call_id string, turn long, name string, level int, n_results long, valid boolean, errors string, message string")


SCHEMAS = {
    "configure": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}}, "additionalProperties": False},
    "reply": {
        "type": "object",
        "required": ["text", "turn"],
        "properties": {"after": {"type": "string"}, "text": {"type": "string", "minLength": 1, "maxLength": 300}, "turn": {"type": "integer", "minimum": 0}},
        "additionalProperties": False,
    },
}


def op7_tool_calls(spark, sf_dir: str) -> DataFrame:
    """Every conversation as calls: a system turn configures, a user turn asks for a reply after the one before it, and what the assistant says next is the result."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    name = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    turn, user = F.col("turn"), F.col("role") == "user"
    after = F.when(turn >= 2, F.struct(name(turn - 2).alias("$ref")))
    args = F.when(user, F.to_json(F.struct("text", "turn", after.alias("after")))).otherwise(F.to_json(F.struct("text")))
    calls = talk.where(F.col("role").isin("user", "system")).select("conv_id", name(turn).alias("call_id"), "turn", F.when(user, "reply").otherwise("configure").alias("name"), args.alias("arguments"))
    results = talk.where(F.col("role") == "assistant").select("conv_id", name(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return link_calls(calls, results, SCHEMAS)


ORACLE_SQL = """
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, role, text, 'call-' || turn AS call_id,
    CASE WHEN role = 'user' THEN 'reply' ELSE 'configure' END AS name,
    CASE WHEN role = 'user' AND turn >= 2 THEN 'call-' || (turn - 2) END AS dep
  FROM conversations WHERE role IN ('user', 'system')),
calls AS (
  SELECT *, '{' || array_to_string(list_filter([
      '"after":{"$ref":"' || dep || '"}', '"text":' || to_json(text), CASE WHEN role = 'user' THEN '"turn":' || turn END], lambda x: x IS NOT NULL), ',') || '}' AS arguments,
    array_to_string(list_filter([
      CASE WHEN text IS NULL THEN '$.text: missing' END, CASE WHEN length(text) < 1 THEN '$.text: too short' END,
      CASE WHEN role = 'user' AND length(text) > 300 THEN '$.text: too long' END, CASE WHEN role = 'user' AND turn < 0 THEN '$.turn: below 0' END], lambda x: x IS NOT NULL), '; ') AS errors
  FROM raw),
leveled AS (
  SELECT c.conv_id, c.call_id, 0 AS level FROM calls c LEFT JOIN calls d ON d.conv_id = c.conv_id AND d.call_id = c.dep WHERE d.call_id IS NULL
  UNION ALL
  SELECT c.conv_id, c.call_id, l.level + 1 FROM leveled l JOIN calls c ON c.conv_id = l.conv_id AND c.dep = l.call_id),
results AS (
  SELECT conv_id, 'call-' || (turn - 1) AS call_id, min(turn) AS turn, arg_min(text, turn) AS content, count(*) AS n
  FROM conversations WHERE role = 'assistant' GROUP BY ALL)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.turn) AS turn, c.name, l.level,
  coalesce(r.n, 0)::BIGINT AS n_results, coalesce(c.errors = '', false) AS valid, coalesce(c.errors, '$: no call') AS errors,
  '{"arguments":' || coalesce(c.arguments, 'null') || ',"id":' || to_json(coalesce(c.call_id, r.call_id)) || ',"name":' || coalesce(to_json(c.name)::VARCHAR, 'null')
    || ',"result":' || coalesce(to_json(r.content)::VARCHAR, 'null') || '}' AS message
FROM calls c LEFT JOIN leveled l ON l.conv_id = c.conv_id AND l.call_id = c.call_id
FULL JOIN results r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
"""
