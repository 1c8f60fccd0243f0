"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Calls and results meet in a hash join on conversation and identifier. A call's level in the dependency
order is the longest path of calls that it depends on. Runs of calls with one parent each are skipped by
pointer doubling: a chain of n calls takes log2(n) joins on unique identifiers. Calls with several parents
are then peeled frontier by frontier, each as soon as all that it depends on has a level. Arguments are
checked against the tool's JSON schema and serialised with sorted keys and without white space.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parasift.llm.common import join_counted, stage, tidy, unstage

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: Any, kind: str) -> bool:
    if kind in ("integer", "number"):
        whole = isinstance(value, int) or isinstance(value, float) and value.is_integer()
        return not isinstance(value, bool) and (whole if kind == "integer" else isinstance(value, (int, float)))
    return isinstance(value, _TYPES[kind])


#: Keywords of a schema that are checked, and those that only tell of it.
CHECKED = {
    "type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "items", "minItems", "maxItems", "uniqueItems",
    "properties", "required", "additionalProperties", "minProperties", "maxProperties", "anyOf", "oneOf", "allOf", "not",
}
TOLD = {"title", "description", "default", "examples", "$schema", "$id", "$comment", "deprecated", "readOnly", "writeOnly"}


def check_schema(schema: Any, at: str = "$") -> None:
    """Raises where a schema holds a keyword or type that ``violations`` does not know: nothing is taken as valid because
    it was not understood."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: not a schema")
    unknown = set(schema) - CHECKED - TOLD
    if unknown:
        raise ValueError(f"{at}: unknown keywords {sorted(unknown)}")
    kinds = schema.get("type", [])
    odd = set([kinds] if isinstance(kinds, str) else kinds) - set(_TYPES) - {"integer", "number"}
    if odd:
        raise ValueError(f"{at}: unknown types {sorted(odd)}")
    if "pattern" in schema:
        re.compile(schema["pattern"])
    for name, own in schema.get("properties", {}).items():
        check_schema(own, f"{at}.{name}")
    for word in ("items", "additionalProperties", "not"):
        if word in schema:
            check_schema(schema[word], f"{at}.{word}")
    for word in ("anyOf", "oneOf", "allOf"):
        for i, own in enumerate(schema.get(word, [])):
            check_schema(own, f"{at}.{word}[{i}]")


def _same(a: Any, b: Any) -> bool:
    """Equal as JSON: 1 is 1.0, but not true."""
    return canonical(a) == canonical(b)


def _of_number(value: float, schema: dict, at: str) -> Iterator[str]:
    if value < schema.get("minimum", -math.inf) or value <= schema.get("exclusiveMinimum", -math.inf):
        yield f"{at}: below the minimum"
    if value > schema.get("maximum", math.inf) or value >= schema.get("exclusiveMaximum", math.inf):
        yield f"{at}: above the maximum"
    if "multipleOf" in schema and Decimal(str(value)) % Decimal(str(schema["multipleOf"])) != 0:
        yield f"{at}: not a multiple"


def _of_text(value: str, schema: dict, at: str) -> Iterator[str]:
    if len(value) < schema.get("minLength", 0):
        yield f"{at}: too short"
    if len(value) > schema.get("maxLength", math.inf):
        yield f"{at}: too long"
    if "pattern" in schema and not re.search(schema["pattern"], value):
        yield f"{at}: not of the pattern"


def _of_list(value: list, schema: dict, at: str) -> Iterator[str]:
    if len(value) < schema.get("minItems", 0):
        yield f"{at}: too few items"
    if len(value) > schema.get("maxItems", math.inf):
        yield f"{at}: too many items"
    if schema.get("uniqueItems") and len({canonical(v) for v in value}) < len(value):
        yield f"{at}: repeated items"
    for i, item in enumerate(value if "items" in schema else []):
        yield from violations(item, schema["items"], f"{at}[{i}]")


def _of_object(value: dict, schema: dict, at: str) -> Iterator[str]:
    known, others = schema.get("properties", {}), schema.get("additionalProperties", True)
    if len(value) < schema.get("minProperties", 0):
        yield f"{at}: too few properties"
    if len(value) > schema.get("maxProperties", math.inf):
        yield f"{at}: too many properties"
    yield from (f"{at}.{name}: missing" for name in schema.get("required", []) if name not in value)
    for name in sorted(value):
        if name in known:
            yield from violations(value[name], known[name], f"{at}.{name}")
        elif others is False:
            yield f"{at}.{name}: unknown"
        else:
            yield from violations(value[name], others, f"{at}.{name}")


def violations(value: Any, schema: dict | bool, at: str = "$") -> list[str]:
    """Where ``value`` breaks ``schema``, of the keywords that ``check_schema`` lets pass."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not of type {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and not any(_same(value, v) for v in schema["enum"]) or "const" in schema and not _same(value, schema["const"]):
        out.append(f"{at}: not one of the allowed values")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += _of_number(value, schema, at)
    elif isinstance(value, str):
        out += _of_text(value, schema, at)
    elif isinstance(value, list):
        out += _of_list(value, schema, at)
    elif isinstance(value, dict):
        out += _of_object(value, schema, at)
    for own in schema.get("allOf", []):
        out += violations(value, own, at)
    if "anyOf" in schema and all(violations(value, own, at) for own in schema["anyOf"]):
        out.append(f"{at}: fits none of the schemas")
    if "oneOf" in schema and sum(not violations(value, own, at) for own in schema["oneOf"]) != 1:
        out.append(f"{at}: does not fit one schema alone")
    if "not" in schema and not violations(value, schema["not"], at):
        out.append(f"{at}: fits what it must not")
    return out


def _plain(value: Any) -> Any:
    """Floats with an integer value become integers, as canonical JSON has one form for each number."""
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("not a JSON number")
        return int(value) if value.is_integer() and abs(value) < 2**53 else value
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


_LONE = re.compile("[\ud800-\udfff]")


def _escaped(text: str) -> str:
    """Lone surrogates, which UTF-8 cannot hold, as JSON escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: Any) -> str:
    return _escaped(json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


_ID = ["conv_id", "call_id"]


def _skip_chains(nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """For each call the anchor that its run of single parents ends at: a call with no parent or several.

    (conv_id, call_id, up, steps, reach, open): ``up`` is the anchor, or still ``open`` on and behind
    cycles; ``reach`` the last turn of the calls on the way, the anchor's too.
    """
    turns = nodes.select("conv_id", F.col("call_id").alias("up"), F.col("last_turn").alias("reach"))
    one = degree.where("parents = 1").select(*_ID, F.col("parent").alias("up")).join(turns, ["conv_id", "up"]).select(*_ID, "up", F.lit(1).cast("long").alias("steps"), "reach", F.lit(True).alias("open"))
    anchors = nodes.join(one, _ID, "left_anti").select(*_ID, F.col("call_id").alias("up"), F.lit(0).cast("long").alias("steps"), F.lit(None).cast("long").alias("reach"), F.lit(False).alias("open"))
    now = stage(anchors.unionByName(one), "chains")
    for _ in range(math.ceil(math.log2(nodes.count() + 1)) + 1):
        if not now.where("open").limit(1).count():
            break
        above = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("further"), F.col("steps").alias("more"), F.col("reach").alias("beyond"), F.col("open").alias("still"))
        onward = now.where("open").join(above, ["conv_id", "up"])
        onward = onward.select(*_ID, F.col("further").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.greatest("reach", "beyond").alias("reach"), F.col("still").alias("open"))
        after = stage(onward.unionByName(now.where("not open")), "chains")
        unstage(now)
        now = after
    return now


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, before) for each call of ``calls`` (``conv_id``, ``call_id``, ``parents``:
    an array of identifiers, ``last_turn``).

    ``level`` is the number of calls on the longest path of dependencies, 0 without a parent among the
    conversation's calls; ``before`` the last turn of all that it depends on, null if there is nothing.
    Both are null on and behind cycles. Rows with a null ``conv_id`` or ``call_id`` are left out, rows of
    one identifier are one call with all their parents. The rounds of the peeling are as many as the calls
    with several parents on one path.
    """
    known = calls.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    nodes = stage(known.groupBy(*_ID).agg(F.max("last_turn").alias("last_turn")), "calls")
    given = known.select(*_ID, F.explode("parents").alias("parent")).distinct()
    edges = stage(given.join(nodes.select("conv_id", F.col("call_id").alias("parent")), ["conv_id", "parent"], "left_semi").select(*_ID, "parent"), "parents")
    degree = edges.groupBy(*_ID).agg(F.count("*").alias("parents"), F.min("parent").alias("parent"))
    chains = _skip_chains(nodes, degree)
    several = degree.where("parents > 1").select(*_ID, "parents")
    anchors = chains.where("not open and steps = 0").select(*_ID)
    solved = anchors.join(several, _ID, "left_anti").select(*_ID, F.lit(0).cast("long").alias("level"), F.lit(None).cast("long").alias("before"))
    # From a call with several parents to the anchor behind each of them.
    behind = chains.select("conv_id", F.col("call_id").alias("parent"), F.col("up").alias("anchor"), F.col("steps").alias("way"), "reach", "open")
    turns = nodes.select("conv_id", F.col("call_id").alias("parent"), F.col("last_turn").alias("own"))
    hops = edges.join(several, _ID).join(behind, ["conv_id", "parent"]).join(turns, ["conv_id", "parent"])
    hops = hops.select(*_ID, "parents", F.when(~F.col("open"), F.col("anchor")).alias("anchor"), (F.col("way") + 1).alias("way"), F.greatest("reach", "own").alias("reach"))
    hops = stage(hops, "hops")
    left = hops.limit(1).count()
    while left:
        solved = stage(solved, "levels")
        waiting = hops.join(solved.select(*_ID), _ID, "left_anti")
        ends = solved.select("conv_id", F.col("call_id").alias("anchor"), F.col("level").alias("base"), F.col("before").alias("far"))
        met = waiting.join(ends, ["conv_id", "anchor"]).groupBy(*_ID, "parents").agg(F.count("*").alias("n"), F.max(F.col("base") + F.col("way")).alias("level"), F.max(F.greatest("reach", "far")).alias("before"))
        found = stage(met.where("n = parents").select(*_ID, "level", "before"), "frontier")
        left = found.limit(1).count()
        solved = solved.unionByName(found)
    ends = solved.select("conv_id", F.col("call_id").alias("up"), F.col("level").alias("base"), F.col("before").alias("far"))
    closed = F.when(~F.col("open"), F.col("up"))
    placed = chains.withColumn("up", closed).join(ends, ["conv_id", "up"], "left")
    return placed.select(*_ID, (F.col("base") + F.col("steps")).alias("level"), F.when(F.col("base").isNotNull(), F.greatest("reach", "far")).alias("before"))


def format_chat(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per row of ``messages``: its columns ``conv_id``, ``turn``, ``role`` and ``kind``,
    ``call_id``, ``linked``, ``level``, ``place``, ``valid``, ``problems``, ``json``.

    ``messages`` has those and ``kind`` (call, result or message), ``call_id``, ``parents`` (an array of the
    calls this one depends on), ``name``, ``arguments`` (JSON text of a call), ``content``; others are ignored.
    Identifiers hold within a conversation. Ordered by ``place``, then ``level`` (nulls first), then ``turn``,
    a conversation's messages stand where their turn puts them, but no call or result before what it depends
    on: ``place`` is the last turn of all that. A call has an even level, its results the odd one after it,
    other messages none; calls on and behind cycles and results without a call have none either and stand at
    their turn. ``linked`` tells whether a call has a result, a result its call. ``valid``: the arguments are
    JSON and meet the tool's schema; null for other kinds. A tool without a schema, arguments that are no
    JSON, too deeply nested or null are invalid; then ``json`` holds them as a string. Rows with a null
    ``conv_id`` or ``call_id`` are never linked; repeated rows give a row each, and repeated identifiers are
    one node of the order. Empty tables give no rows. A schema with keywords that are not checked raises.
    """
    for name, schema in schemas.items():
        check_schema(schema, name)
    columns = ["conv_id", "turn", "role", "kind", "call_id", "name", "arguments", "content"]
    linkable = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull() & F.col("kind").isin("call", "result")
    linkable = F.coalesce(linkable, F.lit(False))
    own, others = messages.where(linkable), messages.where(~linkable)
    call = F.col("kind") == "call"
    ids = own.groupBy(*_ID).agg(
        F.max(call).alias("has_call"), F.max(~call).alias("has_result"), F.max(F.when(call, F.col("turn").cast("long"))).alias("call_turn"), F.max(F.col("turn").cast("long")).alias("last_turn"), F.count("*").alias("rows")
    )
    ids = stage(ids, "ids")
    parents = own.where(call).select(*_ID, "parents").join(ids.select(*_ID, "last_turn"), _ID)
    known = ids.join(levels(parents), _ID, "left").drop("last_turn")
    linked = F.when(call, F.col("has_result")).otherwise(F.col("has_call"))
    deep = F.when(call, 2 * F.col("level")).otherwise(2 * F.col("level") + 1)
    place = F.greatest(F.col("turn").cast("long"), "before", F.when(~call, F.col("call_turn")))
    joined = join_counted(own.select(*columns), stage(known, "known"), _ID, "rows").select(*columns, linked.alias("linked"), deep.cast("long").alias("level"), place.alias("place"))
    rest = others.select(*columns, F.lit(False).alias("linked"), F.lit(None).cast("long").alias("level"), F.col("turn").cast("long").alias("place"))
    kept = ["conv_id", "turn", "role", "kind", "call_id", "linked", "level", "place"]

    @tidy
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, valid, problems = [], [], []
            for role, kind, call_id, name, arguments, content in frame[["role", "kind", "call_id", "name", "arguments", "content"]].astype(object).where(lambda f: f.notna(), None).itertuples(index=False):
                if kind != "call":
                    body = {"kind": kind, "content": content} | ({"call_id": call_id} if kind == "result" else {"role": role})
                    texts.append(canonical(body))
                    valid.append(None)
                    problems.append([])
                    continue
                body = {"kind": kind, "call_id": call_id, "name": name}
                try:
                    value = json.loads(arguments)
                    text = canonical(body | {"arguments": value})
                    wrong = [_escaped(v) for v in violations(_plain(value), schemas[name])] if name in schemas else ["no schema"]
                except (TypeError, ValueError):
                    text, wrong = canonical(body | {"arguments": arguments}), ["not JSON"]
                except RecursionError:
                    text, wrong = canonical(body | {"arguments": arguments}), ["too deeply nested"]
                texts.append(text)
                valid.append(not wrong)
                problems.append(wrong)
            yield frame[kept].assign(valid=pd.array(valid, "boolean"), problems=problems, json=texts)

    types = dict(messages.dtypes)
    schema = ", ".join(f"{c} {types.get(c, 'string')}" for c in kept[:5]) + ", linked boolean, level long, place long, valid boolean, problems array<string>, json string"
    ready = joined.unionByName(rest).select(*kept, "name", "arguments", "content")
    return ready.mapInPandas(_nullable(write, types), schema)


def _nullable(write, types: dict):
    """Integer columns with nulls arrive as floats; they go back as nullable integers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def whole(frame: pd.DataFrame) -> pd.DataFrame:
            return frame.astype({c: "Int64" for c in ("conv_id", "turn", "level", "place") if types.get(c, "bigint") in ("bigint", "int")})

        yield from write(map(whole, frames))

    return run


def turns_as_calls(conversations: DataFrame, tool: str = "reply") -> DataFrame:
    """The messages of a plain chat as calls: each user turn calls ``tool`` and depends on the user turn
    two before it, the assistant turn after it is the result; other turns are plain messages. Turns with a
    null ``conv_id`` or ``turn`` get no identifier; null roles are plain messages, null texts null content."""
    at = lambda back: F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    kind = F.when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("message")
    call_id = F.when(known & (F.col("kind") == "call"), at(0)).when(known & (F.col("kind") == "result"), at(1))
    arguments = F.when(F.col("kind") == "call", F.to_json(F.struct(F.col("turn"), F.col("text").alias("prompt"))))
    return conversations.withColumn("kind", kind).select(
        "conv_id", "turn", "role", "kind", call_id.alias("call_id"), F.when(known & (F.col("kind") == "call"), F.array(at(2))).alias("parents"),
        F.when(F.col("kind") == "call", tool).alias("name"), arguments.alias("arguments"), F.col("text").alias("content"),
    )
