"""Tool calls linked with their results, ordered, validated and written as canonical JSON.

Calls and results meet in a hash join on conversation, identifier and occurrence, so repeated
identifiers pair off one to one. A call that refers to another's result comes after it: its
level is one more than the highest of those it waits for, and (level, position) is a
topological order. References to earlier calls keep the order of positions as it is; levels are
worked out in rounds only for conversations with a reference to a later call.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearname.llm.common import running, seeded_hash
from nearname.session import reliable_checkpoint

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


DEEPEST = 200  # arrays and objects inside one another in the arguments of a call
LONE = re.compile("[\ud800-\udfff]")


def escaped(text: str) -> str:
    """Text whose half characters, which no encoding holds, are written as JSON escapes."""
    return LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """JSON with sorted keys, no blanks, and characters as they are but for half ones."""
    return escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def loaded(text: str):
    """The value of JSON text; ValueError, with what is wrong, where it is none, is nested more
    than DEEPEST deep or holds a number that is not finite."""
    try:
        value = json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        raise ValueError("nested too deep") from None
    except ValueError:
        raise ValueError("no JSON") from None
    level = [value]
    for _ in range(DEEPEST + 1):
        if any(isinstance(x, float) and not math.isfinite(x) for x in level):
            raise ValueError("number out of range")
        level = [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]
        if not level:
            return value
    raise ValueError("nested too deep")


def problems(value, schema: dict, at: str = "") -> list[str]:
    """What in ``value`` breaks a JSON schema of types, required and further properties, items,
    enumerations and bounds; in the order of the schema's names."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(isinstance(value, TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds):
        return [f"{at or '$'}: not {'/'.join(kinds)}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at or '$'}: not listed")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            found.append(f"{at or '$'}: out of bounds")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}/{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(known):
            if k in value:
                found += problems(value[k], known[k], f"{at}/{k}")
        if schema.get("additionalProperties") is False:
            found += [f"{at}/{k}: unknown" for k in sorted(set(value) - set(known))]
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += problems(x, schema["items"], f"{at}/{i}")
    return found


def references(value) -> list[str]:
    """Identifiers of calls whose results ``value`` refers to as {"$result": id}."""
    if isinstance(value, dict):
        if set(value) == {"$result"} and isinstance(value["$result"], str):
            return [value["$result"]]
        return [r for k in sorted(value) for r in references(value[k])]
    return [r for x in value for r in references(x)] if isinstance(value, list) else []


def _read_calls(batches: Iterator[pd.DataFrame], schemas: dict[str, dict]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found, refs, fixed = [], [], []
        for name, text in zip(b["name"], b["arguments"]):
            try:
                value = loaded(text) if text is not None else None
            except ValueError as wrong:
                found.append([f"$: {wrong}"])
                refs.append([])
                fixed.append(canonical(text))
                continue
            found.append([escaped(p) for p in problems(value, schemas[name])] if name in schemas else ["$: no such tool"])
            refs.append(sorted({escaped(r) for r in references(value)}))
            fixed.append(canonical(value))
        yield b.assign(errors=found, after=refs, arguments=fixed)


def _occurrences(rows: DataFrame) -> DataFrame:
    """Rows with ``nth``: how many rows of the same conversation and identifier lie before."""
    key = F.to_json(F.struct("conv_id", "call_id"), {"ignoreNullFields": "false"})
    # Places of a conversation rise, so their own value serves as the order.
    ordered = rows.withColumn("_key", key).withColumn("_at", F.coalesce(F.col("position"), F.lit(0)).cast("bigint")).withColumn("_h", seeded_hash(0, *rows.columns))
    return running(ordered, "_key", ["_at", "_h"], bits=1).withColumnRenamed("place", "nth").drop("_key", "_at", "_h")


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls that come later than their position says; level is
    null in a cycle. Empty when all references point backwards."""
    edges = calls.where(F.size("after") > 0).select("conv_id", "call_id", "position", F.explode("after").alias("on"))
    places = calls.groupBy("conv_id", F.col("call_id").alias("on")).agg(F.min("position").alias("_p"))
    edges = reliable_checkpoint(edges.join(places, ["conv_id", "on"]))
    late = edges.where(F.col("_p") >= F.col("position")).select("conv_id").distinct()
    wait = edges.join(late, "conv_id", "left_semi").select("conv_id", "call_id", "on").distinct()
    wait = reliable_checkpoint(wait)
    every = reliable_checkpoint(calls.join(late, "conv_id", "left_semi").select("conv_id", "call_id").distinct())
    done, level = None, 0
    open_ = every
    while not open_.isEmpty():
        blocked = wait.join(open_.withColumnRenamed("call_id", "on"), ["conv_id", "on"], "left_semi")
        blocked = reliable_checkpoint(blocked)
        free = open_.join(blocked, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level))
        free = reliable_checkpoint(free)
        stuck = free.isEmpty()
        if stuck:
            free = open_.withColumn("level", F.lit(None).cast("int"))
        done = free if done is None else done.unionByName(free)
        if stuck:
            break
        open_ = reliable_checkpoint(open_.join(free, ["conv_id", "call_id"], "left_anti"))
        level += 1
    return done if done is not None else every.withColumn("level", F.lit(None).cast("int"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call or result: conv_id, call_id, level, position, status, errors, json.

    ``calls`` has conv_id, call_id, position, name, arguments (JSON text); ``results`` has
    conv_id, call_id, position, content. Status is linked, unanswered (a call without result),
    orphan (a result without call) or cycle (a call that waits for itself). Null identifiers
    never link. References to calls that do not exist are an error of the call. Extra columns
    are ignored. (level, position) orders each conversation; level is 0 unless a reference
    points to a later call.

    Arguments that are no JSON, hold numbers beyond a double's range or are nested more than
    DEEPEST deep are an error of the call and are written as the text they came as. Half
    characters are written as escapes. Arguments are read whole, however long; repeated rows of
    one identifier pair off with its results one to one, and what is left over is unanswered or
    an orphan.
    """
    calls = calls.select("conv_id", F.col("call_id").cast("string").alias("call_id"), "position", "name", "arguments")
    schema = f"{calls._jdf.schema().toDDL()}, errors array<string>, after array<string>"
    read = reliable_checkpoint(calls.mapInPandas(lambda b: _read_calls(b, schemas), schema))
    called = _occurrences(read)
    given = _occurrences(reliable_checkpoint(results.select("conv_id", F.col("call_id").cast("string").alias("call_id"), "position", "content")))
    given = given.select("conv_id", "call_id", "nth", F.col("position").alias("_position"), "content", F.lit(True).alias("_given"))
    joined = called.withColumn("_called", F.lit(True)).join(given, ["conv_id", "call_id", "nth"], "full")
    known = read.select("conv_id", F.col("call_id").alias("_ref")).distinct()
    asked = read.where(F.size("after") > 0).select("conv_id", "call_id", F.explode("after").alias("_ref"))
    lost = asked.join(known, ["conv_id", "_ref"], "left_anti").groupBy("conv_id", "call_id").agg(F.sort_array(F.collect_set("_ref")).alias("_lost"))
    levels = _levels(read).withColumn("_leveled", F.lit(True))
    whole = joined.join(lost, ["conv_id", "call_id"], "left").join(levels, ["conv_id", "call_id"], "left")
    cycle = F.col("_called").isNotNull() & F.col("_leveled").isNotNull() & F.col("level").isNull()
    status = F.when(F.col("_called").isNull(), "orphan").when(cycle, "cycle").when(F.col("_given").isNull(), "unanswered").otherwise("linked")
    missing = F.transform(F.coalesce("_lost", F.array().cast("array<string>")), lambda r: F.concat(F.lit("$: no call "), r))
    errors = F.concat(F.coalesce("errors", F.array().cast("array<string>")), missing)
    rows = whole.select(
        "conv_id", "call_id", F.when(F.col("_leveled").isNull(), 0).otherwise(F.col("level")).alias("level"), F.coalesce("position", "_position").alias("position"),
        status.alias("status"), errors.alias("errors"), "name", "arguments", "content",
    )
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = ", ".join(f"{c} {types[c]}" for c in ("conv_id", "call_id", "level", "position", "status", "errors")) + ", json string"
    return rows.mapInPandas(_written, out)


def _written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    none = lambda x: x is None or x != x
    for b in batches:
        lines = []
        for r in b.itertuples(index=False):
            message: dict = {"id": r.call_id, "valid": not len(r.errors) and r.status == "linked"}
            if r.status != "orphan":
                message |= {"name": None if none(r.name) else r.name, "arguments": None if none(r.arguments) else json.loads(r.arguments)}
            if r.status in ("linked", "orphan"):
                message["result"] = None if none(r.content) else r.content
            lines.append(canonical(message))
        yield b.drop(columns=["name", "arguments", "content"]).assign(json=lines)


# The tools of the query: a user turn asks for a reply, every other turn but the assistant's sets the scene.
SCHEMAS = {
    "reply": {
        "type": "object",
        "properties": {
            "text": {"type": "string"}, "turn": {"type": "integer", "minimum": 0},
            "context": {"type": "object", "properties": {"$result": {"type": "string"}}, "required": ["$result"]},
        },
        "required": ["text", "turn"], "additionalProperties": False,
    },
    "setup": {"type": "object", "properties": {"text": {"type": "string"}, "role": {"type": "string"}}, "required": ["text", "role"], "additionalProperties": False},
}


def conversation_calls(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that the turns of a conversation amount to.

    A user turn is a call of ``reply`` that refers to the user turn two places before; an
    assistant turn is the result of the turn before it; any other turn, also one without role,
    is a call of ``setup``.
    """
    role = F.coalesce("role", F.lit(""))
    rows = table.select("conv_id", "turn", role.alias("role"), "text").withColumn("_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    before = F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 2).cast("string"))
    context = F.when(F.col("turn") >= 3, F.struct(before.alias("$result")))
    ask = F.to_json(F.struct("text", "turn", context.alias("context")))
    setup = F.to_json(F.struct("text", "role"))
    user = F.col("role") == "user"
    calls = rows.where(F.col("role") != "assistant").select(
        "conv_id", F.col("_id").alias("call_id"), F.col("turn").alias("position"), F.when(user, "reply").otherwise("setup").alias("name"),
        F.when(user, ask).otherwise(setup).alias("arguments"),
    )
    answered = F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    results = rows.where(F.col("role") == "assistant").select("conv_id", answered.alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))
    return calls, results


def linked_conversations(table: DataFrame) -> DataFrame:
    calls, results = conversation_calls(table)
    return link_calls(calls, results, SCHEMAS)
