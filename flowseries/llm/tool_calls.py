"""Chat formatting by linking tool calls with their results.

Calls and results are hash-joined by identifier, which counts within its conversation. A call may name parents, calls
whose results it builds on; its level is its longest distance from a call without parents. Every call and result, and
every other message, then gets a position in its conversation: in the order of time, but never before a call it
builds on. Arguments are checked against the tool's JSON schema (the keywords for values, objects, lists, texts and
numbers, combinations, conditions and references within the schema; any other fails before work begins), and each row
becomes one canonical JSON text: sorted keys, no spaces, whole numbers as integers, UTF-8.

Rows are numbered once and written; identifiers, levels and positions are worked out on numbers alone, and texts are
joined back by number at the end. Levels: in each round a call whose parents all have levels gets its own, and one
that waits for a single call is moved up to what that one waits for, so a chain takes the logarithm of its length in
rounds (each a written table) and stacked merges one round each. Positions: one range sort of the whole table, so a
conversation of any size is spread over tasks.

Defined results: every call is a row (repeated ones too; their parents are taken together, the earliest time counts).
Of several results with one identifier the one with the lowest hash is linked, the others are ``repeated_result``
rows; a result without a call is an ``orphan_result``. A parent that isn't there doesn't count; calls in or behind a
cycle have no level. A call or result with a null identifier (of its own or of its conversation) never links, has no
level and is kept as it is, row by row. Rows of a null conversation have no position; null times come last. Arguments
that are null fail their schema; those that aren't JSON (NaN and numbers beyond a double's or the parser's range are
not), or are nested too deeply, stay text; of repeated keys the last counts; half of a surrogate pair is written as
its escape. Null content is JSON null, texts of any length are taken whole, an empty table gives none.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from fractions import Fraction
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowseries.llm.batches import sliced
from flowseries.llm.scratch import delete, stored, written

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: Any, kind: str) -> bool:
    if kind in ("number", "integer"):
        number = isinstance(value, int | float) and not isinstance(value, bool)
        return number and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, _TYPES[kind])


#: What a schema may hold: rules that are applied, and words that only describe.
_RULES = frozenset(
    "$ref additionalProperties allOf anyOf const contains dependentRequired else enum exclusiveMaximum exclusiveMinimum if items maxItems maxLength maxProperties "
    "maximum minItems minLength minProperties minimum multipleOf not oneOf pattern patternProperties prefixItems properties propertyNames required then type uniqueItems".split()
)
_WORDS = frozenset("$comment $defs $id $schema default definitions deprecated description examples format readOnly title writeOnly".split())
_OF_SCHEMAS, _LISTS, _MAPS = ("additionalProperties", "contains", "else", "if", "items", "not", "propertyNames", "then"), ("allOf", "anyOf", "oneOf", "prefixItems"), ("$defs", "definitions", "patternProperties", "properties")


def check_schema(schema: Any, root: Any = None, at: str = "#") -> None:
    """ValueError for a schema with a keyword that isn't known, or a reference that leads nowhere: arguments must not
    pass for valid because a rule isn't understood."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: no schema")
    if unknown := sorted(set(schema) - _RULES - _WORDS):
        raise ValueError(f"{at}: unknown keywords {', '.join(unknown)}")
    if "$ref" in schema:
        _referred(schema["$ref"], root)
    re.compile(schema.get("pattern", ""))
    for k in _OF_SCHEMAS:
        if k in schema:
            check_schema(schema[k], root, f"{at}/{k}")
    for k in _LISTS:
        for i, x in enumerate(schema.get(k, [])):
            check_schema(x, root, f"{at}/{k}/{i}")
    for k in _MAPS:
        for name, x in schema.get(k, {}).items():
            if k == "patternProperties":
                re.compile(name)
            check_schema(x, root, f"{at}/{k}/{name}")


def _referred(ref: str, root: Any) -> Any:
    """The schema that a reference into the same document names."""
    found = root
    if not ref.startswith("#"):
        raise ValueError(f"reference out of the schema: {ref}")
    for step in ref[1:].split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        try:
            found = found[int(step)] if isinstance(found, list) else found[step]
        except (KeyError, IndexError, ValueError, TypeError):
            raise ValueError(f"reference to nothing: {ref}") from None
    return found


def _key(value: Any) -> Any:
    """Equal for equal JSON values and only for them."""
    if isinstance(value, dict):
        return ("object", frozenset((k, _key(v)) for k, v in value.items()))
    if isinstance(value, list):
        return ("array", tuple(map(_key, value)))
    return (type(value).__name__ if isinstance(value, bool | str | type(None)) else "number", value)


def _same(a: Any, b: Any) -> bool:
    return _key(a) == _key(b)


def schema_errors(value: Any, schema: Any, at: str = "$", root: Any = None) -> list[str]:
    """What speaks against ``value``, as ``place: rule``; empty if nothing."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: false"]
    kinds = schema.get("type")
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: type"]
    found: list[str] = []
    no = lambda rule, bad, where=at: found.append(f"{where}: {rule}") if bad else None
    fits = lambda x, s: not schema_errors(x, s, at, root)
    if "enum" in schema:
        no("enum", not any(_same(value, x) for x in schema["enum"]))
    if "const" in schema:
        no("const", not _same(value, schema["const"]))
    if "$ref" in schema:
        found += schema_errors(value, _referred(schema["$ref"], root), at, root)
    for part in schema.get("allOf", []):
        found += schema_errors(value, part, at, root)
    if "anyOf" in schema:
        no("anyOf", not any(fits(value, x) for x in schema["anyOf"]))
    if "oneOf" in schema:
        no("oneOf", sum(fits(value, x) for x in schema["oneOf"]) != 1)
    if "not" in schema:
        no("not", fits(value, schema["not"]))
    if "if" in schema:
        found += schema_errors(value, schema.get("then" if fits(value, schema["if"]) else "else", True), at, root)
    size: float | int = 0
    if isinstance(value, str):
        size, ends = len(value), ("minLength", "maxLength")
        if "pattern" in schema:
            no("pattern", not re.search(schema["pattern"], value))
    elif isinstance(value, list):
        size, ends = len(value), ("minItems", "maxItems")
        own = schema.get("prefixItems", [])
        for i, x in enumerate(value):
            found += schema_errors(x, own[i] if i < len(own) else schema.get("items", True), f"{at}[{i}]", root)
        no("uniqueItems", schema.get("uniqueItems") is True and len({_key(x) for x in value}) < len(value))
        if "contains" in schema:
            no("contains", not any(fits(x, schema["contains"]) for x in value))
    elif isinstance(value, int | float) and not isinstance(value, bool):
        size, ends = value, ("minimum", "maximum")
        no("exclusiveMinimum", value <= schema.get("exclusiveMinimum", -math.inf))
        no("exclusiveMaximum", value >= schema.get("exclusiveMaximum", math.inf))
        if "multipleOf" in schema:
            no("multipleOf", Fraction(str(value)) % Fraction(str(schema["multipleOf"])) != 0)
    elif isinstance(value, dict):
        size, ends = len(value), ("minProperties", "maxProperties")
        own, others = schema.get("properties", {}), schema.get("patternProperties", {})
        for k in schema.get("required", []):
            no("required", k not in value, f"{at}.{k}")
        for k, more in schema.get("dependentRequired", {}).items():
            for m in more:
                no("dependentRequired", k in value and m not in value, f"{at}.{m}")
        for k, x in value.items():
            named = [own[k]] if k in own else []
            named += [s for pattern, s in others.items() if re.search(pattern, k)]
            rest = schema.get("additionalProperties", True)
            if not named and rest is False:
                no("additionalProperties", True, f"{at}.{k}")
            for s in named or [rest]:
                found += schema_errors(x, s, f"{at}.{k}", root) if s is not False or named else []
            no("propertyNames", not fits(k, schema.get("propertyNames", True)), f"{at}.{k}")
    else:
        return found
    no(ends[0], size < schema.get(ends[0], -math.inf))
    no(ends[1], size > schema.get(ends[1], math.inf))
    return found


def _finite(text: str) -> float:
    number = float(text)
    if math.isinf(number):
        raise ValueError("number out of range")
    return number


def _no_constant(text: str) -> None:
    raise ValueError(f"{text} is not JSON")


def parsed(arguments: str) -> Any:
    """The value of a JSON text; ValueError for what isn't JSON, RecursionError for what is nested too deeply."""
    return json.loads(arguments, parse_float=_finite, parse_constant=_no_constant)


def _whole_characters(text: str) -> str:
    """Halves of surrogate pairs as escapes, since UTF-8 has no form for them."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def _one_form(value: Any) -> Any:
    """Whole numbers as integers however they were written; from 1e21 on only what was written as an integer."""
    if isinstance(value, float):
        return int(value) if value.is_integer() and abs(value) < 1e21 else value
    if isinstance(value, list):
        return [_one_form(x) for x in value]
    return {k: _one_form(x) for k, x in value.items()} if isinstance(value, dict) else value


def canonical(value: Any) -> str:
    """Sorted keys, no spaces, one form for each number."""
    return _whole_characters(json.dumps(_one_form(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def checked(arguments: str | None, schema: dict | None) -> tuple[Any, str, list[str]]:
    """The arguments' value, its canonical JSON, and what speaks against it."""
    try:
        value = parsed(arguments) if arguments is not None else None
        return value, canonical(value), ["$: no such tool"] if schema is None else schema_errors(value, schema)
    except RecursionError:
        return arguments, canonical(arguments), ["$: too deep"]
    except ValueError:
        return arguments, canonical(arguments), ["$: not JSON"]


_MESSAGE, _CALL, _RESULT = 0, 1, 2
#: Levels stay far below this; what runs round a cycle stops here.
_FAR = 1 << 40


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, level, time`` of every row of ``nodes`` (node, time; longs): the longest way over ``edges`` (node, up)
    from a node without any, and the latest time on all ways. No level in or behind a cycle."""
    none = F.lit(None).cast("long")
    state = nodes.select("node", none.alias("up"), F.lit(0).cast("long").alias("d"), "time")
    state = state.unionByName(edges.select("node", "up", F.lit(1).cast("long").alias("d"), none.alias("time")).distinct())
    state, path = stored(state, "ways")
    waiting, last = None, None
    while True:
        at = F.col("up").isNull()
        found = state.groupBy("node").agg(F.count("up").alias("n"), F.max("up").alias("q"), F.max(F.when(at, F.col("d"))).alias("c"), F.max(F.when(~at, F.col("d"))).alias("dq"), F.max("time").alias("t"))
        found, here = stored(found, "levels")
        if last:
            delete(nodes.sparkSession, last)
        last, before = here, waiting
        waiting = found.filter("n > 0").count()
        if waiting in (0, before):
            delete(nodes.sparkSession, path)
            break
        above = found.select(*[F.col(c).alias(f"_{c}") for c in found.columns])
        plus = lambda x: F.least(F.col("d") + F.col(x), F.lit(_FAR))
        way = lambda up, d, t: F.struct(up.alias("up"), d.alias("d"), t.alias("time"))
        rest = way(none, plus("_c"), F.col("_t"))
        ways = F.when(at, F.array(way(none, F.col("d"), F.col("time")))).when(F.col("_n") == 0, F.array(rest))
        ways = ways.when(F.col("_n") == 1, F.array(way(F.col("_q"), plus("_dq"), none), rest)).otherwise(F.array(way(F.col("up"), F.col("d"), none)))
        moved = state.join(above, F.col("up") == F.col("_node"), "left").select("node", F.explode(ways).alias("w")).select("node", "w.*")
        done = path
        state, path = stored(moved.groupBy("node", "up").agg(F.max("d").alias("d"), F.max("time").alias("time")), "ways")
        delete(nodes.sparkSession, done)
    return found.select("node", F.when(F.col("n") == 0, F.col("c")).alias("level"), F.col("t").alias("time"))


def positions(rows: DataFrame, by: list[Column]) -> DataFrame:
    """``row, position``: the rank from 0 within ``conv_id`` in the order of ``by``. One range sort of the whole table;
    a row's place in its range, and the ranges' sizes, give ranks over all."""
    order = [F.col("conv_id").asc(), *by]
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "conv_id", F.monotonically_increasing_id().alias("_i")), "places")
    placed = placed.select("row", "conv_id", F.shiftright("_i", 33).alias("_range"), F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"))
    # One row for each range of the sort.
    sizes = {r["_range"]: r["n"] for r in placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    ahead, total = [], 0
    for k in sorted(sizes):
        ahead.append((k, total))
        total += sizes[k]
    starts = rows.sparkSession.createDataFrame(ahead, "_range long, _ahead long")
    ranked = placed.join(F.broadcast(starts), "_range").select("row", "conv_id", (F.col("_ahead") + F.col("_i")).alias("_rank"))
    first = ranked.groupBy("conv_id").agg(F.min("_rank").alias("_first"))
    return ranked.join(first, "conv_id").select("row", (F.col("_rank") - F.col("_first")).alias("position"))


def _parents(calls: DataFrame) -> Column:
    none = F.array().cast("array<string>")
    if "parent_ids" in calls.columns:
        return F.coalesce("parent_ids", none)
    return F.when(F.col("parent_id").isNull(), none).otherwise(F.array("parent_id")) if "parent_id" in calls.columns else none


def _numbered(calls: DataFrame, results: DataFrame | None = None, messages: DataFrame | None = None) -> DataFrame:
    """All rows in one written table, with numbers: kind, conv_id, call_id, parents, at, name, payload, row."""
    conv = calls.schema["conv_id"].dataType
    text = lambda df, c: (F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c)
    at = lambda df: (F.col("at") if "at" in df.columns else F.lit(None)).cast("long").alias("at")

    def rows(df: DataFrame, kind: int, parents: Column, name: str, payload: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col("conv_id").cast(conv).alias("conv_id"), text(df, "call_id"), parents.alias("parents"), at(df), text(df, name).alias("name"), text(df, payload).alias("payload"))

    out, none = rows(calls, _CALL, _parents(calls), "name", "arguments"), F.array().cast("array<string>")
    if results is not None:
        out = out.unionByName(rows(results, _RESULT, none, "name", "content"))
    if messages is not None:
        out = out.unionByName(rows(messages.drop("call_id"), _MESSAGE, none, "role", "content"))
    return written(out.withColumn("row", F.monotonically_increasing_id()), "turns")


def _identified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Identifiers with their first call's number and linked result's number; and rows with their identifier's."""
    keyed = rows.filter("conv_id IS NOT NULL AND call_id IS NOT NULL").select("kind", "conv_id", "call_id", "row", "at", "parents", F.when(F.col("kind") == _RESULT, F.xxhash64("payload")).alias("h"))
    call = F.col("kind") == _CALL
    ids = keyed.groupBy("conv_id", "call_id").agg(F.min(F.when(call, F.col("row"))).alias("node"), F.min(F.when(call, F.col("at"))).alias("time"), F.min_by("row", "h").alias("answer"))
    ids = written(ids, "identifiers")
    # The hashed side has one short row for each identifier.
    return ids, keyed.join(ids.drop("time").hint("shuffle_hash"), ["conv_id", "call_id"])


def _depths_of(ids: DataFrame, rows: DataFrame) -> DataFrame:
    ups = rows.filter(F.col("kind") == _CALL).select("node", "conv_id", F.explode("parents").alias("call_id"))
    known = ids.filter("node IS NOT NULL").select("conv_id", "call_id", F.col("node").alias("up"))
    return depths(ids.filter("node IS NOT NULL").select("node", "time"), ups.join(known, ["conv_id", "call_id"]).select("node", "up"))


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` of the distinct calls of ``calls`` (conv_id, call_id, and parent_id or parent_ids)
    whose identifiers aren't null."""
    ids, rows = _identified(_numbered(calls))
    return ids.join(_depths_of(ids, rows), "node").select("conv_id", "call_id", "level")


_OUT = {"valid": pa.bool_(), "errors": pa.string(), "message": pa.string()}


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], messages: DataFrame | None = None) -> DataFrame:
    """``calls`` (conv_id, call_id, parent_id or parent_ids, name, arguments), ``results`` (conv_id, call_id, content)
    and other ``messages`` (conv_id, role, content), each with an optional time ``at`` (long), as ``conv_id, position,
    call_id, level, name, status, valid, errors, message``; status: linked, no_result, orphan_result, repeated_result
    or message. Every row is there: a linked result within its calls' rows, all others as rows of their own. Fails for
    schemas with keywords that aren't known."""
    for name, schema in schemas.items():
        check_schema(schema, at=f"{name}#")
    rows = _numbered(calls, results, messages)
    ids, keyed = _identified(rows)
    keyed = written(keyed.select("kind", "row", "conv_id", "node", "answer", "parents"), "identified")
    levelled = _depths_of(ids, keyed)
    known = keyed.join(levelled, "node", "left").select("row", "node", "answer", "level", F.when(F.col("level").isNotNull(), F.col("time")).alias("time"))
    facts = rows.select("row", "kind", "conv_id", "at", "call_id", "name", F.md5(F.col("payload").cast("binary")).alias("digest")).join(known, "row", "left")
    is_result, linked = F.col("kind") == _RESULT, F.col("answer").isNotNull() & F.col("node").isNotNull()
    status = F.when(F.col("kind") == _MESSAGE, "message").when(is_result, F.when(F.col("node").isNull(), "orphan_result").otherwise("repeated_result")).when(linked, "linked").otherwise("no_result")
    own = facts.filter(~(is_result & linked & (F.col("row") == F.col("answer"))) | ~is_result | ~linked)
    own = own.select("row", "conv_id", "kind", "call_id", "name", "digest", F.when(~is_result, F.col("level")).alias("level"), F.when(is_result, F.col("at")).otherwise(F.greatest("at", "time")).alias("at"), status.alias("status"), F.when(~is_result, F.col("answer")).alias("answer"))
    own = written(own, "facts")
    order = [F.col(c).asc_nulls_last() for c in ("at", "level", "kind", "call_id", "name", "digest")]
    placed = own.select("row", "status", "level", "answer").join(positions(own.filter("conv_id IS NOT NULL"), order), "row", "left")
    texts = rows.select("row", "kind", "conv_id", "call_id", "name", "payload").join(placed, "row")
    answers = rows.filter(is_result).select(F.col("row").alias("answer"), F.col("payload").alias("result"))
    whole = texts.join(answers, "answer", "left").select("conv_id", "position", "call_id", "level", F.when(F.col("kind") == _CALL, F.col("name")).alias("name"), "status", F.col("name").alias("role"), "payload", "result")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for _, _, call_id, level, name, state, role, payload, result in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state == "message":
                    out.append((True, "", canonical({"content": payload, "role": role, "status": state})))
                    continue
                value, errors = "null", []
                if state in ("orphan_result", "repeated_result"):
                    result = payload
                else:
                    _, value, errors = checked(payload, schemas.get(name))
                # Keys stand in their sorted order; the arguments are canonical already.
                rest = canonical({"id": call_id, "level": level, "name": name, "result": result, "status": state})
                out.append((not errors and state in ("linked", "no_result"), _whole_characters(";".join(errors)), f'{{"arguments":{value},{rest[1:]}'))
            cols = list(zip(*out, strict=True)) or [()] * len(_OUT)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *(pa.array(c, t) for c, t in zip(cols, _OUT.values(), strict=True))], names=[*batch.schema.names[:6], *_OUT])

    kinds = {f.name: f.dataType.simpleString() for f in whole.schema}
    ddl = ", ".join(f"{c} {kinds[c]}" for c in ("conv_id", "position", "call_id", "level", "name", "status"))
    return whole.mapInArrow(run, f"{ddl}, valid boolean, errors string, message string")


# The tools that turns are taken to call, by the length of what the user says.
TOOLS = {
    "answer": {"type": "object", "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "words": {"type": "integer", "maximum": 40}}, "required": ["text", "turn", "words"], "additionalProperties": False},
    "discuss": {"type": "object", "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "words": {"type": "integer", "maximum": 60}}, "required": ["text", "turn", "words"], "additionalProperties": False},
}


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and other messages of ``conversations`` (conv_id, turn, role, text), each turn in one of them: a
    user's turn calls a tool with its text, the assistant's next turn is the result, and the call builds on the user's
    turn two turns before; turns of any other role, null too, are messages. Conversations hold no tool messages of
    their own, so this is how the table becomes some. A null turn or conversation gives a null identifier."""
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    users = conversations.filter("role = 'user'").withColumn("words", words)
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), "turn", "words"))
    at = F.col("turn").cast("long").alias("at")
    calls = users.select("conv_id", name(F.col("turn")).alias("call_id"), F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).alias("parent_ids"), F.when(F.col("words") > 20, "discuss").otherwise("answer").alias("name"), arguments.alias("arguments"), at)
    results = conversations.filter("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"), at)
    messages = conversations.filter("role IS NULL OR role NOT IN ('user', 'assistant')").select("conv_id", "role", F.col("text").alias("content"), at)
    return calls, results, messages
