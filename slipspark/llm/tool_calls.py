"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Calls and results meet in a hash join on (conversation, call id). Both sides are reduced to one row per id before it, with
combining aggregations, so repeated ids are small whatever their number. Calls name the calls they build on
(``{"$ref": "<call id>"}`` anywhere in their arguments). References of one conversation, up to a bound, are ordered topologically in one
pass over a sorted stream. A conversation of more references is ordered in rounds over the whole table, each of which gives a
level to all calls whose references have one; so none is gathered into one task, and one may hold any share of the
rows. Arguments are checked against a schema per tool, and every
call, with its result, becomes one line of JSON: keys sorted by code point, no blanks, characters as they are.

Defined results, in ``status`` and ``errors``: the first call of an id (by turn, then by its JSON) counts, others are
``duplicate``; so the first result, the number of all is kept. A call without id is ``no_id`` and links with nothing. A
result without call is a row of its own, ``orphan``. A call without result is ``open``. Arguments that are null or no JSON
object are errors, as is an unknown tool or reference. Numbers that are no JSON (NaN, infinities) or too large for a double, lone
surrogates, and values nested deeper than ``DEPTH`` are errors of that call, whose arguments then count as null. A whole number may
be written 1.0. Schemas are checked before anything runs. Calls in or behind a cycle of references are ``cycle`` and have level
-1. A result that stands before its call is taken, and ``early`` says so. Extra columns of the input are ignored.
"""

from __future__ import annotations

import json
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipspark.llm.common import partitions, small_batches, written

#: Nesting that arguments may have, and references in a conversation that are ordered in one pass.
DEPTH, ONE_PASS = 100, 100_000

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def references(value: object) -> set[str]:
    """Call ids that a value refers to."""
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            return {value["$ref"]}
        return set().union(*map(references, value.values()))
    return set().union(*map(references, value)) if isinstance(value, list) else set()


def violations(value: object, schema: dict, at: str = "$") -> list[str]:
    """What in a value breaks a schema of type, enum, minimum, maximum, required, properties, items, additionalProperties.

    A reference stands for a value of any type.
    """
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return []
    kind = schema.get("type")
    whole = kind == "integer" and isinstance(value, float) and value.is_integer()
    if kind and not whole and (not isinstance(value, TYPES[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return [f"{at}: not of type {kind}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if "minimum" in schema and isinstance(value, (int, float)) and value < schema["minimum"]:
        found.append(f"{at}: below minimum")
    if "maximum" in schema and isinstance(value, (int, float)) and value > schema["maximum"]:
        found.append(f"{at}: above maximum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                found += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: not known")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            found += violations(v, schema["items"], f"{at}[{i}]")
    return found


def _refuse(constant: str) -> None:
    raise ValueError(constant)


def _number(text: str) -> float:
    value = float(text)
    return value if math.isfinite(value) else _refuse(text)


def _depth(value: object) -> int:
    """Levels of nesting, at most one more than ``DEPTH``; without recursion."""
    level, here = 0, [value]
    while here and level <= DEPTH:
        level += 1
        here = [v for x in here if isinstance(x, (dict, list)) for v in (x.values() if isinstance(x, dict) else x)]
    return level


def parsed(text: str | None) -> tuple[dict | None, str | None]:
    """(arguments, error)"""
    try:
        value = json.loads(text, parse_constant=_refuse, parse_float=_number) if text is not None else None
        if _depth(value) > DEPTH:
            return None, "$: nested too deep"
        canonical(value).encode()
    except UnicodeEncodeError:
        return None, "$: not text"
    except ValueError:
        return None, "$: no JSON"
    except RecursionError:
        return None, "$: nested too deep"
    return (value, None) if isinstance(value, dict) else (None, "$: no object")


def check_schema(schema: dict, at: str = "$") -> None:
    """ValueError where a schema says what ``violations`` doesn't know."""
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: a schema is an object, not {schema!r}")
    if (kind := schema.get("type")) is not None and kind not in TYPES:
        raise ValueError(f"{at}: unknown type {kind!r}")
    for name, part in schema.get("properties", {}).items():
        check_schema(part, f"{at}.{name}")
    if "items" in schema:
        check_schema(schema["items"], f"{at}[]")


def _checked(schemas: dict[str, dict]):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs, errors, arguments = [], [], []
            for name, text in zip(batch.column("name").to_pylist(), batch.column("arguments").to_pylist()):
                value, error = parsed(text)
                bad = [error] if error else []
                if name not in schemas:
                    bad.append("unknown tool")
                elif value is not None:
                    bad += violations(value, schemas[name])
                refs.append(sorted(references(value)))
                errors.append(bad)
                arguments.append(canonical(value) if value is not None else None)
            kept = [n for n in batch.schema.names if n != "arguments"]
            lists = pa.list_(pa.string())
            columns = [*(batch.column(n) for n in kept), pa.array(arguments, pa.string()), pa.array(refs, lists), pa.array(errors, lists)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "arguments", "refs", "errors"])

    return check


def topological(edges: list[tuple[str, str]]) -> dict[str, int]:
    """Level of every call that needs another, from (call, needed) pairs; calls in or behind a cycle have none."""
    open_needs, behind = Counter(), defaultdict(list)
    for call, needed in set(edges):
        open_needs[call] += 1
        behind[needed].append(call)
    level = dict.fromkeys((n for n in behind if n not in open_needs), 0)
    ready = list(level)
    for call in ready:  # grows while it is walked
        for user in behind.get(call, ()):
            level[user] = max(level.get(user, 0), level[call] + 1)
            open_needs[user] -= 1
            if not open_needs[user]:
                ready.append(user)
    done = set(ready)
    return {c: level[c] for c in open_needs if c in done}


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of conversations that stand together, from (conv_id, call_id, needs)."""

    def out(conv, edges: list[tuple[str, str]]) -> pa.RecordBatch:
        found = topological(edges)
        n = len(found)
        return pa.RecordBatch.from_arrays([pa.array([conv.as_py()] * n, conv.type), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int32())], ["conv_id", "call_id", "level"])

    conv, edges = None, []
    for batch in batches:
        calls, needs = batch.column("call_id").to_pylist(), batch.column("needs").to_pylist()
        for of, call, needed in zip(batch.column("conv_id"), calls, needs):
            if conv is not None and of != conv:
                yield out(conv, edges)
                edges = []
            conv = of
            edges.append((call, needed))
    if conv is not None:
        yield out(conv, edges)


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) from (conv_id, call_id, refs): 0 without references, else one above the highest of them.

    References to unknown calls don't count. Calls in or behind a cycle get no row.
    """
    spark = calls.sparkSession
    ids = calls.select("conv_id", "call_id")
    edges = calls.select("conv_id", "call_id", F.explode_outer("refs").alias("needs")).where("needs is not null")
    edges = edges.join(ids.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"])
    edges = written(edges, "tool-edges").select("conv_id", "call_id", "needs")
    waiting = edges.select("conv_id", "call_id").distinct()
    first = written(ids.join(waiting, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "tool-levels")
    large = written(edges.groupBy("conv_id").count().where(F.col("count") > ONE_PASS).select("conv_id"), "tool-large")
    together = edges.join(large, "conv_id", "left_anti").repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id")
    done = first.unionAll(together.mapInArrow(_ordered, first.schema))
    open_edges = edges.join(large, "conv_id", "left_semi")
    level, fresh = 0, first.join(large, "conv_id", "left_semi")
    while not fresh.isEmpty():
        level += 1
        # an edge goes once the call it needs has a level; who has no edge left gets the next one
        still = written(open_edges.join(fresh.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_anti"), "tool-open")
        before = open_edges.select("conv_id", "call_id").distinct()
        fresh = written(before.join(still.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level)), "tool-levels")
        done = done.unionAll(fresh)
        open_edges = still
    return done


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for row in batch.select(["call_id", "name", "arguments", "content", "errors", "status"]).to_pylist():
            body = {"id": row["call_id"], "status": row["status"]}
            if row["status"] != "orphan":
                body |= {"name": row["name"], "arguments": json.loads(row["arguments"]) if row["arguments"] else None, "errors": row["errors"]}
            if row["content"] is not None:
                body["result"] = row["content"]
            made.append(canonical(body))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, "line"])


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call and per result without a call, in no order; ``(conv_id, level, turn, call_id)`` orders them.

    ``calls`` (conv_id, turn, call_id, name, arguments) and ``results`` (conv_id, turn, call_id, content) are whole tables.
    """
    for name, schema in schemas.items():
        check_schema(schema, name)
    small_batches(calls.sparkSession)
    sound = calls.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("call_id").cast("string").alias("call_id"), "name", "arguments")
    id_type = calls.schema["conv_id"].dataType.simpleString()
    checked = written(sound.mapInArrow(_checked(schemas), f"conv_id {id_type}, turn long, call_id string, name string, arguments string, refs array<string>, errors array<string>"), "tool-calls")
    whole = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()
    body = F.struct(F.coalesce("turn", F.lit((1 << 63) - 1)).alias("at"), "turn", "name", "arguments", "refs", "errors")
    firsts = written(checked.where(whole).groupBy("conv_id", "call_id").agg(F.min(body).alias("b"), F.count("*").alias("calls")), "tool-firsts").select("conv_id", "call_id", "b.turn", "b.name", "b.arguments", "b.refs", "b.errors", "calls")
    answer = F.struct(F.coalesce("turn", F.lit((1 << 63) - 1)).alias("at"), "turn", "content")
    given = results.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("call_id").cast("string").alias("call_id"), "content")
    answers = given.where(whole).groupBy("conv_id", "call_id").agg(F.min(answer).alias("r"), F.count("*").alias("n_results"))
    answers = answers.select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), "n_results")

    order = levels(firsts)
    known = firsts.select("conv_id", F.col("call_id").alias("ref"))
    lost = firsts.select("conv_id", "call_id", F.explode_outer("refs").alias("ref")).where("ref is not null").join(known, ["conv_id", "ref"], "left_anti")
    lost = lost.groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("unknown reference "), "ref"))).alias("lost"))
    joined = firsts.join(order, ["conv_id", "call_id"], "left").join(lost, ["conv_id", "call_id"], "left").join(answers.withColumn("answered", F.lit(True)), ["conv_id", "call_id"], "full")
    status = F.when(F.col("calls").isNull(), "orphan").when(F.col("level").isNull(), "cycle").when(F.col("answered").isNull(), "open").otherwise("linked")
    none = F.array().cast("array<string>")
    errors = F.concat(F.coalesce("errors", none), F.coalesce("lost", none))
    columns = ["conv_id", F.coalesce("turn", "result_turn").alias("turn"), "call_id", "name", "arguments", "content"]
    linked = joined.select(*columns, errors.alias("errors"), status.alias("status"), F.coalesce("level", F.lit(-1)).alias("level"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), F.coalesce(F.col("result_turn") < F.col("turn"), F.lit(False)).alias("early"))

    # what has no id, and what repeats one
    nth = checked.where(whole).join(firsts.where("calls > 1").select("conv_id", "call_id", F.struct("turn", "name", "arguments", "refs", "errors").alias("kept")), ["conv_id", "call_id"])
    same = F.struct("turn", "name", "arguments", "refs", "errors").eqNullSafe(F.col("kept"))
    groups = nth.groupBy("conv_id", "turn", "call_id", "name", "arguments", "errors", "refs", same.alias("same")).count()
    extra = groups.withColumn("count", F.col("count") - F.col("same").cast("long")).where("count > 0")
    extra = extra.select("conv_id", "turn", "call_id", "name", "arguments", "errors", F.lit("duplicate").alias("status"), F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("copy")).drop("copy")
    loose = checked.where(~whole).select("conv_id", "turn", "call_id", "name", "arguments", "errors", F.lit("no_id").alias("status"))
    odd_results = given.where(~whole).select("conv_id", "turn", "call_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), "content", none.alias("errors"), F.lit("orphan").alias("status"), F.lit(-1).alias("level"), F.lit(1).cast("long").alias("n_results"), F.lit(False).alias("early"))
    rest = extra.unionByName(loose).select("conv_id", "turn", "call_id", "name", "arguments", F.lit(None).cast("string").alias("content"), "errors", "status", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("n_results"), F.lit(False).alias("early"))
    rows = linked.unionByName(rest).unionByName(odd_results)
    schema = T.StructType([*rows.schema.fields, T.StructField("line", T.StringType())])
    return rows.mapInArrow(_lines, schema)


#: The tools that calls derived from conversations name.
SCHEMAS = {
    "search": {"type": "object", "required": ["query"], "additionalProperties": False, "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}, "after": {"type": "object"}}},
    "measure": {"type": "object", "required": ["text", "unit"], "properties": {"text": {"type": "string"}, "unit": {"type": "string", "enum": ["chars", "words"]}}},
}


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from plain chats: an assistant's turn calls a tool, the user's next turn is its result.

    Hashes of conversation and turn decide the tool, faults in the arguments, references to the call before, repeated and
    missing ids. Keys stand in no sorted order.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    h = lambda salt, mod: F.pmod(F.xxhash64(F.lit(salt), "conv_id", "turn"), F.lit(mod))
    call_id = F.concat(F.lit("call-"), F.col("turn"))
    words = F.substring_index("text", " ", 5)
    after = F.when((F.col("turn") >= 3) & (h(1, 2) == 0), F.struct(F.concat(F.lit("call-"), F.col("turn") - 2).alias("$ref")))
    limit = F.when(h(2, 9) == 0, F.lit("many")).otherwise((h(3, 60) + 1).cast("string"))
    search = F.concat(
        F.lit('{"query": '), F.to_json(F.array(words)), F.lit(', "limit": '), F.when(h(2, 9) == 0, F.concat(F.lit('"'), limit, F.lit('"'))).otherwise(limit),
        F.coalesce(F.concat(F.lit(', "after": '), F.to_json(after)), F.lit("")), F.lit("}"),
    )
    # a one-word array is written as its only member
    search = F.regexp_replace(search, r'"query": \[(.*?)\], "limit"', '"query": $1, "limit"')
    unit = F.when(h(4, 5) == 0, F.lit("pages")).otherwise(F.lit("words"))
    measure = F.when(h(5, 6) == 0, F.to_json(F.struct(unit.alias("unit")))).otherwise(F.to_json(F.struct(unit.alias("unit"), words.alias("text"))))
    tool = h(6, 10)
    name = F.when(tool < 6, "search").when(tool < 9, "measure").otherwise("teleport")
    arguments = F.when(h(7, 40) == 0, F.lit("{not json")).when(name == "measure", measure).otherwise(search)
    repeats = F.when(h(8, 25) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    calls = rows.where("role = 'assistant'").select("conv_id", "turn", F.when(h(9, 50) > 0, call_id).alias("call_id"), name.alias("name"), arguments.alias("arguments"), F.explode(repeats).alias("copy")).drop("copy")
    results = rows.where("role = 'user' and turn > 0").select("conv_id", "turn", F.concat(F.lit("call-"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def digest(linked: DataFrame) -> DataFrame:
    return linked.select("conv_id", "turn", "call_id", "name", "status", "level", "n_results", "early", F.size("errors").alias("n_errors"), "line")
