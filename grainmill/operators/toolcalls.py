"""Conversations with tools: schema, training rows of the prompt contract, masking of tool names, strict answers, exactness rates.

A conversation is a row with ``messages`` and ``tools``; arguments and parameters are JSON text. Checks don't raise but name the first problem of a
conversation in a column, so that callers choose between refusing a job and dropping rows. Rows are independent: nothing here shuffles but the final sums.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.canonical import canonical, strict_loads

CALLS = "array<struct<name:string,arguments:string>>"
MESSAGES = f"array<struct<role:string,content:string,tool_calls:{CALLS},tool_response:string>>"
TOOLS = "array<struct<name:string,description:string,parameters:string>>"
#: The markers of the prompt format. No text may contain one.
SYSTEM, USER, ASSISTANT, TOOL, END = "<|system|>", "<|user|>", "<|assistant|>", "<|tool|>", "<|end|>"
CALL_OPEN, CALL_CLOSE, RESPONSE_OPEN, RESPONSE_CLOSE = "<tool_call>", "</tool_call>", "<tool_response>", "</tool_response>"
CATALOG_OPEN, CATALOG_CLOSE = "<|tool_catalog|>", "</|tool_catalog|>"
MARKERS = (END, SYSTEM, USER, ASSISTANT, TOOL, CALL_OPEN, CALL_CLOSE, RESPONSE_OPEN, RESPONSE_CLOSE, CATALOG_OPEN, CATALOG_CLOSE)


def marked(text: Column) -> Column:
    """Whether a text contains NUL or a marker, and so could end or forge a part of the prompt; null counts as empty."""
    found = F.lit(False)
    for marker in ("\x00", *MARKERS):
        found = found | F.contains(F.coalesce(text, F.lit("")), F.lit(marker))
    return found


def quoted(text: Column) -> Column:
    """A text as JSON."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def call_text(call: Column) -> Column:
    """{"arguments":...,"name":...} of a call whose arguments are canonical JSON."""
    return F.concat(F.lit('{"arguments":'), call["arguments"], F.lit(',"name":'), quoted(call["name"]), F.lit("}"))


def calls_text(calls: Column) -> Column:
    return F.array_join(F.transform(calls, lambda c: F.concat(F.lit(CALL_OPEN), call_text(c), F.lit(CALL_CLOSE))), "")


def catalog_text(tools: Column) -> Column:
    """Every tool, in order, as a catalog of functions."""
    one = lambda t: F.concat(F.lit('{"function":{"description":'), quoted(t["description"]), F.lit(',"name":'), quoted(t["name"]), F.lit(',"parameters":'), t["parameters"], F.lit('},"type":"function"}'))
    return F.concat(F.lit(CATALOG_OPEN + '{"tools":['), F.array_join(F.transform(tools, one), ","), F.lit("]}" + CATALOG_CLOSE))


def _called(message: Column) -> Column:
    return F.coalesce(F.size(message["tool_calls"]), F.lit(0)) > 0


def body_text(message: Column) -> Column:
    """What an assistant turn says: its calls, or its text."""
    return F.when(_called(message), calls_text(message["tool_calls"])).otherwise(F.coalesce(message["content"], F.lit("")))


def message_text(message: Column) -> Column:
    content = F.coalesce(message["content"], F.lit(""))
    return (
        F.when(message["role"] == "system", F.concat(F.lit(SYSTEM), content))
        .when(message["role"] == "user", F.concat(F.lit(USER), content))
        .when(message["role"] == "tool", F.concat(F.lit(TOOL + RESPONSE_OPEN), F.coalesce(message["tool_response"], F.lit("")), F.lit(RESPONSE_CLOSE)))
        .otherwise(F.concat(F.lit(ASSISTANT), body_text(message), F.lit(END)))
    )


def problem(messages: Column, tools: Column) -> Column:
    """The first thing that the contract forbids in a conversation, or null: unknown roles, markers, calls beside text, tools with equal or no names, calls of unknown
    tools, arguments or parameters that aren't JSON objects."""
    names = F.transform(tools, lambda t: t["name"])
    calls = F.flatten(F.transform(messages, lambda m: F.coalesce(m["tool_calls"], F.array().cast(CALLS))))
    is_object = lambda j: F.coalesce(j.startswith("{") & F.json_object_keys(j).isNotNull(), F.lit(False))
    texts = F.concat(
        F.transform(messages, lambda m: F.concat(F.coalesce(m["content"], F.lit("")), F.lit(" "), F.coalesce(m["tool_response"], F.lit("")))),
        F.transform(calls, lambda c: F.concat(c["name"], F.lit(" "), c["arguments"])),
        F.transform(tools, lambda t: F.concat(t["name"], F.lit(" "), F.coalesce(t["description"], F.lit("")), F.lit(" "), t["parameters"])),
    )
    return (
        F.when(F.exists(messages, lambda m: ~F.coalesce(m["role"].isin("system", "user", "assistant", "tool"), F.lit(False))), "role")
        .when(F.exists(names, lambda n: F.coalesce(n, F.lit("")) == "") | (F.size(F.array_distinct(names)) < F.size(names)), "tool_names")
        .when(F.exists(tools, lambda t: ~is_object(t["parameters"])), "parameters")
        .when(F.exists(messages, lambda m: _called(m) & (F.coalesce(m["content"], F.lit("")) != "")), "calls_beside_text")
        .when(F.exists(calls, lambda c: ~F.array_contains(names, F.coalesce(c["name"], F.lit("")))), "unknown_tool")
        .when(F.exists(calls, lambda c: ~is_object(c["arguments"])), "arguments")
        .when(F.exists(texts, marked), "marker")
    )


def canonical_conversations(rows: DataFrame) -> DataFrame:
    """Arguments and parameters in canonical JSON; what isn't strict JSON becomes null, which problem() then names."""
    flat = rows.withColumn("__a", F.flatten(F.transform("messages", lambda m: F.transform(F.coalesce(m["tool_calls"], F.array().cast(CALLS)), lambda c: c["arguments"]))))
    flat = flat.withColumn("__p", F.transform("tools", lambda t: t["parameters"]))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema)

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else canonical(strict_loads(text))
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pa.array([[one(x) for x in row or ()] for row in batch.column(c).to_pylist()], pa.list_(pa.string())) for c in (batch.num_columns - 2, batch.num_columns - 1)]
            yield pa.record_batch([*batch.columns[:-2], *made], names=batch.schema.names)

    out = flat.mapInArrow(run, kind)
    before = F.transform("messages", lambda m: F.coalesce(F.size(m["tool_calls"]), F.lit(0)))
    out = out.withColumn("__n", before)
    start = lambda i: F.aggregate(F.slice("__n", 1, i), F.lit(0), lambda a, n: a + n)
    out = out.withColumn("messages", F.transform("messages", lambda m, i: m.withField("tool_calls", F.transform(F.coalesce(m["tool_calls"], F.array().cast(CALLS)), lambda c, k: c.withField("arguments", F.get("__a", start(i) + k))))))
    out = out.withColumn("tools", F.transform("tools", lambda t, i: t.withField("parameters", F.get("__p", i))))
    return out.drop("__a", "__p", "__n")


def training_rows(rows: DataFrame, key: str) -> DataFrame:
    """(key, message_index, prompt, body, prompt_bytes, loss_bytes): one row for each assistant turn, with the whole catalog, the whole history and the mark of the next turn as its prompt;
    loss is on the body and its end mark only. A conversation with a problem() is an error at run time: nothing is cut to fit."""
    bad = problem(F.col("messages"), F.col("tools"))
    checked = F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("not a valid conversation: "), bad)).cast(MESSAGES)).otherwise(F.col("messages"))
    rows = rows.select(key, "tools", checked.alias("messages")).withColumn("__lines", F.transform("messages", message_text))
    turn = F.filter(F.transform("messages", lambda m, i: F.struct(i.alias("i"), m["role"].alias("role"), body_text(m).alias("body"))), lambda t: t["role"] == "assistant")
    flat = rows.withColumn("__t", F.explode(turn))
    prompt = F.concat(catalog_text(F.col("tools")), F.lit(END), F.array_join(F.slice("__lines", 1, F.col("__t.i")), ""), F.lit(ASSISTANT))
    out = flat.select(key, F.col("__t.i").alias("message_index"), prompt.alias("prompt"), F.col("__t.body").alias("body"))
    return out.withColumn("prompt_bytes", F.octet_length("prompt")).withColumn("loss_bytes", F.octet_length("body") + len(END))


def semantic_hash(messages: Column, tools: Column) -> Column:
    """SHA-256 of everything that a model would see; ids and metadata don't count."""
    return F.sha2(F.concat(catalog_text(tools), F.lit("\x1d"), F.array_join(F.transform(messages, message_text), "\x1e")), 256)


def masked(rows: DataFrame, key: str, *, seed: int, fraction: float = 1.0, variants: int = 1, prefix: str = "fn") -> DataFrame:
    """The rows, each as variant 0, and for a hash-drawn share of those with tools ``variants`` copies whose tool names are aliases, in the catalog, in calls and nowhere else.

    An alias is prefix, twelve hash digits of seed, key, variant and content, and the name's place among the sorted names. Equal tool names or calls of unknown tools are errors at
    run time. Adds ``variant`` and ``aliases``, a map from names to aliases.
    """
    own = F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), semantic_hash(F.col("messages"), F.col("tools")))
    chosen = (F.size("tools") > 0) & (F.conv(F.substring(F.sha2(own, 256), 1, 8), 16, 10).cast("bigint") < int(fraction * (1 << 32)))
    out = rows.withColumn("__own", own).withColumn("variant", F.explode(F.sequence(F.lit(0), F.when(chosen, F.lit(variants)).otherwise(F.lit(0)))))
    names = F.transform("tools", lambda t: t["name"])
    digits = F.substring(F.sha2(F.concat_ws(":", "__own", F.col("variant").cast("string")), 256), 1, 12)
    alias = F.transform(F.array_sort(names), lambda n, i: F.concat(F.lit(f"{prefix}_"), digits, F.lit("_"), F.lpad(i.cast("string"), 3, "0")))
    known = F.when(F.size(F.array_distinct(names)) < F.size(names), F.raise_error(F.lit("equal tool names")).cast("map<string,string>")).otherwise(F.map_from_arrays(F.array_sort(names), alias))
    out = out.withColumn("aliases", F.when(F.col("variant") > 0, known)).drop("__own")
    renamed = lambda n: F.coalesce(F.try_element_at("aliases", n), F.raise_error(F.concat(F.lit("a call of an unknown tool: "), n)).cast("string"))
    tools = F.transform("tools", lambda t: t.withField("name", renamed(t["name"])))
    messages = F.transform("messages", lambda m: m.withField("tool_calls", F.transform(m["tool_calls"], lambda c: c.withField("name", renamed(c["name"])))))
    masked_row = F.col("variant") > 0
    return out.withColumn("messages", F.when(masked_row, messages).otherwise(F.col("messages"))).withColumn("tools", F.when(masked_row, tools).otherwise(F.col("tools")))


def strict_answer(text: str | None) -> tuple[bool, bool, list[tuple[str, str]]]:
    """(format valid, attempts a call, calls) of a model's answer: text without markers, or nothing but call blocks, each with exactly a name and an argument object."""
    text = text or ""
    attempted = CALL_OPEN in text or CALL_CLOSE in text
    valid = not any(m in text for m in MARKERS if m not in (CALL_OPEN, CALL_CLOSE))
    if not attempted:
        return valid, False, []
    calls, rest = [], text
    while rest.strip():
        before, opened, after = rest.partition(CALL_OPEN)
        inside, closed, rest = after.partition(CALL_CLOSE)
        if before.strip() or not opened or not closed or CALL_OPEN in inside:
            return False, True, calls
        try:
            value = strict_loads(inside)
        except ValueError:
            valid = False
            continue
        if isinstance(value, dict) and set(value) == {"name", "arguments"} and isinstance(value["name"], str) and value["name"] and isinstance(value["arguments"], dict):
            calls.append((value["name"], canonical(value["arguments"])))
        else:
            valid = False
    return valid and bool(calls), True, calls


#: JSON Schema types and the Python values that have them.
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def fits_schema(value, schema: dict) -> bool:
    """The subset object, properties, required, additionalProperties, array, items, scalar types and enum; a boolean is no number."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    has = lambda k: number and (k == "number" or float(value).is_integer()) if k in ("number", "integer") else isinstance(value, _TYPES.get(k, ()))
    if kinds and not any(map(has, kinds)) or "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, dict):
        own, more = schema.get("properties") or {}, schema.get("additionalProperties", True)
        if not set(schema.get("required") or ()) <= value.keys():
            return False
        return all(fits_schema(v, own[k]) if k in own else more if isinstance(more, bool) else fits_schema(v, more) for k, v in value.items())
    return not isinstance(value, list) or all(fits_schema(v, schema.get("items") or {}) for v in value)


JUDGED = f"format_valid boolean, attempted boolean, schema_valid boolean, said {CALLS}"


def judged_answers(rows: DataFrame, answer: str, tools: str) -> DataFrame:
    """Adds what an answer is: whether its format is strictly valid, whether it attempts a call, whether all its calls fit the tools' schemas, and its calls."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    at, catalog = rows.columns.index(answer), rows.columns.index(tools)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column(at).to_pylist(), batch.column(catalog).to_pylist(), strict=True):
                valid, attempted, calls = strict_answer(text)
                known = {t["name"]: t["parameters"] for t in own or ()}
                fits = valid and bool(calls) and all(n in known and fits_schema(json.loads(a), json.loads(known[n] or "{}")) for n, a in calls)
                out.append((valid, attempted, fits, [{"name": n, "arguments": a} for n, a in calls]))
            kinds = (pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.struct([("name", pa.string()), ("arguments", pa.string())])))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)]
            yield pa.record_batch([*batch.columns, *columns], names=[*batch.schema.names, "format_valid", "attempted", "schema_valid", "said"])

    return rows.mapInArrow(run, f"{kind}, {JUDGED}")


def shared_items(a: Column, b: Column) -> Column:
    """The size of the intersection of two arrays as multisets."""
    times = lambda items, x: F.size(F.filter(items, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))


def decision_flags(rows: DataFrame, *, expected: str = "expected", said: str = "said") -> DataFrame:
    """Adds, for decisions with expected and said calls, format_valid, complete, attempted, expected_text and answer: what each metric counts.

    Calls are compared as multisets of (name, canonical arguments). An answer that isn't complete and valid has no calls.
    """
    strict = F.col("complete") & F.col("format_valid")
    calls = F.when(strict, F.col(said)).otherwise(F.array().cast(CALLS))
    names = lambda c: F.transform(c, lambda x: x["name"])
    out = rows.withColumn("__said", calls).withColumn("is_tool", F.size(expected) > 0).withColumn("__strict", strict)
    whole = F.col("__strict") & (F.array_sort(F.col("__said")) == F.array_sort(F.col(expected)))
    exact = F.col("__strict") & (F.array_sort(names(F.col("__said"))) == F.array_sort(names(F.col(expected))))
    out = out.withColumn("whole_exact", whole).withColumn("name_exact", exact)
    out = out.withColumn("abstained", F.col("__strict") & (F.size("__said") == 0) & ~F.col("attempted"))
    out = out.withColumn("text_exact", F.col("abstained") & (F.coalesce("answer", F.lit("")) == F.coalesce("expected_text", F.lit(""))))
    out = out.withColumn("n_said", F.size("__said")).withColumn("n_expected", F.size(expected))
    out = out.withColumn("n_names", shared_items(names(F.col(expected)), names(F.col("__said")))).withColumn("n_calls", shared_items(F.col(expected), F.col("__said")))
    out = out.withColumn("parallel", F.size(expected) > 1)
    out = out.withColumn("many_arguments", F.exists(expected, lambda c: F.size(F.json_object_keys(c["arguments"])) > 1))
    return out.drop("__said", "__strict")


def _share(hit: Column, of: Column) -> Column:
    return F.try_divide(F.count_if(hit & of).cast("double"), F.count_if(of))


def conversation_scores(flags: DataFrame, *, episode: str = "episode", category: str | None = None) -> DataFrame:
    """One row of rates over decision_flags(), or a row for each category and one, with a null category, for all. A rate without cases is null.

    An episode, a conversation with several assistant turns (``multi_turn``), is exact if all its tool decisions are: each follows the reference history, not the model's own.
    """
    tool, plain, every = F.col("is_tool"), ~F.col("is_tool"), F.lit(True)
    strict = F.col("complete") & F.col("format_valid")
    step = tool & F.col("multi_turn")
    names, said, expected = (F.sum(F.when(tool, F.col(c)).otherwise(0)) for c in ("n_names", "n_said", "n_expected"))
    rates = {
        "decisions": F.count(F.lit(1)),
        "tool_decisions": F.count_if(tool),
        "action_exact": _share(F.when(tool, F.col("whole_exact")).otherwise(F.col("abstained")), every),
        "response_exact": _share(F.when(tool, F.col("whole_exact")).otherwise(F.col("text_exact")), every),
        "completion": _share(F.col("complete"), every),
        "format_validity": _share(strict, every),
        "schema_validity_on_attempts": _share(strict & F.col("schema_valid"), F.col("attempted")),
        "tool_format_validity": _share(strict & (F.col("n_said") > 0), tool),
        "tool_schema_validity": _share(strict & F.col("schema_valid"), tool),
        "name_exact": _share(F.col("name_exact"), tool),
        "name_precision": F.try_divide(names.cast("double"), said),
        "name_recall": F.try_divide(names.cast("double"), expected),
        "name_f1": F.try_divide(F.nullif(2.0 * names, F.lit(0.0)), said + expected),
        "arguments_given_name": F.try_divide(F.sum(F.when(tool, F.col("n_calls")).otherwise(0)).cast("double"), names),
        "whole_call_exact": _share(F.col("whole_exact"), tool),
        "abstention": _share(F.col("abstained"), plain),
        "text_exact": _share(F.col("text_exact"), plain),
        "parallel_exact": _share(F.col("whole_exact"), tool & F.col("parallel")),
        "many_arguments_exact": _share(F.col("whole_exact"), tool & F.col("many_arguments")),
        "step_exact": _share(F.col("whole_exact"), step),
    }
    columns = [v.alias(k) for k, v in rates.items()]
    episodes = flags.where(step).groupBy(*([category] if category else []), episode).agg(F.min(F.col("whole_exact").cast("int")).alias("ok"))
    if not category:
        return flags.agg(*columns).crossJoin(episodes.agg(F.avg("ok").alias("episode_exact")))
    found = flags.groupingSets([[category], []], category).agg(*columns)
    whole = episodes.groupingSets([[category], []], category).agg(F.avg("ok").alias("episode_exact")).withColumnRenamed(category, "__c")
    return found.join(whole, F.col(category).eqNullSafe(F.col("__c")), "left").drop("__c")


def slot_values(arguments: Column) -> Column:
    """The scalar values of argument objects as text: what a split audit compares."""
    return F.map_values(F.from_json(arguments, "map<string,string>"))

