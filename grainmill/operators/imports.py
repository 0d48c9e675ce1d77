"""Public records to tool conversations and to prompt-only cases; enrichment levels, synthesis from templates, trajectory scores.

Adapters are plain functions of one JSON record, run in Arrow batches; they return null for a record that they can't use, and the rows say so in ``problem``, so that nothing is lost without a trace.
"""

from __future__ import annotations

import ast
import json
import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.canonical import canonical
from grainmill.operators import toolcalls as T
from grainmill.operators.adapters import parse_actions, parse_call_list

#: JSON types by Python type, for schemas that are inferred from calls.
KINDS = {bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object", type(None): "null"}


def message(role: str, content: str | None = None, calls: list[tuple[str, dict]] | None = None, response: str | None = None) -> dict:
    made = [{"name": n, "arguments": canonical(a)} for n, a in calls] if calls is not None else None
    return {"role": role, "content": content, "tool_calls": made, "tool_response": response}


def inferred_tools(calls: list[tuple[str, dict]], known: dict[str, dict] | None = None) -> list[dict]:
    """A catalog for calls: the known tools, and for others an object schema with the types that their arguments have."""
    known, seen = known or {}, defaultdict(lambda: defaultdict(set))
    for name, arguments in calls:
        for key, value in arguments.items():
            seen[name][key].add(KINDS[type(value)])
        seen[name]
    tools = {n: {"name": n, "description": t.get("description") or "", "parameters": canonical(t.get("parameters") or {"type": "object"})} for n, t in known.items()}
    for name, keys in seen.items():
        if name not in tools:
            schema = {"type": "object", "properties": {k: {"type": min(v) if len(v) == 1 else sorted(v)} for k, v in sorted(keys.items())}}
            tools[name] = {"name": name, "description": "", "parameters": canonical(schema)}
    return [tools[n] for n in sorted(tools)]


def tools_in(text: str | None) -> dict[str, dict]:
    """The tools of the first JSON list of objects with names in a system prompt."""
    decoder, at = json.JSONDecoder(), (text or "").find("[")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
        except ValueError:
            found = None
        if isinstance(found, list) and found and all(isinstance(t, dict) and isinstance(t.get("name"), str) for t in found):
            return {t["name"]: t for t in found}
        at = text.find("[", at + 1)
    return {}


def call_list_history(record: dict, *, texts: bool = True) -> dict | None:
    """A system prompt with tools and turns of user, assistant and tool: every turn; assistant turns are strict call lists or texts. Without texts, only turns that act, and what users and tools said."""
    messages, calls = [], []
    for turn in record["conversations"]:
        speaker, said = turn["from"], turn["value"]
        if speaker == "assistant":
            own = parse_call_list(said)
            calls += own
            if own:
                messages.append(message("assistant", calls=own))
            elif texts:
                messages.append(message("assistant", said))
        elif speaker == "tool":
            messages.append(message("tool", response=said))
        elif speaker == "user":
            messages.append(message("user", said))
        else:
            return None
    return {"messages": messages, "tools": inferred_tools(calls, tools_in(record.get("system")))} if calls else None


def acting_history(record: dict) -> dict | None:
    return call_list_history(record, texts=False)


def first_call(record: dict) -> dict | None:
    """The turns up to and with the first one that acts."""
    whole = call_list_history(record)
    if whole is None:
        return None
    at = next(k for k, m in enumerate(whole["messages"]) if m["tool_calls"])
    return whole | {"messages": whole["messages"][: at + 1]}


def mobile_step(record: dict) -> dict | None:
    """A user's instruction, and the last assistant turn as one JSON action (action_type or action, and its fields)."""
    asked = next(m["content"] for m in record["messages"] if m["role"] == "user")
    action = json.loads(next(m["content"] for m in reversed(record["messages"]) if m["role"] == "assistant"))
    name = action.get("action_type") or action.get("action")
    if not isinstance(name, str) or not asked.strip():
        return None
    call = (name, {k: v for k, v in sorted(action.items()) if k not in ("action_type", "action") and v is not None})
    said = [message("system", "You act on a phone. No picture is given."), message("user", asked), message("assistant", calls=[call]), message("tool", response="recorded")]
    return {"messages": said, "tools": inferred_tools([call])}


def phone_episode(record: dict) -> dict | None:
    """A goal, and steps with what the screen says and the action taken: one turn for each."""
    said, calls = [message("user", record["goal"])], []
    for step in record["steps"]:
        action = dict(step["action"])
        call = (action.pop("action_type"), {k: v for k, v in sorted(action.items()) if v is not None})
        calls.append(call)
        said += [message("assistant", calls=[call]), message("tool", response=step.get("screen") or "")]
    return {"messages": said, "tools": inferred_tools(calls)} if calls else None


def desktop_trajectory(record: dict) -> dict | None:
    """An instruction, and steps whose code is literal pointer and keyboard calls: one turn for each step."""
    said, calls = [message("user", record["instruction"])], []
    for step in record["traj"]:
        own = [(a["action_type"], a["arguments"]) for a in parse_actions(step["value"]["code"])]
        calls += own
        said += [message("assistant", calls=own), message("tool", response="done")]
    return {"messages": said, "tools": inferred_tools(calls)} if calls else None


def first_reference_action(record: dict) -> dict | None:
    """A task with its tools and reference actions of several actors: the first action of the agent, that is the first one whose name is in the agent's catalog."""
    known = {t["name"]: t for t in record["tools"]}
    action = next((a for a in record["actions"] if a["name"] in known), None)
    if action is None:
        return None
    call = (action["name"], action.get("arguments") or {})
    return {"messages": [message("user", record["task"]), message("assistant", calls=[call])], "tools": inferred_tools([], known)}


def web_step(record: dict) -> dict | None:
    """A task on a web page: the operation, with its value, on the element that is marked positive."""
    operation, target = record["operation"], record["pos_candidates"][0]
    call = (operation["op"].lower(), {"element": str(target["backend_node_id"])} | ({"value": operation["value"]} if operation.get("value") else {}))
    asked = "\n".join([record["confirmed_task"], *(f"done: {a}" for a in record.get("action_reprs", [])[: record.get("step", 0)])])
    return {"messages": [message("user", asked), message("assistant", calls=[call])], "tools": inferred_tools([call])}


def question_answer(record: dict) -> dict | None:
    """question and answer under the usual names, without tools."""
    asked, said = (next((str(record[k]) for k in keys if record.get(k) not in (None, "")), "").strip() for keys in (("question", "problem", "prompt", "instruction"), ("answer", "solution", "response", "output")))
    return {"messages": [message("user", asked), message("assistant", said)], "tools": []} if asked and said else None


ADAPTERS: dict[str, Callable[[dict], dict | None]] = {f.__name__: f for f in (call_list_history, acting_history, first_call, mobile_step, phone_episode, desktop_trajectory, first_reference_action, web_step, question_answer)}


def imported(rows: DataFrame, adapter: str | Callable[[dict], dict | None], *, column: str = "value") -> DataFrame:
    """(record, messages, tools, problem): a row for each row; record is the SHA-256 of its JSON. problem is json, record (the adapter found it lacking) or null. Null JSON counts as json."""
    read = ADAPTERS[adapter] if isinstance(adapter, str) else adapter

    def one(text: str | None) -> tuple[list | None, list | None, str | None]:
        try:
            record = json.loads(text or "")
        except ValueError:
            return None, None, "json"
        try:
            found = read(record)
        except (KeyError, TypeError, ValueError, IndexError, AttributeError, StopIteration, SyntaxError):
            found = None
        return (found["messages"], found["tools"], None) if found else (None, None, "record")

    call = pa.struct([("name", pa.string()), ("arguments", pa.string())])
    kinds = (pa.list_(pa.struct([("role", pa.string()), ("content", pa.string()), ("tool_calls", pa.list_(call)), ("tool_response", pa.string())])), pa.list_(pa.struct([("name", pa.string()), ("description", pa.string()), ("parameters", pa.string())])), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(v) for v in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), *(pa.array([f[k] for f in found], t) for k, t in enumerate(kinds))], names=["record", "messages", "tools", "problem"])

    return rows.select(F.sha2(column, 256).alias("record"), column).mapInArrow(run, f"record string, messages {T.MESSAGES}, tools {T.TOOLS}, problem string")


def public_build(rows: DataFrame, sources: dict[str, str], *, source: str = "source", column: str = "value", held_out: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Conversations of several public sources, each by its adapter: (source, record, messages, tools, digest) of what is valid under the prompt contract, one of each content, and whose first prompts aren't among
    held-out ones (prompt: normalised text); and the counts of (source, outcome): kept, duplicate, held_out, or the problem."""
    parts = []
    for name, adapter in sources.items():
        parts.append(imported(rows.where(F.col(source) == name), adapter, column=column).withColumn("source", F.lit(name)))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = every.withColumn("problem", F.coalesce("problem", T.problem(F.col("messages"), F.col("tools"))))
    every = every.withColumn("digest", F.when(F.col("problem").isNull(), T.semantic_hash(F.col("messages"), F.col("tools"))))
    asked = F.lower(F.trim(F.regexp_replace(F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"], r"\s+", " ")))
    if held_out is not None:
        hit = held_out.select(F.col("prompt").alias("__p"), F.lit(True).alias("__hit")).distinct()
        every = every.withColumn("__asked", asked).join(hit, F.col("__asked") == F.col("__p"), "left").withColumn("problem", F.coalesce("problem", F.when(F.col("__hit"), "held_out"))).drop("__asked", "__p", "__hit")
    first = every.where("problem is null").groupBy("digest").agg(F.min(F.struct("source", "record")).alias("first"))
    every = every.join(first, "digest", "left")
    own = F.struct("source", "record") == F.col("first")
    counts = every.groupBy("source", F.coalesce("problem", F.when(own, "kept").otherwise("duplicate")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    kept = every.where(F.col("problem").isNull() & own).dropDuplicates(["digest"])
    return kept.select("source", "record", "messages", "tools", "digest"), counts


#: What enrichment says around a request.
WRAPPERS = ("Please handle this request: {request}", "Here is what I need done. {request}", "Task from the queue: {request}", "{request} Use the tools you have.")
CONTEXTS = ("We are working on {domain}. {request}", "Context: {domain}. Request: {request}", "In the {domain} workspace: {request}")
CANCELLED, ACKNOWLEDGED = 'This request is cancelled and only quoted: "{request}" Do not act on it; confirm that you understood.', "Understood. I will not act on it."


def enriched(rows: DataFrame, key: str, *, seed: int, levels: int = 3, domain: Column | None = None) -> DataFrame:
    """Each conversation at level 0, and up to ``levels``: 1, its first request in other words around it; 2, with its domain; 3, if it acts, cancelled: the request quoted, no call, an acknowledgement. Which words is a matter of seed
    and key. Adds ``level``. Conversations without a user turn stay at level 0."""
    at = F.array_position(F.transform("messages", lambda m: m["role"]), "user").cast("int")
    request = F.get("messages", at - 1)["content"]
    pick = lambda texts, k: F.element_at(F.array(*map(F.lit, texts)), (F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.lit(k)), F.lit(len(texts))) + 1).cast("int"))
    fill = lambda text: F.replace(F.replace(text, F.lit("{domain}"), domain if domain is not None else F.lit("this task")), F.lit("{request}"), request)
    acts = F.exists("messages", lambda m: F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0)
    most = F.when(at == 0, 0).otherwise(F.least(F.lit(levels), F.when(acts, 3).otherwise(2)))
    out = rows.withColumn("level", F.explode(F.sequence(F.lit(0), most)))
    words = F.when(F.col("level") == 1, fill(pick(WRAPPERS, 1))).when(F.col("level") == 2, fill(pick(CONTEXTS, 2)))
    changed = F.transform("messages", lambda m, i: F.when(i == at - 1, m.withField("content", words)).otherwise(m))
    none, no_calls = F.lit(None).cast("string"), F.lit(None).cast(T.CALLS)
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"), no_calls.alias("tool_calls"), none.alias("tool_response"))
    cancelled = F.array(turn("user", F.replace(F.lit(CANCELLED), F.lit("{request}"), request)), turn("assistant", F.lit(ACKNOWLEDGED))).cast(T.MESSAGES)
    return out.withColumn("messages", F.when(F.col("level") == 0, F.col("messages")).when(F.col("level") == 3, cancelled).otherwise(changed))


def synthesised(spark, templates: list[str], slots: dict[str, list[str]], count: int, seed: int) -> DataFrame:
    """(id, template, text): ``count`` texts, a template for each by hash, and in it each {slot} by another hash of seed, id and slot. An unknown slot in a template is an error at once."""
    import re

    if unknown := {s for t in templates for s in re.findall(r"\{(\w+)\}", t)} - set(slots):
        raise ValueError(f"unknown slots: {sorted(unknown)}")
    draw = lambda what, n: (F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(what)), F.lit(n)) + 1).cast("int")
    out = spark.range(count).withColumn("template", draw("", len(templates)) - 1)
    text = F.element_at(F.array(*map(F.lit, templates)), F.col("template") + 1)
    for name, values in sorted(slots.items()):
        text = F.replace(text, F.lit(f"{{{name}}}"), F.element_at(F.array(*map(F.lit, values)), draw(name, len(values))))
    return out.withColumn("text", text)


def function_cases(record: dict) -> list[tuple[str, str]]:
    """A function-calling case: id, questions in turns, functions. One prompt with all that is asked and offered."""
    asked = [m["content"] for turn in record["question"] for m in (turn if isinstance(turn, list) else [turn]) if m["role"] in ("user", "system")]
    offered = [canonical(f) for f in record.get("function", [])]
    return [(record["id"], "\n".join([*asked, *offered]))]


def web_cases(record: dict) -> list[tuple[str, str]]:
    """A web task with its actions: one prompt for each step, the task and what was done before it; the element and the operation are answers and stay out."""
    done = record.get("action_reprs", [])
    return [(f"{record['annotation_id']}/{a['action_uid']}", "\n".join([record["confirmed_task"], *done[:k]])) for k, a in enumerate(record["actions"])]


def dialogue_cases(record: dict) -> list[tuple[str, str]]:
    """A browsing dialogue: one prompt for each instructor turn, with what was said before it."""
    said, out = [], []
    for k, turn in enumerate(record["turns"]):
        if turn.get("type") == "chat":
            said.append(f"{turn['speaker']}: {turn['utterance']}")
            if turn["speaker"] == "instructor":
                out.append((f"{record['demo']}/{k}", "\n".join(said)))
    return out


def goal_cases(record: dict) -> list[tuple[str, str]]:
    """An environment's task and seed, with its goal and what the page shows at first."""
    return [(f"{record['task_name']}.{record['task_seed']}", "\n".join(filter(None, [record["goal"], record.get("axtree_txt")])))]


EXPORTS: dict[str, Callable[[dict], list[tuple[str, str]]]] = {f.__name__: f for f in (function_cases, web_cases, dialogue_cases, goal_cases)}


def prompt_cases(rows: DataFrame, export: str, *, column: str = "value") -> DataFrame:
    """(record, source_case_id, prompt, problem): prompt-only cases of benchmark records, as freeze.freeze_denylist() takes them; a record that can't be read has one row with problem ``record``."""
    read = EXPORTS[export]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                try:
                    own = [(i, p, None) for i, p in read(json.loads(text or "null"))]
                except (KeyError, TypeError, ValueError, AttributeError):
                    own = [(None, None, "record")]
                at += [k] * len(own)
                out += own
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([o[k] for o in out], pa.string()) for k in range(3))], names=["record", "source_case_id", "prompt", "problem"])

    return rows.select(F.sha2(column, 256).alias("record"), column).mapInArrow(run, "record string, source_case_id string, prompt string, problem string")


#: Of trajectory scores: the distance that counts as a hit, the decay beyond it, and the similarity from which a text counts as right.
HIT, DECAY, SAME_TEXT = 0.01, 1.0, 0.8
POINTER = ("click", "doubleclick", "rightclick", "middleclick", "tripleclick", "moveto", "dragto")


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for x in a:
        last, row[0] = row[0], row[0] + 1
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def action_score(kind: str, said: dict, gold: dict) -> float:
    """From 0 to 1, how near an action's arguments come: a pointer in a target box or by distance, texts by edit distance, keys and status by equality, scrolling by direction and amount."""
    kind = kind.lower()
    if kind in POINTER:
        x, y = float(said["x"]), float(said["y"])
        if any(b[0] <= x <= b[2] and b[1] <= y <= b[3] for b in gold.get("boxes", [])):
            return 1.0
        far = math.hypot(x - float(gold["x"]), y - float(gold["y"]))
        return 1.0 if far <= HIT else math.exp(-DECAY * (far - HIT))
    if kind == "write":
        a, b = (str(v.get("text", "")).casefold().strip() for v in (said, gold))
        near = 1 - edit_distance(a, b) / max(len(a), len(b)) if a or b else 1.0
        return 1.0 if near >= SAME_TEXT else near / SAME_TEXT
    if kind in ("press", "hotkey"):
        return float([str(k).lower() for k in said.get("keys", [])] == [str(k).lower() for k in gold.get("keys", [])])
    if kind in ("scroll", "hscroll"):
        a, b = (float(v.get("clicks", 0)) for v in (said, gold))
        return 1.0 if a == b else 0.0 if a * b <= 0 else min(abs(a), abs(b)) / max(abs(a), abs(b))
    if kind == "wait":
        return float(float(said.get("seconds", -1)) == float(gold.get("seconds", 0)))
    return float(str(said.get("status")).lower() == str(gold.get("status")).lower()) if kind == "terminate" else 0.0


def trajectory_score(gold: list[dict], said: list[dict]) -> float:
    """The mean over kinds of action of their mean score, place by place; more actions than asked for cost in proportion, a wrong kind at a place scores 0 there, a first action of no kind that occurs scores 0 in all."""
    if not gold or not said:
        return 0.0
    kinds = [a["action_type"].lower() for a in gold]
    own = [a["action_type"].lower() for a in said]
    charge = min(1.0, len(gold) / len(said))
    if kinds[0] == "terminate":
        return charge * (own[0] == "terminate" and action_score("terminate", said[0]["arguments"], gold[0]["arguments"]))
    if own[0] not in kinds:
        return 0.0
    scores = defaultdict(list)
    for k, kind in enumerate(kinds):
        if kind != "terminate":
            try:
                scores[kind].append(action_score(kind, said[k]["arguments"], gold[k]["arguments"]) if k < len(own) and own[k] == kind else 0.0)
            except (KeyError, TypeError, ValueError):
                scores[kind].append(0.0)
    return charge * sum(sum(v) / len(v) for v in scores.values()) / len(scores)


def trajectory_scores(rows: DataFrame, key: str, gold: str, said: str) -> DataFrame:
    """(key, score) of JSON lists of actions; what can't be read scores 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    out.append(float(trajectory_score(json.loads(a or "[]"), json.loads(b or "[]"))))
                except (ValueError, KeyError, TypeError, AttributeError):
                    out.append(0.0)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.float64())], names=["k", "score"])

    return rows.select(F.col(key).alias("k"), gold, said).mapInArrow(run, f"k {rows.schema[key].dataType.simpleString()}, score double").withColumnRenamed("k", key)


def signature_types(code: str, decorator: str) -> dict[str, dict]:
    """Tools of Python source: functions with a decorator, their documentation and the JSON types of their annotated parameters; what has no scalar type is a string whose description names the type."""
    scalars = {"str": "string", "int": "integer", "float": "number", "bool": "boolean"}
    tools = {}
    for node in ast.walk(ast.parse(code)):
        if not isinstance(node, ast.FunctionDef) or not any(ast.unparse(d).split("(")[0].split(".")[-1] == decorator for d in node.decorator_list):
            continue
        parameters = [a for a in node.args.args if a.arg != "self"]
        required = parameters[: len(parameters) - len(node.args.defaults)]
        properties = {}
        for a in parameters:
            given = (ast.unparse(a.annotation) if a.annotation else "str").replace(" | None", "").removeprefix("Optional[")
            given = given.removesuffix("]") if "[" not in given else given
            kind = scalars.get(given) or ("array" if given.lower().startswith("list") else "string")
            properties[a.arg] = {"type": kind} | ({} if given in scalars or kind == "array" else {"description": f"source type: {given}"})
        tools[node.name] = {"name": node.name, "description": ast.get_docstring(node) or "", "parameters": {"type": "object", "properties": properties, "required": [a.arg for a in required]}}
    return tools
