import json
import re

import pytest
from pyspark.sql import functions as F

from grainmill.operators import freeze, governance, schedules
from grainmill.operators import imports as I
from grainmill.operators import toolcalls as T

TOOLS = [{"name": "get", "description": "Gets", "parameters": {"type": "object", "properties": {"a": {"type": "integer"}}}}]
LISTED = {"system": f"Use these: {json.dumps(TOOLS)} now.", "conversations": [{"from": "user", "value": "do"}, {"from": "assistant", "value": "Sure?"}, {"from": "user", "value": "yes"}, {"from": "assistant", "value": "[get(a=1), put(b='x', c=[1])]"}, {"from": "tool", "value": "{}"}, {"from": "assistant", "value": "done"}]}


def rows(spark, *records):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in records], "value string")


def got(spark, adapter, record):
    r = I.imported(rows(spark, record), adapter).first()
    return r.problem or ([(m.role, m.content if m.content is not None else m.tool_response, [(c.name, json.loads(c.arguments)) for c in m.tool_calls or ()]) for m in r.messages], {t.name: json.loads(t.parameters) for t in r.tools})


def test_histories(spark):
    calls = [("get", {"a": 1}), ("put", {"b": "x", "c": [1]})]
    said, tools = got(spark, "call_list_history", LISTED)
    assert said == [("user", "do", []), ("assistant", "Sure?", []), ("user", "yes", []), ("assistant", None, calls), ("tool", "{}", []), ("assistant", "done", [])]
    assert tools == {"get": TOOLS[0]["parameters"], "put": {"type": "object", "properties": {"b": {"type": "string"}, "c": {"type": "array"}}}}
    assert [m[0] for m in got(spark, "acting_history", LISTED)[0]] == ["user", "user", "assistant", "tool"]
    assert [m[0] for m in got(spark, "first_call", LISTED)[0]] == ["user", "assistant", "user", "assistant"]
    assert got(spark, "call_list_history", {"conversations": [{"from": "user", "value": "x"}]}) == "record" and got(spark, "call_list_history", "{") == "json" and got(spark, "first_call", {"a": 1}) == "record"
    valid = T.training_rows(I.imported(rows(spark, LISTED), "call_list_history"), "record")
    assert valid.count() == 3


@pytest.mark.parametrize(
    ("adapter", "record", "call"),
    [
        ("mobile_step", {"messages": [{"role": "user", "content": "open mail"}, {"role": "assistant", "content": '{"action_type": "click", "y": 2, "x": 1, "text": null}'}]}, ("click", {"x": 1, "y": 2})),
        ("phone_episode", {"goal": "g", "steps": [{"screen": "s", "action": {"action_type": "tap", "x": 3}}]}, ("tap", {"x": 3})),
        ("desktop_trajectory", {"instruction": "i", "traj": [{"value": {"code": "pyautogui.write(message='hi')"}}]}, ("write", {"text": "hi"})),
        ("first_reference_action", {"task": "t", "tools": TOOLS, "actions": [{"name": "toggle"}, {"name": "get", "arguments": {"a": 4}}]}, ("get", {"a": 4})),
        ("web_step", {"confirmed_task": "buy", "operation": {"op": "TYPE", "value": "v"}, "pos_candidates": [{"backend_node_id": 7}], "action_reprs": ["a", "b"], "step": 1}, ("type", {"element": "7", "value": "v"})),
    ],
)
def test_single_records(spark, adapter, record, call):
    said, tools = got(spark, adapter, record)
    assert [c for m in said for c in m[2]] == [call] and call[0] in tools
    r = I.imported(rows(spark, record), adapter)
    assert r.select(T.problem(F.col("messages"), F.col("tools")).alias("p")).first().p is None
    assert got(spark, adapter, {"messages": []}) == "record"


def test_questions(spark):
    assert got(spark, "question_answer", {"problem": " p ", "solution": 7}) == ([("user", "p", []), ("assistant", "7", [])], {}) and got(spark, "question_answer", {"question": "q"}) == "record"


def test_public_build(spark):
    qa = {"question": "What?", "answer": "That."}
    data = rows(spark, LISTED, LISTED, "{").withColumn("source", F.lit("l")).union(rows(spark, qa, {"question": "Held  Out", "answer": "x"}, {"question": "a <|end|>", "answer": "x"}).withColumn("source", F.lit("q")))
    held = spark.createDataFrame([("held out",)], "prompt string")
    kept, counts = I.public_build(data, {"l": "call_list_history", "q": "question_answer"}, held_out=held)
    assert sorted(r.source for r in kept.collect()) == ["l", "q"]
    assert {(r.source, r.outcome): r.n for r in counts.collect()} == {("l", "kept"): 2, ("l", "json"): 1, ("q", "kept"): 1, ("q", "held_out"): 1, ("q", "marker"): 1}


def test_enrichment(spark):
    made = I.imported(rows(spark, LISTED, {"question": "q", "answer": "a"}), lambda r: I.call_list_history(r) if "conversations" in r else I.question_answer(r))
    out = {(len(r.tools) > 0, r.level): r for r in I.enriched(made, "record", seed=3, domain=F.lit("mail")).collect()}
    assert sorted(out) == [(False, 0), (False, 1), (False, 2), (True, 0), (True, 1), (True, 2), (True, 3)]
    first = {k: r.messages[0].content for k, r in out.items()}
    assert first[True, 0] == "do" and "do" in first[True, 1] and first[True, 1] != "do" and "mail" in first[True, 2] and '"do"' in first[True, 3]
    assert [m.role for m in out[True, 3].messages] == ["user", "assistant"] and len(out[True, 2].messages) == 6 and out[True, 2].messages[2].content == "yes"


def test_synthesis(spark):
    out = I.synthesised(spark, ["Book {what} in {city}", "{city}!"], {"what": ["a room", "a car"], "city": ["Oslo", "Rome", "Bern"]}, 300, 5).collect()
    assert {r.text for r in out} == {f"Book {w} in {c}" for w in ("a room", "a car") for c in ("Oslo", "Rome", "Bern")} | {f"{c}!" for c in ("Oslo", "Rome", "Bern")}
    with pytest.raises(ValueError, match="unknown slots"):
        I.synthesised(spark, ["{x}"], {}, 1, 1)


def test_prompt_exports_freeze(spark):
    bfcl = {"id": "simple_1", "question": [[{"role": "user", "content": "sum"}]], "function": [{"name": "f"}], "ground_truth": ["f()"]}
    web = {"annotation_id": "w", "confirmed_task": "buy", "actions": [{"action_uid": "1"}, {"action_uid": "2"}], "action_reprs": ["click a", "click b"]}
    talk = {"demo": "d", "turns": [{"type": "chat", "speaker": "instructor", "utterance": "hi"}, {"type": "browser"}, {"type": "chat", "speaker": "navigator", "utterance": "ok"}, {"type": "chat", "speaker": "instructor", "utterance": "go"}]}
    goal = {"task_name": "t", "task_seed": 3, "goal": "win", "axtree_txt": "root"}
    found = [r for name, x in (("function_cases", bfcl), ("web_cases", web), ("dialogue_cases", talk), ("goal_cases", goal)) for r in I.prompt_cases(rows(spark, x, {"z": 1}), name).collect()]
    assert [(r.source_case_id, r.prompt) for r in found if not r.problem] == [("simple_1", 'sum\n{"name":"f"}'), ("w/1", "buy"), ("w/2", "buy\nclick a"), ("d/0", "instructor: hi"), ("d/3", "instructor: hi\nnavigator: ok\ninstructor: go"), ("t.3", "win\nroot")]
    assert sum(r.problem == "record" for r in found) == 4
    lines = I.prompt_cases(rows(spark, web), "web_cases").select(F.to_json(F.struct("source_case_id", "prompt")).alias("value"))
    assert freeze.freeze_denylist(lines, "m2w", max_cases=9, max_bytes=99)[0].count() == 2


def act(kind, **arguments):
    return {"action_type": kind, "arguments": arguments}


def test_trajectories(spark):
    gold = [act("click", x=0.5, y=0.5, boxes=[[0.4, 0.4, 0.6, 0.6]]), act("write", text="Hello"), act("click", x=0.1, y=0.1), act("terminate", status="success")]
    assert I.trajectory_score(gold, [act("click", x=0.59, y=0.41), act("write", text="hello "), act("click", x=0.1, y=0.105)]) == 1.0
    far = I.trajectory_score(gold, [act("click", x=0.5, y=0.5), act("write", text="zzzzz"), act("click", x=0.1, y=0.6)])
    assert far == pytest.approx(((1 + 2.718281828 ** -(0.5 - 0.01)) / 2 + 0) / 2)
    assert I.trajectory_score(gold, [act("scroll", clicks=1)]) == 0.0 and I.trajectory_score(gold, []) == 0.0 and I.trajectory_score(gold[:1], [act("click", x=0.5, y=0.5)] * 4) == 0.25
    assert I.trajectory_score([act("terminate", status="failure")], [act("terminate", status="Failure")]) == 1.0
    assert I.action_score("scroll", {"clicks": -2}, {"clicks": -4}) == 0.5 and I.action_score("scroll", {"clicks": 2}, {"clicks": -2}) == 0 and I.action_score("hotkey", {"keys": ["Ctrl"]}, {"keys": ["ctrl"]}) == 1
    out = I.trajectory_scores(spark.createDataFrame([(1, json.dumps(gold), json.dumps(gold)), (2, None, "x")], "k int, g string, s string"), "k", "g", "s").collect()
    assert {r.k: r.score for r in out} == {1: 1.0, 2: 0.0}


def test_signatures():
    code = 'class K:\n @is_tool(W)\n def f(self, a: str, n: int = 3, xs: list[str] = None, d: Optional[float] = None, z: Foo = 1):\n  """Does f."""\n def g(self): pass'
    assert I.signature_types(code, "is_tool") == {"f": {"name": "f", "description": "Does f.", "parameters": {"type": "object", "properties": {"a": {"type": "string"}, "n": {"type": "integer"}, "xs": {"type": "array"}, "d": {"type": "number"}, "z": {"type": "string", "description": "source type: Foo"}}, "required": ["a"]}}}
    assert re.match("Does", I.signature_types(code, "is_tool")["f"]["description"])


def test_coverage_is_spread_without_changing_the_set(spark):
    for total, coverage in ((10, 3), (100, 7), (5, 5), (9, 1)):
        out = schedules.spread_coverage(spark.range(total).withColumnRenamed("id", "rank"), "rank", coverage, total).collect()
        place = {r["rank"]: r.position for r in out}
        taken = [((2 * k + 1) * total) // (2 * coverage) for k in range(coverage)]
        assert [place[k] for k in range(coverage)] == taken and [place[k] for k in range(coverage, total)] == [p for p in range(total) if p not in taken]


def test_pulses(spark):
    out = {r.ordinal: (r.source, r["index"], r.epoch) for r in schedules.pulsed(spark, ["a", "b", "a"], {"a": 3, "b": 2, "p": 2}, "p", 5, 2, 0, 12).collect()}
    assert [out[k] for k in range(12)] == [("a", 0, 0), ("b", 0, 0), ("a", 1, 0), ("p", 0, 0), ("p", 1, 0), ("a", 2, 0), ("b", 1, 0), ("a", 0, 1), ("p", 0, 1), ("p", 1, 1), ("a", 1, 1), ("b", 0, 1)]


def test_catalog_problems(spark):
    kind = "id string, family string, source_url string, access string, policy string, license string"
    good = ("a", "web", "https://x.org/a", "public_download", "train", "mit")
    bad = [("b", "sea", *good[2:]), ("c", "web", "http://x", *good[3:]), ("d", "web", good[2], "gated", "train", "mit"), ("e", "web", good[2], "gated", "eval_only", None), ("f", "web", good[2], "public_download", "train", "Unknown"), ("g", "web", good[2], good[3], "maybe", "mit"), ("h", *good[1:]), ("h", *good[1:])]
    found = governance.catalog_problems(spark.createDataFrame([good, *bad], kind), ["web"]).collect()
    assert {r.id: r.problem for r in found} == {"b": "family", "c": "url", "d": "access", "f": "license", "g": "policy", "h": "repeated_id"}
