import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from grainmill.operators import toolcalls as T

SCHEMA = f"id bigint, messages {T.MESSAGES}, tools {T.TOOLS}"
PARAMETERS = json.dumps({"type": "object", "properties": {"city": {"type": "string"}, "days": {"type": "integer"}}, "required": ["city"], "additionalProperties": False})
WEATHER, MAIL = ("weather", 'Says "what" comes\nnext', PARAMETERS), ("mail", None, '{ "type": "object" }')


def call(name, **arguments):
    return (name, json.dumps(arguments))


EPISODE = [
    ("system", "Be brief.", None, None),
    ("user", "Weather in Oslo & Rome? ü", None, None),
    ("assistant", None, [call("weather", days=2, city="Oslo"), call("weather", city="Rome")], None),
    ("tool", None, None, '{"ok": 1}'),
    ("assistant", "Sunny.", None, None),
]


@pytest.fixture
def rows(spark):
    return T.canonical_conversations(spark.createDataFrame([(1, EPISODE, [WEATHER, MAIL]), (2, [("user", "hi", None, None), ("assistant", "hello", [], None)], [])], SCHEMA))


def test_training_rows_follow_the_contract(rows):
    got = {(r.id, r.message_index): r for r in T.training_rows(rows, "id").collect()}
    plain = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    tools = [{"type": "function", "function": {"name": n, "description": d or "", "parameters": json.loads(p)}} for n, d, p in (WEATHER, MAIL)]
    catalog = "<|tool_catalog|>" + plain({"tools": tools}) + "</|tool_catalog|><|end|>"
    calls = "".join("<tool_call>" + plain({"name": n, "arguments": json.loads(a)}) + "</tool_call>" for n, a in EPISODE[2][2])
    first = catalog + "<|system|>Be brief.<|user|>Weather in Oslo & Rome? ü<|assistant|>"
    assert (got[1, 2].prompt, got[1, 2].body) == (first, calls)
    assert (got[1, 4].prompt, got[1, 4].body) == (first + calls + '<|end|><|tool|><tool_response>{"ok": 1}</tool_response><|assistant|>', "Sunny.")
    assert got[2, 1].prompt == '<|tool_catalog|>{"tools":[]}</|tool_catalog|><|end|><|user|>hi<|assistant|>' and len(got) == 3
    assert all(r.prompt_bytes == len(r.prompt.encode()) and r.loss_bytes == len(r.body.encode()) + 7 for r in got.values())


@pytest.mark.parametrize(
    ("want", "messages", "tools"),
    [
        (None, EPISODE, [WEATHER]),
        ("role", [("robot", "x", None, None)], []),
        ("role", [(None, "x", None, None)], []),
        ("tool_names", EPISODE, [WEATHER, WEATHER]),
        ("parameters", EPISODE, [("weather", "", "[1]")]),
        ("parameters", EPISODE, [("weather", "", '{"a": 1, "a": 2}')]),
        ("calls_beside_text", [("assistant", "x", [call("weather")], None)], [WEATHER]),
        ("unknown_tool", [("assistant", None, [call("walk")], None)], [WEATHER]),
        ("arguments", [("assistant", None, [("weather", "7")], None)], [WEATHER]),
        ("arguments", [("assistant", None, [("weather", '{"a": NaN}')], None)], [WEATHER]),
        ("marker", [("user", "x <|end|> y", None, None)], []),
        ("marker", [("tool", None, None, "</tool_response>")], []),
        ("marker", [("assistant", None, [call("weather", city="<|user|>")], None)], [WEATHER]),
        ("marker", [("user", "a\x00b", None, None)], []),
    ],
)
def test_problems(spark, want, messages, tools):
    rows = T.canonical_conversations(spark.createDataFrame([(1, messages, tools)], SCHEMA))
    assert rows.select(T.problem(F.col("messages"), F.col("tools")).alias("p")).first().p == want
    if want:
        with pytest.raises(Exception, match=f"not a valid conversation: {want}"):
            T.training_rows(rows, "id").collect()


def test_masking_renames_catalog_and_calls_alike(rows):
    out = T.masked(rows, "id", seed=3, variants=2, prefix="zz").collect()
    assert sorted((r.id, r.variant) for r in out) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    for r in out:
        if r.variant:
            names = [t.name for t in r.tools]
            assert [n[-4:] for n in names] == ["_001", "_000"] and all(n.startswith("zz_") and len(n) == 19 for n in names)
            assert {c.name for m in r.messages for c in m.tool_calls or ()} == {names[0]} and r.aliases == {"weather": names[0], "mail": names[1]}
            assert [json.loads(c.arguments) for m in r.messages for c in m.tool_calls or ()] == [{"city": "Oslo", "days": 2}, {"city": "Rome"}] and r.tools[0].description == WEATHER[1]
        else:
            assert r.aliases is None and [t.name for t in r.tools] == (["weather", "mail"] if r.id == 1 else [])
    assert len({r.tools[0].name for r in out if r.id == 1}) == 3
    assert sorted(map(str, out)) == sorted(map(str, T.masked(rows, "id", seed=3, variants=2, prefix="zz").collect()))


def test_masking_takes_a_share(spark):
    rows = spark.range(400).select("id", F.lit(None).cast(T.MESSAGES).alias("m"), F.array(F.struct(F.lit("f").alias("name"), F.lit("").alias("description"), F.lit("{}").alias("parameters"))).cast(T.TOOLS).alias("tools"))
    rows = rows.withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"), F.lit(None).cast(T.CALLS).alias("tool_calls"), F.lit(None).cast("string").alias("tool_response"))))
    assert 60 < T.masked(rows, "id", seed=1, fraction=0.25).where("variant = 1").count() < 140


def test_masking_refuses_unknown_tools(spark):
    rows = spark.createDataFrame([(1, [("assistant", None, [call("walk")], None)], [MAIL])], SCHEMA)
    with pytest.raises(Exception, match="unknown tool: walk"):
        T.masked(rows, "id", seed=1).collect()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("hello", (True, False, [])),
        (None, (True, False, [])),
        ("a <|end|>", (False, False, [])),
        ('<tool_call>{"name":"f","arguments":{"b":1,"a":[]}}</tool_call>\n<tool_call>{"name":"g","arguments":{}}</tool_call>', (True, True, [("f", '{"a":[],"b":1}'), ("g", "{}")])),
        ('x <tool_call>{"name":"f","arguments":{}}</tool_call>', (False, True, [])),
        ('<tool_call>{"name":"f","arguments":{}}</tool_call> x', (False, True, [("f", "{}")])),
        ('<tool_call>{"name":"f","arguments":{}}', (False, True, [])),
        ('<tool_call>{"name":"f","arguments":{},"id":1}</tool_call>', (False, True, [])),
        ('<tool_call>{"name":"f","arguments":{"a":1,"a":2}}</tool_call>', (False, True, [])),
        ('<tool_call>{"name":"","arguments":{}}</tool_call>', (False, True, [])),
        ('<tool_call>{"name":"f","arguments":{"a":"<|user|>"}}</tool_call>', (False, True, [("f", '{"a":"<|user|>"}')])),
    ],
)
def test_strict_answers(text, want):
    assert T.strict_answer(text) == want


def test_schemas():
    schema = json.loads(PARAMETERS)
    assert T.fits_schema({"city": "a", "days": 2}, schema) and T.fits_schema({"city": "a", "days": 2.0}, schema)
    for bad in ({}, {"city": 1}, {"city": "a", "days": True}, {"city": "a", "x": 1}, {"city": "a", "days": 1.5}, []):
        assert not T.fits_schema(bad, schema)
    assert T.fits_schema([1, None], {"type": "array", "items": {"type": ["integer", "null"]}}) and not T.fits_schema("c", {"enum": ["a", "b"]})


CASES = [
    # episode, multi_turn, category, expected, expected_text, answer, complete
    (1, True, "a", [call("weather", city="Oslo"), call("mail")], None, '<tool_call>{"name":"mail","arguments":{}}</tool_call><tool_call>{"name":"weather","arguments":{"city":"Oslo"}}</tool_call>', True),
    (1, True, "a", [call("weather", city="Rome", days=1)], None, '<tool_call>{"name":"weather","arguments":{"city":"Rome"}}</tool_call>', True),
    (1, True, "a", [], "done", "done", True),
    (2, True, "b", [call("mail")], None, '<tool_call>{"name":"mail","arguments":{}}</tool_call>', True),
    (3, False, "b", [call("mail"), call("mail")], None, '<tool_call>{"name":"mail","arguments":{}}</tool_call>', True),
    (3, False, "b", [call("mail")], None, '<tool_call>{"name":"mail","arguments":{}}</tool_call>', False),
    (4, False, "b", [], "ok", "okay", True),
    (4, False, "b", [], "ok", '<tool_call>{"name":"walk","arguments":{}}</tool_call>', True),
    (5, False, "c", [call("weather", city="x")], None, "no call", True),
]


def plain_scores(cases):
    """The rates, counted one case at a time."""
    n = Counter()
    episodes = {}
    known = {"weather": json.loads(PARAMETERS), "mail": {"type": "object"}}
    for episode, multi, _, expected, text, answer, complete in cases:
        valid, attempted, calls = T.strict_answer(answer)
        ok = valid and complete
        want = Counter((a, json.dumps(json.loads(b), sort_keys=True)) for a, b in expected)
        said = Counter((a, json.dumps(json.loads(b), sort_keys=True)) for a, b in calls) if ok else Counter()
        fits = ok and bool(calls) and all(a in known and T.fits_schema(json.loads(b), known[a]) for a, b in calls)
        abstained = ok and not calls and not attempted
        n["all"] += 1
        n["complete"] += complete
        n["format"] += ok
        n["attempted"] += attempted
        n["attempted fits"] += attempted and fits
        if expected:
            whole = ok and said == want
            names, own = Counter(a for a, _ in want.elements()), Counter(a for a, _ in said.elements())
            n["tool"] += 1
            n["tool format"] += ok and bool(said)
            n["tool fits"] += fits
            n["whole"] += whole
            n["names"] += (names & own).total()
            n["said"] += own.total()
            n["expected"] += names.total()
            n["calls"] += (want & said).total()
            n["name exact"] += ok and names == own
            n["parallel"] += len(expected) > 1
            n["parallel exact"] += whole and len(expected) > 1
            many = any(len(json.loads(b)) > 1 for _, b in expected)
            n["many"] += many
            n["many exact"] += many and whole
            n["action"] += whole
            n["response"] += whole
            if multi:
                n["steps"] += 1
                n["steps exact"] += whole
                episodes[episode] = episodes.get(episode, True) and whole
        else:
            n["plain"] += 1
            n["abstained"] += abstained
            n["text"] += abstained and answer == text
            n["action"] += abstained
            n["response"] += abstained and answer == text
    share = lambda a, b: n[a] / n[b] if n[b] else None
    precision, recall = share("names", "said"), share("names", "expected")
    return {
        "decisions": n["all"], "tool_decisions": n["tool"], "action_exact": share("action", "all"), "response_exact": share("response", "all"), "completion": share("complete", "all"), "format_validity": share("format", "all"),
        "schema_validity_on_attempts": share("attempted fits", "attempted"), "tool_format_validity": share("tool format", "tool"), "tool_schema_validity": share("tool fits", "tool"), "name_exact": share("name exact", "tool"),
        "name_precision": precision, "name_recall": recall, "name_f1": 2 * precision * recall / (precision + recall) if precision and recall else None, "arguments_given_name": share("calls", "names"), "whole_call_exact": share("whole", "tool"),
        "abstention": share("abstained", "plain"), "text_exact": share("text", "plain"), "parallel_exact": share("parallel exact", "parallel"), "many_arguments_exact": share("many exact", "many"), "step_exact": share("steps exact", "steps"),
        "episode_exact": sum(episodes.values()) / len(episodes) if episodes else None,
    }


def test_scores_equal_counts_by_hand(spark):
    canonical = lambda calls: [(n, json.dumps(json.loads(a), sort_keys=True, separators=(",", ":"))) for n, a in calls]
    rows = [(e, m, c, canonical(x), t, a, d, [WEATHER, MAIL]) for e, m, c, x, t, a, d in CASES]
    df = spark.createDataFrame(rows, f"episode int, multi_turn boolean, category string, expected {T.CALLS}, expected_text string, answer string, complete boolean, tools {T.TOOLS}")
    flags = T.decision_flags(T.judged_answers(df, "answer", "tools"))
    got = T.conversation_scores(flags).first().asDict()
    assert got == pytest.approx(plain_scores(CASES))
    by = {r.category: r.asDict() for r in T.conversation_scores(flags, category="category").collect()}
    assert set(by) == {"a", "b", "c", None}
    for name, found in by.items():
        assert {k: v for k, v in found.items() if k != "category"} == pytest.approx(plain_scores([c for c in CASES if name is None or c[2] == name]))
    assert T.conversation_scores(flags.limit(0)).first().action_exact is None


def test_shared_items(spark):
    row = spark.createDataFrame([(["a", "a", "b"], ["a", "b", "b", "c"])], "a array<string>, b array<string>")
    assert row.select(T.shared_items(F.col("a"), F.col("b")).alias("n")).first().n == 2


def test_slot_values(spark):
    row = spark.createDataFrame([('{"a":"x","b":2}',)], "j string").select(T.slot_values(F.col("j")).alias("v")).first()
    assert sorted(row.v) == ["2", "x"]
