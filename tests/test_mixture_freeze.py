import json

import pytest
from pyspark.sql import functions as F

from grainmill.operators import freeze as Z
from grainmill.operators import mixture as M

SOURCES = [{"name": "a", "weight": "0.5", "license": "MIT", "evidence": "e1"}, {"name": "b", "weight": "0.3", "allowed_licenses": ["MIT", "cc0"], "evidence": "e2"}, {"name": "c", "weight": "0.2", "evidence": "e3"}]


def test_plan(spark):
    rows = {r.name: r for r in M.mixture_plan(spark, SOURCES, 1001).collect()}
    assert [rows[n].budget for n in "abc"] == [501, 300, 200] and rows["a"].normalized_weight == pytest.approx(0.5) and rows["b"].allowed == ["cc0", "mit"] and rows["c"].license == "unknown"
    assert M.plan_hash(M.mixture_plan(spark, SOURCES, 1001)) != M.plan_hash(M.mixture_plan(spark, SOURCES, 1000))
    for bad in ([], [{"name": "a"}, {"name": "a"}], [{"name": "a", "weight": 0}], [{"name": "a", "x": 1}], [{"name": "a", "evidence": "e", "license": "x"}, {"name": "b", "evidence": "e", "license": "y"}]):
        with pytest.raises(ValueError):
            M.mixture_plan(spark, bad, 100)
    with pytest.raises(ValueError, match="evidence"):
        M.mixture_plan(spark, [{"name": "a"}], 100, need_evidence=True)


def corpus(spark):
    rows = [("a", f"a text number {k} " + "x" * 90, None) for k in range(10)] + [("a", "a text number 3 " + "x" * 90 + " \r\n", None), ("a", "short", None), ("a", None, None)]
    rows += [("b", f"b text number {k} " + "y" * 90, "MIT" if k % 2 else "gpl") for k in range(10)] + [("b", f"a text number {k} " + "x" * 90, "cc0 ") for k in range(10)]
    rows += [("c", f"c text {k} " + "z" * 90, "any") for k in range(2)] + [("d", "q" * 100, "MIT")]
    return spark.createDataFrame(rows, "source string, text string, license string")


def test_judged(spark):
    plan = M.mixture_plan(spark, SOURCES, 1001)
    out = M.judged(corpus(spark), plan, license="license", least=50).groupBy("source", "reason").count().collect()
    assert {(r.source, r.reason): r["count"] for r in out} == {("a", ""): 11, ("a", "length"): 1, ("a", "missing_text"): 1, ("b", ""): 15, ("b", "license"): 5, ("c", ""): 2, ("d", "unknown_source"): 1}


def test_acquire_and_resume(spark, tmp_path):
    plan = M.mixture_plan(spark, SOURCES, 1001)
    records = {r["name"]: r for r in M.acquire(corpus(spark), plan, str(tmp_path), license="license", least=50)}
    kept = {n: spark.read.parquet(f"{tmp_path}/{n}").collect() for n in "abc"}
    a = [r.clean for r in kept["a"]]
    # rows of 106 characters: the fifth reaches 501; no text twice, over all sources
    assert len(a) == 5 and records["a"]["chars"] == 530 and not records["a"]["exhausted"] and records["a"]["skipped"] == {"duplicate": 1, "length": 1, "missing_text": 1}
    every = [r.digest for rows in kept.values() for r in rows]
    assert len(every) == len(set(every)) and records["b"]["documents"] == 3 and records["b"]["skipped"] == {"duplicate": 5, "license": 5}
    assert records["c"]["exhausted"] is True and records["c"]["documents"] == 2
    # a source without a record is done again, the others aren't, and the result is the same
    (tmp_path / "b.json").unlink()
    before = (tmp_path / "a" / "_SUCCESS").stat().st_mtime_ns
    assert {r["name"]: r for r in M.acquire(corpus(spark), plan, str(tmp_path), license="license", least=50)} == records
    assert (tmp_path / "a" / "_SUCCESS").stat().st_mtime_ns == before
    record = json.loads((tmp_path / "c.json").read_text())
    (tmp_path / ".c.json.crc").unlink()
    (tmp_path / "c.json").write_text(json.dumps(record | {"chars": 1}))
    with pytest.raises(ValueError, match="doesn't match its hash"):
        M.acquire(corpus(spark), plan, str(tmp_path), license="license", least=50)


def test_readiness(spark):
    plan = M.mixture_plan(spark, SOURCES, 1001)
    had = spark.createDataFrame([("a", 600), ("b", 299)], "name string, chars bigint")
    rows = {r.name: (r.ready, r.blockers) for r in M.readiness(plan, had, evidence=["e1", "e2"]).collect()}
    assert rows == {"a": (True, []), "b": (False, ["short_of_budget"]), "c": (False, ["no_rows", "no_evidence"])}
    assert all("no_space" in r.blockers for r in M.readiness(plan, had, free_bytes=5, minimum_free_bytes=9).collect())


def test_policy(spark):
    catalog = spark.createDataFrame([("a", "train", True), ("a", "eval", True), ("b", "train", False), ("c", "eval", True)], "source string, use string, allowed boolean")
    rows = spark.createDataFrame([(s,) for s in "abcd"], "source string")
    assert {r.source: r.policy for r in M.policy_gate(rows, catalog, "train").collect()} == {"a": "allowed", "b": "refused", "c": "not_for_train", "d": "unknown_source"}
    with pytest.raises(Exception, match="twice"):
        M.policy_gate(rows, catalog.union(catalog), "train").collect()


GOOD = {
    "split": "train", "rule_verified": True, "public_data": True, "model_verified": False, "environment_executed": False, "action_count": 2, "capabilities": ["a", "b"],
    "provenance": {"dataset": "d", "subset": "s", "revision": "r", "record_id": "i", "url": "https://x", "license": "mit", "file_sha256": "0" * 64, "source_line": 3},
}


def without(key):
    return {k: v for k, v in GOOD.items() if k != key}


@pytest.mark.parametrize(
    ("meta", "want"),
    [
        (GOOD, None),
        ({"split": "train", "rule_verified": True}, None),
        ({"split": "test", "rule_verified": True}, "split"),
        ({"split": "train", "rule_verified": 1}, "rule"),
        ({"split": "train", "rule_verified": True, "model_verified": "maybe"}, "flags"),
        (GOOD | {"model_verified": True}, "flags"),
        (without("environment_executed"), "flags"),
        (without("provenance"), "provenance_keys"),
        (GOOD | {"provenance": GOOD["provenance"] | {"more": 1}}, "provenance_keys"),
        (GOOD | {"provenance": GOOD["provenance"] | {"license": ""}}, "provenance_values"),
        (GOOD | {"provenance": GOOD["provenance"] | {"url": "http://x"}}, "provenance_values"),
        (GOOD | {"provenance": GOOD["provenance"] | {"source_line": 0}}, "provenance_values"),
        (GOOD | {"capabilities": ["b", "a"]}, "capabilities"),
        (GOOD | {"action_count": 3}, "action_count"),
        ("[]", "metadata"),
    ],
)
def test_traces(spark, meta, want):
    text = meta if isinstance(meta, str) else json.dumps(meta)
    assert spark.createDataFrame([(text,)], "m string").select(M.trace_problem(F.col("m"), F.lit(2)).alias("p")).first().p == want


@pytest.mark.parametrize(
    ("feedback", "want"),
    [
        (None, True),
        ({"adopted": True}, True),
        ({"adopted": True, "uncertainty": 0.5}, True),
        ({"adopted": True, "uncertainty": 0.6}, False),
        ({"adopted": True, "uncertainty": True}, False),
        ({"adopted": True, "rejected": True}, False),
        ({"preference_winner": True, "missing_knowledge": True}, False),
        ({"uncertainty": 0.1}, False),
        ("yes", False),
    ],
)
def test_feedback(spark, feedback, want):
    meta = GOOD if feedback is None else GOOD | {"feedback": feedback}
    assert spark.createDataFrame([(json.dumps(meta),)], "m string").select(M.feedback_selected(F.col("m")).alias("s")).first().s is want


def test_mining_and_pool(spark, tmp_path):
    refused = GOOD | {"quality": {"accepted": False}}
    rows = spark.createDataFrame([(1, "x", json.dumps(GOOD)), (2, "x", json.dumps(GOOD)), (3, "y", json.dumps(refused)), (4, "z", json.dumps({"split": "train", "rule_verified": True})), (5, "w", "{}")], "id int, t string, meta string")
    pool = M.mined(rows, actions=F.lit(2), digest=F.sha2("t", 256), tie=["id"])
    assert [r.id for r in pool.collect()] == [1]
    record = M.publish_pool(pool, str(tmp_path), "g1")
    assert record["rows"] == record["distinct"] == 1 and (tmp_path / "manifest.json").exists()


def test_corpus_freeze(spark):
    rows = [(k, f"text {k}", "train" if k % 5 else "val", f"s{k % 2}", "mit") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, split string, source string, license string")
    shards = spark.createDataFrame([("train", 0, 3, 90), ("train", 1, 2, 60), ("val", 0, 1, 9)], "split string, shard int, rows bigint, tokens bigint")
    contract = {"splits": ["train", "val"], "min_tokens": {"train": 150}, "allowed_licenses": ["mit"], "disjoint": True, "denylist": "abc"}
    record = Z.freeze_corpus(docs, contract, shards=shards, denylist="abc")
    assert record["splits"]["val"]["documents"] == 4 and record["shards"]["train"] == {"shards": 2, "rows": 5, "tokens": 150}
    assert Z.verify_corpus(record, docs.repartition(3).orderBy(F.col("doc_id").desc()), shards=shards, denylist="abc") == []
    other = docs.withColumn("text", F.when(F.col("doc_id") == 7, "changed").otherwise(F.col("text")))
    assert Z.verify_corpus(record, other, shards=shards, denylist="abc") == ["splits"] and Z.verify_corpus(record, docs, denylist="abd") == ["denylist", "shards"]
    with pytest.raises(ValueError, match="hash"):
        Z.verify_corpus(record | {"denylist": "x"}, docs)
    overlap = docs.union(spark.createDataFrame([(1, "text 5", "val", "s1", "gpl")], docs.schema))
    with pytest.raises(ValueError, match=r"\['tokens of train', 'denylist', 'licenses', 'split overlap'\]"):
        Z.freeze_corpus(overlap, contract)


def lines(spark, *records):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in records], "value string")


def test_denylist_freeze(spark):
    ok = [{"source_case_id": "1", "prompt": "What is  it?"}, {"source_case_id": "2", "prompt": "what is it ?"}, {"source_case_id": "3", "prompt": "other"}]
    cases, record = Z.freeze_denylist(lines(spark, *ok), "s", max_cases=5, max_bytes=100)
    assert sorted(r.source_case_id for r in cases.collect()) == ["1", "3"] and (record["cases"], record["distinct"]) == (3, 2)
    assert Z.verify_denylist(record, cases) and not Z.verify_denylist(record, cases.limit(1))
    for bad, problem in (({"source_case_id": "4", "prompt": "p", "extra": 1}, "keys"), ({"source_case_id": "4", "prompt": "p", "meta": [{"Answer": 1}]}, "labels"), ('{"prompt": "a", "prompt": "b"}', "json"), ({"source_case_id": "4", "prompt": " "}, "empty"), (ok[0], "1 repeated ids")):
        with pytest.raises(ValueError, match=problem):
            Z.freeze_denylist(lines(spark, *ok, bad), "s", max_cases=9, max_bytes=100)
    for limits in ({"max_cases": 2, "max_bytes": 100}, {"max_cases": 9, "max_bytes": 3}):
        with pytest.raises(ValueError):
            Z.freeze_denylist(lines(spark, *ok), "s", **limits)
    audit = Z.audit_denylist(spark.range(10).withColumnRenamed("id", "doc_id"), spark.createDataFrame([(1, "1"), (2, "1")], "doc_id int, source_case_id string"), cases).first()
    assert (audit.suite, audit.cases, audit.matched_cases, audit.documents, audit.removed) == ("s", 2, 1, 10, 2)


def test_suite_conflicts(spark):
    kind = "name string, sha256 string, bytes int"
    required = spark.createDataFrame([("a", "1", 5), ("b", "2", 6), ("c", "3", 7)], kind)
    supplied = spark.createDataFrame([("a", "1", 5), ("b", "2", 9), ("d", "x", 1), ("e", "x", 1), ("e", "y", 1)], kind)
    assert {r.name: r.problem for r in Z.suite_conflicts(required, supplied).collect()} == {"b": "differs", "c": "absent", "e": "conflict"}


def test_action_slices(spark):
    rows = [(k, f"Prompt  {k % 6}", [("f", json.dumps({"b": k, "a": 1} if k % 2 else {"a": k}))]) for k in range(12)]
    df = spark.createDataFrame(rows, "id int, p string, calls array<struct<name:string,arguments:string>>")
    kept, record = Z.freeze_actions(df, key="id", prompt="p", calls="calls", each=2, seed=1)
    assert kept.count() == record["rows"] == 4 and sorted(record["templates"].values()) == [2, 2] and len({r.prompt_sha256 for r in kept.collect()}) == 4
    assert Z.freeze_actions(df.repartition(5), key="id", prompt="p", calls="calls", each=2, seed=1)[1] == record
