"""Freezing: corpora with splits and shards, denylist suites, action slices. What is frozen is a small record whose hash covers it; verifying computes it again and names what differs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions import text as X
from grainmill.functions.canonical import canonical, strict_loads
from grainmill.operators import governance, selection

#: Field names under which answers hide; a prompt-only suite has none of them, at any depth.
LABEL_FIELDS = frozenset("answer answers label labels gold target targets solution solutions expected expected_output reference references rubric ground_truth completion response score correct correct_answer".split())


def corpus_record(docs: DataFrame, *, shards: DataFrame | None = None, tokenizer: dict | None = None, denylist: str | None = None, key: str = "doc_id", text: str = "text", split: str = "split", provenance: tuple[str, ...] = ("source", "license")) -> dict:
    """What a packed corpus is: for each split its documents, characters and the fingerprints of ids and contents; counts by provenance; the audit across splits; shards (split, shard, rows, tokens) added up;
    the tokenizer's and denylist's hashes; and the record's own hash."""
    splits = {}
    for r in docs.groupBy(split).agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars")).orderBy(split).collect():
        own = docs.where(F.col(split).eqNullSafe(r[split]))
        content = governance.multiset_fingerprint(own.select(F.sha2(text, 256).alias("v")), "v").first()
        splits[str(r[split])] = {"documents": r.documents, "chars": r.chars, "ids": governance.set_fingerprint(own, key).first()["fingerprint"], "content_sum": content["sum"], "content_xor": content["xor"]}
    audit = governance.split_audit(docs.select(selection.identity(F.col(key)).alias("identity"), F.sha2(text, 256).alias("document_sha256"), F.col(split).alias("split"))).first().asDict()
    # a row for each source, licence and split
    counts = docs.groupBy(*(F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in (*provenance, split) if c in docs.columns)).agg(F.count(F.lit(1)).alias("documents"))
    fields = {"splits": splits, "audit": audit, "provenance": sorted((r.asDict() for r in counts.collect()), key=canonical), "tokenizer": tokenizer or {}, "denylist": denylist}
    if shards is not None:
        found = shards.groupBy("split").agg(F.countDistinct("shard").alias("shards"), F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"))
        fields["shards"] = {r["split"]: {k: r[k] for k in ("shards", "rows", "tokens")} for r in found.collect()}
    return governance.manifest(fields)


def corpus_problems(record: dict, expected: dict) -> list[str]:
    """What a record breaks of a contract with any of: splits (names), min_tokens (by split), tokenizer, denylist, allowed_licenses, disjoint (True)."""
    problems = []
    if "splits" in expected and sorted(record["splits"]) != sorted(expected["splits"]):
        problems.append("splits")
    for name, least in expected.get("min_tokens", {}).items():
        if record.get("shards", {}).get(name, {}).get("tokens", 0) < least:
            problems.append(f"tokens of {name}")
    problems += [k for k in ("tokenizer", "denylist") if k in expected and record[k] != expected[k]]
    if "allowed_licenses" in expected and any(r.get("license", "unknown") not in expected["allowed_licenses"] for r in record["provenance"]):
        problems.append("licenses")
    if expected.get("disjoint") and (record["audit"]["in_two_splits"] or record["audit"]["content_in_two_splits"]):
        problems.append("split overlap")
    return problems


def freeze_corpus(docs: DataFrame, expected: dict, **parts) -> dict:
    """The record of a corpus that keeps its contract; one that doesn't is an error that names all it breaks."""
    record = corpus_record(docs, **parts)
    if problems := corpus_problems(record, expected):
        raise ValueError(f"the corpus breaks its contract: {problems}")
    return record


def verify_corpus(record: dict, docs: DataFrame, **parts) -> list[str]:
    """The fields in which a corpus differs from its record; none if it is the same. A record that was changed is an error."""
    governance.verify_manifest(record)
    now = corpus_record(docs, **parts)
    return sorted(k for k in record if k != "sha256" and record[k] != now.get(k))


def _labelled(value) -> bool:
    if isinstance(value, dict):
        return any(str(k).lower() in LABEL_FIELDS or _labelled(v) for k, v in value.items())
    return isinstance(value, list) and any(map(_labelled, value))


def denylist_rows(rows: DataFrame, column: str = "value") -> DataFrame:
    """(line, source_case_id, prompt, problem) of JSON lines that must hold exactly source_case_id and prompt: json, labels (a field name of LABEL_FIELDS at any depth), keys, empty, or null."""

    def one(text: str | None) -> tuple[str | None, str | None, str | None]:
        try:
            record = strict_loads(text or "")
        except ValueError:
            return None, None, "json"
        if _labelled(record):
            return None, None, "labels"
        if not isinstance(record, dict) or set(record) != {"source_case_id", "prompt"} or not all(isinstance(v, str) for v in record.values()):
            return None, None, "keys"
        return record["source_case_id"], record["prompt"], None if record["prompt"].strip() and record["source_case_id"] else "empty"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(v) for v in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(0), *(pa.array([f[k] for f in found], pa.string()) for k in range(3))], names=["line", "source_case_id", "prompt", "problem"])

    return rows.select(F.col(column).alias("line")).mapInArrow(run, "line string, source_case_id string, prompt string, problem string")


def freeze_denylist(rows: DataFrame, suite: str, *, max_cases: int, max_bytes: int, column: str = "value") -> tuple[DataFrame, dict]:
    """(suite, source_case_id, prompt, norm), one case for each normalised prompt, the smallest id; and the suite's record.

    A line with a problem, an id that stands twice, more than ``max_cases`` cases or ``max_bytes`` bytes of prompts are errors: a frozen suite is complete or isn't made.
    """
    found = denylist_rows(rows, column)
    problems = {r.problem: r.n for r in found.where("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = found.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_case_id").alias("ids"), F.coalesce(F.sum(F.octet_length("prompt")), F.lit(0)).alias("bytes")).first()
    if problems or totals.ids < totals.n or totals.n > max_cases or totals.bytes > max_bytes:
        raise ValueError(f"the suite can't be frozen: {problems}, {totals.n - totals.ids} repeated ids, {totals.n} cases, {totals.bytes} bytes")
    cases = found.withColumn("norm", X.match_text(F.col("prompt"))).groupBy("norm").agg(F.min_by(F.struct("source_case_id", "prompt"), "source_case_id").alias("c"))
    cases = cases.select(F.lit(suite).alias("suite"), "c.*", "norm")
    mark = governance.set_fingerprint(cases.select(F.concat_ws("\x1f", "source_case_id", "norm").alias("v")), "v").first()
    return cases, governance.manifest({"suite": suite, "cases": totals.n, "distinct": mark["count"], "bytes": totals.bytes, "fingerprint": mark["fingerprint"]})


def verify_denylist(record: dict, cases: DataFrame) -> bool:
    """Whether frozen cases are those of their record; a changed record is an error."""
    governance.verify_manifest(record)
    mark = governance.set_fingerprint(cases.select(F.concat_ws("\x1f", "source_case_id", "norm").alias("v")), "v").first()
    return (mark["count"], mark["fingerprint"]) == (record["distinct"], record["fingerprint"])


def suite_conflicts(required: DataFrame, supplied: DataFrame) -> DataFrame:
    """(name, problem): required suites (name, sha256, bytes) that are absent or differ, and supplied ones that contradict themselves. No rows mean that the policy is met."""
    own = supplied.groupBy("name").agg(F.countDistinct("sha256", "bytes").alias("k"), F.min("sha256").alias("s"), F.min("bytes").alias("b"))
    both = required.join(own, "name", "full_outer")
    problem = F.when(F.col("k") > 1, "conflict").when(F.col("sha256").isNull(), F.lit(None)).when(F.col("k").isNull(), "absent").when((F.col("sha256") != F.col("s")) | (F.col("bytes") != F.col("b")), "differs")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def audit_denylist(docs: DataFrame, hits: DataFrame, cases: DataFrame, *, doc: str = "doc_id", case: str = "source_case_id") -> DataFrame:
    """(suite, cases, matched_cases, documents, removed) of (doc, case) hits: how many of a suite's cases were found, and how many documents they cost."""
    found = hits.join(cases.select("suite", case), case).groupBy("suite").agg(F.countDistinct(case).alias("matched_cases"), F.countDistinct(doc).alias("removed"))
    sizes = cases.groupBy("suite").agg(F.count(F.lit(1)).alias("cases"))
    total = docs.agg(F.count(F.lit(1)).alias("documents"))
    return sizes.join(found, "suite", "left").crossJoin(total).select("suite", "cases", F.coalesce("matched_cases", F.lit(0)).alias("matched_cases"), "documents", F.coalesce("removed", F.lit(0)).alias("removed"))


def action_template(calls: Column) -> Column:
    """SHA-256 of what calls look like without their values: names in order, each with its sorted argument keys. calls are structs of name and arguments (JSON)."""
    one = lambda c: F.concat(c["name"], F.lit("("), F.array_join(F.array_sort(F.coalesce(F.json_object_keys(c["arguments"]), F.array().cast("array<string>"))), ","), F.lit(")"))
    return F.sha2(F.array_join(F.transform(calls, one), ";"), 256)


def freeze_actions(rows: DataFrame, *, key: str, prompt: str, calls: str, each: int, seed: int) -> tuple[DataFrame, dict]:
    """At most ``each`` rows of every action template, the first by seeded hash, one row of each normalised prompt; with template and prompt_sha256, and the record of the slice."""
    found = rows.withColumn("template", action_template(F.col(calls))).withColumn("prompt_sha256", F.sha2(F.lower(X.collapse(F.col(prompt))), 256))
    found = found.groupBy("prompt_sha256").agg(F.min_by(F.struct(*found.columns), key).alias("r")).select("r.*")
    kept = selection.cap_per_group(found, "template", each, seed, key=key)
    mark = governance.set_fingerprint(kept.select(F.concat_ws(":", "template", "prompt_sha256").alias("v")), "v").first()
    # a row for each template
    sizes = {r.template: r.n for r in kept.groupBy("template").agg(F.count(F.lit(1)).alias("n")).collect()}
    return kept, governance.manifest({"rows": mark["count"], "fingerprint": mark["fingerprint"], "templates": json.loads(canonical(sizes)), "each": each, "seed": seed})
