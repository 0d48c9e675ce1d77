"""Queries over tool conversations, mixtures and freezes. The tables have no tool calls, so a user's events of a day stand for a conversation: each event is a call of a tool of its type, with props as arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions import text as X
from grainmill.functions.canonical import canonical_json
from grainmill.operators import conversations, freeze, governance, imports, metrics, mixture, packing, schedules, selection
from grainmill.operators import toolcalls as T
from grainmill.plans.conversations import _H
from grainmill.sources import readers, sinks
from grainmill.sources.shared import new_folder
from grainmill.sources.tables import table, texts

PARAMETERS = '{"properties":{"k":{"maximum":99,"type":"integer"}},"required":["k"],"type":"object"}'


def _days(spark: SparkSession, sf: str) -> DataFrame:
    """(key, calls): the events of each user and day, in order, as calls."""
    rows = table(spark, sf, "events").select("event_id", F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("key"), "event_type", "props")
    call = F.struct("event_id", F.struct(F.col("event_type").alias("name"), canonical_json("props").alias("arguments")).alias("call"))
    return rows.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(call)), lambda c: c["call"]).alias("calls"))


def _episodes(spark: SparkSession, sf: str) -> DataFrame:
    """(key, messages, tools): what a user asks, the calls, a tool's answer, a closing text; the tools are those of the calls."""
    none, no_calls = F.lit(None).cast("string"), F.lit(None).cast(T.CALLS)
    turn = lambda role, content=none, calls=no_calls, response=none: F.struct(F.lit(role).alias("role"), content.alias("content"), calls.alias("tool_calls"), response.alias("tool_response"))
    messages = F.array(turn("user", F.concat(F.lit('Do "'), F.col("key"), F.lit('" now'))), turn("assistant", calls=F.col("calls")), turn("tool", response=F.lit("ok")), turn("assistant", F.concat(F.size("calls").cast("string"), F.lit(" done"))))
    tools = F.transform(F.array_sort(F.array_distinct(F.transform("calls", lambda c: c["name"]))), lambda n: F.struct(n.alias("name"), F.concat(F.lit("Makes a "), n).alias("description"), F.lit(PARAMETERS).alias("parameters")))
    return _days(spark, sf).select("key", messages.cast(T.MESSAGES).alias("messages"), tools.cast(T.TOOLS).alias("tools"))


def prompt_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The training rows of every assistant turn under the prompt contract."""
    out = T.training_rows(_episodes(spark, sf), "key")
    return out.select("key", F.col("message_index").cast("bigint").alias("message_index"), F.sha2("prompt", 256).alias("prompt"), F.sha2("body", 256).alias("body"), F.col("prompt_bytes").cast("bigint").alias("prompt_bytes"), F.col("loss_bytes").cast("bigint").alias("loss_bytes"))


def masked_names(spark: SparkSession, sf: str) -> DataFrame:
    """Two masked variants of half of the conversations: how their calls begin."""
    out = T.masked(_episodes(spark, sf), "key", seed=9, fraction=0.5, variants=2, prefix="fn").where("variant > 0")
    return out.select("key", "variant", F.array_join(F.transform("tools", lambda t: t["name"]), ",").alias("catalog"), F.array_join(F.transform(F.get("messages", F.lit(1))["tool_calls"], lambda c: c["name"]), ",").alias("calls"))


def tool_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of a made-up model against the events: it forgets every fifth event, changes the argument of every seventh, breaks off on some days and talks on others."""
    rows = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("date").alias("day"), F.col("event_type").alias("name"), canonical_json("props").alias("arguments"))
    said = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit('<tool_call>{"arguments":'), F.when(F.col("event_id") % 7 == 0, F.lit('{"k":"x"}')).otherwise(F.col("arguments")), F.lit(',"name":"'), F.col("name"), F.lit('"}</tool_call>')))
    cases = rows.groupBy("user_id", "day").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("event_id") % 3 != 0, F.struct("event_id", "name", "arguments")))), lambda c: F.struct(c["name"], c["arguments"])).alias("expected"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("event_id") % 3 != 0, F.struct("event_id", said.alias("t"))))), lambda c: c["t"]), "").alias("answer"),
    )
    day = F.dayofmonth("day")
    cases = cases.withColumn("answer", F.when(day % 10 == 0, F.concat("answer", F.lit(" so"))).otherwise(F.col("answer"))).withColumn("complete", (day + F.col("user_id")) % 11 != 0)
    tools = F.array(*(F.struct(F.lit(n).alias("name"), F.lit("").alias("description"), F.lit(PARAMETERS).alias("parameters")) for n in ("click", "error", "purchase", "signup", "view")))
    cases = cases.withColumn("tools", tools.cast(T.TOOLS)).withColumn("expected", F.col("expected").cast(T.CALLS)).withColumn("expected_text", F.lit("")).withColumn("episode", F.col("user_id")).withColumn("multi_turn", F.col("user_id") % 2 == 0)
    found = T.conversation_scores(T.decision_flags(T.judged_answers(cases, "answer", "tools")))
    names = ("decisions", "tool_decisions", "completion", "format_validity", "name_exact", "name_precision", "name_recall", "arguments_given_name", "whole_call_exact", "abstention", "step_exact", "episode_exact")
    return found.select(*(F.round(F.col(n).cast("double"), 9).alias(n) for n in names))


def document_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Bits per byte, cross entropy and top-1 by language and overall; word counts stand for tokens, and digits of hashes for losses."""
    docs = texts(spark, sf).where("text IS NOT NULL").select("lang", F.regexp_count("text", F.lit("[^ \t\n\r\f\x0b]+")).cast("bigint").alias("tokens"), F.octet_length("text").cast("bigint").alias("utf8_bytes"), (F.col("doc_id") % 97 * 1.5).alias("nll_nats"), (F.col("doc_id") % 5).alias("correct_tokens"))
    out = metrics.document_scores(docs, "lang")
    return out.select("lang", "documents", "tokens", "utf8_bytes", *(F.round(c, 9).alias(c) for c in ("cross_entropy", "bits_per_byte", "top1")))


def paired_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Two arms of document scores, documents drawn 10,000 times for both at once."""
    docs = texts(spark, sf).where("text IS NOT NULL").select("doc_id", F.lit(10).cast("bigint").alias("tokens"), F.octet_length("text").cast("bigint").alias("utf8_bytes"), (F.col("doc_id") % 97 * 1.5).alias("nll_nats"), (F.col("doc_id") % 5).alias("correct_tokens"))
    other = docs.withColumn("nll_nats", F.col("nll_nats") + F.col("doc_id") % 7 - 3.0)
    return metrics.paired_documents(docs, other, "doc_id", seed=4)


def task_floors(spark: SparkSession, sf: str) -> DataFrame:
    """Events as tasks: half of the observations quote the argument."""
    rows = table(spark, sf, "events").select(F.concat(F.lit("User "), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" wants "), F.regexp_extract("props", "[0-9]+", 0))).otherwise(F.lit(""))).alias("observation"), F.col("event_type").alias("gold_name"), F.when(F.col("event_id") % 4 != 0, F.col("props")).alias("gold_arguments"))
    out = metrics.floors(rows)
    return out.select("rows", *(F.round(c, 9).alias(c) for c in ("majority", "constant", "no_arguments", "derivability", "fully_derivable", "reachable")))


def clean_rates(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select((F.col("event_id") % 3 != 0).alias("step"), F.col("event_type").isin("view", "click").alias("type"), (F.col("user_id") % 4 == 0).alias("leaked"))
    out = metrics.rates_and_clean(rows, F.col("leaked"), {"type_match": F.col("type"), "step_success": F.col("step")})
    return out.select("subset", "rows", "leaked_rows", F.round("type_match", 9).alias("type_match"), F.round("step_success", 9).alias("step_success"))


def suite_report(spark: SparkSession, sf: str) -> DataFrame:
    """Event types as suites and users as cases: the first event of each user and type is its result; every third user is expected."""
    rows = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("e")).where("user_id % 5 <> 0").withColumn("v", (F.col("e") % 4 == 0).cast("double"))
    users = table(spark, sf, "events").select("event_type", "user_id").distinct().where("user_id % 3 <> 0")
    out = metrics.suite_report(rows, users, suite="event_type", case="user_id", value="v", failed=F.col("e") % 9 == 0)
    return out.select("event_type", "cases", "duplicates", "missing", "unexpected", "failures", F.round("mean", 9).alias("mean"), "status")


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    """Every source but one, weights 1 to 4, the odd ones with an allow-list."""
    names = [r.source for r in table(spark, sf, "documents").select("source").distinct().orderBy("source").collect()]
    sources = [{"name": n, "weight": k % 4 + 1, "license": "MIT" if k % 3 else "gpl", "allowed_licenses": ["mit"] if k % 2 else []} for k, n in enumerate(names[1:])]
    return mixture.mixture_plan(spark, sources, 50_000)


def mixture_budgets(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf).select("position", "name", "weight", "budget", F.round("normalized_weight", 9).alias("share"))


def mixture_admission(spark: SparkSession, sf: str) -> DataFrame:
    out = mixture.judged(texts(spark, sf), _plan(spark, sf))
    return out.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))


def mixture_acquired(spark: SparkSession, sf: str) -> DataFrame:
    """What each source gives until its budget is reached, texts of earlier sources left out."""
    records = mixture.acquire(texts(spark, sf), _plan(spark, sf), new_folder(spark))
    return spark.createDataFrame([(r["name"], r["documents"], r["chars"], r["requested"], r["exhausted"]) for r in records], "name string, documents bigint, chars bigint, requested bigint, exhausted boolean")


def mixture_readiness(spark: SparkSession, sf: str) -> DataFrame:
    had = texts(spark, sf).groupBy(F.col("source").alias("name")).agg(F.sum(F.length("text")).alias("chars"))
    return mixture.readiness(_plan(spark, sf), had).select("name", "budget", "chars", F.array_join("blockers", ",").alias("blockers"), "ready")


def corpus_freeze(spark: SparkSession, sf: str) -> DataFrame:
    """The frozen record's rows: documents and characters of each split."""
    docs = texts(spark, sf)
    docs = docs.join(selection.split_documents(docs, 0.2, 17).select("doc_id", "split"), "doc_id")
    record = freeze.freeze_corpus(docs, {"splits": ["train", "val"]}, provenance=("source",))
    return spark.createDataFrame([(k, v["documents"], v["chars"], v["content_xor"]) for k, v in record["splits"].items()], "split string, documents bigint, chars bigint, content_xor string")


def denylist_freeze(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark as a suite, each item twice in two spellings: one case for each normalised prompt."""
    rows = table(spark, sf, "benchmark").where("text IS NOT NULL")
    both = rows.select(F.concat(F.lit("a"), F.col("item_id").cast("string")).alias("source_case_id"), F.col("text").alias("prompt")).union(rows.select(F.concat(F.lit("b"), F.col("item_id").cast("string")), F.concat(F.lit(" "), F.upper("text"))))
    cases, _ = freeze.freeze_denylist(both.select(F.to_json(F.struct("source_case_id", "prompt")).alias("value")), "benchmark", max_cases=1 << 20, max_bytes=1 << 30)
    return cases.select("suite", "source_case_id", F.sha2("prompt", 256).alias("prompt"))


def action_templates(spark: SparkSession, sf: str) -> DataFrame:
    return _days(spark, sf).groupBy(freeze.action_template(F.col("calls")).alias("template")).agg(F.count(F.lit(1)).alias("n"))


def widened(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations of odd ids, and twenty of the even ones that share no turn with ids divisible by seven and are short."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set(F.sha1(F.coalesce("text", F.lit("")))).alias("prompts"), F.sum(F.octet_length("text")).alias("size"))
    guards = rows.where("conv_id % 7 = 0").select(F.explode("prompts").alias("prompt"))
    out = selection.widen(rows.where("conv_id % 2 = 1"), rows.where("conv_id % 2 = 0"), guards, key="conv_id", prompts="prompts", size=F.col("size"), most=2000, cap=20, seed=5)
    return out.select("conv_id", "added")


def confirmatory_split(spark: SparkSession, sf: str) -> DataFrame:
    """A primary selection of conversations that shows every role and turn, and a confirmation that shares no prompt with it."""
    rows = table(spark, sf, "conversations")
    made = conversations.decisions(rows).groupBy("conv_id").agg(F.collect_set(F.sha2("prompt", 256)).alias("prompts"))
    strata = rows.groupBy("conv_id").agg(F.collect_set(F.concat_ws(":", "role", F.col("turn").cast("string"))).alias("strata"))
    hashes = conversations.rebuild(rows).select("conv_id", conversations.semantic_hash(F.col("messages")).alias("semantic"))
    rows = strata.join(hashes, "conv_id").join(made, "conv_id", "left").withColumn("prompts", F.coalesce("prompts", F.array().cast("array<string>")))
    return selection.confirmatory(rows, "conv_id", semantic="semantic", prompts="prompts", strata="strata", primary=20, confirm=20)


def shuffled(spark: SparkSession, sf: str) -> DataFrame:
    return selection.bounded_shuffle(table(spark, sf, "documents").select("doc_id"), "doc_id", 11, 64)


def mined_traces(spark: SparkSession, sf: str) -> DataFrame:
    """Events as recorded traces with metadata, half of them adopted; one of each kind and argument."""
    rows = table(spark, sf, "events")
    meta = F.concat(F.lit('{"split":"'), F.when(F.col("event_id") % 10 == 0, "test").otherwise("train"), F.lit('","rule_verified":'), F.when(F.col("event_id") % 11 == 0, "false").otherwise("true"), F.lit(',"feedback":{"adopted":'), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit(',"uncertainty":'), (F.col("event_id") % 8 / 10.0).cast("string"), F.lit("}}"))
    rows = rows.select("event_id", "event_type", "props", meta.alias("meta"))
    return mixture.mined(rows, actions=F.lit(1), digest=F.sha2(F.concat_ws("|", "event_type", "props"), 256), tie=["event_id"]).select("digest", "event_id")


def record_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as JSON records of unknown shape: texts in turns, in text fields, and elsewhere."""
    docs = texts(spark, sf).where("text IS NOT NULL")
    shape = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.array(F.struct(F.col("text").alias("content"))).alias("messages")))).when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(F.col("text").alias("completion"), F.lit("x" * 50).alias("note")))).otherwise(F.to_json(F.struct(F.struct(F.col("text").alias("inner")).alias("outer"))))
    return readers.record_texts(docs.select(shape.alias("value"))).groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))


def shard_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as shard files, grouped back to their sources."""
    paths = table(spark, sf, "documents").select(F.concat(F.lit("/data/"), "source", F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 5, "0"), F.lit(".jsonl.gz")).alias("path"))
    return readers.shard_sources(paths).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def canonical_props(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical JSON of the events' properties, with a key added in front and one behind."""
    rows = table(spark, sf, "events")
    value = F.concat(F.lit('{ "z": [1, 2.50], '), F.substring("props", 2, 1000).substr(F.lit(1), F.length("props") - 2), F.lit(', "a": null}'))
    return rows.select("event_id", canonical_json(value).alias("json"))


def byte_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The byte tokens of the benchmark's texts."""
    rows = table(spark, sf, "benchmark").where("text IS NOT NULL").select("item_id", packing.byte_ids(F.col("text")).alias("ids"))
    return rows.select("item_id", F.size("ids").cast("bigint").alias("n"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


def training_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs and targets of the benchmark's texts as rows of up to 64 byte tokens."""
    rows = table(spark, sf, "benchmark").where("text IS NOT NULL").select("item_id", F.slice(F.concat(F.array(F.lit(0)), packing.byte_ids(F.col("text"))), 1, 64).alias("tokens"))
    out = packing.pairs(rows, 80)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, v: a + v)
    return out.select("item_id", total("x").alias("x"), total("y").alias("y"), F.size("x").alias("n"))


def stage_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = texts(spark, sf).groupBy("lang").agg(F.sum(F.octet_length("text")).alias("tokens"))
    return schedules.stage_plan(rows, "tokens", 4096).select("lang", "tokens", "steps", "used")


def assignments_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A split written with its manifest, read back and audited."""
    docs, folder = texts(spark, sf), new_folder(spark)
    sinks.write_assignments(selection.split_documents(docs, 0.2, 17), docs, folder)
    return sinks.read_generation(spark, folder).groupBy("split").agg(F.countDistinct("identity").alias("identities"))


def source_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Round robin over the four commonest kinds of events."""
    rows = table(spark, sf, "events")
    frames = [rows.where(F.col("event_type") == n).select("event_id") for n in ("click", "error", "purchase", "view")]
    return readers.round_robin(frames, ["event_id"]).select("event_id", "turn", "source_number")


def labels_shortened(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts as labels: those beyond 160 characters are cut and marked with a hash."""
    return table(spark, sf, "benchmark").select("item_id", X.bounded_label(F.col("text")).alias("label"))


def suites_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Required suites, a hash for each benchmark item, of which some are absent and some differ."""
    own = table(spark, sf, "benchmark").select(F.concat(F.lit("s"), F.col("item_id").cast("string")).alias("name"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"), "item_id")
    supplied = own.where("item_id % 5 <> 0").withColumn("bytes", F.when(F.col("item_id") % 7 == 0, 0).otherwise(F.col("bytes")))
    return freeze.suite_conflicts(own.drop("item_id"), supplied.drop("item_id"))


def slot_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Argument values of even and odd events."""
    rows = table(spark, sf, "events").select("event_id", F.explode(T.slot_values(F.col("props"))).alias("slot"))
    return conversations.overlap(rows.where("event_id % 200 = 0"), rows.where("event_id % 200 <> 0"), "slot")


def pool_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """A pool of distinct texts, published; its distinct digests."""
    pool = texts(spark, sf).select(F.sha2("text", 256).alias("digest")).distinct()
    record = mixture.publish_pool(pool, new_folder(spark), "g1")
    mark = governance.set_fingerprint(pool, "digest").first()
    return spark.createDataFrame([(record["rows"], record["distinct"], record["fingerprint"] == mark["fingerprint"])], "rows bigint, distinct bigint, same boolean")


def imported_histories(spark: SparkSession, sf: str) -> DataFrame:
    """The days as records of call lists, some broken: how many turns and calls of each outcome come in."""
    rows = _days(spark, sf).withColumn("n", F.size("calls"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("calls", lambda c: F.concat(c["name"], F.lit("(k="), F.get_json_object(c["arguments"], "$.k"), F.lit(")"))), ", "), F.lit("]"))
    said = F.when(F.col("n") % 5 == 0, F.lit("I won't.")).otherwise(listed)
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    value = F.to_json(F.struct(F.array(turn("user", F.col("key")), turn("assistant", said), turn("tool", F.lit("{}")), turn("assistant", F.lit("done"))).alias("conversations")))
    found = imports.imported(rows.select(F.when(F.col("n") == 7, F.substring(value, 1, 20)).otherwise(value).alias("value")), "call_list_history")
    calls = F.aggregate("messages", F.lit(0), lambda a, m: a + F.coalesce(F.size(m["tool_calls"]), F.lit(0)))
    return found.groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("messages")), F.lit(0)).alias("turns"), F.coalesce(F.sum(calls), F.lit(0)).alias("calls"))


def enriched_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations at all levels of enrichment: rows, turns, and requests that were changed."""
    out = imports.enriched(_episodes(spark, sf), "key", seed=3)
    changed = F.get("messages", F.lit(0))["content"] != F.concat(F.lit('Do "'), F.col("key"), F.lit('" now'))
    return out.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("messages")).alias("turns"), F.count_if(changed).alias("changed"))


def exported_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as browsing dialogues: a prompt-only case for each user turn."""
    rows = table(spark, sf, "conversations").withColumn("s", F.when(F.col("role") == "user", "instructor").otherwise("navigator"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "s", F.coalesce("text", F.lit("")).alias("t")))), lambda r: F.struct(F.lit("chat").alias("type"), r["s"].alias("speaker"), r["t"].alias("utterance")))
    records = rows.groupBy("conv_id").agg(turns.alias("turns")).select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("demo"), "turns")).alias("value"))
    return imports.prompt_cases(records, "dialogue_cases").select("source_case_id", F.sha2("prompt", 256).alias("prompt"))


def coverage_spread(spark: SparkSession, sf: str) -> DataFrame:
    """The quota order of the conversations' turns, with its strata spread over all of it."""
    rows = table(spark, sf, "conversations").withColumn("h", F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")), 256))
    ordered = selection.quota_order(rows, ["role", "turn"], "h").select("conv_id", "turn", F.col("position").alias("rank"))
    strata = rows.select("role", "turn").distinct().count()
    return schedules.spread_coverage(ordered, "rank", strata, rows.count()).select("conv_id", "turn", "position")


def pulsed_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Two languages in a cycle of three, interrupted by a third one for four of every twenty draws."""
    sizes = {r.lang: r.n for r in table(spark, sf, "documents").where("lang IN ('de', 'en', 'fr')").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = schedules.pulsed(spark, ["en", "fr", "en"], sizes, "de", 20, 4, 0, 3000)
    return out.select("ordinal", "source", F.col("index").cast("bigint").alias("row_index"), F.col("epoch").cast("bigint").alias("epoch"))


def catalog_check(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as catalog entries with mistakes: what is wrong with them."""
    k = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    rows = table(spark, sf, "documents").select("source").distinct()
    entries = rows.select(F.col("source").alias("id"), F.when(k % 5 == 0, "sea").otherwise("web").alias("family"), F.concat(F.when(k % 7 == 0, "http").otherwise("https"), F.lit("://example.org/"), "source").alias("source_url"), F.when(k % 3 == 0, "gated").otherwise("public_download").alias("access"), F.when(k % 2 == 0, "train").otherwise("eval_only").alias("policy"), F.when(k % 11 == 0, "unknown").otherwise("mit").alias("license"))
    return governance.catalog_problems(entries, ["web"])


QUERIES = [imported_histories, enriched_levels, exported_prompts, coverage_spread, pulsed_replay, catalog_check, prompt_rows, masked_names, tool_scores, document_scores, paired_documents, task_floors, clean_rates, suite_report, mixture_budgets, mixture_admission, mixture_acquired, mixture_readiness, corpus_freeze, denylist_freeze, action_templates, widened, confirmatory_split, shuffled, mined_traces, record_texts, shard_groups, canonical_props, byte_totals, training_pairs, stage_budget, assignments_round_trip, source_turns, labels_shortened, suites_missing, slot_overlap, pool_fingerprint]

_CALL = """'{"arguments":{"k":' || regexp_extract(props, '[0-9]+') || '},"name":"' || event_type || '"}'"""
_DAYS = f"""d AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS key, string_agg('<tool_call>' || {_CALL} || '</tool_call>', '' ORDER BY event_id) AS calls, string_agg(event_type, ',' ORDER BY event_id) AS called, count(*) AS n, list_sort(list_distinct(list(event_type))) AS names FROM events GROUP BY 1),
c AS (SELECT *, '<|tool_catalog|>{{"tools":[' || list_aggregate(list_transform(names, lambda x: '{{"function":{{"description":"Makes a ' || x || '","name":"' || x || '","parameters":{PARAMETERS}}},"type":"function"}}'), 'string_agg', ',') || ']}}</|tool_catalog|>' AS catalog, '<|user|>Do "' || key || '" now' AS asked FROM d)"""
_WORDS = r"len(regexp_extract_all(text, '[^ \t\n\r\f\x0b]+'))::BIGINT"
_MIX = "s AS (SELECT source AS name, row_number() OVER (ORDER BY source) - 2 AS position FROM (SELECT DISTINCT source FROM documents)), p AS (SELECT position, name, (position % 4 + 1)::BIGINT AS weight, CASE WHEN position % 3 = 0 THEN 'gpl' ELSE 'mit' END AS license, position % 2 = 1 AS listed FROM s WHERE position >= 0), q AS (SELECT *, 50000 * weight // sum(weight) OVER () AS f, 50000 * weight % sum(weight) OVER () AS r, weight / sum(weight) OVER ()::DOUBLE AS share FROM p), b AS (SELECT *, (f + (row_number() OVER (ORDER BY r DESC, position) <= 50000 - sum(f) OVER ())::INT)::BIGINT AS budget FROM q)"
_FOLDED = r"array_to_string(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'), ' ')"

ORACLES = {
    "imported_histories": "WITH d AS (SELECT count(*) AS n FROM events GROUP BY user_id, ts::DATE) SELECT CASE WHEN n = 7 THEN 'json' WHEN n % 5 = 0 THEN 'record' END AS problem, count(*) AS n, CASE WHEN any_value(n) = 7 OR any_value(n) % 5 = 0 THEN 0 ELSE 4 * count(*) END AS turns, CASE WHEN any_value(n) = 7 OR any_value(n) % 5 = 0 THEN 0 ELSE sum(n)::BIGINT END AS calls FROM d GROUP BY 1",
    "enriched_levels": "WITH d AS (SELECT DISTINCT user_id, ts::DATE FROM events), n AS (SELECT count(*) AS n FROM d) SELECT range::INT AS level, n, CASE WHEN range = 3 THEN 2 ELSE 4 END * n AS turns, CASE WHEN range = 0 THEN 0 ELSE n END AS changed FROM n, range(4)",
    "exported_prompts": "WITH l AS (SELECT conv_id, turn, role, row_number() OVER w - 1 AS k, string_agg(CASE WHEN role = 'user' THEN 'instructor' ELSE 'navigator' END || ': ' || coalesce(text, ''), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id || '/' || k AS source_case_id, sha256(p) AS prompt FROM l WHERE role = 'user'",
    "coverage_spread": f"WITH a AS (SELECT *, {_H} AS h, sha256(role || '|' || turn) AS s, count(*) OVER (PARTITION BY role, turn) AS n, row_number() OVER (PARTITION BY role, turn ORDER BY {_H}) - 1 AS k FROM conversations), o AS (SELECT conv_id, turn, row_number() OVER (ORDER BY CASE WHEN k = 0 THEN -1.0 ELSE (2 * k - 1) / (2.0::DOUBLE * (n - 1)) END, CASE WHEN k = 0 THEN n ELSE 0 END, CASE WHEN k = 0 THEN s ELSE sha256(s || '|' || h) END, h) - 1 AS r FROM a), t AS (SELECT count(*) AS t, (SELECT count(DISTINCT s) FROM a) AS c FROM a), p AS (SELECT range AS r, (2 * range + 1) * t // (2 * c) AS position FROM t, range(c)), f AS (SELECT range AS position, row_number() OVER (ORDER BY range) - 1 + any_value(c) OVER () AS r FROM t, range(t) WHERE range NOT IN (SELECT position FROM p)) SELECT conv_id, turn, position FROM o JOIN (SELECT r, position FROM p UNION ALL SELECT r, position FROM f) USING (r)",
    "pulsed_replay": "WITH n AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang), o AS (SELECT range AS ordinal, range // 20 AS p, range % 20 AS a FROM range(3000)), k AS (SELECT ordinal, a >= 16 AS pulse, CASE WHEN a >= 16 THEN p * 4 + a - 16 ELSE p * 16 + a END AS k FROM o), d AS (SELECT ordinal, CASE WHEN pulse THEN 'de' WHEN k % 3 = 1 THEN 'fr' ELSE 'en' END AS source, CASE WHEN pulse THEN k WHEN k % 3 = 1 THEN k // 3 ELSE k // 3 * 2 + (k % 3 = 2)::INT END AS i FROM k) SELECT ordinal, source, i % size AS row_index, i // size AS epoch FROM d JOIN n ON lang = source",
    "catalog_check": "WITH s AS (SELECT DISTINCT source AS id, regexp_extract(source, '[0-9]+')::INT AS k FROM documents) SELECT id, CASE WHEN k % 5 = 0 THEN 'family' WHEN k % 7 = 0 THEN 'url' WHEN k % 2 = 0 AND k % 3 = 0 THEN 'access' ELSE 'license' END AS problem FROM s WHERE k % 5 = 0 OR k % 7 = 0 OR k % 6 = 0 OR k % 22 = 0",
    "prompt_rows": f"WITH {_DAYS}, r AS (SELECT key, 1::BIGINT AS message_index, catalog || '<|end|>' || asked || '<|assistant|>' AS prompt, calls AS body FROM c UNION ALL SELECT key, 3, catalog || '<|end|>' || asked || '<|assistant|>' || calls || '<|end|><|tool|><tool_response>ok</tool_response><|assistant|>', n || ' done' FROM c) SELECT key, message_index, sha256(prompt) AS prompt, sha256(body) AS body, strlen(prompt) AS prompt_bytes, strlen(body) + 7 AS loss_bytes FROM r",
    "masked_names": f"WITH {_DAYS}, o AS (SELECT *, '9:' || key || ':' || sha256(catalog || chr(29) || asked || chr(30) || '<|assistant|>' || calls || '<|end|>' || chr(30) || '<|tool|><tool_response>ok</tool_response>' || chr(30) || '<|assistant|>' || n || ' done<|end|>') AS own FROM c), v AS (SELECT *, unnest([1, 2]) AS variant FROM o WHERE ('0x' || substr(sha256(own), 1, 8))::BIGINT < 2147483648), a AS (SELECT *, list_transform(names, lambda x, i: 'fn_' || substr(sha256(own || ':' || variant), 1, 12) || '_' || lpad((i - 1)::VARCHAR, 3, '0')) AS alias FROM v) SELECT key, variant, array_to_string(alias, ',') AS catalog, array_to_string(list_transform(string_split(called, ','), lambda x: alias[list_position(names, x)]), ',') AS calls FROM a",
    "tool_scores": """WITH e AS (SELECT user_id, ts::DATE AS day, event_id, event_type AS name, event_type || '|' || regexp_extract(props, '[0-9]+') AS call, event_type || '|' || CASE WHEN event_id % 7 = 0 THEN 'x' ELSE regexp_extract(props, '[0-9]+') END AS said, event_id % 5 <> 0 AS told FROM events),
c AS (SELECT user_id, day, coalesce(list_sort(list(call) FILTER (event_id % 3 <> 0)), []) AS want, coalesce(list_sort(list(said) FILTER (event_id % 3 <> 0 AND told)), []) AS got FROM e GROUP BY ALL),
f AS (SELECT *, (day(day) + user_id) % 11 <> 0 AS complete, NOT (len(got) > 0 AND day(day) % 10 = 0) AS valid, user_id % 2 = 0 AS multi FROM c),
g AS (SELECT *, complete AND valid AS ok, CASE WHEN complete AND valid THEN got ELSE [] END AS own, list_transform(want, lambda x: split_part(x, '|', 1)) AS want_names FROM f),
h AS (SELECT *, list_transform(own, lambda x: split_part(x, '|', 1)) AS own_names FROM g),
i AS (SELECT *, ok AND own = want AS whole, ok AND list_sort(own_names) = list_sort(want_names) AS names, ok AND len(own) = 0 AND len(got) = 0 AS abstained,
  list_sum(list_transform(list_distinct(want_names), lambda x: least(len(list_filter(want_names, lambda y: y = x)), len(list_filter(own_names, lambda y: y = x))))) AS shared_names,
  list_sum(list_transform(list_distinct(want), lambda x: least(len(list_filter(want, lambda y: y = x)), len(list_filter(own, lambda y: y = x))))) AS shared_calls FROM h),
p AS (SELECT avg(w) AS v FROM (SELECT min(whole::INT) AS w FROM i WHERE len(want) > 0 AND multi GROUP BY user_id))
SELECT count(*)::DOUBLE AS decisions, (count(*) FILTER (len(want) > 0))::DOUBLE AS tool_decisions, round(avg(complete::INT), 9) AS completion, round(avg(ok::INT), 9) AS format_validity, round(avg(names::INT) FILTER (len(want) > 0), 9) AS name_exact,
  round(sum(shared_names) FILTER (len(want) > 0) / sum(len(own)) FILTER (len(want) > 0)::DOUBLE, 9) AS name_precision, round(sum(shared_names) FILTER (len(want) > 0) / sum(len(want))::DOUBLE, 9) AS name_recall, round(sum(shared_calls) FILTER (len(want) > 0) / sum(shared_names) FILTER (len(want) > 0)::DOUBLE, 9) AS arguments_given_name,
  round(avg(whole::INT) FILTER (len(want) > 0), 9) AS whole_call_exact, round(avg(abstained::INT) FILTER (len(want) = 0), 9) AS abstention, round(avg(whole::INT) FILTER (len(want) > 0 AND multi), 9) AS step_exact, round(any_value(p.v), 9) AS episode_exact FROM i, p""",
    "document_scores": f"WITH d AS (SELECT lang, {_WORDS} AS t, strlen(text) AS b, doc_id % 97 * 1.5::DOUBLE AS nll, doc_id % 5 AS c FROM documents WHERE text IS NOT NULL) SELECT lang, count(*) AS documents, sum(t)::BIGINT AS tokens, sum(b)::BIGINT AS utf8_bytes, round(sum(nll) / sum(t), 9) AS cross_entropy, round(sum(nll) / (ln(2) * sum(b)), 9) AS bits_per_byte, round(sum(c) / sum(t)::DOUBLE, 9) AS top1 FROM d GROUP BY GROUPING SETS ((lang), ())",
    "task_floors": "WITH t AS (SELECT 'User ' || user_id || CASE WHEN event_id % 2 = 0 THEN ' wants ' || regexp_extract(props, '[0-9]+') ELSE '' END AS o, event_type AS g, event_id % 4 <> 0 AS has, regexp_extract(props, '[0-9]+') AS k FROM events), m AS (SELECT g, count(*) AS n FROM t GROUP BY g ORDER BY n DESC, g LIMIT 1), a AS (SELECT o, max(n) AS n FROM (SELECT o, g, CASE WHEN has THEN k END AS a, count(*) AS n FROM t GROUP BY ALL) GROUP BY o), h AS (SELECT *, has AND contains(o, k) AS hit FROM t) SELECT count(*) AS rows, round((SELECT n FROM m) / count(*)::DOUBLE, 9) AS majority, round(avg((g = (SELECT g FROM m) AND NOT has)::INT), 9) AS constant, round(avg((NOT has)::INT), 9) AS no_arguments, round(avg(hit::INT) FILTER (has), 9) AS derivability, round(avg((hit OR NOT has)::INT), 9) AS fully_derivable, round((SELECT sum(n) FROM a) / count(*)::DOUBLE, 9) AS reachable FROM h",
    "clean_rates": "WITH e AS (SELECT event_id % 3 <> 0 AS s, event_type IN ('view', 'click') AS t, user_id % 4 = 0 AS l FROM events), x AS (SELECT 'all' AS subset, * FROM e UNION ALL SELECT 'clean', * FROM e WHERE NOT l) SELECT subset, count(*) AS rows, (SELECT count(*) FROM e WHERE l) AS leaked_rows, round(avg(t::INT), 9) AS type_match, round(avg(s::INT), 9) AS step_success FROM x GROUP BY subset",
    "suite_report": "WITH a AS (SELECT event_type, user_id, min(event_id) AS e FROM events GROUP BY ALL), r AS (SELECT * FROM a WHERE user_id % 5 <> 0), x AS (SELECT event_type, user_id FROM a WHERE user_id % 3 <> 0), c AS (SELECT event_type, count(*) FILTER (r.user_id IS NULL) AS missing, count(*) FILTER (x.user_id IS NULL) AS unexpected FROM r FULL JOIN x USING (event_type, user_id) GROUP BY event_type), s AS (SELECT event_type, count(*) AS cases, round(avg((e % 4 = 0)::INT), 9) AS mean, count(*) FILTER (e % 9 = 0) AS failures FROM r GROUP BY event_type) SELECT event_type, cases, 0::BIGINT AS duplicates, missing, unexpected, failures, mean, CASE WHEN missing + unexpected = 0 THEN 'complete' ELSE 'incomplete' END AS status FROM c JOIN s USING (event_type)",
    "mixture_budgets": f"WITH {_MIX} SELECT position::INT AS position, name, weight, budget, round(share, 9) AS share FROM b",
    "mixture_admission": f"WITH {_MIX}, d AS (SELECT source, trim(regexp_replace(text, '\\r\\n?', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents) SELECT source, CASE WHEN b.name IS NULL THEN 'unknown_source' WHEN t IS NULL THEN 'missing_text' WHEN length(t) NOT BETWEEN 200 AND 2000000 THEN 'length' WHEN listed AND license <> 'mit' THEN 'license' ELSE '' END AS reason, count(*) AS n, sum(length(t))::BIGINT AS chars FROM d LEFT JOIN b ON name = source GROUP BY ALL",
    "mixture_readiness": f"WITH {_MIX}, h AS (SELECT source AS name, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1) SELECT name, budget, coalesce(chars, 0) AS chars, CASE WHEN coalesce(chars, 0) = 0 THEN 'no_rows' WHEN chars < budget THEN 'short_of_budget' ELSE '' END AS blockers, coalesce(chars, 0) >= budget AS ready FROM b LEFT JOIN h USING (name)",
    "denylist_freeze": f"WITH t AS (SELECT 'a' || item_id AS id, text AS p FROM benchmark UNION ALL SELECT 'b' || item_id, ' ' || upper(text) FROM benchmark), n AS (SELECT id, p, {_FOLDED.replace('text', 'p')} AS norm FROM t) SELECT 'benchmark' AS suite, min(id) AS source_case_id, sha256(arg_min(p, id)) AS prompt FROM n GROUP BY norm",
    "action_templates": "WITH d AS (SELECT string_agg(event_type || '(k)', ';' ORDER BY event_id) AS t FROM events GROUP BY user_id, ts::DATE) SELECT sha256(t) AS template, count(*) AS n FROM d GROUP BY 1",
    "widened": "WITH c AS (SELECT conv_id, list_distinct(list(sha1(coalesce(text, '')))) AS p, sum(strlen(text)) AS n FROM conversations GROUP BY conv_id), g AS (SELECT DISTINCT unnest(p) AS h FROM c WHERE conv_id % 7 = 0), x AS (SELECT DISTINCT conv_id FROM (SELECT conv_id, unnest(p) AS h FROM c) WHERE h IN (FROM g)), e AS (SELECT conv_id FROM c WHERE conv_id % 2 = 0 AND n <= 2000 AND conv_id NOT IN (FROM x) ORDER BY sha256('5:' || conv_id), conv_id LIMIT 20) SELECT conv_id, false AS added FROM c WHERE conv_id % 2 = 1 UNION ALL SELECT conv_id, true FROM e",
    "shuffled": "SELECT doc_id, doc_id // 64 * 64 + row_number() OVER (PARTITION BY doc_id // 64 ORDER BY sha256('11:' || doc_id)) - 1 AS shuffled FROM documents",
    "mined_traces": "SELECT sha256(event_type || '|' || props) AS digest, min(event_id) AS event_id FROM events WHERE event_id % 10 <> 0 AND event_id % 11 <> 0 AND event_id % 2 = 0 AND event_id % 8 <= 5 GROUP BY 1",
    "record_texts": r"WITH t AS (SELECT trim(replace(text, chr(10), ' '), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t, text, doc_id FROM documents WHERE text IS NOT NULL) SELECT count(*) AS n, sum(length(t))::BIGINT AS chars FROM t WHERE length(t) >= 40 AND (doc_id % 3 < 2 OR length(text) > 40)",
    "shard_groups": "SELECT source, count(*) AS n FROM documents GROUP BY source",
    "canonical_props": """SELECT event_id, '{"a":null,"k":' || regexp_extract(props, '[0-9]+') || ',"z":[1,2.5]}' AS json FROM events""",
    "byte_totals": "WITH b AS (SELECT item_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM benchmark WHERE text IS NOT NULL) SELECT item_id, count(*) AS n, sum(('0x' || h)::BIGINT)::BIGINT AS total FROM b GROUP BY item_id",
    "training_pairs": "WITH b AS (SELECT item_id, list_concat([0], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT))[1:64] AS t FROM benchmark WHERE text IS NOT NULL) SELECT item_id, list_sum(t)::BIGINT AS x, (list_sum(t[2:]) - 100 * (79 - len(t) + 1))::BIGINT AS y, 79 AS n FROM b",
    "stage_budget": "SELECT lang, sum(strlen(text))::BIGINT AS tokens, (sum(strlen(text)) // 4096)::BIGINT AS steps, (sum(strlen(text)) // 4096 * 4096)::BIGINT AS used FROM documents GROUP BY lang",
    "assignments_round_trip": "WITH ids AS (SELECT DISTINCT sha256(doc_id::VARCHAR) AS i FROM documents), r AS (SELECT row_number() OVER (ORDER BY sha256('17:' || i), i) AS k, count(*) OVER () AS n FROM ids) SELECT CASE WHEN k <= greatest(1, least(n - 1, round_even(n * 0.2, 0))) THEN 'val' ELSE 'train' END AS split, count(*) AS identities FROM r GROUP BY 1",
    "source_turns": "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS turn, (list_position(['click', 'error', 'purchase', 'view'], event_type) - 1)::INT AS source_number FROM events WHERE event_type IN ('click', 'error', 'purchase', 'view')",
    "labels_shortened": "SELECT item_id, CASE WHEN length(text) <= 160 THEN text ELSE left(text, 138) || '…#' || substr(sha256(text), 1, 20) END AS label FROM benchmark",
    "suites_missing": "SELECT 's' || item_id AS name, CASE WHEN item_id % 5 = 0 THEN 'absent' ELSE 'differs' END AS problem FROM benchmark WHERE item_id % 5 = 0 OR item_id % 7 = 0",
    "slot_overlap": "WITH s AS (SELECT event_id, regexp_extract(props, '[0-9]+') AS v FROM events), l AS (SELECT DISTINCT v FROM s WHERE event_id % 200 = 0), r AS (SELECT DISTINCT v FROM s WHERE event_id % 200 <> 0) SELECT (SELECT count(*) FROM l) AS \"left\", (SELECT count(*) FROM r) AS \"right\", (SELECT count(*) FROM l SEMI JOIN r USING (v)) AS shared",
    "pool_fingerprint": "SELECT count(DISTINCT text) AS rows, count(DISTINCT text) AS \"distinct\", true AS same FROM documents",
}
