"""Mixtures of sources: the plan, admission by text, length and licence, budgets, readiness, resumption.

A plan is a small table, a row for each source in the order of the configuration. Sources are acquired one after the other, since a text that an earlier source has taken is a duplicate in later ones; within a
source, rows come in the order of a seeded hash of their text.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions import text as X
from grainmill.functions.canonical import canonical
from grainmill.operators import governance, selection
from grainmill.operators.ranking import global_rank, hash_group

KEYS = frozenset("name weight license license_field allowed_licenses evidence".split())
PLAN = "position int, name string, weight bigint, license string, allowed array<string>, evidence string, normalized_weight double, budget bigint"


def mixture_plan(spark: SparkSession, sources: list[dict], target_chars: int, *, need_evidence: bool = False) -> DataFrame:
    """(position, name, weight, license, allowed, evidence, normalized_weight, budget): each source's characters by largest remainders of exact decimal weights; the budgets add up to ``target_chars``.

    Errors: no sources, repeated names, unknown keys, weights that aren't positive, fewer characters than sources, and, if evidence is needed, a source without it; so is one evidence name with two licences.
    """
    names = [s.get("name") for s in sources]
    if not sources or len(set(names)) < len(names) or not all(isinstance(n, str) and n for n in names):
        raise ValueError("a mixture needs sources of different names")
    if unknown := {k for s in sources for k in s} - KEYS:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    weights = [Decimal(str(s.get("weight", 1))) for s in sources]
    if not all(w.is_finite() and w > 0 for w in weights) or target_chars < len(sources):
        raise ValueError("weights must be positive, and there must be a character for each source")
    if need_evidence and not all(s.get("evidence") for s in sources):
        raise ValueError("a source has no licence evidence")
    said: dict[str, str] = {}
    for s in sources:
        if s.get("evidence") and said.setdefault(s["evidence"], s.get("license") or "") != (s.get("license") or ""):
            raise ValueError(f"conflicting licences for evidence {s['evidence']}")
    scale = 10 ** max(0, *(-w.as_tuple().exponent for w in weights))
    rows = [(k, s["name"], int(w * scale), normal_license(s.get("license")), sorted({normal_license(x) for x in s.get("allowed_licenses", [])}), s.get("evidence")) for k, (s, w) in enumerate(zip(sources, weights, strict=True))]
    plan = spark.createDataFrame(rows, "position int, name string, weight bigint, license string, allowed array<string>, evidence string")
    return selection.shares(selection.apportion(plan, target_chars), "weight", "given").withColumnRenamed("share", "normalized_weight").select(*(c.split()[0] for c in PLAN.split(", ")))


def normal_license(value: str | None) -> str:
    return (value or "").strip().lower() or "unknown"


def plan_hash(plan: DataFrame) -> str:
    """SHA-256 of the plan's rows as canonical JSON. A plan has a row for each source."""
    return hashlib.sha256(canonical([r.asDict() for r in plan.orderBy("position").collect()]).encode()).hexdigest()


def judged(rows: DataFrame, plan: DataFrame, *, source: str = "source", text: str = "text", license: str | None = None, least: int = 200, most: int = 2_000_000) -> DataFrame:
    """Adds clean (line ends as LF, stripped), license_name, chars, digest and ``reason``: unknown_source, missing_text, length, license, or '' for what may be admitted.

    The licence is the row's where there is such a column, else the source's; a source without allowed licences takes all.
    """
    own = plan.select(F.col("name").alias("__name"), F.col("license").alias("__license"), "allowed", "position", "budget")
    clean = X.strip(F.regexp_replace(F.col(text), r"\r\n?", "\n"))
    said = F.lower(F.trim(F.col(license))) if license else F.lit(None).cast("string")
    out = rows.join(F.broadcast(own), F.col(source) == F.col("__name"), "left").withColumn("clean", clean)
    out = out.withColumn("license_name", F.coalesce(F.nullif(said, F.lit("")), "__license", F.lit("unknown"))).withColumn("chars", F.length("clean")).withColumn("digest", F.sha2("clean", 256))
    reason = (
        F.when(F.col("__name").isNull(), "unknown_source")
        .when(F.col("clean").isNull(), "missing_text")
        .when(~F.col("chars").between(least, most), "length")
        .when((F.size("allowed") > 0) & ~F.array_contains("allowed", F.col("license_name")), "license")
        .otherwise("")
    )
    return out.withColumn("reason", reason).drop("__name", "__license", "allowed")


def acquire(rows: DataFrame, plan: DataFrame, folder: str, *, seed: int = 42, source: str = "source", **options) -> list[dict]:
    """Writes what the mixture takes of each source to folder/name, and after it a record of it; a list of the records: name, documents, chars, requested, exhausted, skipped by reason.

    In hash order, a source gives the first row of each text that no earlier source has given, until its budget is reached; the row that reaches it counts. A source whose record is there
    and belongs to this plan and seed is not done again; one without is done anew from its beginning, so that a job that broke off goes on with the source at which it broke.
    """
    from grainmill.sources import sinks

    spark, mark = rows.sparkSession, plan_hash(plan)
    found = judged(rows, plan, source=source, **options)
    records, taken = [], None
    for s in plan.orderBy("position").collect():
        path = f"{folder}/{s['name']}"
        record = sinks.read_record(spark, f"{path}.json")
        if record is None or record["plan"] != mark or record["seed"] != seed:
            record = _one_source(found.where(F.col(source) == s["name"]), taken, s["budget"], seed, path) | {"name": s["name"], "requested": s["budget"], "plan": mark, "seed": seed}
            sinks.write_record(spark, f"{path}.json", governance.manifest(record))
            record = sinks.read_record(spark, f"{path}.json")
        governance.verify_manifest(record)
        records.append(record)
        digests = spark.read.parquet(path).select("digest")
        taken = digests if taken is None else taken.union(digests)
    return records


def _one_source(rows: DataFrame, taken: DataFrame | None, budget: int, seed: int, path: str) -> dict:
    spark = rows.sparkSession
    skipped = {r.reason: r.n for r in rows.where("reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    fit = rows.where("reason = ''")
    total = fit.count()
    columns = [c for c in rows.columns if c not in ("position", "budget", "reason")]
    fresh = fit.groupBy("digest").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row")).select("row.*")
    if taken is not None:
        fresh = fresh.join(taken, "digest", "left_anti")
    fresh = fresh.withColumn("__h", selection.seeded(seed, F.col("digest")))
    ordered = global_rank(fresh.withColumn("__g", hash_group(F.col("__h"), total)), "__g", [F.col("__h")], "used", amount="chars")
    ordered.where(F.col("used") < budget).drop("__h", "__g").write.mode("overwrite").parquet(path)
    kept = spark.read.parquet(path).agg(F.count(F.lit(1)), F.coalesce(F.sum("chars"), F.lit(0))).first()
    available = fresh.agg(F.count(F.lit(1))).first()[0]
    return {"documents": kept[0], "chars": kept[1], "exhausted": kept[1] < budget, "skipped": dict(sorted((skipped | {"duplicate": total - available}).items()))}


def readiness(plan: DataFrame, available: DataFrame, *, full_budgets: bool = True, evidence: list[str] | None = None, free_bytes: int | None = None, minimum_free_bytes: int = 0) -> DataFrame:
    """(name, budget, chars, blockers, ready) for each source, of (name, chars) that could be had: no_rows, short_of_budget, no_evidence, and for all of them no_space. A mixture is ready if every source is."""
    flat = plan.join(available.select("name", "chars"), "name", "left").withColumn("chars", F.coalesce("chars", F.lit(0)))
    checks = [(F.col("chars") == 0, "no_rows"), ((F.col("chars") > 0) & (F.col("chars") < F.col("budget")) & F.lit(full_budgets), "short_of_budget")]
    if evidence is not None:
        checks.append((F.col("evidence").isNull() | ~F.col("evidence").isin(evidence or [""]), "no_evidence"))
    if free_bytes is not None:
        checks.append((F.lit(free_bytes < minimum_free_bytes), "no_space"))
    blockers = F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in checks)))
    return flat.select("name", "budget", "chars", blockers.alias("blockers"), (F.size(blockers) == 0).alias("ready"))


def policy_gate(rows: DataFrame, catalog: DataFrame, use: str, *, source: str = "source") -> DataFrame:
    """Adds ``policy``: that of the row's source in a catalog of (source, use, license, allowed), or why the row may not be used: unknown_source, not_for_<use>, refused. A source that stands twice in the catalog for a use is an error."""
    own = catalog.groupBy("source").agg(F.collect_set("use").alias("uses"), F.max(F.when(F.col("use") == use, F.struct(F.lit(1).alias("k"), "allowed"))).alias("mine"), F.sum(F.when(F.col("use") == use, 1).otherwise(0)).alias("n"))
    own = own.select(F.col("source").alias("__s"), "mine", "n")
    out = rows.join(F.broadcast(own), F.col(source) == F.col("__s"), "left")
    twice = F.when(F.col("n") > 1, F.raise_error(F.lit("a source stands twice in the catalog")).cast("string"))
    policy = twice.when(F.col("__s").isNull(), "unknown_source").when(F.col("mine").isNull(), f"not_for_{use}").when(~F.col("mine.allowed"), "refused").otherwise("allowed")
    return out.withColumn("policy", policy).drop("__s", "mine", "n")


PROVENANCE = ("dataset", "subset", "revision", "record_id", "url", "license", "file_sha256", "source_line")


def _fields(meta: Column) -> Column:
    """Top-level values: strings as they are, others as JSON text; null where the metadata isn't an object."""
    return F.from_json(meta, "map<string,string>")


def trace_problem(meta: Column, actions: Column) -> Column:
    """Why a recorded conversation may not be trained on, or null: its JSON metadata must say split train and rule_verified true; public data must also say that neither a model nor an environment has
    checked it, carry exactly the PROVENANCE keys, filled in, and count its actions right."""
    m = _fields(meta)
    at = lambda k: F.try_element_at(m, F.lit(k))
    flag = lambda k: at(k).isNull() | at(k).isin("true", "false")
    p = F.from_json(at("provenance"), "map<string,string>")
    own = lambda k: F.coalesce(F.try_element_at(p, F.lit(k)), F.lit(""))
    public = F.coalesce(at("public_data") == "true", F.lit(False))
    capabilities = F.from_json(at("capabilities"), "array<string>")
    return (
        F.when(m.isNull(), "metadata")
        .when(~at("split").eqNullSafe("train"), "split")
        .when(~at("rule_verified").eqNullSafe("true"), "rule")
        .when(~flag("model_verified") | ~flag("environment_executed"), "flags")
        .when(public & ~(at("model_verified").eqNullSafe("false") & at("environment_executed").eqNullSafe("false")), "flags")
        .when(public & (p.isNull() | ~F.array_sort(F.map_keys(p)).eqNullSafe(F.array_sort(F.array(*map(F.lit, PROVENANCE))))), "provenance_keys")
        .when(public & F.exists(F.array(*map(F.lit, PROVENANCE)), lambda k: F.coalesce(F.try_element_at(p, k), F.lit("")) == ""), "provenance_values")
        .when(public & (~own("url").startswith("https://") | ~own("file_sha256").rlike("^[0-9a-f]{64}$") | ~own("source_line").rlike("^[1-9][0-9]*$")), "provenance_values")
        .when(public & (capabilities.isNull() | ~F.array_sort(F.array_distinct(capabilities)).eqNullSafe(capabilities) | F.exists(capabilities, lambda c: c == "")), "capabilities")
        .when(public & ~F.coalesce(at("action_count") == actions.cast("string"), F.lit(False)), "action_count")
    )


def feedback_selected(meta: Column) -> Column:
    """Whether feedback speaks for a conversation: not rejected, no missing knowledge, preferred, adopted or relevant, uncertainty up to 0.5; without feedback, public data whose quality isn't refused."""
    m = _fields(meta)
    f = F.from_json(F.try_element_at(m, F.lit("feedback")), "map<string,string>")
    q = F.from_json(F.try_element_at(m, F.lit("quality")), "map<string,string>")
    at = lambda k: F.coalesce(F.try_element_at(f, F.lit(k)), F.lit(""))
    good = (at("preference_winner") == "true") | (at("adopted") == "true") | (at("knowledge_relevant") == "true")
    doubt = F.try_element_at(f, F.lit("uncertainty"))
    sure = doubt.isNull() | F.coalesce(doubt.try_cast("double") <= 0.5, F.lit(False))
    without = F.coalesce(F.try_element_at(m, F.lit("public_data")) == "true", F.lit(False)) & ~F.coalesce(F.try_element_at(q, F.lit("accepted")) == "false", F.lit(False))
    return F.when(F.try_element_at(m, F.lit("feedback")).isNull(), without).otherwise(f.isNotNull() & (at("rejected") != "true") & (at("missing_knowledge") != "true") & good & sure)


def mined(rows: DataFrame, *, meta: str = "meta", actions: Column, digest: Column, tie: list[str]) -> DataFrame:
    """The conversations without a trace_problem() that feedback selects, one of each digest, the smallest by ``tie``. Adds ``digest``."""
    kept = rows.where(trace_problem(F.col(meta), actions).isNull() & feedback_selected(F.col(meta))).withColumn("digest", digest)
    return kept.groupBy("digest").agg(F.min_by(F.struct(*kept.columns), F.struct(*tie)).alias("row")).select("row.*")


def publish_pool(pool: DataFrame, folder: str, generation: str) -> dict:
    """A new generation of a training pool, with the fingerprint of its digests in the manifest; readers see the old one or the new one whole."""
    from grainmill.sources import sinks

    mark = governance.set_fingerprint(pool, "digest").first()
    return sinks.write_generation(pool, folder, generation, fields={"fingerprint": mark["fingerprint"], "distinct": mark["count"]})

