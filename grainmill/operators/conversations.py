"""Conversations: rebuilding, rendering, decisions, overlap audits, structural flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

ROLES = ("system", "user", "assistant", "tool")


def rebuild(turns: DataFrame) -> DataFrame:
    """(conv_id, messages): the turns in order. A conversation is bounded; its rows meet by design."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(rows.alias("messages"))


def render(messages: Column) -> Column:
    """Role markers and texts, one line each."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>"), F.coalesce(m["text"], F.lit("")))), "\n")


def byte_accounting(messages: Column) -> Column:
    """Input bytes of the rendering with an end mark per message, and loss bytes: assistant texts and their end marks."""
    body = F.transform(messages, lambda m: F.octet_length(F.coalesce(m["text"], F.lit(""))))
    marks = F.transform(messages, lambda m: F.octet_length(m["role"]) + 5)
    loss = F.transform(F.filter(messages, lambda m: m["role"] == "assistant"), lambda m: F.octet_length(F.coalesce(m["text"], F.lit(""))) + 1)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    return F.struct((total(body) + total(marks)).alias("input"), total(loss).alias("loss"))


def decisions(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, prompt, target): each assistant turn with the rendered history before it."""
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>"), F.coalesce("text", F.lit("")))
    rows = turns.withColumn("prompt", F.array_join(F.collect_list(line).over(before), "\n"))
    return rows.where("role = 'assistant'").select("conv_id", "turn", "prompt", F.col("text").alias("target"))


def semantic_hash(messages: Column) -> Column:
    """SHA-256 of roles and texts; ids and metadata don't count."""
    parts = F.transform(messages, lambda m: F.concat(m["role"], F.lit("\x1f"), F.coalesce(m["text"], F.lit(""))))
    return F.sha2(F.array_join(parts, "\x1e"), 256)


def overlap(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """(left, right, shared) distinct values of a hash column on two sides."""
    a, b = left.select(column).distinct(), right.select(column).distinct()
    both = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), column, "full_outer")
    return both.agg(F.count("l").alias("left"), F.count("r").alias("right"), F.count(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1)).alias("shared"))


def without_prompts(turns: DataFrame, held_out: DataFrame) -> DataFrame:
    """Conversations none of whose decision prompts is among the held-out (prompt_hash)."""
    hit = decisions(turns).withColumn("prompt_hash", F.sha2("prompt", 256)).join(held_out, "prompt_hash", "left_semi").select("conv_id").distinct()
    return turns.join(hit, "conv_id", "left_anti")


def trainable(messages: Column) -> Column:
    """Has a user turn and ends with an assistant turn that says something."""
    last = F.element_at(messages, -1)
    return (F.size(messages) > 0) & F.exists(messages, lambda m: m["role"] == "user") & (last["role"] == "assistant") & (F.length(F.trim(last["text"])) > 0)


def recovers(messages: Column, failure: str = r"(?i)\b(error|failed|failure)\b") -> Column:
    """An assistant turn comes after a turn that reports a failure."""
    state = F.aggregate(messages, F.struct(F.lit(False).alias("failed"), F.lit(False).alias("ok")), lambda a, m: F.struct((a["failed"] | F.coalesce(m["text"], F.lit("")).rlike(failure)).alias("failed"), (a["ok"] | (a["failed"] & (m["role"] == "assistant"))).alias("ok")))
    return state["ok"]


def tasks(turns: DataFrame) -> DataFrame:
    """(conv_id, observation, gold): the first assistant turn and all text before it."""
    rows = rebuild(turns)
    at = F.array_position(F.transform("messages", lambda m: m["role"]), "assistant")
    said = F.transform(F.slice("messages", 1, F.greatest(at.cast("int") - 1, F.lit(0))), lambda m: F.coalesce(m["text"], F.lit("")))
    return rows.where(at > 0).select("conv_id", F.array_join(said, "\n").alias("observation"), F.element_at("messages", at.cast("int"))["text"].alias("gold"))


def fit_report(turns: DataFrame, limit: int) -> DataFrame:
    """(kept, oversize, longest): conversations all of whose decisions fit into ``limit`` bytes of prompt and target, and the others."""
    sizes = decisions(turns).select("conv_id", (F.octet_length("prompt") + F.octet_length(F.coalesce("target", F.lit("")))).alias("n")).groupBy("conv_id").agg(F.max("n").alias("n"))
    return sizes.agg(F.count_if(F.col("n") <= limit).alias("kept"), F.count_if(F.col("n") > limit).alias("oversize"), F.max("n").alias("longest"))


def masked_catalog(tools: Column, seed: str) -> Column:
    """Tool names replaced by an alias of 12 hash digits and the position; descriptions and parameters stay."""
    return F.transform(tools, lambda t, i: t.withField("name", F.concat(F.lit("fn_"), F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), t["name"]), 256), 1, 12), F.lit("_"), i.cast("string"))))


def rotated(items: Column, by: int) -> Column:
    """The items in a cyclic order that starts ``by`` places later."""
    n = F.size(items)
    return F.transform(items, lambda _, i: F.element_at(items, (F.pmod(i + by, n) + 1).cast("int")))


def padded_catalog(own: Column, pool: Column, size: int) -> Column:
    """A catalog filled up to ``size`` with distractors that it doesn't have, in the pool's order."""
    return F.slice(F.concat(own, F.array_except(pool, own)), 1, F.greatest(F.lit(size), F.size(own)))
