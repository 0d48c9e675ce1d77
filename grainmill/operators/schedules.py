"""Which row is drawn when: replay cycles, permutation blocks, micro-batches, stage budgets. Positions are computed, rows are joined to them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.operators.ranking import global_rank, hash_group


def cycle_slots(cycle: list[str]) -> list[tuple[int, str, int, int]]:
    """(slot, source, its turn in the cycle, its turns in a cycle)."""
    return [(k, s, cycle[:k].count(s), cycle.count(s)) for k, s in enumerate(cycle)]


def replay_window(spark: SparkSession, cycle: list[str], sizes: dict[str, int], start: int, stop: int) -> DataFrame:
    """(ordinal, source, index, epoch): exact interleaving by a configured cycle; each source's rows are taken in order and again from the first."""
    if missing := set(cycle) - set(sizes):
        raise ValueError(f"no size of {sorted(missing)}")
    table = spark.createDataFrame([(*s, sizes[s[1]]) for s in cycle_slots(cycle)], "slot int, source string, turn int, turns int, size bigint")
    n = len(cycle)
    rows = spark.range(start, stop).select(F.col("id").alias("ordinal"), (F.col("id") % n).cast("int").alias("slot"), F.expr(f"id div {n}").alias("round"))
    drawn = F.col("round") * F.col("turns") + F.col("turn")
    return rows.join(F.broadcast(table), "slot").select("ordinal", "source", (drawn % F.col("size")).alias("index"), F.floor(drawn / F.col("size")).alias("epoch"))


def permutation_blocks(rows: DataFrame, key: str, seed: int, draws: int) -> DataFrame:
    """(draw, key): every block of as many draws as rows is a permutation by hash: no row comes again before all have."""
    n = rows.count()
    if not n:
        return rows.select(F.lit(0).cast("bigint").alias("draw"), key).limit(0)
    blocks = rows.select(key).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(0, math.ceil(draws / n) - 1)))))
    blocks = blocks.withColumn("h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("block").cast("string"), F.col(key).cast("string")), 256))
    ranked = global_rank(blocks.withColumn("g", hash_group(F.col("h"), n)), "g", [F.col("h"), F.col(key)], by=["block"])
    return ranked.select((F.col("block") * n + F.col("rank")).alias("draw"), key).where(F.col("draw") < draws)


def keyed_order(rows: DataFrame, order: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in the order of (keys, position); an order that isn't a permutation of the rows is an error at run time."""
    both = rows.join(order.groupBy(*keys).agg(F.min("position").alias("position"), F.count(F.lit(1)).alias("__n")), keys, "full_outer")
    bad = F.col("position").isNull() | (F.col("__n") != 1)
    return both.withColumn("position", F.when(bad, F.raise_error(F.lit("not a permutation")).cast("bigint")).otherwise(F.col("position"))).drop("__n")


def microbatch_tokens(rows: DataFrame, length: str, batch: int, order: str) -> DataFrame:
    """(batch, input_tokens, loss_tokens): rows by position in batches; a row of n tokens has n - 1 inputs and as many targets."""
    n = F.greatest(F.col(length) - 1, F.lit(0))
    return rows.groupBy(F.floor(F.col(order) / batch).alias("batch")).agg((F.max(n) * F.count(F.lit(1))).alias("input_tokens"), F.sum(n).alias("loss_tokens"))


def suggested_tokens(parameters: int, per_parameter: float = 20.0) -> int:
    return math.ceil(parameters * per_parameter)


def stage_plan(stages: DataFrame, total: str = "tokens", batch_tokens: int = 65_536) -> DataFrame:
    """Adds steps and the tokens they use: whole steps that don't exceed a stage's tokens."""
    return stages.withColumn("steps", F.floor(F.col(total) / batch_tokens)).withColumn("used", F.col("steps") * batch_tokens)


def spread_coverage(rows: DataFrame, rank: str, coverage: int, total: int) -> DataFrame:
    """Adds ``position``: the first ``coverage`` of ``total`` ranked rows at centred places over all of them, the others, in their order, at the places between. Ranks start at 0."""
    if not 1 <= coverage <= total:
        raise ValueError("coverage must lie between 1 and the number of rows")
    spark = rows.sparkSession
    places = spark.range(coverage).select(F.col("id").alias(rank), F.expr(f"((2 * id + 1) * {total}) div {2 * coverage}").alias("position"))
    # the k-th free place lies behind k free ones and the places taken before it
    free = spark.range(total).select(F.col("id").alias("position")).join(places.select("position"), "position", "left_anti").withColumn("__g", F.floor(F.col("position") / 4096))
    free = global_rank(free, "__g", [F.col("position")], "__k").select((F.col("__k") + coverage).cast("bigint").alias(rank), "position")
    return rows.join(places.union(free), rank)


def pulsed(spark: SparkSession, cycle: list[str], sizes: dict[str, int], pulse: str, period: int, length: int, start: int, stop: int) -> DataFrame:
    """(ordinal, source, index, epoch): a replay window in which the last ``length`` of every ``period`` draws come from a pulse source, and the others go on with the cycle where it was."""
    if not 0 < length < period or pulse not in sizes:
        raise ValueError("a pulse must be shorter than its period, and its source have a size")
    rows = spark.range(start, stop).select(F.col("id").alias("ordinal"), F.expr(f"id div {period}").alias("p"), (F.col("id") % period).alias("at"))
    inside = F.col("at") >= period - length
    rows = rows.withColumn("k", F.when(inside, F.col("p") * length + F.col("at") - (period - length)).otherwise(F.col("p") * (period - length) + F.col("at")))
    pulses = rows.where(inside).select("ordinal", F.lit(pulse).alias("source"), (F.col("k") % sizes[pulse]).alias("index"), F.floor(F.col("k") / sizes[pulse]).alias("epoch"))
    plain = rows.where(~inside).select("ordinal", "k")
    last = -(-stop // period) * (period - length)
    base = replay_window(spark, cycle, sizes, 0, max(1, last)).withColumnRenamed("ordinal", "k")
    return plain.join(base, "k").select("ordinal", "source", "index", "epoch").unionByName(pulses)
