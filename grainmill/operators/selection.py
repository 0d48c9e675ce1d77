"""Splits, caps, budgets, weights, deterministic orders and samples. Where a job would draw at random, rows are ordered by a hash of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainmill.functions import text as X
from grainmill.operators import graphs
from grainmill.operators.ranking import global_rank, hash_group


def seeded(seed: int | str, key: Column) -> Column:
    """The hash that stands for a seeded shuffle's order."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def identity(key: Column) -> Column:
    return F.sha2(key.cast("string"), 256)


def validation_size(n: Column, fraction: float) -> Column:
    """Half-to-even rounding, at least one and at most all but one; none of a single document or at fraction 0."""
    size = F.greatest(F.lit(1), F.least(n - 1, F.bround(n * F.lit(fraction)).cast("bigint")))
    return F.when((n > 1) & F.lit(fraction > 0), size).otherwise(F.lit(0)).cast("bigint")


def split_documents(docs: DataFrame, fraction: float, seed: int, *, key: str = "doc_id") -> DataFrame:
    """(key, identity, split): exactly the wanted number of identities, the smallest by seeded hash, go to val."""
    if not 0 <= fraction < 1:
        raise ValueError("fraction must lie in [0, 1)")
    ids = docs.select(identity(F.col(key)).alias("identity")).distinct()
    ids = ids.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("identity")), 256))
    n = ids.count()
    ranked = global_rank(ids.withColumn("g", hash_group(F.col("h"), n)), "g", [F.col("h"), F.col("identity")])
    chosen = ranked.select("identity", F.when(F.col("rank") < validation_size(F.lit(n).cast("bigint"), fraction), "val").otherwise("train").alias("split"))
    return docs.select(F.col(key), identity(F.col(key)).alias("identity")).join(chosen, "identity").select(key, "identity", "split")


def frozen_split(docs: DataFrame, assignments: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Joins an earlier assignment on (hash of id, hash of text). A document without one, or an id in two splits, is an error at run time."""
    known = assignments.groupBy("identity", "document_sha256").agg(F.min("split").alias("split"), F.max("split").alias("other"))
    rows = docs.withColumn("identity", identity(F.col(key))).withColumn("document_sha256", F.sha2(F.col("text"), 256))
    out = rows.join(known, ["identity", "document_sha256"], "left")
    checked = F.when(F.col("split").isNull(), F.raise_error(F.lit("a document has no assignment"))).when(F.col("split") != F.col("other"), F.raise_error(F.lit("an id is in two splits"))).otherwise(F.col("split"))
    return out.withColumn("split", checked.cast("string")).drop("other")


def cap_per_group(rows: DataFrame, group: str, cap: int, seed: int, *, key: str) -> DataFrame:
    """At most ``cap`` rows of each group, the first by seeded hash. Hash intervals are cut first, so that a large group is many tasks."""
    h = seeded(seed, F.col(key))
    part = W.partitionBy(group, F.substring("__h", 1, 2)).orderBy("__h")
    first = rows.withColumn("__h", h).withColumn("__n", F.row_number().over(part)).where(F.col("__n") <= cap)
    return first.withColumn("__n", F.row_number().over(W.partitionBy(group).orderBy("__h"))).where(F.col("__n") <= cap).drop("__h", "__n")


def within_budget(rows: DataFrame, group: str, amount: str, budget: Column, seed: int, *, key: str) -> DataFrame:
    """Rows of each group in seeded order until the budget is reached; the row that crosses it is kept."""
    n = rows.count()
    ordered = rows.withColumn("__h", seeded(seed, F.col(key))).withColumn("__g", hash_group(F.col("__h"), n))
    ordered = global_rank(ordered, "__g", [F.col("__h")], "used", by=[group], amount=amount)
    return ordered.where(F.col("used") < budget).drop("__h", "__g")


def apportion(rows: DataFrame, target: int, *, weight: str = "weight", order: str = "position") -> DataFrame:
    """Adds ``budget``: shares of ``target`` rounded down, and one more for the largest remainders, ties by order. Weights are integers; exact."""
    rows = rows.withColumn("__floor", F.expr(f"{target} * {weight} div sum({weight}) over ()"))
    rows = rows.withColumn("__rest", F.expr(f"{target} * {weight} % sum({weight}) over ()"))
    rows = rows.withColumn("__more", F.lit(target) - F.sum("__floor").over(W.partitionBy()))
    turn = F.row_number().over(W.orderBy(F.col("__rest").desc(), F.col(order)))
    return rows.withColumn("budget", F.col("__floor") + F.when(turn <= F.col("__more"), 1).otherwise(0)).drop("__floor", "__rest", "__more")


def shares(rows: DataFrame, amount: str, how: str = "sqrt") -> DataFrame:
    """Adds ``share``: proportional to the amount, its square root, or a given weight."""
    value = F.sqrt(F.col(amount).cast("double")) if how == "sqrt" else F.col(amount).cast("double")
    return rows.withColumn("__v", value).withColumn("share", F.col("__v") / F.sum("__v").over(W.partitionBy())).drop("__v")


def weighted_draw(draws: DataFrame, table: DataFrame, seed: int, *, draw: str = "draw", name: str = "source", share: str = "share") -> DataFrame:
    """(draw, source): a hash of seed and draw number as a uniform number, looked up in the cumulated shares of a small table."""
    upper = F.sum(share).over(W.orderBy(name))
    table = table.select(name, upper.alias("hi")).withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy(name)), F.lit(0.0)))
    last = F.lead("hi").over(W.orderBy(name)).isNull()
    table = table.withColumn("hi", F.when(last, F.lit(2.0)).otherwise(F.col("hi")))
    u = X.hash_prefix(F.concat(F.lit(f"{seed}:"), F.col(draw).cast("string"))) / F.lit(float(1 << 32))
    return draws.withColumn("__u", u).join(F.broadcast(table), (F.col("__u") >= F.col("lo")) & (F.col("__u") < F.col("hi"))).select(draw, name)


def scheduled_mixture(start: list[float], end: list[float], steps: int, amounts: list[float]) -> Column:
    """The source chosen at each of ``steps`` steps: weights go linearly from start to end, the source with the largest deficit is next, ties by
    position; a chosen source is charged its amount. One fold over the steps, as an array of positions."""
    sizes = range(len(start))
    zero = F.struct(F.array().cast("array<int>").alias("chosen"), F.array(*(F.lit(0.0) for _ in sizes)).alias("used"), F.array(*(F.lit(0.0) for _ in sizes)).alias("due"))

    def step(acc, t):
        f = t.cast("double") / F.lit(float(max(1, steps - 1)))
        weights = [F.lit(a) + (F.lit(b) - F.lit(a)) * f for a, b in zip(start, end, strict=True)]
        total = sum(weights[1:], weights[0])
        mean = F.lit(sum(amounts) / len(amounts))
        due = F.array(*(acc["due"][k] + w / total * mean for k, w in enumerate(weights)))
        deficit = F.transform(due, lambda d, k: F.struct((d - acc["used"][k]).alias("v"), (-k).alias("k")))
        best = -F.array_max(deficit)["k"]
        charged = F.transform(acc["used"], lambda u, k: u + F.when(k == best, F.element_at(F.array(*map(F.lit, amounts)), best + 1)).otherwise(F.lit(0.0)))
        return F.struct(F.concat(acc["chosen"], F.array(best)).alias("chosen"), charged.alias("used"), due.alias("due"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), zero, step, lambda acc: acc["chosen"])


def first_of_each(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The smallest row of each group, by aggregation."""
    return rows.groupBy(*group).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("row")).select("row.*")


def quota_order(rows: DataFrame, stratum: list[str], digest: str) -> DataFrame:
    """Adds ``position``: one row of every stratum first, rare strata before common ones, then the rest interleaved at centred quantiles. A stratum is ranked by intervals of its digests, whatever its size."""
    label = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in stratum)), 256)
    n = rows.count()
    rows = rows.withColumn("__s", label).withColumn("__g", hash_group(F.col(digest), n))
    sizes = rows.groupBy("__s").agg(F.count(F.lit(1)).alias("__n"))
    rows = global_rank(rows, "__g", [F.col(digest)], "__k", by=["__s"]).join(sizes, "__s")
    quantile = F.when(F.col("__k") == 0, F.lit(-1.0)).otherwise((2 * F.col("__k") - 1) / (2.0 * (F.col("__n") - 1)))
    tie = F.when(F.col("__k") == 0, F.col("__s")).otherwise(F.sha2(F.concat_ws("|", "__s", digest), 256))
    rows = rows.withColumn("__q", quantile).withColumn("__t", tie).withColumn("__size", F.when(F.col("__k") == 0, F.col("__n")).otherwise(0))
    rows = rows.withColumn("__g", F.floor(F.col("__q") * max(256, n // 4096)))
    return global_rank(rows, "__g", [F.col("__q"), F.col("__size"), F.col("__t"), F.col(digest)], "position").drop("__n", "__k", "__s", "__q", "__t", "__size", "__g")


def spread_positions(total: int, count: int) -> Column:
    """floor((2 i + 1) total / (2 count)) for i below count."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor((2 * i + 1) * total / F.lit(2 * count)).cast("bigint"))


def balanced(rows: DataFrame, bucket: str, order: list[str], limit: int) -> DataFrame:
    """Round robin over buckets in hash order, each bucket in its own order, ``limit`` rows in all. A bucket's first rows are found in parts, then among these."""
    part = W.partitionBy(bucket, "__p").orderBy(*order)
    first = rows.withColumn("__p", F.pmod(F.xxhash64(*order), F.lit(64))).withColumn("turn", F.row_number().over(part)).where(F.col("turn") <= limit)
    first = first.withColumn("turn", F.row_number().over(W.partitionBy(bucket).orderBy(*order))).where(F.col("turn") <= limit)
    return first.withColumn("__b", F.sha2(F.col(bucket).cast("string"), 256)).orderBy("turn", "__b").limit(limit).drop("__b", "__p")


def select_files(files: DataFrame, seed: int, k: int, path: str = "path") -> DataFrame:
    """k files, the first by the hash of seed and path: a sampling operator."""
    return files.orderBy(seeded(seed, F.col(path)), path).limit(k)


def curriculum(rows: DataFrame, score: str, prompt: str, target: str) -> DataFrame:
    """Adds ``position``: easy rows first, ties by SHA-1 of target, NUL and prompt. Rows of one score are ranked by intervals of that hash."""
    rows = rows.withColumn("__t", F.sha1(F.concat(F.col(target), F.lit("\0"), F.col(prompt))))
    rows = rows.withColumn("__g", F.struct(F.col(score).alias("s"), hash_group(F.col("__t"), rows.count()).alias("h")))
    return global_rank(rows, "__g", [F.col("__t")], "position").drop("__t", "__g")


def difficulty(prompt: Column, target: Column, tools: Column) -> Column:
    """How hard a decision is: calls in its target, longer prompts and larger catalogs count; plain text is easiest."""
    calls = F.regexp_count(target, F.lit("<tool_call>"))
    return calls * 4 + F.log2(1 + F.length(prompt) / 256.0) + F.log2(1.0 + F.coalesce(F.size(tools), F.lit(0)))


#: Distinct sets of strata that the driver may hold while it covers them.
COVER_SETS = 100_000


def greedy_cover(rows: DataFrame, key: str, strata: str, limit: int) -> list:
    """Keys that together show every stratum: each time the row with most strata not yet shown, ties by the key's hash; then filled up by hash.

    Rows with the same strata are alike but for their hash, so one row stands for each set of strata, and these sets, which are few by nature, are covered on the driver; more than
    COVER_SETS are an error. Coverage that needs more than ``limit`` rows is one too.
    """
    ranked = rows.select(F.col(key).alias("k"), F.array_sort(F.array_distinct(strata)).alias("s"), F.sha2(F.col(key).cast("string"), 256).alias("h"))
    sets = ranked.groupBy("s").agg(F.min(F.struct("h", "k")).alias("first"))
    found = sets.limit(COVER_SETS + 1).collect()
    if len(found) > COVER_SETS:
        raise ValueError("too many sets of strata")
    left = {r["first"]["h"]: (r["first"]["k"], frozenset(r["s"])) for r in found}
    missing, chosen, taken = frozenset().union(*(s for _, s in left.values())), [], []
    while missing:
        h = min(left, key=lambda h: (-len(left[h][1] & missing), h))
        chosen.append(left[h][0])
        taken.append(h)
        missing -= left.pop(h)[1]
        if len(chosen) > limit:
            raise ValueError("coverage needs more rows than allowed")
    rest = ranked.where(~F.col("h").isin(taken)).orderBy("h").limit(limit - len(chosen))
    return chosen + ([r["k"] for r in rest.select("k").collect()] if limit > len(chosen) else [])


def confirmatory(rows: DataFrame, key: str, *, semantic: str, prompts: str, strata: str, primary: int, confirm: int) -> DataFrame:
    """(key, part): a covering primary selection and, from the rows that share neither its semantic hashes nor any of its prompts (an array of hashes), a covering confirmation."""
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    first = greedy_cover(rows, key, strata, primary)
    chosen = spark.createDataFrame([(k,) for k in first], f"{key} {kind}")
    own = rows.join(F.broadcast(chosen), key)
    # at most ``primary`` rows
    seen_rows, seen_prompts = own.select(semantic).distinct(), own.select(F.explode(prompts).alias("__p")).distinct()
    hit = rows.select(key, F.explode(prompts).alias("__p")).join(F.broadcast(seen_prompts), "__p", "left_semi").select(key).distinct()
    rest = rows.join(F.broadcast(seen_rows), semantic, "left_anti").join(hit, key, "left_anti")
    second = greedy_cover(rest, key, strata, confirm) if rest.limit(1).count() else []
    return spark.createDataFrame([(k, "primary") for k in first] + [(k, "confirm") for k in second], f"{key} {kind}, part string")


def bounded_shuffle(rows: DataFrame, position: str, seed: int, buffer: int) -> DataFrame:
    """Adds ``shuffled``, an order in which no row moves farther than ``buffer`` places: rows change places by hash inside stretches of that many."""
    stretch = F.floor(F.col(position) / buffer)
    turn = F.row_number().over(W.partitionBy("__b").orderBy(seeded(seed, F.col(position)), position))
    return rows.withColumn("__b", stretch).withColumn("shuffled", (F.col("__b") * buffer + turn - 1).cast("bigint")).drop("__b")


def widen(base: DataFrame, extra: DataFrame, guards: DataFrame, *, key: str, prompts: str, size: Column, most: int, cap: int, seed: int) -> DataFrame:
    """The base and at most ``cap`` extra rows, the first by seeded hash, none of whose prompts (an array of hashes) is guarded (prompt) and that fit into ``most``. Rows without prompts don't count as extra. Adds ``added``."""
    flat = extra.select(F.col(key).alias("__k"), F.explode(prompts).alias("prompt"))
    hit = flat.join(guards.select("prompt").distinct(), "prompt", "left_semi").select("__k").distinct()
    fit = extra.where((size <= most) & (F.size(prompts) > 0)).join(hit, F.col(key) == F.col("__k"), "left_anti")
    chosen = fit.orderBy(seeded(seed, F.col(key)), key).limit(cap)
    return base.withColumn("added", F.lit(False)).unionByName(chosen.withColumn("added", F.lit(True)))


def disjoint_groups(rows: DataFrame, key: str, hashes: str, checkpoint) -> DataFrame:
    """(key, root): rows that share a hash, directly or through others, get the smallest hash that any of them has."""
    flat = checkpoint(rows.select(F.col(key).alias("k"), F.explode(hashes).alias("h")).distinct())
    least = flat.groupBy("k").agg(F.min("h").alias("m"))
    roots = graphs.components(flat.join(least, "k").select(F.col("h").alias("a"), F.col("m").alias("b")), checkpoint)
    found = least.join(roots, F.col("m") == F.col("node"), "left")
    return found.select(F.col("k").alias(key), F.coalesce("root", "m").alias("root"))


def group_split(rows: DataFrame, key: str, hashes: str, buckets: int, checkpoint) -> DataFrame:
    """(key, root, split): groups of rows that share prompts are never divided."""
    roots = disjoint_groups(rows, key, hashes, checkpoint)
    number = F.conv(F.substring("root", 1, 8), 16, 10).cast("bigint")
    return roots.withColumn("split", F.when(number % buckets == 0, "eval").otherwise("train"))
