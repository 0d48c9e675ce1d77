"""Grouped metrics: rates, floors, percentiles, deadlines, bootstrap intervals, paired comparisons."""

from __future__ import annotations

import hashlib
import math
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(condition: Column, of: Column | None = None) -> Column:
    """The share of rows that meet a condition among those that meet ``of``; null without any."""
    of = F.lit(True) if of is None else of
    return F.try_divide(F.count_if(condition & of).cast("double"), F.count_if(of))


def macro_rate(rows: DataFrame, unit: str, condition: Column) -> DataFrame:
    """The mean over units of each unit's rate: repeated prompts count once."""
    return rows.groupBy(unit).agg(F.avg(condition.cast("double")).alias("r")).agg(F.avg("r").alias("macro"), F.count(F.lit(1)).alias("units"))


def majority(rows: DataFrame, label: str, group: list[str] | None = None) -> DataFrame:
    """(group, label, n, total, rate): the commonest label, ties by name."""
    group = group or []
    counts = rows.groupBy(*group, label).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(label))).alias("top"), F.sum("n").alias("total"))
    return best.select(*group, F.col(f"top.{label}").alias(label), (-F.col("top.n")).alias("n"), "total", (-F.col("top.n") / F.col("total")).alias("rate"))


def ambiguity(rows: DataFrame, observation: str, gold: str) -> DataFrame:
    """(groups, rows, ambiguous): repeated observations, and those with more than one answer."""
    groups = rows.groupBy(observation).agg(F.count(F.lit(1)).alias("n"), F.min(gold).alias("a"), F.max(gold).alias("b")).where("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("a") != F.col("b")).alias("ambiguous"))


def nearest_rank(rows: DataFrame, value: str, percents: tuple[int, ...]) -> DataFrame:
    """One column for each percent: the smallest value with at least that share of rows at or below it."""
    kind = rows.schema[value].dataType
    return rows.agg(*(F.expr(f"percentile_disc({p / 100}) within group (order by {value})").cast(kind).alias(f"p{p}") for p in percents))


def latency_summary(rows: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """Count, extremes, mean and linearly interpolated percentiles."""
    columns = [F.count(value).alias("count"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max")]
    columns += [F.percentile(value, q).alias(f"p{round(q * 100)}") for q in (0.5, 0.9, 0.95, 0.99)]
    return rows.groupBy(*(group or [])).agg(*columns)


def success_at(rows: DataFrame, value: str, useful: Column, deadlines: tuple[float, ...], group: list[str] | None = None) -> DataFrame:
    """Per group and deadline: opportunities, on_time, useful, success rate and useful actions a minute (null if nothing was measured)."""
    flat = rows.withColumn("deadline", F.explode(F.array(*map(F.lit, deadlines))))
    hit = F.col(value) <= F.col("deadline")
    out = flat.groupBy(*(group or []), "deadline").agg(F.count(F.lit(1)).alias("opportunities"), F.count_if(hit).alias("on_time"), F.count_if(hit & useful).alias("useful"), F.sum(value).alias("__ms"))
    return out.withColumn("success", F.col("useful") / F.col("opportunities")).withColumn("per_minute", F.try_divide(F.col("useful").cast("double"), F.col("__ms") / 60000.0)).drop("__ms")


def ratio_of_sums(rows: DataFrame, top: str, bottom: str, group: str) -> DataFrame:
    """(group, ratio) and the overall ratio in the row whose group is null."""
    return rows.groupingSets([[group], []], group).agg(F.try_divide(F.sum(top), F.sum(bottom)).alias("ratio"), F.count(F.lit(1)).alias("n"))


#: Parts in which rows are resampled; more rows make larger parts.
PARTS = 64


def resampled_sums(rows: DataFrame, key: str, columns: list[str], *, replicates: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """(by, replicate, columns): sums over as many rows as there are, drawn with replacement, for each replicate.

    Exact draws in parallel: how many of the n draws fall into each part of the rows follows one multinomial draw, which every task makes alike from the parts' sizes; inside a part its
    draws are uniform. Parts go by a hash of the key and are sorted by it, so the result depends on neither order nor partitioning. A null counts as 0. Repeated keys are rows of
    their own. No rows give no replicates.
    """
    by = by or []
    rows = rows.select(*by, F.col(key).cast("string").alias("__key"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("__key"), F.lit(PARTS)).cast("int"))
    sizes: dict[tuple, list[int]] = {}
    for r in rows.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes.setdefault(tuple(r[k] for k in by), [0] * PARTS)[r["__part"]] = r["n"]

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        group, part = tuple(pdf[k].iloc[0] for k in by), int(pdf["__part"].iloc[0])
        words = [seed & 0xFFFFFFFF, *hashlib.sha256(repr(group).encode()).digest()[:8]]
        own = np.array(sizes[group], np.int64)
        n_draws = np.random.default_rng(words).multinomial(own.sum(), own / own.sum(), size=replicates)[:, part]
        values = pdf.sort_values(["__key", *columns])[columns].to_numpy(np.float64)
        chance, out = np.random.default_rng([*words, part]), np.zeros((replicates, len(columns)))
        step = max(1, 2_000_000 // max(1, len(values)))
        for i in range(0, replicates, step):
            counts = n_draws[i : i + step]
            total = np.vstack([np.zeros(len(columns)), np.cumsum(values[chance.integers(0, len(values), counts.sum())], axis=0)])
            ends = np.cumsum(counts)
            out[i : i + step] = total[ends] - total[ends - counts]
        made = {k: [pdf[k].iloc[0]] * replicates for k in by} | {"replicate": np.arange(replicates)} | {c: out[:, j] for j, c in enumerate(columns)}
        return pd.DataFrame(made)

    kind = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in by), "replicate bigint", *(f"{c} double" for c in columns)])
    parts = rows.groupBy(*by, "__part").applyInPandas(draw, kind)
    return parts.groupBy(*by, "replicate").agg(*(F.sum(c).alias(c) for c in columns))


def bootstrap_interval(rows: DataFrame, cluster: str, value: str, *, replicates: int = 10_000, seed: int = 0, group: str | None = None) -> DataFrame:
    """(estimate, lower, upper, clusters): 95 % percentile interval of the mean over clusters of their mean value, whole clusters drawn again. Clusters without a value don't count."""
    by = [group] if group else []
    means = rows.groupBy(*by, cluster).agg(F.avg(value).alias("m")).where("m is not null").withColumn("one", F.lit(1.0))
    drawn = resampled_sums(means, cluster, ["m", "one"], replicates=replicates, seed=seed, by=by).withColumn("v", F.col("m") / F.col("one"))
    interval = drawn.groupBy(*by).agg(F.percentile("v", 0.025).alias("lower"), F.percentile("v", 0.975).alias("upper"))
    found = means.groupBy(*by).agg(F.avg("m").alias("estimate"), F.count(F.lit(1)).alias("clusters"))
    out = found.join(interval, by) if by else found.crossJoin(interval)
    return out.select(*by, "estimate", "lower", "upper", "clusters")


def paired_interval(baseline: DataFrame, candidate: DataFrame, cluster: str, value: str, *, replicates: int = 10_000, seed: int = 0) -> DataFrame:
    """(baseline, candidate, estimate, lower, upper, clusters): the interval of the mean over clusters of candidate minus baseline, each cluster drawn for both arms at once. Other
    clusters, or other numbers of values in a cluster, on one side are an error at run time."""
    a, b = (x.groupBy(cluster).agg(F.avg(value).alias(n), F.count(value).alias(f"n_{n}")) for x, n in ((baseline, "a"), (candidate, "b")))
    both = a.join(b, cluster, "full_outer")
    uneven = ~F.col("n_a").eqNullSafe(F.col("n_b"))
    both = both.withColumn("m", F.when(uneven, F.raise_error(F.lit("the arms differ in clusters or in values of a cluster")).cast("double")).otherwise(F.col("b") - F.col("a")))
    out = bootstrap_interval(both.select(cluster, "m"), cluster, "m", replicates=replicates, seed=seed)
    return both.agg(F.avg("a").alias("baseline"), F.avg("b").alias("candidate")).crossJoin(out)


#: Ratios of sums over documents: numerator, denominator, factor, and whether more is better.
DOCUMENT_RATIOS = {"cross_entropy": ("nll_nats", "tokens", 1.0, False), "bits_per_byte": ("nll_nats", "utf8_bytes", 1 / math.log(2), False), "top1": ("correct_tokens", "tokens", 1.0, True)}


def document_scores(rows: DataFrame, group: str | None = None) -> DataFrame:
    """(group, documents, tokens, utf8_bytes, cross_entropy, bits_per_byte, top1) of (tokens, utf8_bytes, nll_nats, correct_tokens), by group and, with a null group, overall.

    Ratios of sums; null without tokens or bytes."""
    ratios = [F.try_divide(F.sum(top) * F.lit(f), F.sum(bottom)).alias(n) for n, (top, bottom, f, _) in DOCUMENT_RATIOS.items()]
    columns = [F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.sum("utf8_bytes").alias("utf8_bytes"), *ratios]
    return rows.groupingSets([[group], []], group).agg(*columns) if group else rows.agg(*columns)


def paired_documents(left: DataFrame, right: DataFrame, key: str, *, replicates: int = 10_000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """(metric, estimate, lower, upper, wins, losses, ties): left minus right for each of DOCUMENT_RATIOS, documents drawn for both arms at once; wins, losses and ties are shares of
    the replicates that favour left, right and neither. Arms must have the same keys, each once, tokens and bytes; anything else is an error at run time."""
    own = ["tokens", "utf8_bytes", "nll_nats", "correct_tokens"]
    a, b = (x.groupBy(key).agg(F.count(F.lit(1)).alias(f"{n}_n"), *(F.first(c).alias(f"{n}_{c}") for c in own)) for x, n in ((left, "l"), (right, "r")))
    both = a.join(b, key, "full_outer")
    uneven = ~((F.col("l_n") == 1) & (F.col("r_n") == 1) & (F.col("l_tokens") == F.col("r_tokens")) & (F.col("l_utf8_bytes") == F.col("r_utf8_bytes")))
    checked = F.when(F.coalesce(uneven, F.lit(True)), F.raise_error(F.lit("the arms aren't aligned")).cast("double"))
    deltas = both.select(key, checked.otherwise(F.col("l_tokens")).alias("tokens"), F.col("l_utf8_bytes").alias("utf8_bytes"), (F.col("l_nll_nats") - F.col("r_nll_nats")).alias("nll_nats"), (F.col("l_correct_tokens") - F.col("r_correct_tokens")).alias("correct_tokens"))
    metrics = F.array(*(F.struct(F.lit(n).alias("metric"), (F.col(top) * F.lit(f) / F.col(bottom)).alias("v"), F.lit(1 if up else -1).alias("sign")) for n, (top, bottom, f, up) in DOCUMENT_RATIOS.items()))
    flat = lambda df: df.select(F.explode(metrics).alias("m")).select("m.*")
    estimate = flat(deltas.agg(*(F.sum(c).alias(c) for c in own))).select("metric", F.col("v").alias("estimate"))
    tail = (1 - confidence) / 2
    good = F.signum("v") * F.col("sign")
    share = lambda c: F.avg(c.cast("double"))
    drawn = flat(resampled_sums(deltas, key, own, replicates=replicates, seed=seed)).groupBy("metric")
    spread = drawn.agg(F.percentile("v", tail).alias("lower"), F.percentile("v", 1 - tail).alias("upper"), share(good > 0).alias("wins"), share(good < 0).alias("losses"), share(good == 0).alias("ties"))
    return estimate.join(spread, "metric")


def paired(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(n, mean_delta, wins, ties): two arms aligned by key; a key on one side only is an error at run time."""
    both = left.select(key, F.col(value).alias("a")).join(right.select(key, F.col(value).alias("b")), key, "full_outer")
    delta = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a key has one arm only"))).otherwise(F.col("b") - F.col("a")).cast("double")
    return both.select(delta.alias("d")).agg(F.count("d").alias("n"), F.avg("d").alias("mean_delta"), F.avg(F.when(F.col("d") > 0, 1.0).otherwise(0.0)).alias("wins"), F.avg(F.when(F.col("d") == 0, 1.0).otherwise(0.0)).alias("ties"))


def sign_test(wins: int, losses: int) -> float:
    """Two-sided exact binomial p-value; 1 without decided pairs."""
    n = wins + losses
    return min(1.0, 2 * sum(comb(n, k) for k in range(min(wins, losses) + 1)) / 2**n) if n else 1.0


def t_critical(freedom: int, confidence: float = 0.95) -> float:
    """The two-sided critical value of Student's t, by bisection over its integrated density."""
    scale = math.exp(math.lgamma((freedom + 1) / 2) - math.lgamma(freedom / 2)) / math.sqrt(freedom * math.pi)

    def inside(t: float) -> float:
        # the density over [0, t] by u = atan(x / sqrt(freedom)): a smooth integrand on a bounded interval
        u = np.linspace(0, math.atan(t / math.sqrt(freedom)), 20_001)
        y = scale * math.sqrt(freedom) * np.cos(u) ** (freedom - 1)
        return 2 * float((y[:-1] + y[1:]).sum() / 2 * (u[1] - u[0]))

    low, high = 0.0, 1e6
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if inside(middle) < confidence else (low, middle)
    return (low + high) / 2


def seed_summary(rows: DataFrame, value: str, group: list[str]) -> DataFrame:
    return rows.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("sd"), F.try_divide(F.stddev_samp(value), F.sqrt(F.count(value).cast("double"))).alias("se"))


def seed_deltas(left: DataFrame, right: DataFrame, seed: str, value: str, group: list[str], *, higher_is_better: bool = True) -> DataFrame:
    """Per group, of left minus right by seed: n, mean, median, sd, se, the t interval (lower, upper), wins, losses, ties and the two-sided sign test. A seed on one side only is an error."""
    keys = [*group, seed]
    both = left.select(*keys, F.col(value).alias("a")).join(right.select(*keys, F.col(value).alias("b")), keys, "full_outer")
    delta = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a seed has one arm only")).cast("double")).otherwise(F.col("a") - F.col("b"))
    both = both.withColumn("d", delta).withColumn("good", F.signum("d") * (1 if higher_is_better else -1))
    out = seed_summary(both, "d", group).join(both.groupBy(*group).agg(F.count_if(F.col("good") > 0).alias("wins"), F.count_if(F.col("good") < 0).alias("losses"), F.count_if(F.col("good") == 0).alias("ties")), group)
    # as many values as there are numbers of seeds
    sizes = sorted({r.n for r in out.select("n").distinct().collect() if r.n > 1})
    critical = F.create_map(*(F.lit(x) for n in sizes for x in (n, t_critical(n - 1)))) if sizes else F.lit(None).cast("map<bigint,double>")
    margin = F.try_element_at(critical, F.col("n")) * F.col("se")
    tested = sorted({(r.wins, r.losses) for r in out.select("wins", "losses").distinct().collect()})
    p_value = F.lit(None).cast("double")
    for w, l in tested:
        p_value = F.when((F.col("wins") == w) & (F.col("losses") == l), F.lit(sign_test(w, l))).otherwise(p_value)
    return out.withColumn("lower", F.col("mean") - margin).withColumn("upper", F.col("mean") + margin).withColumn("p_value", p_value)


def floors(tasks: DataFrame, *, observation: str = "observation", name: str = "gold_name", arguments: str = "gold_arguments") -> DataFrame:
    """What answers without understanding would score: rows, majority (the commonest name), constant (that name without arguments), no_arguments, derivability (argument values that stand in the
    observation), reachable (the best answer for each distinct observation) and fully_derivable. arguments is JSON text or null."""
    values = F.map_values(F.from_json(F.coalesce(F.col(arguments), F.lit("{}")), "map<string,string>"))
    rows = tasks.select(F.col(observation).alias("o"), F.col(name).alias("gold"), F.coalesce(F.col(arguments), F.lit("{}")).alias("a"), values.alias("v"))
    rows = rows.withColumn("hits", F.size(F.filter("v", lambda x: F.contains(F.lower("o"), F.lower(x)))))
    top = majority(rows, "gold").select(F.col("gold").alias("top"), F.col("rate").alias("majority"), F.lit(1).alias("k"))
    best = majority(rows.withColumn("answer", F.concat_ws("\x1f", "gold", "a")).withColumn("key", F.sha1("o")), "answer", ["key"]).agg(F.sum("n").alias("reachable"))
    every = F.count(F.lit(1))
    # the commonest name is one row
    rows = rows.join(F.broadcast(top), F.lit(1) == F.col("k"))
    out = rows.agg(
        every.alias("rows"), F.first("majority").alias("majority"), (F.count_if((F.col("gold") == F.col("top")) & (F.size("v") == 0)) / every).alias("constant"), (F.count_if(F.size("v") == 0) / every).alias("no_arguments"),
        F.try_divide(F.sum("hits").cast("double"), F.sum(F.size("v"))).alias("derivability"), (F.count_if(F.col("hits") == F.size("v")) / every).alias("fully_derivable"),
    )
    return out.crossJoin(best).withColumn("reachable", F.col("reachable") / F.col("rows"))


def rates_and_clean(outcomes: DataFrame, leaked: Column, rates: dict[str, Column]) -> DataFrame:
    """(subset, rows, leaked_rows, rates): over all rows, and over the clean ones, that is those that aren't leaked. A clean subset without rows has null rates, not zeros."""
    flat = outcomes.withColumn("__leaked", F.coalesce(leaked, F.lit(False)))
    flat = flat.withColumn("subset", F.explode(F.when(F.col("__leaked"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("clean")))))
    found = flat.groupBy("subset").agg(F.count(F.lit(1)).alias("rows"), *(rate(c).alias(n) for n, c in rates.items()))
    total = outcomes.agg(F.count_if(F.coalesce(leaked, F.lit(False))).alias("leaked_rows"))
    names = outcomes.sparkSession.createDataFrame([("all",), ("clean",)], "subset string")
    out = names.join(found, "subset", "left").crossJoin(total)
    return out.select("subset", F.coalesce("rows", F.lit(0)).alias("rows"), "leaked_rows", *rates)


def multiset_overlap(left: DataFrame, right: DataFrame, key: str, item: str) -> DataFrame:
    """(predicted, reference, shared, precision, recall, f1): items per key compared with repeats, summed over keys."""
    a = left.groupBy(key, item).agg(F.count(F.lit(1)).alias("p"))
    b = right.groupBy(key, item).agg(F.count(F.lit(1)).alias("r"))
    both = a.join(b, [key, item], "full_outer").select(F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("r", F.lit(0)).alias("r"))
    out = both.agg(F.sum("p").alias("predicted"), F.sum("r").alias("reference"), F.sum(F.least("p", "r")).alias("shared"))
    out = out.withColumn("precision", F.try_divide(F.col("shared"), F.col("predicted"))).withColumn("recall", F.try_divide(F.col("shared"), F.col("reference")))
    return out.withColumn("f1", F.try_divide(2 * F.col("shared"), F.col("predicted") + F.col("reference")))


def coverage(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(duplicates, missing, unexpected) of case keys."""
    counts = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    both = expected.select(*keys).distinct().withColumn("e", F.lit(1)).join(counts, keys, "full_outer")
    return both.agg(F.count_if(F.col("n") > 1).alias("duplicates"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected"))


def by_category(rows: DataFrame, categories: str, value: str, *, unless: dict[str, list[str]] | None = None) -> DataFrame:
    """Each row counts in all of its categories and in ALL_CATEGORIES; in a category of ``unless`` only if it has none of the categories named there."""
    own = F.array_distinct(categories)
    for skipped, others in (unless or {}).items():
        own = F.when(F.arrays_overlap(categories, F.array(*map(F.lit, others))), F.array_remove(own, skipped)).otherwise(own)
    flat = rows.withColumn("category", F.explode(F.array_append(own, "ALL_CATEGORIES")))
    return flat.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.avg((F.col(value) == 1).cast("double")).alias("exact"))


def suite_report(results: DataFrame, expected: DataFrame, *, suite: str, case: str, value: str, failed: Column | None = None, group: list[str] | None = None) -> DataFrame:
    """Per suite (and group): cases, mean and exact share of the value (1 is a success), failures, and how the cases found compare with the expected (suite, case): duplicates, missing, unexpected
    and ``status``: complete, or incomplete. A suite without results has no mean; one that isn't expected is incomplete."""
    keys, by = [suite, case], [suite, *(group or [])]
    counts = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    both = expected.select(*keys).distinct().withColumn("__e", F.lit(True)).join(counts, keys, "full_outer")
    cover = both.groupBy(suite).agg(F.count_if(F.col("__n") > 1).alias("duplicates"), F.count_if(F.col("__n").isNull()).alias("missing"), F.count_if(F.col("__e").isNull()).alias("unexpected"))
    broken = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    scores = results.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), F.avg(value).alias("mean"), F.avg((F.col(value) == 1).cast("double")).alias("exact"), F.count_if(broken).alias("failures"))
    out = cover.join(scores, suite, "left").withColumn("cases", F.coalesce("cases", F.lit(0))).withColumn("failures", F.coalesce("failures", F.lit(0)))
    return out.withColumn("status", F.when(F.col("duplicates") + F.col("missing") + F.col("unexpected") == 0, "complete").otherwise("incomplete"))


def retrieval_by_size(rows: DataFrame, rank: str, size: str, correct: Column, ks: tuple[int, ...] = (1, 4, 8, 16, 32)) -> DataFrame:
    """retrieval() for each catalog size, and the share of rows whose whole answer is right."""
    whole = rows.groupBy(size).agg(rate(correct).alias("end_to_end"))
    return retrieval(rows, rank, ks, [size]).join(whole, size)


def selection_and_arguments(outcomes: DataFrame, selected: Column, arguments: Column, group: list[str] | None = None) -> DataFrame:
    """(rows, selection, arguments_given_selection, both): whether the right function was chosen, and its arguments right where it was."""
    every = F.count(F.lit(1)).alias("rows")
    return outcomes.groupBy(*(group or [])).agg(every, rate(selected).alias("selection"), rate(arguments, selected).alias("arguments_given_selection"), rate(selected & arguments).alias("both"))


def text_similarity(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """1 - edit distance / longer length; 0 below the threshold, 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    score = F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)
    return F.when(score >= threshold, score).otherwise(0.0)


def point_similarity(x: Column, y: Column, gx: Column, gy: Column, near: float, scale: float) -> Column:
    """1 within ``near`` of the goal, then exponential decay."""
    d = F.hypot(x - gx, y - gy)
    return F.when(d <= near, F.lit(1.0)).otherwise(F.exp(-(d - near) / scale))


def error_bucket(predicted: Column, gold: Column, catalog: Column) -> Column:
    """parse_fail, correct_name, wrong_in_catalog or out_of_catalog; without a catalog every wrong name counts as inside."""
    inside = F.when(catalog.isNull() | (F.size(catalog) == 0), F.lit(True)).otherwise(F.array_contains(catalog, predicted))
    return F.when(predicted.isNull(), "parse_fail").when(predicted == gold, "correct_name").when(inside, "wrong_in_catalog").otherwise("out_of_catalog")


def retrieval(rows: DataFrame, rank: str, ks: tuple[int, ...] = (1, 4, 8, 16, 32), group: list[str] | None = None) -> DataFrame:
    """Recall at each k and mean reciprocal rank; a null rank is a miss."""
    hits = [F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks]
    return rows.groupBy(*(group or [])).agg(F.count(F.lit(1)).alias("n"), *hits, F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0))).alias("mrr"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """(value, n) of a scalar or list column, commonest first."""
    many = rows.schema[column].dataType.typeName() == "array"
    flat = rows.select(F.explode(column).alias("value") if many else F.col(column).alias("value"))
    return flat.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value")
