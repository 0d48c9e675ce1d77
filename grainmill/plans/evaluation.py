"""Queries of evaluation: deadlines, percentiles, intervals, floors, retrieval, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.operators import dom, metrics, similarity
from grainmill.sources.tables import table


def _actions(spark: SparkSession, sf: str) -> DataFrame:
    """events as action records: the value is the latency, clicks and purchases are successes, whole values above 1 are valid."""
    rows = table(spark, sf, "events")
    return rows.select("event_id", "user_id", "event_type", F.col("value").alias("ms"), (F.col("event_id") % 3 != 0).alias("success"), (F.col("event_id") % 7 != 0).alias("valid"))


def success_at_deadline(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.success_at(_actions(spark, sf), "ms", F.col("success") & F.col("valid"), (25.0, 50.0, 100.0), ["event_type"])
    return out.withColumn("success", F.round("success", 9)).withColumn("per_minute", F.round("per_minute", 6))


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.latency_summary(_actions(spark, sf), "ms", ["event_type"])
    return out.select("event_type", "count", *(F.round(c, 6).alias(c) for c in ("min", "mean", "max", "p50", "p90", "p95", "p99")))


def nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.nearest_rank(_actions(spark, sf), "ms", (50, 90, 99))


def bootstrap_interval(spark: SparkSession, sf: str) -> DataFrame:
    rows = _actions(spark, sf).withColumn("useful", (F.col("success") & F.col("valid") & (F.col("ms") <= 50)).cast("double"))
    return metrics.bootstrap_interval(rows, "user_id", "useful", replicates=1000, seed=7, group="event_type")


def case_macro(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.macro_rate(_actions(spark, sf), "user_id", F.col("success") & F.col("valid") & (F.col("ms") <= 50))
    return out.select(F.round("macro", 9).alias("macro"), "units")


def suite_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Null where a rate's denominator is empty."""
    rows = _actions(spark, sf)
    out = rows.groupBy("event_type").agg(metrics.rate(F.col("valid")).alias("parsed"), metrics.rate(F.col("success"), F.col("valid")).alias("step"), metrics.rate(F.col("success"), F.col("ms") > 1e12).alias("never"))
    return out.select("event_type", F.round("parsed", 9).alias("parsed"), F.round("step", 9).alias("step"), "never")


def paired_arms(spark: SparkSession, sf: str) -> DataFrame:
    rows = _actions(spark, sf)
    left = rows.where("event_id % 2 = 0").groupBy("event_type").agg(F.avg("ms").alias("ms"))
    right = rows.where("event_id % 2 = 1").groupBy("event_type").agg(F.avg("ms").alias("ms"))
    return metrics.paired(left, right, "event_type", "ms").withColumn("mean_delta", F.round("mean_delta", 6))


def seed_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.seed_summary(_actions(spark, sf), "ms", ["event_type"])
    return out.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "sd", "se")))


def ratio_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of two measures and their ratio per group and in all, as bits per byte are built."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("a"), F.col("l_quantity").cast("double").alias("b"))
    return metrics.ratio_of_sums(rows, "a", "b", "l_returnflag").select("l_returnflag", F.round("ratio", 6).alias("ratio"), "n")


def weighted_loss(spark: SparkSession, sf: str) -> DataFrame:
    """A loss per row, weighted by its tokens: discount and quantity stand for them."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_discount").cast("double").alias("loss"), F.col("l_quantity").cast("double").alias("tokens"))
    return rows.groupBy("source").agg(F.round(F.try_divide(F.sum(F.col("loss") * F.col("tokens")), F.sum("tokens")), 9).alias("loss"))


def quality_label_floor(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return metrics.majority(rows, "quality", ["lang"])


def chance_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """The mean of one over each document's number of candidate sources in its language."""
    docs = table(spark, sf, "documents")
    sizes = docs.groupBy("lang").agg(F.countDistinct("source").alias("k"))
    return docs.join(F.broadcast(sizes), "lang").agg(F.round(F.avg(1.0 / F.col("k")), 9).alias("chance"), F.min("k").alias("least"), F.max("k").alias("most"))


def multiset_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Event types of even events against those of odd ones, by user."""
    rows = table(spark, sf, "events")
    out = metrics.multiset_overlap(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "user_id", "event_type")
    return out.select("predicted", "reference", "shared", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def coverage_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_type")
    return metrics.coverage(rows.where("user_id % 3 <> 0"), rows.where("user_id % 5 <> 0"), ["user_id", "event_type"])


def category_means(spark: SparkSession, sf: str) -> DataFrame:
    rows = _actions(spark, sf).select(F.array("event_type", F.when(F.col("valid"), "valid").otherwise("invalid")).alias("c"), F.col("success").cast("double").alias("v"))
    return metrics.by_category(rows, "c", "v").select("category", "n", F.round("mean", 9).alias("mean"), F.round("exact", 9).alias("exact"))


def error_buckets(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_type", F.lag("event_type").over(_by_user()).alias("said"), F.array(F.lit("view"), F.lit("click")).alias("catalog"))
    return rows.groupBy(metrics.error_bucket(F.col("said"), F.col("event_type"), F.col("catalog")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _by_user():
    from pyspark.sql.window import Window

    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def text_similarity(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "benchmark").withColumn("text", F.regexp_replace("text", "[^ -~]", ""))
    rows = rows.select("item_id", F.substring("text", 1, 40).alias("a"), F.substring("text", 3, 40).alias("b"))
    return rows.select("item_id", F.round(metrics.text_similarity(F.col("a"), F.col("b"), 0.5), 6).alias("score"))


def text_similarity_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts, each with a variant of its own: each e before a letter from a to m is lost with it, and the end is another."""
    rows = table(spark, sf, "benchmark").withColumn("a", F.regexp_replace("text", "[^ -~]", ""))
    rows = rows.withColumn("b", F.concat(F.regexp_replace("a", "e[a-m]", ""), F.lit(" and so on")))
    return rows.select("item_id", F.round(metrics.text_similarity(F.col("a"), F.col("b"), 0.5), 6).alias("score"))


def metadata_profile(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.value_counts(table(spark, sf, "events"), "event_type")


def cosine_top(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return similarity.cosine_top(rows, rows.where("vec_id % 50 = 0"), 5)


def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """Share of queries with a neighbour of their own label among the first k."""
    rows = table(spark, sf, "embeddings")
    top = similarity.cosine_top(rows, rows.where("vec_id % 50 = 0"), 16)
    labels = rows.select("vec_id", "label")
    top = top.join(labels, "vec_id").join(labels.withColumnsRenamed({"vec_id": "query", "label": "own"}), "query")
    ranks = top.groupBy("query").agg(F.min(F.when(F.col("label") == F.col("own"), F.col("rank"))).alias("rank"))
    out = metrics.retrieval(ranks, "rank", (1, 4, 8, 16))
    return out.select("n", *(F.round(c, 9).alias(c) for c in ("recall_1", "recall_4", "recall_8", "recall_16", "mrr")))


def dom_nodes(spark: SparkSession, sf: str) -> DataFrame:
    rows = dom.dom_nodes(table(spark, sf, "pages")).select("page_id", F.explode("nodes").alias("n"))
    return rows.groupBy("n.tag").agg(F.count(F.lit(1)).alias("n"), F.max("n.depth").alias("depth"))


def dom_rank(spark: SparkSession, sf: str) -> DataFrame:
    return dom.ranked_dom(table(spark, sf, "pages"), "find the licence in the footer", budget=512)


QUERIES = [success_at_deadline, latency_percentiles, nearest_rank, bootstrap_interval, case_macro, suite_rates, paired_arms, seed_summary, ratio_by_group, weighted_loss, quality_label_floor, chance_baseline, multiset_f1, coverage_check, category_means, error_buckets, text_similarity, text_similarity_whole, metadata_profile, cosine_top, recall_at_k, dom_nodes, dom_rank]

_A = "a AS (SELECT event_id, user_id, event_type, value AS ms, event_id % 3 <> 0 AS success, event_id % 7 <> 0 AS valid FROM events)"
_TOP = "p AS (SELECT q.vec_id AS query, e.vec_id, q.label AS own, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM p)"

ORACLES = {
    "success_at_deadline": f"WITH {_A} SELECT event_type, deadline::DOUBLE AS deadline, count(*) AS opportunities, count(*) FILTER (ms <= deadline) AS on_time, count(*) FILTER (ms <= deadline AND success AND valid) AS useful, round(count(*) FILTER (ms <= deadline AND success AND valid) / count(*)::DOUBLE, 9) AS success, round(count(*) FILTER (ms <= deadline AND success AND valid) / (sum(ms) / 60000), 6) AS per_minute FROM a, (VALUES (25.0), (50.0), (100.0)) t(deadline) GROUP BY event_type, deadline",
    "latency_percentiles": f"WITH {_A} SELECT event_type, count(ms) AS count, round(min(ms), 6) AS min, round(avg(ms), 6) AS mean, round(max(ms), 6) AS max, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.9), 6) AS p90, round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99 FROM a GROUP BY event_type",
    "nearest_rank": "SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99 FROM events",
    "case_macro": f"WITH {_A}, m AS (SELECT user_id, avg((success AND valid AND ms <= 50)::INT) AS r FROM a GROUP BY user_id) SELECT round(avg(r), 9) AS macro, count(*) AS units FROM m",
    "suite_rates": f"WITH {_A} SELECT event_type, round(avg(valid::INT), 9) AS parsed, round(avg(success::INT) FILTER (valid), 9) AS step, avg(success::INT) FILTER (ms > 1e12) AS never FROM a GROUP BY event_type",
    "paired_arms": f"WITH {_A}, l AS (SELECT event_type, avg(ms) AS x FROM a WHERE event_id % 2 = 0 GROUP BY 1), r AS (SELECT event_type, avg(ms) AS y FROM a WHERE event_id % 2 = 1 GROUP BY 1), d AS (SELECT y - x AS d FROM l JOIN r USING (event_type)) SELECT count(*) AS n, round(avg(d), 6) AS mean_delta, avg((d > 0)::INT) AS wins, avg((d = 0)::INT) AS ties FROM d",
    "seed_summary": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS sd, round(stddev_samp(value) / sqrt(count(value)), 6) AS se FROM events GROUP BY event_type",
    "ratio_by_group": "SELECT l_returnflag, round(sum(l_extendedprice::DOUBLE) / sum(l_quantity::DOUBLE), 6) AS ratio, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())",
    "weighted_loss": "SELECT l_returnflag AS source, round(sum(l_discount::DOUBLE * l_quantity::DOUBLE) / sum(l_quantity::DOUBLE), 9) AS loss FROM lineitem GROUP BY 1",
    "quality_label_floor": "WITH c AS (SELECT lang, quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY lang)::BIGINT AS total, row_number() OVER (PARTITION BY lang ORDER BY n DESC, quality) AS k FROM c) SELECT lang, quality, n, total, n / total::DOUBLE AS rate FROM t WHERE k = 1",
    "chance_baseline": "WITH s AS (SELECT lang, count(DISTINCT source) AS k FROM documents GROUP BY lang) SELECT round(avg(1.0::DOUBLE / k), 9) AS chance, min(k) AS least, max(k) AS most FROM documents JOIN s USING (lang)",
    "multiset_f1": "WITH l AS (SELECT user_id, event_type, count(*) AS p FROM events WHERE event_id % 2 = 0 GROUP BY ALL), r AS (SELECT user_id, event_type, count(*) AS r FROM events WHERE event_id % 2 = 1 GROUP BY ALL), s AS (SELECT sum(p)::BIGINT AS predicted, sum(r)::BIGINT AS reference, sum(least(coalesce(p, 0), coalesce(r, 0)))::BIGINT AS shared FROM l FULL JOIN r USING (user_id, event_type)) SELECT *, round(shared / predicted::DOUBLE, 9) AS precision, round(shared / reference::DOUBLE, 9) AS recall, round(2 * shared / (predicted + reference)::DOUBLE, 9) AS f1 FROM s",
    "coverage_check": "WITH e AS (SELECT DISTINCT user_id, event_type, 1 AS e FROM events WHERE user_id % 3 <> 0), f AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE user_id % 5 <> 0 GROUP BY ALL) SELECT count(*) FILTER (n > 1) AS duplicates, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (e IS NULL) AS unexpected FROM e FULL JOIN f USING (user_id, event_type)",
    "category_means": f"WITH {_A}, c AS (SELECT success::INT AS v, unnest([event_type, CASE WHEN valid THEN 'valid' ELSE 'invalid' END, 'ALL_CATEGORIES']) AS category FROM a) SELECT category, count(*) AS n, round(avg(v), 9) AS mean, round(avg((v = 1)::INT), 9) AS exact FROM c GROUP BY category",
    "error_buckets": "WITH l AS (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS said FROM events) SELECT CASE WHEN said IS NULL THEN 'parse_fail' WHEN said = event_type THEN 'correct_name' WHEN said IN ('view', 'click') THEN 'wrong_in_catalog' ELSE 'out_of_catalog' END AS bucket, count(*) AS n FROM l GROUP BY 1",
    "text_similarity_whole": "WITH t AS (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS a FROM benchmark), u AS (SELECT item_id, a, regexp_replace(a, 'e[a-m]', '', 'g') || ' and so on' AS b FROM t), s AS (SELECT item_id, 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE AS s FROM u) SELECT item_id, round(CASE WHEN s >= 0.5 THEN s ELSE 0 END, 6) AS score FROM s",
    "text_similarity": "WITH t AS (SELECT item_id, substr(regexp_replace(text, '[^ -~]', '', 'g'), 1, 40) AS a, substr(regexp_replace(text, '[^ -~]', '', 'g'), 3, 40) AS b FROM benchmark), s AS (SELECT item_id, 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE AS s FROM t) SELECT item_id, round(CASE WHEN s >= 0.5 THEN s ELSE 0 END, 6) AS score FROM s",
    "metadata_profile": "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1",
    "cosine_top": f"WITH {_TOP} SELECT query, vec_id, score, rank FROM k WHERE rank <= 5",
    "recall_at_k": f"WITH {_TOP}, m AS (SELECT query, min(rank) FILTER (label = own AND rank <= 16) AS r FROM k GROUP BY query) SELECT count(*) AS n, round(avg((coalesce(r, 99) <= 1)::INT), 9) AS recall_1, round(avg((coalesce(r, 99) <= 4)::INT), 9) AS recall_4, round(avg((coalesce(r, 99) <= 8)::INT), 9) AS recall_8, round(avg((coalesce(r, 99) <= 16)::INT), 9) AS recall_16, round(avg(coalesce(1.0::DOUBLE / r, 0)), 9) AS mrr FROM m",
}
