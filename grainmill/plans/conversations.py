"""Queries over conversations: rendering, decisions, audits, orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions import text as X
from grainmill.operators import conversations as C
from grainmill.operators import metrics, selection, similarity
from grainmill.sources.tables import table


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


def render_conversation(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.rebuild(_turns(spark, sf))
    return rows.select("conv_id", F.sha2(C.render(F.col("messages")), 256).alias("rendered"), C.semantic_hash(F.col("messages")).alias("semantic"))


def conversation_history(spark: SparkSession, sf: str) -> DataFrame:
    return C.decisions(_turns(spark, sf)).select("conv_id", "turn", F.sha2("prompt", 256).alias("prompt_hash"), F.length("prompt").alias("n"))


def decision_byte_lengths(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.rebuild(_turns(spark, sf)).select("conv_id", C.byte_accounting(F.col("messages")).alias("b"))
    return rows.select("conv_id", F.col("b.input").alias("input"), F.col("b.loss").alias("loss"))


def turn_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = _turns(spark, sf)
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.max("turn").alias("last"))


def length_distribution(spark: SparkSession, sf: str) -> DataFrame:
    rows = _turns(spark, sf).select(F.octet_length("text").alias("n"))
    return metrics.nearest_rank(rows, "n", (50, 90, 95, 99))


def trainable_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return C.rebuild(_turns(spark, sf)).where(C.trainable(F.col("messages"))).select("conv_id")


def context_fit(spark: SparkSession, sf: str) -> DataFrame:
    return C.fit_report(_turns(spark, sf), 2048)


def structural_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """'the' stands for a failure word, so that the synthetic texts have some."""
    rows = C.rebuild(_turns(spark, sf))
    return rows.select("conv_id", C.recovers(F.col("messages"), r"\bthe\b").alias("recovers"))


def task_projection(spark: SparkSession, sf: str) -> DataFrame:
    return C.tasks(_turns(spark, sf)).select("conv_id", F.sha2("observation", 256).alias("observation"), F.sha2("gold", 256).alias("gold"))


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = _turns(spark, sf).withColumn("bucket", X.hash_bucket("conversations", F.col("conv_id")))
    return rows.where("bucket < 80").drop("bucket"), rows.where("bucket >= 80").drop("bucket")


def hash_bucket_split(spark: SparkSession, sf: str) -> DataFrame:
    """Whole conversations by the first four bytes of a hash."""
    rows = _turns(spark, sf).select("conv_id").distinct()
    return rows.select("conv_id", F.when(X.hash_bucket("conversations", F.col("conv_id")) < 20, "eval").otherwise("train").alias("split"))


def split_leakage(spark: SparkSession, sf: str) -> DataFrame:
    train, test = (C.rebuild(x).select(C.semantic_hash(F.col("messages")).alias("h")) for x in _halves(spark, sf))
    return C.overlap(train, test, "h")


def turn_text_leakage(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _halves(spark, sf)
    return C.overlap(train.select(F.sha1("text").alias("h")), test.select(F.sha1("text").alias("h")), "h")


def prefix_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of one side whose first 60 or last 400 characters the other side has."""
    train, test = _halves(spark, sf)
    heads = train.select(F.substring("text", 1, 60).alias("head")).distinct()
    tails = train.select(F.expr("right(text, 400)").alias("tail")).distinct()
    rows = test.withColumn("head", F.substring("text", 1, 60)).withColumn("tail", F.expr("right(text, 400)"))
    rows = rows.join(heads.withColumn("h", F.lit(1)), "head", "left").join(tails.withColumn("t", F.lit(1)), "tail", "left")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count("h").alias("heads"), F.count("t").alias("tails"))


def prompt_holdout(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _halves(spark, sf)
    held = C.decisions(test).select(F.sha2("prompt", 256).alias("prompt_hash")).distinct()
    return C.without_prompts(train, held).select("conv_id").distinct()


def group_disjoint_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.decisions(_turns(spark, sf)).groupBy("conv_id").agg(F.collect_set(F.sha2("prompt", 256)).alias("hashes"))
    return selection.group_split(rows, "conv_id", "hashes", 5, similarity.parquet_checkpoint(spark))


def duplicate_ambiguity(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.ambiguity(_turns(spark, sf), "text", "role")


def role_majority(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.majority(_turns(spark, sf), "role", ["turn"])


def stratified_min_hash(spark: SparkSession, sf: str) -> DataFrame:
    rows = _turns(spark, sf).withColumn("h", F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")), 256))
    return selection.first_of_each(rows, ["role", "turn"], ["h"]).select("role", "turn", "conv_id")


def quota_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = _turns(spark, sf).withColumn("h", F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")), 256))
    return selection.quota_order(rows, ["role", "turn"], "h").select("conv_id", "turn", "position")


def balanced_shortest(spark: SparkSession, sf: str) -> DataFrame:
    rows = _turns(spark, sf).select("conv_id", "turn", "role", F.length("text").alias("n")).withColumnRenamed("turn", "t")
    return selection.balanced(rows, "role", ["n", "conv_id", "t"], 60).select("conv_id", "t", "role", "turn")


def curriculum_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.decisions(_turns(spark, sf)).withColumn("score", F.length("target"))
    return selection.curriculum(rows, "score", "prompt", "target").select("score", "position")


def coverage_subset(spark: SparkSession, sf: str) -> DataFrame:
    """A small set of conversations that shows every (role, turn)."""
    rows = _turns(spark, sf).groupBy("conv_id").agg(F.collect_set(F.concat_ws(":", "role", F.col("turn").cast("string"))).alias("strata"))
    chosen = selection.greedy_cover(rows, "conv_id", "strata", 40)
    return spark.createDataFrame([(c,) for c in chosen], "conv_id bigint")


def retrieval_of(turns: DataFrame, queried: Column) -> DataFrame:
    """Recall and mean reciprocal rank of the user turn before each assistant turn of the queried conversations, among the user turns of all conversations."""
    written = similarity.parquet_checkpoint(turns.sparkSession)
    grams = similarity.char_grams(F.col("text"))
    # equal texts are compared once and count as often as they stand
    user = written(turns.where("role = 'user'").groupBy("text").agg(F.count(F.lit(1)).alias("n")).select("n", grams.alias("g")))
    asked = turns.where(queried & (F.col("role") == "user")).select("conv_id", "turn", grams.alias("g"))
    reply = turns.where(queried & (F.col("role") == "assistant")).select("conv_id", (F.col("turn") - 1).alias("turn"), grams.alias("q"))
    goal = written(reply.join(asked, ["conv_id", "turn"]).select("conv_id", "turn", "q", similarity.sparse_dot(F.col("q"), F.col("g")).alias("own")))
    ahead = similarity.count_above(user, goal, ["conv_id", "turn"])
    return metrics.retrieval(goal.join(ahead, ["conv_id", "turn"], "left").select((F.coalesce("above", F.lit(0)) + 1).alias("rank")), "rank")


def chat_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """For each assistant turn of a query conversation, its rank of the user turn before it among all user turns by n-gram cosine."""
    return retrieval_of(_turns(spark, sf), F.col("conv_id") % 50 == 0)


QUERIES = [render_conversation, conversation_history, decision_byte_lengths, turn_stats, length_distribution, trainable_conversations, context_fit, structural_recovery, task_projection, hash_bucket_split, split_leakage, turn_text_leakage, prefix_overlap, prompt_holdout, group_disjoint_split, duplicate_ambiguity, role_majority, stratified_min_hash, quota_order, balanced_shortest, curriculum_order, coverage_subset, chat_retrieval]

_LINE = "'<|' || role || '|>' || coalesce(text, '')"
_D = f"d AS (SELECT conv_id, turn, role, text, coalesce(string_agg({_LINE}, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prompt FROM conversations)"
_B = "('0x' || substr(sha256('conversations:' || conv_id), 1, 8))::BIGINT % 100"
_SEM = "SELECT conv_id, sha256(string_agg(role || chr(31) || coalesce(text, ''), chr(30) ORDER BY turn)) AS h FROM conversations GROUP BY conv_id"
_H = "sha256(conv_id || ':' || turn)"

ORACLES = {
    "render_conversation": f"SELECT conv_id, sha256(string_agg({_LINE}, chr(10) ORDER BY turn)) AS rendered, sha256(string_agg(role || chr(31) || coalesce(text, ''), chr(30) ORDER BY turn)) AS semantic FROM conversations GROUP BY conv_id",
    "conversation_history": f"WITH {_D} SELECT conv_id, turn, sha256(prompt) AS prompt_hash, length(prompt) AS n FROM d WHERE role = 'assistant'",
    "decision_byte_lengths": "SELECT conv_id, sum(strlen(coalesce(text, '')) + strlen(role) + 5)::BIGINT AS input, coalesce(sum(strlen(coalesce(text, '')) + 1) FILTER (role = 'assistant'), 0)::BIGINT AS loss FROM conversations GROUP BY conv_id",
    "turn_stats": "SELECT role, count(*) AS n, sum(strlen(text))::BIGINT AS bytes, max(turn) AS last FROM conversations GROUP BY role",
    "length_distribution": "SELECT quantile_disc(strlen(text), 0.5) AS p50, quantile_disc(strlen(text), 0.9) AS p90, quantile_disc(strlen(text), 0.95) AS p95, quantile_disc(strlen(text), 0.99) AS p99 FROM conversations",
    "trainable_conversations": "SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_or(role = 'user') AND arg_max(role, turn) = 'assistant' AND length(trim(arg_max(text, turn))) > 0",
    "context_fit": f"WITH {_D}, s AS (SELECT conv_id, max(strlen(prompt) + strlen(coalesce(text, ''))) AS n FROM d WHERE role = 'assistant' GROUP BY conv_id) SELECT count(*) FILTER (n <= 2048) AS kept, count(*) FILTER (n > 2048) AS oversize, max(n) AS longest FROM s",
    "structural_recovery": r"WITH f AS (SELECT conv_id, min(turn) FILTER (regexp_matches(text, '\bthe\b')) AS first, max(turn) FILTER (role = 'assistant') AS last FROM conversations GROUP BY conv_id) SELECT conv_id, coalesce(last > first, false) AS recovers FROM f",
    "task_projection": "WITH a AS (SELECT conv_id, min(turn) FILTER (role = 'assistant') AS t0 FROM conversations GROUP BY conv_id) SELECT conv_id, sha256(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (turn < t0), '')) AS observation, sha256(any_value(text) FILTER (turn = t0)) AS gold FROM conversations JOIN a USING (conv_id) WHERE t0 IS NOT NULL GROUP BY conv_id",
    "hash_bucket_split": f"SELECT DISTINCT conv_id, CASE WHEN {_B} < 20 THEN 'eval' ELSE 'train' END AS split FROM conversations",
    "split_leakage": f"WITH s AS ({_SEM}), l AS (SELECT DISTINCT h FROM s WHERE {_B} < 80), r AS (SELECT DISTINCT h FROM s WHERE {_B} >= 80) SELECT (SELECT count(*) FROM l) AS \"left\", (SELECT count(*) FROM r) AS \"right\", (SELECT count(*) FROM l SEMI JOIN r USING (h)) AS shared",
    "turn_text_leakage": f"WITH l AS (SELECT DISTINCT text FROM conversations WHERE {_B} < 80), r AS (SELECT DISTINCT text FROM conversations WHERE {_B} >= 80) SELECT (SELECT count(*) FROM l) AS \"left\", (SELECT count(*) FROM r) AS \"right\", (SELECT count(*) FROM l SEMI JOIN r USING (text)) AS shared",
    "prefix_overlap": f"WITH a AS (SELECT text FROM conversations WHERE {_B} < 80), b AS (SELECT text FROM conversations WHERE {_B} >= 80) SELECT count(*) AS n, count(*) FILTER (left(text, 60) IN (SELECT left(text, 60) FROM a)) AS heads, count(*) FILTER (right(text, 400) IN (SELECT right(text, 400) FROM a)) AS tails FROM b",
    "prompt_holdout": f"WITH {_D}, e AS (SELECT prompt FROM d WHERE role = 'assistant' AND {_B} >= 80), x AS (SELECT conv_id FROM d WHERE role = 'assistant' AND prompt IN (FROM e)) SELECT DISTINCT conv_id FROM conversations WHERE {_B} < 80 AND conv_id NOT IN (FROM x)",
    "group_disjoint_split": f"WITH RECURSIVE {_D}, h AS (SELECT DISTINCT conv_id, sha256(prompt) AS h FROM d WHERE role = 'assistant'), e AS (SELECT DISTINCT a.conv_id AS a, b.conv_id AS b FROM h a JOIN h b USING (h)), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a), r AS (SELECT c.a AS conv_id, min(h.h) AS root FROM c JOIN h ON h.conv_id = c.b GROUP BY 1) SELECT conv_id, root, CASE WHEN ('0x' || substr(root, 1, 8))::BIGINT % 5 = 0 THEN 'eval' ELSE 'train' END AS split FROM r",
    "duplicate_ambiguity": "WITH g AS (SELECT text, count(*) AS n, count(DISTINCT role) AS k FROM conversations GROUP BY text HAVING count(*) > 1) SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS rows, count(*) FILTER (k > 1) AS ambiguous FROM g",
    "role_majority": "WITH c AS (SELECT turn, role, count(*) AS n FROM conversations GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY turn)::BIGINT AS total, row_number() OVER (PARTITION BY turn ORDER BY n DESC, role) AS k FROM c) SELECT turn, role, n, total, n / total::DOUBLE AS rate FROM t WHERE k = 1",
    "stratified_min_hash": f"SELECT role, turn, conv_id FROM conversations QUALIFY row_number() OVER (PARTITION BY role, turn ORDER BY {_H}) = 1",
    "quota_order": f"WITH a AS (SELECT *, {_H} AS h, sha256(role || '|' || turn) AS s, count(*) OVER (PARTITION BY role, turn) AS n, row_number() OVER (PARTITION BY role, turn ORDER BY {_H}) - 1 AS k FROM conversations) SELECT conv_id, turn, row_number() OVER (ORDER BY CASE WHEN k = 0 THEN -1.0 ELSE (2 * k - 1) / (2.0::DOUBLE * (n - 1)) END, CASE WHEN k = 0 THEN n ELSE 0 END, CASE WHEN k = 0 THEN s ELSE sha256(s || '|' || h) END, h) - 1 AS position FROM a",
    "balanced_shortest": "WITH a AS (SELECT conv_id, turn AS t, role, row_number() OVER (PARTITION BY role ORDER BY length(text), conv_id, turn) AS turn FROM conversations) SELECT * FROM a ORDER BY turn, sha256(role) LIMIT 60",
    "curriculum_order": f"WITH {_D} SELECT length(text) AS score, row_number() OVER (ORDER BY length(text), sha1(text || chr(0) || prompt)) - 1 AS position FROM d WHERE role = 'assistant'",
}
