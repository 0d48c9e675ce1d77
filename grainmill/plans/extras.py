"""Queries of sampling schedules, set operations, guards, sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions import text as X
from grainmill.operators import conversations, governance, metrics, schedules, selection
from grainmill.operators.ranking import global_rank
from grainmill.plans.corpus import STRIP
from grainmill.sources import readers, sinks
from grainmill.sources.shared import new_folder
from grainmill.sources.tables import table
from grainmill.streaming import streams


def bernoulli_sample(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(X.hash_selected(7, F.col("doc_id"), 0.1)).select("doc_id")


def replay_window(spark: SparkSession, sf: str) -> DataFrame:
    """Languages in a cycle of four: which of its rows each draw takes."""
    sizes = {r.lang: r.n for r in table(spark, sf, "documents").where("lang IN ('en', 'de', 'fr')").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = schedules.replay_window(spark, ["en", "de", "en", "fr"], sizes, 10, 4000)
    return out.select("ordinal", "source", F.col("index").alias("row_index"), F.col("epoch").cast("bigint").alias("epoch"))


def permutation_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return schedules.permutation_blocks(table(spark, sf, "benchmark"), "item_id", 5, 100)


def microbatches(spark: SparkSession, sf: str) -> DataFrame:
    return schedules.microbatch_tokens(table(spark, sf, "documents"), "n_chars", 32, "doc_id")


def spread_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Where 37 rows stand if they are spread evenly over all documents, and the documents that have those ranks by id."""
    docs = table(spark, sf, "documents").select("doc_id")
    total = docs.count()
    places = spark.range(1).select(F.explode(selection.spread_positions(total, 37)).alias("position"))
    ranked = global_rank(docs.withColumn("g", F.floor(F.col("doc_id") / 4096)), "g", [F.col("doc_id")], "position").drop("g")
    return ranked.join(F.broadcast(places), "position")


def file_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Ten sources by the hash of seed and name: a sampling operator."""
    files = table(spark, sf, "documents").select(F.concat(F.lit("shards/"), "source", F.lit(".jsonl")).alias("path")).distinct()
    return selection.select_files(files, 42, 10)


def append_unseen(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("source", F.sha2("text", 256).alias("digest")).withColumn("old", X.hash_bucket("pool", F.col("digest")) < 50)
    pool = docs.where("old").drop("old").dropDuplicates(["digest"])
    return governance.append_unseen(pool, docs.drop("old"), "digest").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("digest").alias("distinct"))


def union_with_provenance(spark: SparkSession, sf: str) -> DataFrame:
    parts = [table(spark, sf, n).select(F.lit(n).alias("origin"), F.length("text").alias("chars")) for n in ("documents", "benchmark", "conversations")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))


def marker_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with a prompt marker or NUL are not inert: here '||' and '##' stand for markers."""
    bad = F.col("text").contains("||") | F.col("text").contains("##") | F.col("text").contains("\x00")
    return table(spark, sf, "documents").groupBy(bad.alias("refused")).agg(F.count(F.lit(1)).alias("n"))


def source_policy(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog says which sources may be trained on."""
    catalog = spark.createDataFrame([(f"src{k}", "train" if k % 3 else "eval") for k in range(15)], "source string, policy string")
    rows = table(spark, sf, "documents").join(F.broadcast(catalog), "source", "left")
    return rows.groupBy(F.coalesce("policy", F.lit("unknown")).alias("policy")).agg(F.count(F.lit(1)).alias("n"))


def name_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Users of the events of one kind of id, and how many of them the events of the other kind have."""
    rows = table(spark, sf, "events")
    return conversations.overlap(rows.where("event_id % 4 = 0"), rows.where("event_id % 4 <> 0"), "user_id")


def router_load(spark: SparkSession, sf: str) -> DataFrame:
    """Per label and position, the sum of a vector column: how expert loads are added up."""
    rows = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("expert", "v"))
    return rows.groupBy("label", "expert").agg(F.round(F.sum(F.col("v").cast("double")), 4).alias("load"))


def stratum_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Where each stratum first appears in the quota order."""
    rows = table(spark, sf, "events").select("event_type", (F.col("user_id") % 7).alias("g"), F.sha2(F.col("event_id").cast("string"), 256).alias("h"))
    out = selection.quota_order(rows, ["event_type", "g"], "h")
    return out.groupBy("event_type", "g").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n"))


def suite_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The mean over suites with enough rows, per category."""
    rows = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 10).alias("suite")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"))
    return rows.groupBy("event_type").agg(F.round(F.avg(F.when(F.col("n") >= 190, F.col("v"))), 6).alias("mean"), F.count_if(F.col("n") >= 190).alias("suites"))


def retained_by_length(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.value_counts(table(spark, sf, "documents").select(F.length("text").between(200, 2_000_000).alias("ok")), "ok")


def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents to JSON lines and back through the document reader."""
    path = new_folder(spark)
    docs = table(spark, sf, "documents")
    sinks.write_documents(docs.select("text", "source", F.col("doc_id").cast("string").alias("doc_id")), path)
    rows = spark.read.schema("text string, source string, doc_id string").json(path)
    return rows.select("doc_id", "source", F.sha2("text", 256).alias("digest"))


def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts of a stream over the events files, to their end. An extension of ours."""
    schema = table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = streams.windowed_counts(rows, "ts", "1 day", group=["event_type"])
    path = streams.to_end(counts, new_folder(spark))
    return spark.read.parquet(path).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


def chapters(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a chapter of a book, books of about sixteen documents of a source; pieces of 200 characters or more."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL")
    docs = docs.withColumn("book", F.substring(F.sha2(F.floor(F.col("doc_id") / 16).cast("string"), 256), 1, 8))
    books = docs.groupBy("source", "book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda r: F.concat(F.lit("Chapter "), r["doc_id"].cast("string"), F.lit("\n"), r["text"])), "\n").alias("text"))
    return readers.chapters(books).groupBy("source").agg(F.count(F.lit(1)).alias("pieces"))


QUERIES = [bernoulli_sample, replay_window, permutation_blocks, microbatches, spread_positions, file_selection, append_unseen, union_with_provenance, marker_guard, source_policy, name_coverage, router_load, stratum_first_seen, suite_summary, retained_by_length, json_round_trip, stream_counts, chapters]

ORACLES = {
    "bernoulli_sample": "SELECT doc_id FROM documents WHERE ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT < 429496729",
    "replay_window": "WITH n AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang), t AS (SELECT slot, lang AS source, turn, turns, size FROM (VALUES (0, 'en', 0, 2), (1, 'de', 0, 1), (2, 'en', 1, 2), (3, 'fr', 0, 1)) t(slot, lang, turn, turns) JOIN n USING (lang)), o AS (SELECT range AS ordinal FROM range(10, 4000)) SELECT ordinal, source, ((ordinal // 4) * turns + turn) % size AS row_index, ((ordinal // 4) * turns + turn) // size AS epoch FROM o JOIN t ON ordinal % 4 = slot",
    "permutation_blocks": "WITH n AS (SELECT count(*) AS n FROM benchmark), b AS (SELECT range AS b FROM range(100)), r AS (SELECT b * n + row_number() OVER (PARTITION BY b ORDER BY sha256('5:' || b || ':' || item_id), item_id) - 1 AS draw, item_id FROM benchmark, b, n) SELECT * FROM r WHERE draw < 100",
    "microbatches": "SELECT (doc_id // 32)::BIGINT AS batch, (max(greatest(n_chars - 1, 0)) * count(*))::BIGINT AS input_tokens, sum(greatest(n_chars - 1, 0))::BIGINT AS loss_tokens FROM documents GROUP BY 1",
    "spread_positions": "WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS n FROM documents) SELECT position, doc_id FROM d WHERE position IN (SELECT ((2 * range + 1) * (SELECT count(*) FROM documents)) // 74 FROM range(37))",
    "file_selection": "WITH p AS (SELECT DISTINCT 'shards/' || source || '.jsonl' AS path FROM documents) SELECT path FROM p ORDER BY sha256('42:' || path), path LIMIT 10",
    "append_unseen": "SELECT count(DISTINCT sha256(text)) AS n, count(DISTINCT sha256(text)) AS \"distinct\" FROM documents",
    "union_with_provenance": "SELECT 'documents' AS origin, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents UNION ALL SELECT 'benchmark', count(*), sum(length(text))::BIGINT FROM benchmark UNION ALL SELECT 'conversations', count(*), sum(length(text))::BIGINT FROM conversations",
    "marker_guard": "SELECT contains(text, '||') OR contains(text, '##') OR contains(text, chr(0)) AS refused, count(*) AS n FROM documents GROUP BY 1",
    "source_policy": "SELECT CASE WHEN regexp_extract(source, '[0-9]+')::INT >= 15 THEN 'unknown' WHEN regexp_extract(source, '[0-9]+')::INT % 3 = 0 THEN 'eval' ELSE 'train' END AS policy, count(*) AS n FROM documents GROUP BY 1",
    "name_coverage": "WITH l AS (SELECT DISTINCT user_id FROM events WHERE event_id % 4 = 0), r AS (SELECT DISTINCT user_id FROM events WHERE event_id % 4 <> 0) SELECT (SELECT count(*) FROM l) AS \"left\", (SELECT count(*) FROM r) AS \"right\", (SELECT count(*) FROM l SEMI JOIN r USING (user_id)) AS shared",
    "router_load": "WITH e AS (SELECT label, unnest(range(len(embedding)))::INT AS expert, unnest(embedding) AS v FROM embeddings) SELECT label, expert, round(sum(v::DOUBLE), 4) AS load FROM e GROUP BY 1, 2",
    "stratum_first_seen": "WITH s AS (SELECT event_type, user_id % 7 AS g, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, g, row_number() OVER (ORDER BY n, sha256(event_type || '|' || g)) - 1 AS first, n FROM s",
    "suite_summary": "WITH s AS (SELECT event_type, user_id % 10 AS suite, count(*) AS n, avg(value) AS v FROM events GROUP BY ALL) SELECT event_type, round(avg(v) FILTER (n >= 190), 6) AS mean, count(*) FILTER (n >= 190) AS suites FROM s GROUP BY event_type",
    "retained_by_length": "SELECT length(text) BETWEEN 200 AND 2000000 AS value, count(*) AS n FROM documents GROUP BY 1",
    "json_round_trip": "SELECT doc_id::VARCHAR AS doc_id, source, sha256(text) AS digest FROM documents",
    "stream_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "chapters": f"SELECT source, count(*) AS pieces FROM documents WHERE length({STRIP % 'text'}) >= 200 GROUP BY source",
}
