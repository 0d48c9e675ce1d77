"""Mixing sources to target weights, in DataFrame operations only.

Every row gets a hash-random key from the MD5 of its id and text, so equal intervals of the key space hold about equal
numbers of rows. Rows are dealt by (source, interval): a range sort without sampling in which a source with a third of all
rows spreads over as many intervals as its size asks for. The prefix sum of token counts has three levels:
inside an interval, over the intervals of a group, over the groups of a source. Only sums go between them.
Where a row's prefix ends says how much of it the budget takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainmill.llm.common import field, written

#: Rows an interval has on average, and intervals in a group.
INTERVAL_ROWS, GROUP_INTERVALS = 512, 1024


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and \\t \\n \\v \\f \\r; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most_epochs: int = 3) -> DataFrame:
    """(__src, source, source_size) to the same with weight and target.

    Sources take the weights in turn by code point, null last. Shares add up to all sizes; a target stops at most_epochs
    times its source's size and the excess is shared again by weight. That ends at one level L with
    target = min(cap, L * weight): in the order of cap / weight, the capped ones come first.
    The table has a row for each source; this is the only place where sources stand in one window.
    """
    turn = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("__turn", F.row_number().over(turn) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__turn") % len(weights) + 1).cast("int")).cast("bigint")
    ranked = ranked.withColumn("weight", weight).withColumn("__cap", F.col("source_size") * most_epochs)
    by_cap = W.orderBy(F.col("__cap") / F.col("weight"), "__turn")
    every = W.partitionBy(F.lit(1))
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, W.unboundedFollowing)
    ranked = (
        ranked.withColumn("__left", F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(before), F.lit(0)))
        .withColumn("__weights", F.sum("weight").over(onward))
        .withColumn("__capped", F.col("__left").cast("double") * F.col("weight") > F.col("__cap").cast("double") * F.col("__weights"))
    )
    level = F.max(F.when(~F.col("__capped"), F.struct(-F.col("__cap") / F.col("weight"), -F.col("__turn"), F.col("__left").alias("l"), F.col("__weights").alias("w")))).over(every)
    ranked = ranked.withColumn("__level", level)
    target = F.when(F.col("__capped"), F.col("__cap").cast("double")).otherwise(F.col("__level.l").cast("double") * F.col("weight") / F.col("__level.w"))
    return ranked.withColumn("target", F.least(target, F.col("__cap").cast("double"))).select("__src", "source_size", "weight", "target")


def mix(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = (5, 2, 1), most_epochs: int = 3, carry: bool = False) -> DataFrame:
    """Per row: the id, size (words), source_size, target and taken (words the mix takes, repeats counted).

    A source's budget is its target rounded to whole words. Each row is taken once for every whole epoch in it, and in the
    last, part epoch rows are taken in key order until the budget is used up: the row at the cut gives just the words that are
    missing, so every budget is met exactly. With carry, the column ``row`` holds the whole input row.

    Null and empty texts have size 0 and taken 0. Null is a source of its own, other than ''. Null ids and
    repeated ids have keys like any other, since the text is part of the key; rows equal in id and text are interchangeable.
    If there are no words, all targets are 0. Columns of other names stay out of the way: they travel inside ``row``.
    """
    spark = docs.sparkSession
    ident, text, source = field(docs, id_column), field(docs, text_column).cast("string"), field(docs, source_column).cast("string")
    text_digest = F.md5(F.coalesce(text, F.lit("")))
    digest = F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("null")), F.lit(" "), text_digest))
    key = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    src = F.concat(F.when(source.isNull(), "0").otherwise("1"), F.coalesce(source, F.lit("")))
    columns = [ident.alias("__id"), source.alias("__source"), src.alias("__src"), words(text).alias("size"), digest.alias("__digest"), key.alias("__key")]
    rows = docs.select(*columns, *([F.struct(*(field(docs, c) for c in docs.columns)).alias("row")] if carry else []))
    if not carry:
        rows = written(rows, "mix-sizes")
    intervals = max(1, -(-docs.count() // INTERVAL_ROWS))
    rows = rows.withColumn("__at", F.floor(F.col("__key") * F.lit(intervals) / F.lit(1 << 32)).cast("bigint"))
    rows = rows.withColumn("__group", F.floor(F.col("__at") / GROUP_INTERVALS).cast("bigint"))
    sums = written(rows.groupBy("__src", "__group", "__at").agg(F.max("__source").alias("source"), F.sum("size").alias("__sum")), "mix-sums")
    targets = source_targets(sums.groupBy("__src").agg(F.max("source").alias("source"), F.sum("__sum").alias("source_size")), weights, most_epochs)
    groups = sums.groupBy("__src", "__group").agg(F.sum("__sum").alias("__group_sum"))
    ahead = W.partitionBy("__src").orderBy("__group").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.withColumn("__group_start", F.coalesce(F.sum("__group_sum").over(ahead), F.lit(0)))
    ahead = W.partitionBy("__src", "__group").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("__start", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)))
    starts = starts.join(groups, ["__src", "__group"]).join(targets, "__src")
    starts = starts.select("__src", "__at", (F.col("__group_start") + F.col("__start")).alias("__start"), "source_size", "target")
    ahead = W.partitionBy("__src", "__at").orderBy("__digest").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.drop("__group", "__source", "__key").withColumn("__inside", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    rows = rows.join(starts, ["__src", "__at"])
    budget = F.least(F.floor(F.col("target") + 0.5).cast("bigint"), F.col("source_size") * most_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = budget - epochs * F.col("source_size") - F.col("__start") - F.col("__inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), rest))
    return rows.select(F.col("__id").alias(id_column), "size", "source_size", "target", taken.alias("taken"), *(["row"] if carry else []))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with their own columns: each as often as the mix takes it, a part of half a text or more as a whole one, a smaller part not at all. Rows without words leave."""
    out = mix(docs, carry=True, **options)
    times = F.floor((F.col("taken") * 2 + F.col("size")) / (F.col("size") * 2)).cast("int")
    copies = F.explode(F.when(F.col("size") > 0, F.array_repeat(F.col("row"), times)).otherwise(F.array()))
    return out.select(copies.alias("row")).select(*(F.col("row")[c].alias(c) for c in docs.columns))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ' ' || md5(coalesce(text, ''))) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
             row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM d GROUP BY source),
w AS (SELECT *, CASE turn % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight FROM s),
o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (ORDER BY cap / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w),
c AS (SELECT *, rest::DOUBLE * weight > cap::DOUBLE * weights AS capped FROM o),
l AS (SELECT rest, weights FROM c WHERE NOT capped ORDER BY cap / weight, turn LIMIT 1),
t AS (SELECT c.source, c.source_size, least(cap::DOUBLE, CASE WHEN capped THEN cap::DOUBLE ELSE l.rest::DOUBLE * weight / l.weights END) AS target FROM c, l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, least(floor(t.target + 0.5)::BIGINT, 3 * t.source_size) AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + greatest(0, least(size, CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END - start)))::BIGINT AS taken FROM p
"""
