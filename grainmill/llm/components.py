"""Connected components by alternating large-star and small-star steps (Kiveris and others, 2014), on DataFrames.

Each step is an aggregation and a join, and is written to the shared folder, so lineage stays short and nothing is
collected but a count and a checksum. A vertex with very many neighbours is met by partial aggregation and by
a join that Spark splits when it is skewed, never by a list of its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("b", "a") % 1000003), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) undirected links of comparable ids to (node, component): every linked node and the smallest one it reaches.

    Self-links and links with a null end have no effect; repeated links count once. No links give an empty table.
    """
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    ends = written(ends, "links")
    seen = _mark(ends)
    while seen[0]:
        # large star: every neighbour larger than u joins the smallest of u and its neighbours
        both = ends.union(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u and its neighbours not larger than u join the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ends = written(small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links")
        now = _mark(ends)
        if now == seen:
            break
        seen = now
    return ends.select(F.col("a").alias("node"), F.col("b").alias("component")).union(ends.select("b", "b").distinct())
