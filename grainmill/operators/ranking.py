"""Global ranks and running sums without a single-task window.

A caller names a ``coarse`` column: a value that follows the wanted order and has bounded groups (a hash prefix, a
length class). Counts per coarse value are summed up in a window over those few values; the exact order is settled inside each group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def hash_group(digest: Column, rows: int, group_rows: int = 4096) -> Column:
    """The interval of a hexadecimal digest when the rows make groups of about group_rows."""
    groups = max(1, -(-rows // group_rows))
    return F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") * F.lit(groups) / F.lit(1 << 32)).cast("bigint")


def global_rank(df: DataFrame, coarse: str, order: list[Column], name: str = "rank", *, by: list[str] | None = None, amount: str | None = None) -> DataFrame:
    """Adds ``name``: the number of rows (or the sum of ``amount``) before each row, within ``by`` if given. Starts at 0."""
    by = by or []
    value = F.col(amount) if amount else F.lit(1)
    sums = df.groupBy(*by, coarse).agg(F.sum(value).alias("__sum"))
    before = W.partitionBy(*by).orderBy(coarse).rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("__start", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    inside = W.partitionBy(*by, coarse).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = df.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    keys = [*by, coarse]
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    out = out.alias("a").join(starts.alias("b"), same).select("a.*", "b.__start")
    return out.withColumn(name, F.col("__start") + F.col("__inside")).drop("__start", "__inside")
