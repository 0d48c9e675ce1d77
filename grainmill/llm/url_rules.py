"""URL filters as a sort-merge range join.

A host's key is its labels in reverse, each ended by byte 1: ``blog.example.com`` becomes ``com\\1example\\1blog\\1``; bytes 1 and 2
inside a label are escaped by byte 2. A rule's host and all its subdomains are then exactly the keys that begin with the rule's key, an interval of the
sorted keys; intervals nest or are disjoint. URLs and rules are put in one order and swept: a stack holds
the rules whose interval the sweep is in, an entry for each host with its paths by length, so that very many rules of one host cost a look-up for
each length that they have. A URL takes, from the stack, the longest rule whose path its own path begins with.

Both sides are dealt by range. Cut points come from a sample of the URL keys, about SAMPLED for each partition, chosen by a hash threshold; a key carries a salt, so that a
host with very many URLs lies on both sides of cuts. Every rule goes to each partition that its interval touches. The intervals
that a cut falls into all begin with a prefix of that cut's host, so copies of rules are bounded by the depth of hosts, and no
rule table is broadcast.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import field, partitions, session

#: host, path, verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Sampled keys for each partition.
SAMPLED = 64


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty if there is none."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    safe = F.replace(F.replace(host, F.lit("\x02"), F.lit("\x02\x12")), F.lit("\x01"), F.lit("\x02\x11"))
    return F.concat(F.array_join(F.reverse(F.split(safe, r"\.", -1)), "\x01"), F.lit("\x01"))


def _end(key: str) -> str:
    """The first key after all that begin with this one."""
    return key[:-1] + "\x02"


class Entry:
    """The rules of one host: verdicts by path, and the lengths of the paths, longest first."""

    def __init__(self, key: str, host: str):
        self.key, self.host = key, host
        self.verdicts: dict[str, str] = {}
        self.lengths: list[int] = []

    def add(self, path: str, verdict: str) -> None:
        # of two equal rules, block wins
        if self.verdicts.get(path) != "block":
            self.verdicts[path] = verdict
        at = bisect_left(self.lengths, -len(path))
        if at == len(self.lengths) or self.lengths[at] != -len(path):
            self.lengths.insert(at, -len(path))

    def best(self, path: str) -> tuple[int, int, str, str] | None:
        """(length, length of the host, rule, verdict) of the longest rule that fits."""
        for n in self.lengths:
            start = path[:-n] if n else ""
            if len(start) == -n and start in self.verdicts:
                return len(self.host) - n, len(self.host), self.host + start, self.verdicts[start]
        return None


def sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """(part, key, kind, id, host, path, verdict), sorted by part, key, kind, to an answer for each URL.

    kind 0 is a rule, with its position in id's place left empty; kind 1 is a URL.
    """
    part, stack = None, []
    for batch in batches:
        keep, rules, verdicts = [], [], []
        columns = [batch.column(c).to_pylist() for c in (0, 1, 2, 4, 5, 6)]
        for k, (p, key, kind, host, path, verdict) in enumerate(zip(*columns, strict=True)):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1].key != key:
                    stack.append(Entry(key, host))
                stack[-1].add(path, verdict)
                continue
            best = max((found for e in stack if (found := e.best(path))), default=None)
            keep.append(k)
            rules.append(best[2] if best else None)
            verdicts.append(best[3] if best else default)
        rows = pa.array(keep, pa.int64())
        yield pa.record_batch([batch.column(3).take(rows), batch.column(4).take(rows), batch.column(5).take(rows), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=["i", "host", "path", "rule", "verdict"])


def apply_rules(pages: DataFrame, rules: DataFrame, *, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """Per row: the id, host, path, rule (host and path of the longest rule that fits, else null) and verdict.

    rules has host, path and verdict. Longest is by characters of host and path, then of the host; of two equal rules, block
    wins. A null url, or one without ://, has empty host and path, and only a rule with an empty host would fit: none
    does, it gets the default. Rules with a null or empty host are void, a null path counts as empty.
    Repeated rows are answered one by one; no rules give all rows the default; no pages give an empty table. URLs of any length are
    read whole. Other columns, whatever their names, are left out.
    """
    spark = session(pages)
    url = field(pages, url_column).cast("string")
    kind = pages.schema[id_column].dataType.simpleString()
    urls = pages.select(field(pages, id_column).alias("i"), host_of(url).alias("host"), path_of(url).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("salted", F.concat("key", F.lit("\x00"), F.lower(F.hex(F.xxhash64("path", F.col("i").cast("string"))))))
    count = partitions(spark)
    total = max(1, pages.count())
    below = min((1 << 62) - 1, (SAMPLED * count << 62) // total)
    sample = sorted(r.salted for r in urls.select("salted").where(F.shiftrightunsigned(F.xxhash64("salted"), 2) <= F.lit(below)).collect())
    cuts = sorted({sample[len(sample) * i // count] for i in range(1, count)}) if sample else []

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [bisect_right(cuts, s) for s in batch.column(4).to_pylist()]
            kinds = pa.array([1] * batch.num_rows, pa.int32())
            none = pa.nulls(batch.num_rows, pa.string())
            yield pa.record_batch([pa.array(places, pa.int32()), batch.column(3), kinds, batch.column(0), batch.column(1), batch.column(2), none], names=["part", "key", "kind", "i", "host", "path", "verdict"])

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, path, verdict, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, last = bisect_right(cuts, key), bisect_left(cuts, _end(key))
                rows += [(p, key, host, path, verdict) for p in range(first, last + 1)]
            places, keys, hosts, paths, verdicts = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.record_batch([pa.array(places, pa.int32()), pa.array(keys, pa.string()), pa.array([0] * len(rows), pa.int32()), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(verdicts, pa.string())], names=["part", "key", "kind", "host", "path", "verdict"])

    schema = "part int, key string, kind int, host string, path string, verdict string"
    left = urls.mapInArrow(parts, f"part int, key string, kind int, i {kind}, host string, path string, verdict string")
    host = F.translate(F.col("host"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    right = rules.where("host <> ''").select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict"))
    right = right.withColumn("key", host_key(F.col("host"))).mapInArrow(copies, schema)
    both = left.unionByName(right, allowMissingColumns=True)
    both = both.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "key", "kind")
    out = both.mapInArrow(lambda batches: sweep(batches, default), f"i {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("i", id_column)


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


ORACLE = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(h, p, v)),
m AS (SELECT u.page_id, u.host, u.path, r.h || r.p AS rule, r.v AS verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.h) + length(r.p) DESC NULLS LAST) AS n
      FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
