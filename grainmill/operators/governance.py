"""Fingerprints, freeze audits, derived corpora, manifests."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.canonical import canonical


def multiset_fingerprint(values: DataFrame, column: str) -> DataFrame:
    """(count, sum, xor): equal for equal multisets, whatever the order. The sum of the SHA-256 values modulo 2 ** 256, added up in eight decimal words, and their xor; nulls don't count."""
    h = F.sha2(F.col(column), 256)
    word = [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)") for k in range(8)]
    sums = [F.coalesce(F.sum(w), F.lit(0).cast("decimal(30,0)")).alias(f"w{k}") for k, w in enumerate(word)]
    xors = [F.lower(F.lpad(F.hex(F.coalesce(F.bit_xor(w.cast("bigint")), F.lit(0).cast("bigint"))), 8, "0")) for w in word]
    found = values.agg(F.count(column).alias("count"), *sums, F.concat(*xors).alias("xor"))
    base, carry, digits = F.lit(1 << 32).cast("decimal(20,0)"), F.lit(0).cast("decimal(30,0)"), []
    for k in range(7, -1, -1):
        total = (F.col(f"w{k}") + carry).cast("decimal(38,0)")
        digits.insert(0, F.lower(F.lpad(F.hex((total % base).cast("bigint")), 8, "0")))
        carry = F.floor(total / base).cast("decimal(30,0)")
    return found.select("count", F.concat(*digits).alias("sum"), "xor")


def set_fingerprint(values: DataFrame, column: str, group_values: int = 4096) -> DataFrame:
    """(count, fingerprint): distinct values hashed level by level, by their first hash digits, so that no task has more than some thousands of them together: two digits for up to 256 groups, three more
    for each further level that the number of values asks for."""
    h = values.select(F.sha2(F.col(column).cast("string"), 256).alias("h")).distinct()
    n, digits = h.count(), 2
    while n > group_values * 16**digits:
        digits += 3
    level = h.select(F.col("h").alias("g"), F.col("h").alias("d"), F.lit(1).cast("bigint").alias("n"))
    while True:
        folded = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]), "\n"), 256)
        counted = F.coalesce(F.sum("n"), F.lit(0)).alias("n" if digits else "count")
        if not digits:
            return level.agg(counted, folded.alias("fingerprint"))
        level = level.groupBy(F.substring("g", 1, digits).alias("p")).agg(counted, folded.alias("d")).select(F.col("p").alias("g"), "d", "n")
        digits -= 3 if digits > 2 else 2


def split_audit(assignments: DataFrame) -> DataFrame:
    """(identities, in_two_splits, repeated_content) of (identity, document_sha256, split)."""
    a = assignments.groupBy("identity").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).agg(F.count(F.lit(1)).alias("identities"), F.count_if(F.col("lo") != F.col("hi")).alias("in_two_splits"))
    b = assignments.groupBy("document_sha256").agg(F.min("split").alias("lo"), F.max("split").alias("hi"), F.count(F.lit(1)).alias("n"))
    b = b.agg(F.count_if(F.col("n") > 1).alias("repeated_content"), F.count_if(F.col("lo") != F.col("hi")).alias("content_in_two_splits"))
    return a.crossJoin(F.broadcast(b))


def derived(docs: DataFrame, groups: dict[str, list[str]], source: str = "source") -> DataFrame:
    """Adds ``corpus``: each source belongs to one group at most; documents of other sources go."""
    owner: dict[str, str] = {}
    for name, sources in groups.items():
        for s in sources:
            if s in owner:
                raise ValueError(f"{s} is in two groups")
            owner[s] = name
    table = docs.sparkSession.createDataFrame(sorted(owner.items()), f"{source} string, corpus string")
    return docs.join(F.broadcast(table), source)


def manifest(fields: dict) -> dict:
    """The fields and, as ``sha256``, the hash of their canonical JSON."""
    return fields | {"sha256": hashlib.sha256(canonical(fields).encode()).hexdigest()}


def verify_manifest(found: dict) -> None:
    if manifest({k: v for k, v in found.items() if k != "sha256"}) != found:
        raise ValueError("the manifest doesn't match its hash")


def append_unseen(pool: DataFrame, new: DataFrame, digest: str) -> DataFrame:
    """The pool and those new rows whose digest it doesn't have, one of each."""
    fresh = new.join(pool.select(digest), digest, "left_anti").dropDuplicates([digest])
    return pool.unionByName(fresh, allowMissingColumns=True)


def missing_suites(required: DataFrame, supplied: DataFrame, name: str = "name", digest: str = "sha256") -> DataFrame:
    """Required suites that are absent, or there with another hash."""
    return required.join(supplied, [name, digest], "left_anti")


def known_keys_only(value: Column, allowed: list[str]) -> Column:
    """True if a JSON object has no key beyond the allowed ones."""
    return F.size(F.array_except(F.json_object_keys(value), F.array(*map(F.lit, allowed)))) == 0


def catalog_problems(entries: DataFrame, families: list[str]) -> DataFrame:
    """(id, problem) of a catalog's entries (id, family, source_url, access, policy, license): repeated_id, family, url, access (training rows must be open to all), license (and reviewed). No rows mean a valid catalog."""
    twice = entries.groupBy("id").agg(F.count(F.lit(1)).alias("__n"))
    train = F.col("policy") == "train"
    problem = (
        F.when(F.col("__n") > 1, "repeated_id")
        .when(~F.coalesce(F.col("family").isin(families), F.lit(False)), "family")
        .when(~F.coalesce(F.col("source_url").rlike("^https://[^/ ]+"), F.lit(False)), "url")
        .when(~F.coalesce(F.col("policy").isin("train", "eval_only", "excluded"), F.lit(False)), "policy")
        .when(train & ~F.coalesce(F.col("access") == "public_download", F.lit(False)), "access")
        .when(train & F.lower(F.coalesce("license", F.lit("unknown"))).isin("", "unknown", "unverified", "terms_review"), "license")
    )
    return entries.join(twice, "id").select("id", problem.alias("problem")).where("problem is not null").distinct()
