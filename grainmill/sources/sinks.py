"""Sinks: filtered documents, split assignments, packed rows, pools. Data first, the manifest last."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.operators import governance


def write_documents(docs: DataFrame, path: str) -> None:
    """JSON lines, compressed."""
    docs.write.mode("overwrite").option("compression", "gzip").json(path)


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Through a temporary name and a rename, in whatever file system the path is in."""
    fs, place = _fs(spark, path)
    _, temporary = _fs(spark, f"{path}.tmp")
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(place, False)
    fs.rename(temporary, place)


def _read_text(spark: SparkSession, path: str) -> str:
    return "".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())


def write_record(spark: SparkSession, path: str, record: dict) -> None:
    """A small JSON record, whole or not at all."""
    _write_text(spark, path, json.dumps(record, sort_keys=True))


def read_record(spark: SparkSession, path: str) -> dict | None:
    """The record at a path; null if there is none."""
    fs, place = _fs(spark, path)
    return json.loads(_read_text(spark, path)) if fs.exists(place) else None


def write_generation(rows: DataFrame, path: str, name: str, partition_by: list[str] | None = None, fields: dict | None = None) -> dict:
    """Writes a new generation below path, then lets the manifest name it: readers see the old one or the new one whole."""
    target = f"{path}/{name}"
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target)
    spark = rows.sparkSession
    found = governance.manifest({"generation": name, "rows": spark.read.parquet(target).count(), "schema": rows.schema.simpleString()} | (fields or {}))
    _write_text(spark, f"{path}/manifest.json", json.dumps(found, sort_keys=True))
    return found


def read_generation(spark: SparkSession, path: str) -> DataFrame:
    """The generation that the manifest names, if manifest and rows agree."""
    found = json.loads(_read_text(spark, f"{path}/manifest.json"))
    governance.verify_manifest(found)
    rows = spark.read.parquet(f"{path}/{found['generation']}")
    if rows.count() != found["rows"]:
        raise ValueError("the generation has another number of rows")
    return rows


def write_assignments(split: DataFrame, docs: DataFrame, path: str, *, key: str = "doc_id") -> dict:
    """(identity, document_sha256, split) with a manifest that holds the set's fingerprint."""
    rows = split.join(docs.select(key, F.sha2("text", 256).alias("document_sha256")), key).select("identity", "document_sha256", "split").distinct()
    mark = governance.set_fingerprint(rows.select(F.concat_ws(":", "identity", "document_sha256", "split").alias("v")), "v").first()
    return write_generation(rows, path, "assignments", fields={"fingerprint": mark["fingerprint"]})
