"""Readers: documents, denylists, conversations, interleaved files, TFRecords, curves."""

from __future__ import annotations

import gzip
import io
import json
import struct
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions import text as X
from grainmill.operators.selection import seeded

#: Suffixes of whole-file documents.
TEXT_SUFFIXES = (".txt", ".md", ".rst", ".py", ".js", ".ts", ".java", ".rs", ".go")
DOCUMENT = "text string, source string, doc_id string, license string, meta string"
CONVERSATION = "messages array<struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:string>>,tool_response:string>>, tools array<struct<name:string,description:string,parameters:string>>, meta string"


def _glob(suffixes: tuple[str, ...]) -> str:
    return "*{" + ",".join(suffixes) + "}"


def _bounded(value: Column, most: int) -> Column:
    return F.when(F.octet_length(value) <= most, value).otherwise(F.raise_error(F.lit("a record is larger than allowed")).cast("string"))


def json_documents(spark: SparkSession, path: str, *, max_bytes: int = 8 << 20) -> DataFrame:
    """Documents of .jsonl and .ndjson files: the first string of text, content and code; the id is doc_id, id or the text's hash."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", _glob((".jsonl", ".ndjson"))).text(path).where(F.trim("value") != "")
    record = F.from_json(_bounded(F.col("value"), max_bytes), "text string, content string, code string, doc_id string, id string, source string, license string, meta string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.select(record.alias("r"), F.col("_metadata.file_path").alias("path"))
    text = F.coalesce("r.text", "r.content", "r.code")
    ok = F.when(F.col("r._bad").isNotNull(), F.raise_error(F.lit("a line is not JSON")).cast("string")).otherwise(text)
    return rows.select(ok.alias("text"), F.coalesce("r.source", "path").alias("source"), F.coalesce("r.doc_id", "r.id", F.sha2(text, 256)).alias("doc_id"), F.coalesce("r.license", F.lit("unknown")).alias("license"), F.coalesce("r.meta", F.lit("{}")).alias("meta")).where("text is not null")


def file_documents(spark: SparkSession, path: str, *, max_bytes: int = 8 << 20) -> DataFrame:
    """Whole files as documents, decoded with replacement characters; the path is source and id."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _glob(TEXT_SUFFIXES)).load(path)
    size = F.when(F.col("length") <= max_bytes, F.col("content")).otherwise(F.raise_error(F.lit("a file is larger than allowed")).cast("binary"))
    return rows.select(F.make_valid_utf8(size.cast("string")).alias("text"), F.col("path").alias("source"), F.col("path").alias("doc_id"), F.lit("unknown").alias("license"), F.lit("{}").alias("meta"))


def documents(spark: SparkSession, path: str, *, max_bytes: int = 8 << 20) -> DataFrame:
    """JSON lines and whole files below a path."""
    return json_documents(spark, path, max_bytes=max_bytes).unionByName(file_documents(spark, path, max_bytes=max_bytes))


def denylist(spark: SparkSession, path: str) -> DataFrame:
    """(text, norm) of evaluation prompts in a suite ({"cases": [...]}), JSON lines or plain lines; one of each normalised text.

    Of a record counts the first of prompt, query, instruction, text, content, else its user messages.
    """
    files = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(path)
    fields = "prompt string, query string, instruction string, text string, content string, messages array<struct<role:string,content:string>>"
    suite = F.from_json("value", f"cases array<struct<{fields.replace(' string', ':string').replace('messages array', 'messages:array')}>>")
    cases = files.select(F.explode(F.coalesce(suite["cases"], F.array())).alias("r"))
    lines = files.where(suite["cases"].isNull()).select(F.explode(F.split("value", "\r?\n")).alias("line")).where(F.trim("line") != "")
    record = F.from_json("line", fields)
    parsed = lines.withColumn("r", F.when(F.trim("line").startswith("{"), record))
    said = lambda r: F.coalesce(*(r[k] for k in ("prompt", "query", "instruction", "text", "content")), F.nullif(F.array_join(F.transform(F.filter(r["messages"], lambda m: m["role"] == "user"), lambda m: m["content"]), "\n"), F.lit("")))
    rows = cases.select(said(F.col("r")).alias("text")).union(parsed.select(F.when(F.col("r").isNull(), F.col("line")).otherwise(said(F.col("r"))).alias("text")))
    rows = rows.withColumn("norm", X.match_text(F.col("text"))).where("norm <> ''")
    return rows.groupBy("norm").agg(F.min("text").alias("text")).select("text", "norm")


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """Conversation JSON lines under the fixed schema; a line that doesn't parse is an error."""
    return spark.read.schema(CONVERSATION).option("mode", "FAILFAST").json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The elements of files that hold one JSON array each."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def parquet_text(spark: SparkSession, path: str, column: str, schema: T.StructType) -> DataFrame:
    """One text column of files that must have exactly the given schema; nothing else is read."""
    found = spark.read.parquet(path)
    if found.schema.jsonValue()["fields"] != schema.jsonValue()["fields"] and [(f.name, f.dataType) for f in found.schema] != [(f.name, f.dataType) for f in schema]:
        raise ValueError("the files have another schema")
    return found.select(F.col(column).alias("text"))


def select_files(spark: SparkSession, paths: list[str], seed: int, k: int) -> list[str]:
    """k of the paths, the first by the hash of seed and path."""
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    return [r.path for r in rows.orderBy(seeded(seed, F.col("path")), "path").limit(k).collect()]


def round_robin(frames: list[DataFrame], order: list[str]) -> DataFrame:
    """Rows of several sources, one of each in turn: (turn, source) numbers say the order. A source's turns are ranks over ranges of the order's first column, as a range sort deals them, so that no source is one task."""
    from grainmill.operators.ranking import global_rank

    ranked = []
    for number, frame in enumerate(frames):
        found = frame.stat.approxQuantile(order[0], [k / 64 for k in range(1, 64)], 0.01) if isinstance(frame.schema[order[0]].dataType, T.NumericType) else []
        cuts = F.array(*map(F.lit, sorted(set(found)))).cast("array<double>")
        stretch = F.size(F.filter(cuts, lambda c: c < F.col(order[0]).cast("double"))) if found else F.substring(F.col(order[0]).cast("string"), 1, 4)
        ranked.append(global_rank(frame.withColumn("__g", stretch), "__g", [F.col(c) for c in order], "turn").drop("__g").withColumn("source_number", F.lit(number)))
    return reduce(DataFrame.unionByName, ranked)


def crc32c(data: bytes) -> int:
    """Castagnoli's checksum."""
    table = crc32c.table  # type: ignore[attr-defined]
    crc = 0xFFFFFFFF
    for b in data:
        crc = crc >> 8 ^ table[(crc ^ b) & 0xFF]
    return crc ^ 0xFFFFFFFF


def _castagnoli() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


crc32c.table = _castagnoli()  # type: ignore[attr-defined]


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def tfrecords(data: bytes) -> Iterator[bytes]:
    """The records of a TFRecord file, plain or gzipped; a wrong checksum or a cut record is an error."""
    stream = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while head := stream.read(12):
        if len(head) < 12 or masked(crc32c(head[:8])) != struct.unpack("<I", head[8:])[0]:
            raise ValueError("a record's length is damaged")
        body, tail = stream.read(struct.unpack("<Q", head[:8])[0]), stream.read(4)
        if len(tail) < 4 or masked(crc32c(body)) != struct.unpack("<I", tail)[0]:
            raise ValueError("a record is damaged")
        yield body


def protobuf_fields(data: bytes) -> list[tuple[int, int, int | bytes]]:
    """(field, wire type, value) of a message: varints as numbers, the rest as bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 0x7F) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 0x80:
                return value, at

    out, at = [], 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                if kind != 2:
                    raise ValueError("an unknown wire type")
                size, at = varint(at)
            if at + size > len(data):
                raise ValueError("a field is cut off")
            value, at = data[at : at + size], at + size
        out.append((key >> 3, kind, value))
    return out


def tfrecord_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, data) of the TFRecord files below a path, a file at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                records = list(tfrecords(content.as_py()))
                yield pa.record_batch([pa.array([name.as_py()] * len(records), pa.string()), pa.array(range(len(records)), pa.int64()), pa.array(records, pa.binary())], names=["path", "record", "data"])

    return files.mapInArrow(run, "path string, record bigint, data binary")


def chapters(rows: DataFrame, text: str = "text", least: int = 200) -> DataFrame:
    """Pieces of books between chapter headings, of ``least`` characters or more, numbered."""
    pieces = F.transform(F.split(text, r"(?im)^\s*chapter\s+[ivxlcdm0-9]+\b.*$"), X.strip)
    return rows.select("*", F.posexplode(F.filter(pieces, lambda p: F.length(p) >= least)).alias("piece", "piece_text"))


#: Fields that hold turns, and fields that hold text, of records of unknown shape.
TURN_FIELDS = ("messages", "conversations", "conversation", "turns", "dialog", "dialogue")
TEXT_FIELDS = ("text", "content", "value", "prompt", "response", "completion", "output", "answer", "question", "instruction", "input", "body", "chosen", "rejected", "story", "document")


def spans(value: str, least: int = 40) -> list[str]:
    """Text of a JSON record of any shape, line feeds as spaces: what its turns and its text fields say, and where it has neither, every string longer than ``least``."""

    def said(v) -> list[str]:
        if isinstance(v, str):
            return [v] if v.strip() else []
        if isinstance(v, list):
            return [x for item in v for x in said(item)]
        if isinstance(v, dict):
            return [x for k in (*TURN_FIELDS, *TEXT_FIELDS) if k in v for x in said(v[k])]
        return []

    def any_text(v) -> list[str]:
        if isinstance(v, str):
            return [v] if len(v) > least else []
        inside = v if isinstance(v, list) else list(v.values()) if isinstance(v, dict) else []
        return [x for item in inside for x in any_text(item)]

    record = json.loads(value)
    found = said(record) if isinstance(record, (dict, list)) else []
    return [x.replace("\n", " ").strip() for x in found or any_text(record)]


def record_texts(rows: DataFrame, column: str = "value", *, least: int = 40, min_chars: int = 40) -> DataFrame:
    """(record, part, text, chars) of JSON records, at least ``min_chars`` long; a record that isn't JSON is an error. ``record`` is the SHA-256 of the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[t for t in spans(v, least) if len(t) >= min_chars] if v else [] for v in batch.column(1).to_pylist()]
            at = pa.array([k for k, own in enumerate(found) for _ in own], pa.int64())
            yield pa.record_batch([batch.column(0).take(at), pa.array([i for own in found for i in range(len(own))], pa.int32()), pa.array([t for own in found for t in own], pa.string())], names=["record", "part", "text"])

    out = rows.select(F.sha2(column, 256).alias("record"), column).mapInArrow(run, "record string, part int, text string")
    return out.withColumn("chars", F.length("text"))


def shard_sources(paths: DataFrame, path: str = "path") -> DataFrame:
    """(source, path): shards by the part of their file name before the last dash or underscore and number; a file without a number is a source of its own."""
    name = F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z0-9]+)*$", 1)
    return paths.select(F.regexp_replace(name, r"[-_][0-9]+(?:[-_]of[-_][0-9]+)?$", "").alias("source"), F.col(path).alias("path"))


def select_shards(shards: DataFrame, wanted: list[str]) -> DataFrame:
    """The shards of the wanted sources; an unknown source is an error at once."""
    names = shards.sparkSession.createDataFrame([(w,) for w in sorted(set(wanted))], "source string")
    if unknown := [r.source for r in names.join(shards.select("source").distinct(), "source", "left_anti").collect()]:
        raise ValueError(f"unknown sources: {sorted(unknown)}")
    return shards.join(F.broadcast(names), "source", "left_semi")


def without_files(rows: DataFrame, refused: list[str], path: str = "path") -> DataFrame:
    """Rows whose file name is not on a list of refused ones."""
    return rows.where(~F.regexp_extract(path, r"([^/]*)$", 1).isin(refused))


def conversation_sources(spark: SparkSession, specs: list[dict]) -> DataFrame:
    """Conversations of several sources with ``origin`` and ``weight``. A spec has name and path, and may have weight (1) and sha256, the multiset fingerprint sum that its rows must have."""
    from grainmill.operators import governance

    frames = []
    for spec in specs:
        if unknown := set(spec) - {"name", "path", "weight", "sha256"}:
            raise ValueError(f"unknown keys: {sorted(unknown)}")
        weight = float(spec.get("weight", 1))
        if not 0 < weight < float("inf"):
            raise ValueError(f"the weight of {spec['name']} must be positive")
        rows = conversations(spark, spec["path"])
        if "sha256" in spec and governance.multiset_fingerprint(rows.select(F.to_json(F.struct(*rows.columns)).alias("v")), "v").first()["sum"] != spec["sha256"]:
            raise ValueError(f"{spec['name']} has other rows than its fingerprint says")
        frames.append(rows.withColumn("origin", F.lit(spec["name"])).withColumn("weight", F.lit(weight)))
    return reduce(DataFrame.unionByName, frames)
