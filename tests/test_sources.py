import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F

from grainmill.operators import selection
from grainmill.sources import readers, sinks
from grainmill.streaming import streams


def test_documents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text('{"text": "", "content": "later"}\n\n{"content": "c", "id": "i", "license": "mit"}\n')
    (tmp_path / "b.md").write_bytes(b"whole \xff file")
    rows = {r.text: r for r in readers.documents(spark, str(tmp_path)).collect()}
    assert set(rows) == {"", "c", "whole � file"}
    assert rows["c"].doc_id == "i" and rows["c"].license == "mit" and len(rows[""].doc_id) == 64


def test_record_bound(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text(json.dumps({"text": "a" * 100}))
    with pytest.raises(Exception, match="larger than allowed"):
        readers.json_documents(spark, str(tmp_path), max_bytes=50).collect()


def test_denylist(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": 1, "cases": [{"query": "What is it?"}, {"messages": [{"role": "user", "content": "one"}, {"role": "assistant", "content": "no"}]}]}))
    (tmp_path / "b.txt").write_text("plain line\nwhat  is it ?\n")
    (tmp_path / "c.jsonl").write_text('{"text": "t", "prompt": "p"}\n')
    assert {r.norm for r in readers.denylist(spark, str(tmp_path)).collect()} == {"what is it ?", "one", "plain line", "p"}


def test_tfrecords(spark, tmp_path):
    def record(body):
        head = struct.pack("<Q", len(body))
        return head + struct.pack("<I", readers.masked(readers.crc32c(head))) + body + struct.pack("<I", readers.masked(readers.crc32c(body)))

    assert readers.crc32c(b"123456789") == 0xE3069283
    (tmp_path / "x.tfrecord").write_bytes(gzip.compress(record(b"one") + record(b"")))
    assert [bytes(r.data) for r in readers.tfrecord_files(spark, str(tmp_path)).orderBy("record").collect()] == [b"one", b""]
    with pytest.raises(ValueError):
        list(readers.tfrecords(record(b"one")[:-1] + b"\0"))
    assert readers.protobuf_fields(b"\x08\x96\x01\x12\x02hi") == [(1, 0, 150), (2, 2, b"hi")]


def test_chapters_and_spans(spark):
    book = "Chapter I\n" + "a" * 210 + "\nCHAPTER 2 x\nshort\nchapter iii\n" + "b" * 220
    rows = readers.chapters(spark.createDataFrame([(book,)], "text string")).collect()
    assert [len(r.piece_text) for r in rows] == [210, 220]
    assert readers.spans(json.dumps({"messages": [{"content": "x" * 50}, {"content": "no"}], "other": "y" * 60})) == ["x" * 50, "no"]
    assert readers.spans(json.dumps({"a": {"b": ["short", "z" * 41]}, "n": 4})) == ["z" * 41]
    assert readers.spans(json.dumps({"turns": [{"value": "v"}], "chosen": "c\nd", "meta": "m" * 99})) == ["v", "c d"]


def test_round_robin(spark):
    frames = [spark.createDataFrame([(k, i) for i in range(3 + k)], "s int, i int") for k in range(2)]
    out = readers.round_robin(frames, ["i"]).orderBy("turn", "source_number").collect()
    assert [(r.s, r.i) for r in out[:4]] == [(0, 0), (1, 0), (0, 1), (1, 1)] and len(out) == 7


def test_parquet_text_checks_schema(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "text string, n int").write.parquet(str(tmp_path / "p"))
    good = spark.read.parquet(str(tmp_path / "p")).schema
    assert readers.parquet_text(spark, str(tmp_path / "p"), "text", good).columns == ["text"]
    with pytest.raises(ValueError):
        readers.parquet_text(spark, str(tmp_path / "p"), "text", spark.range(1).schema)


def test_generations(spark, tmp_path):
    path = str(tmp_path / "g")
    sinks.write_generation(spark.range(5).toDF("a"), path, "one")
    assert sinks.read_generation(spark, path).count() == 5
    spark.range(9).toDF("a").write.parquet(f"{path}/two")  # a crash before the manifest
    assert sinks.read_generation(spark, path).count() == 5
    sinks.write_generation(spark.range(9).toDF("a"), path, "two")
    assert sinks.read_generation(spark, path).count() == 9
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "doc_id int, text string")
    found = sinks.write_assignments(selection.split_documents(docs, 0.2, 1), docs, str(tmp_path / "s"))
    assert found["rows"] == 10 and len(found["fingerprint"]) == 64


def run(query):
    query.processAllAvailable()
    query.stop()


def test_curve_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    points = [{"run": "r", "stage": "s", "step": k, "loss": 2.0 - k, "sources": {"a": {"draws": 1, "tokens": 10 * (k + 1), "loss": float(k)}}} for k in range(2)]
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(map(json.dumps, points)))
    assert [r.step for r in readers_curve(spark, tmp_path)] == [0, 1]
    assert streams.source_losses(streams.read_curve(spark, str(tmp_path / "in"))).first().loss == pytest.approx(20 / 30)
    run(streams.curve_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("curve").start())
    assert spark.table("curve").count() == 2


def readers_curve(spark, tmp_path):
    return streams.read_curve(spark, str(tmp_path / "in")).collect()


def test_streams_over_events(spark, tmp_path):
    rows = spark.createDataFrame([("a", "d1", 5, "2024-01-01 00:00:00"), ("a", "d1", 7, "2024-01-01 00:01:00"), ("b", "d2", 9, "2024-01-01 00:20:00"), ("a", "d3", 3, "2024-01-01 00:50:00")], "source string, digest string, n int, ts string")
    rows = rows.withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run(streams.dedup_stream(stream(), "digest", "ts").writeStream.format("memory").queryName("dd").start())
    assert spark.table("dd").count() == 3
    run(streams.windowed_counts(stream(), "ts", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("wc").start())
    assert sorted(r.n for r in spark.table("wc").collect()) == [1, 1, 2]
    run(streams.running_budget(stream(), "source", "n", 6).writeStream.outputMode("update").format("memory").queryName("rb").start())
    assert {(r.source, r.taken, r.rows) for r in spark.table("rb").collect()} == {("a", 12, 2), ("b", 9, 1)}
    run(streams.sessions(stream(), "ts", "5 minutes", ["source"]).writeStream.outputMode("complete").format("memory").queryName("ss").start())
    assert spark.table("ss").count() == 3


def test_record_texts(spark):
    rows = spark.createDataFrame([(json.dumps({"messages": [{"content": "a" * 45}, {"content": "b"}], "text": "c" * 60}),), (json.dumps({"x": "d" * 50}),), (None,)], "value string")
    out = readers.record_texts(rows).collect()
    assert sorted((r.part, r.text[0], r.chars) for r in out) == [(0, "a", 45), (0, "d", 50), (1, "c", 60)]


def test_shards_and_refusals(spark):
    paths = spark.createDataFrame([("/d/web-0001.jsonl.gz",), ("/d/web-2.parquet",), ("/d/code_00-of-07.txt",), ("/d/notes.md",)], "path string")
    found = readers.shard_sources(paths)
    assert sorted((r.source, r.path.split("/")[-1]) for r in found.collect()) == [("code", "code_00-of-07.txt"), ("notes", "notes.md"), ("web", "web-0001.jsonl.gz"), ("web", "web-2.parquet")]
    assert readers.select_shards(found, ["web"]).count() == 2
    with pytest.raises(ValueError, match="unknown sources: \\['none'\\]"):
        readers.select_shards(found, ["web", "none"])
    assert readers.without_files(paths, ["notes.md"]).count() == 3


def test_conversation_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"messages": [{"role": "user", "content": "x"}]}) + "\n")
    rows = readers.conversation_sources(spark, [{"name": "a", "path": str(tmp_path / "a.jsonl"), "weight": 2}, {"name": "b", "path": str(tmp_path)}])
    assert sorted((r.origin, r.weight) for r in rows.collect()) == [("a", 2.0), ("b", 1.0)]
    for bad in ({"weight": 0}, {"sha256": "0"}, {"color": 1}):
        with pytest.raises(ValueError):
            readers.conversation_sources(spark, [{"name": "a", "path": str(tmp_path), **bad}])


def test_intermediate_tables_go(spark, tmp_path, monkeypatch):
    from grainmill.sources import shared

    monkeypatch.setattr(shared, "new_folder", lambda spark: f"file://{tmp_path}/t{len(list(tmp_path.iterdir()))}")
    monkeypatch.setattr(shared, "_WRITTEN", [])
    cut = shared.parquet_checkpoint(spark)
    assert cut(spark.range(5)).count() == 5 and cut(spark.range(6)).count() == 6 and len(list(tmp_path.iterdir())) == 2
    assert shared.cleanup(spark) == 2 and not list(tmp_path.iterdir())
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared._own_folder("yarn")
