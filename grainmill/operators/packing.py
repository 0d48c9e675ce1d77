"""Byte tokens, token rows of fixed length, shards, and training pairs from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EOS = 0


def byte_ids(text: Column) -> Column:
    """The UTF-8 bytes of a text as numbers."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("[0-9A-F]{2}"), 0)
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int"))


def byte_encoder() -> Callable[[str], list[int]]:
    """The byte tokenizer as pack() wants it."""
    return lambda text: list((text or "").encode())


def packed(documents: Iterator[list[int]], row_tokens: int, eos: int = EOS) -> Iterator[list[int]]:
    """Token rows of at most row_tokens: each starts with the end mark and ends with it, documents stand between marks and go on in the next row."""
    row = [eos]
    for ids in documents:
        at = 0
        while at < len(ids):
            room = row_tokens - 1 - len(row)
            if room < 1:
                yield row if row[-1] == eos else [*row, eos]
                row = [eos]
                room = row_tokens - 2
            piece = ids[at : at + room]
            at += len(piece)
            row = [*row, *piece, eos]
            if at < len(ids):
                yield row
                row = [eos]
    if len(row) > 1:
        yield row


def pack(docs: DataFrame, *, split: str, group: str, order: list[str], ids: str, row_tokens: int, encode: Callable | None = None, eos: int = EOS) -> DataFrame:
    """(split, group, row, tokens, length) of documents in order, one sequence for each split and group.

    Packing is a sequence by nature: groups are what is done in parallel, and each adds one short row at most. Rows
    stream through a task; none holds more than a batch and a row. With encode, ``ids`` is text and encode
    a function that makes an encoder in the worker.
    """
    rows = docs.select(F.col(split).alias("split"), F.col(group).cast("bigint").alias("grp"), F.col(ids).alias("ids"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))
    rows = rows.repartition("split", "grp").sortWithinPartitions("split", "grp", *(f"o{i}" for i in range(len(order)))).select("split", "grp", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encode() if encode else None

        def documents() -> Iterator[tuple]:
            for batch in batches:
                for s, g, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield (s, g), (encoder(x) if encoder else x) or []

        def groups() -> Iterator[tuple]:
            stream, held = documents(), []

            def own(key) -> Iterator[list[int]]:
                yield held.pop()[1]
                for k, x in stream:
                    if k != key:
                        held.append((k, x))
                        return
                    yield x

            for first in stream:
                held.append(first)
                while held:
                    key = held[0][0]
                    yield key, own(key)

        for (s, g), own in groups():
            out = []
            for k, row in enumerate(packed(own, row_tokens, eos)):
                out.append((s, g, k, row, len(row)))
                if len(out) == 512:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return rows.mapInArrow(run, "split string, grp bigint, row bigint, tokens array<int>, length int")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["split", "grp", "row", "tokens", "length"])


def shards(rows: DataFrame, rows_per_shard: int) -> DataFrame:
    """Adds ``shard`` and the SHA-256 of each row's ids."""
    return rows.withColumn("shard", F.floor(F.col("row") / rows_per_shard)).withColumn("sha256", F.sha2(F.array_join("tokens", ","), 256))


def pairs(rows: DataFrame, row_tokens: int) -> DataFrame:
    """Adds x and y: inputs and targets shifted by one, padded to row_tokens - 1; targets beyond the row's length are -100."""
    fill = F.array_repeat(F.lit(EOS), row_tokens)
    x = F.slice(F.concat("tokens", fill), 1, row_tokens - 1)
    y = F.slice(F.concat(F.slice("tokens", 2, row_tokens), F.array_repeat(F.lit(-100), row_tokens)), 1, row_tokens - 1)
    return rows.withColumn("x", x).withColumn("y", y)


def encoded(docs: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids) by the tokenizers library and a vocabulary file that is there on every machine, whole texts, nothing added or cut; null counts as empty. Tokenizers are given, never trained."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for batch in batches:
            ids = [e.ids for e in tokenizer.encode_batch_fast([t or "" for t in batch.column(1).to_pylist()], add_special_tokens=False)]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["k", "ids"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"k {docs.schema[key].dataType.simpleString()}, ids array<int>").withColumnRenamed("k", key)


def token_lengths(docs: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, n): how many tokens each text has."""
    return encoded(docs, key, text, path).select(key, F.size("ids").alias("n"))


def padded(rows: DataFrame, row_tokens: int) -> DataFrame:
    """Rows of exactly row_tokens: ``tokens`` filled up with the end mark, ``length`` as it was."""
    fill = F.array_repeat(F.lit(EOS), row_tokens)
    return rows.withColumn("tokens", F.slice(F.concat("tokens", fill), 1, row_tokens))


def write_shards(rows: DataFrame, path: str, rows_per_shard: int, row_tokens: int) -> dict:
    """Padded rows as a generation with folders for splits and shards, and a manifest that has, for each shard, its rows, tokens and the SHA-256 of its rows' ids."""
    from grainmill.sources import sinks

    made = shards(padded(rows, row_tokens), rows_per_shard)
    each = made.groupBy("split", "grp", "shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("length").alias("tokens"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "sha256"))), lambda r: r["sha256"]), ""), 256).alias("sha256"))
    parts = [r.asDict() for r in each.orderBy("split", "grp", "shard").collect()]
    return sinks.write_generation(made, path, "shards", ["split", "shard"], {"row_tokens": row_tokens, "shards": parts})
