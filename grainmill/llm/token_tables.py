"""Token ids in sorted-string-table shards: documents keyed by identifier, looked up by binary search.

A shard, all integers little-endian:

    blocks   each: length u32, crc32 u32, then zlib of its entries
    entry    shared u16, rest u16, count u32, the rest of the key, count token ids
    index    zlib of, for each block: key length u16, its first key, offset u64, length u32, entries u32, tokens u64
    bloom    the bits of a Bloom filter over the identifiers
    footer   index offset u64, index length u32, bloom length u32, hashes u32, id bytes u32, entries u64, tokens u64,
             crc32 of index and bloom u32, version u32, magic

Keys sort as the documents do: byte 0 for a null identifier, else byte 1 and the identifier (a long as eight
big-endian bytes with the sign flipped, a string as UTF-8), then a four-byte number for rows that repeat an identifier in a shard.
In a block a key leaves out what it shares with the key before it. Token ids take two bytes if the vocabulary allows, else
four. Shards hold ascending, disjoint ranges; ``_manifest.json`` lists them and is written last.
"""

from __future__ import annotations

import bisect
import ctypes
import io
import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.llm.common import field, new_path, partitions, session

MAGIC, VERSION = b"GMSSTBL1", 1
FOOTER = struct.Struct("<QIIIIQQII8s")
ENTRY, BLOCK, PLACE = struct.Struct("<HHI"), struct.Struct("<II"), struct.Struct("<QIIQ")
#: Uncompressed bytes of a block, compressed bytes of a shard, Bloom bits for each document.
BLOCK_BYTES, SHARD_BYTES, BLOOM_BITS = 256 << 10, 256 << 20, 10


def key_of(ident: int | str | None) -> bytes:
    if ident is None:
        return b"\x00"
    return b"\x01" + (ident.encode() if isinstance(ident, str) else struct.pack(">Q", ident + (1 << 63)))


def ident_of(key: bytes, text: bool) -> int | str | None:
    if key[:1] == b"\x00":
        return None
    return key[1:].decode() if text else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _probes(ident: bytes, hashes: int, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(ident, 0), xxhash.xxh64_intdigest(ident, 1) | 1
    return [(a + i * b) % (1 << 64) % bits for i in range(hashes)]


class Writer:
    """Writes one shard to a binary stream; keys must come in order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.index, self.block, self.first, self.last = [], [], None, b""
        self.entries = self.tokens = self.held = self.block_tokens = 0
        self.idents: list[bytes] = []
        self.begin, self.end = None, None

    def add(self, ident: bytes, repeat: int, ids: bytes) -> None:
        key = ident + struct.pack(">I", repeat)
        shared = 0
        if self.first is None:
            self.first = key
        else:
            for a, b in zip(key, self.last, strict=False):
                if a != b:
                    break
                shared += 1
        count = len(ids) // self.width
        self.block.append(ENTRY.pack(shared, len(key) - shared, count) + key[shared:] + ids)
        self.held += len(ids) + len(key)
        self.block_tokens += count
        self.last = key
        if not self.idents or self.idents[-1] != ident:
            self.idents.append(ident)
        self.begin, self.end = self.begin or ident, ident
        if self.held >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.block:
            return
        body = zlib.compress(b"".join(self.block), 1)
        self.out.write(BLOCK.pack(len(body), zlib.crc32(body)))
        self.out.write(body)
        size = BLOCK.size + len(body)
        self.index.append(struct.pack("<H", len(self.first)) + self.first + PLACE.pack(self.at, size, len(self.block), self.block_tokens))
        self.at += size
        self.entries += len(self.block)
        self.tokens += self.block_tokens
        self.block, self.first, self.last, self.held, self.block_tokens = [], None, b"", 0, 0

    def finish(self) -> None:
        self.flush()
        bits = max(64, -(-len(self.idents) * BLOOM_BITS // 64) * 64)
        hashes = max(1, round(BLOOM_BITS * 0.693))
        bloom = np.zeros(bits, np.uint8)
        for ident in self.idents:
            bloom[_probes(ident, hashes, bits)] = 1
        index, packed = zlib.compress(b"".join(self.index), 1), np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index)
        self.out.write(packed)
        self.out.write(FOOTER.pack(self.at, len(index), len(packed), hashes, self.width, self.entries, self.tokens, zlib.crc32(packed, zlib.crc32(index)), VERSION, MAGIC))
        self.at += len(index) + len(packed) + FOOTER.size


class Reader:
    """Random access to one shard; raises ValueError where a checksum or the magic is wrong."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - FOOTER.size)
        at, index_size, bloom_size, self.hashes, self.width, self.entries, self.tokens, crc, version, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token table shard")
        file.seek(at)
        index, self.bloom = file.read(index_size), file.read(bloom_size)
        if zlib.crc32(self.bloom, zlib.crc32(index)) != crc:
            raise ValueError("the index is damaged")
        self.keys, self.places, raw, p = [], [], zlib.decompress(index), 0
        while p < len(raw):
            n = raw[p] | raw[p + 1] << 8
            self.keys.append(raw[p + 2 : p + 2 + n])
            self.places.append(PLACE.unpack_from(raw, p + 2 + n))
            p += 2 + n + PLACE.size

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        """(key, token bytes) of one block."""
        offset, size, _, _ = self.places[k]
        self.file.seek(offset)
        data = self.file.read(size)
        length, crc = BLOCK.unpack_from(data)
        if zlib.crc32(data[BLOCK.size :]) != crc or length != size - BLOCK.size:
            raise ValueError("a block is damaged")
        raw, p, key = zlib.decompress(data[BLOCK.size :]), 0, b""
        while p < len(raw):
            shared, rest, count = ENTRY.unpack_from(raw, p)
            p += ENTRY.size
            key = key[:shared] + raw[p : p + rest]
            p += rest
            yield key, raw[p : p + count * self.width]
            p += count * self.width

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.places)):
            yield from self.block(k)

    def may_have(self, ident: bytes) -> bool:
        bits = len(self.bloom) * 8
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _probes(ident, self.hashes, bits))

    def get(self, ident: bytes) -> list[np.ndarray]:
        """The token ids of every row with this identifier: Bloom filter, binary search of the index, then its blocks."""
        found = []
        if not self.may_have(ident):
            return found
        k = max(0, bisect.bisect_left(self.keys, ident + bytes(4)) - 1)
        while k < len(self.keys) and self.keys[k][:-4] <= ident:
            found += [self.ids(ids) for key, ids in self.block(k) if key[:-4] == ident]
            k += 1
        return found

    def ids(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class CachedEncoder:
    """A tokenizers file; byte-level BPE with its built-in split is answered by segment.

    That split is by a public pattern that doesn't look back. Where all characters of a text are ASCII or Latin letters, PLAIN
    is the same pattern with the character classes spelt out, and a segment is what the library merges in alone.
    Elsewhere SPACED cuts between a character and the white space after it, which no alternative of the pattern crosses.
    Each distinct segment goes to the library once and is remembered, up to CACHE segments of CACHE_CHARACTERS in all: beyond a half of either, those not asked for since the half before are forgotten. Texts with an
    added token's string, or with characters that libraries class differently as white space, go to the library whole, and
    so does everything with another tokenizer.
    """

    CACHE, CACHE_CHARACTERS = 800_000, 32 << 20
    PLAIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+")
    NOT_PLAIN = re.compile("[^\t\n\r -~À-ÖØ-öø-ɏ]")
    SPACED = re.compile("[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
    ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        spec = json.loads(self.lib.to_str())
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        self.split = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and model.get("type") == "BPE" and not model.get("dropout")
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.width = 2 if max(self.lib.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
        self.end = self.pack([end_id])
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.characters = 0

    def pack(self, ids: list[int]) -> bytes:
        packed = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder != "little":
            packed.byteswap()
        return packed.tobytes()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of(self, segments: list[str]) -> list[bytes]:
        """The packed ids of distinct segments; new ones go to the library."""
        found = list(map(self.known.get, segments))
        missing = [x for x, ids in zip(segments, found, strict=True) if ids is None]
        if not missing:
            return found
        old = list(map(self.before.get, missing))
        new = [x for x, ids in zip(missing, old, strict=True) if ids is None]
        made: list[bytes] = []
        for i in range(0, len(new), 20_000):
            made += self._encode(new[i : i + 20_000])
        fresh = iter(made)
        old = [next(fresh) if ids is None else ids for ids in old]
        size = sum(map(len, missing))
        if 2 * (len(self.known) + len(missing)) > self.CACHE or 2 * (self.characters + size) > self.CACHE_CHARACTERS:
            self.before, self.known, self.characters = self.known, {}, 0
        if 2 * len(missing) <= self.CACHE and 2 * size <= self.CACHE_CHARACTERS:
            self.characters += size
            self.known.update(zip(missing, old, strict=True))
        fresh = iter(old)
        return [next(fresh) if ids is None else ids for ids in found]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """The packed ids of texts whose characters are all plain: segments are found, told apart and put together as arrays."""
        raw = [t.encode() for t in texts]
        data = b"".join(raw)
        ends = np.cumsum([len(r) for r in raw])
        starts = plain_segments(np.frombuffer(data, np.uint8), ends)
        offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        parts = pa.Array.from_buffers(pa.string(), len(starts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        ids = pa.array(self.ids_of(parts.dictionary.to_pylist()), pa.binary()).take(parts.indices)
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        packed, at = ids.buffers()[2], np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        packed = packed.to_pybytes() if packed else b""
        cuts = at[np.searchsorted(starts, np.concatenate([[0], ends]))].tolist() if len(starts) else [0] * (len(texts) + 1)
        return [packed[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text, with the end id."""
        out: list[bytes] = [b""] * len(texts)
        plain, parts, whole = [], {}, []
        for k, text in enumerate(texts):
            if not self.split or any(a in text for a in self.added):
                whole.append(k)
            elif not self.NOT_PLAIN.search(text):
                plain.append(k)
            elif not self.ODD.search(text):
                parts[k] = self.SPACED.findall(text)
            else:
                whole.append(k)
        held, size = [], 0
        for k in plain:
            held.append(k)
            size += len(texts[k])
            if size >= PLAIN_CHARACTERS or k == plain[-1]:
                for j, ids in zip(held, self._plain([texts[j] for j in held]), strict=True):
                    out[j] = ids + self.end
                held, size = [], 0
        if parts:
            distinct = list(set().union(*parts.values()))
            known = dict(zip(distinct, self.ids_of(distinct), strict=True))
            for k, segments in parts.items():
                out[k] = b"".join(map(known.__getitem__, segments)) + self.end
        for k, ids in zip(whole, self._encode([texts[k] for k in whole]) if whole else [], strict=True):
            out[k] = ids + self.end
        return out


#: Characters of plain texts that are cut into segments at a time.
PLAIN_CHARACTERS = 4 << 20
#: Classes of bytes in plain texts: letters (and all bytes beyond ASCII), digits, white space, others.
_LETTER, _DIGIT, _SPACE, _OTHER = range(4)
_CLASS = np.array([_SPACE if b in b" \t\n\r" else _DIGIT if 48 <= b <= 57 else _LETTER if b >= 128 or chr(b).isalpha() else _OTHER for b in range(256)], np.uint8)


def plain_segments(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the segments of the public split pattern begin in texts of plain characters, given as bytes end to end; ends of the texts, in order.

    A run of letters, digits or other characters takes one space before it. Of white space before a run the last character stands alone, if it isn't that space, and the ones before it are a segment; white
    space at a text's end is one. An apostrophe at the beginning of a run, without a space, and the letters of a contraction after it are a segment.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    kind = _CLASS[data]
    first = np.zeros(n + 1, bool)  # texts begin here
    first[np.concatenate([[0], ends])] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run & (kind != _SPACE)
    # the space before a run is its own
    spaced = np.flatnonzero(start & ~first[:n])
    spaced = spaced[data[spaced - 1] == 32]
    start[spaced] = False
    start[spaced - 1] = True
    # white space: where a run of it begins, and its last character if a text goes on
    begins = np.flatnonzero(run & (kind == _SPACE))
    last = np.flatnonzero((kind == _SPACE) & np.append(run[1:], True))
    goes_on = ~first[last + 1]
    start[begins] = True
    start[last[goes_on]] = True
    # contractions
    quote = np.flatnonzero(start & (data == 39))
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1]]
    one = quote[np.isin(data[quote + 1], np.frombuffer(b"stmd", np.uint8))]
    two = quote[quote + 2 < n]
    two = two[~first[two + 2]]
    pair = data[two + 1].astype(np.int32) << 8 | data[two + 2]
    two = two[np.isin(pair, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])]
    for at, width in ((one, 2), (two, 3)):
        start[at + 1] = False
        at = at[at + width < n]
        start[at + width] = True
    return np.flatnonzero(start)


@lru_cache(maxsize=1)
def encoder_for(path: str, end_id: int) -> CachedEncoder:
    """One for each worker process: tasks that follow one another share what it remembers."""
    return CachedEncoder(path, end_id)


def release() -> None:
    """Gives memory that is free, in Arrow's pool and in the C library's heap, back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def gathered(batches: Iterator[pa.RecordBatch], characters: int) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of batches put together until they have so many characters."""
    idents, texts, size = [], [], 0
    for batch in batches:
        idents += batch.column(0).to_pylist()
        texts += batch.column(1).to_pylist()
        size += sum(map(len, texts[len(texts) - batch.num_rows :]))
        if size >= characters:
            yield idents, texts
            idents, texts, size = [], [], 0
    if texts:
        yield idents, texts


def write_table(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> list[dict]:
    """Writes every row's token ids under path in ascending id order; returns and stores the manifest.

    Null texts count as empty and hold the end id only. Null ids come first. Rows that repeat an id stay, ordered by
    text hash; the hash is also part of the range key, so an id with very many rows spreads over shards. An empty table gives
    an empty manifest. A task writes to a name of its attempt and renames; the manifest lists what committed tasks wrote.
    """
    spark = session(docs)
    text = isinstance(docs.schema[id_column].dataType, T.StringType)
    ident = field(docs, id_column)
    rows = docs.select((ident if text else ident.cast("bigint")).alias("i"), F.coalesce(field(docs, text_column).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange(partitions(spark), F.col("i").asc_nulls_first(), "h").sortWithinPartitions(F.col("i").asc_nulls_first(), "h").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _open(path)
        system.create_dir(folder)
        part, encoder = TaskContext.get().partitionId(), encoder_for(tokenizer, end_id)
        writer, made, last, repeat = None, [], None, 0

        def close() -> None:
            writer.finish()
            writer.out.close()
            name = f"shard-{part:06d}-{len(made):04d}.sst"
            system.move(writer.name, f"{folder}/{name}")
            made.append((part, len(made), name, writer.begin, writer.end, writer.entries, writer.tokens, writer.at))

        for idents, texts in gathered(batches, PLAIN_CHARACTERS):
            for ident, ids in zip(idents, encoder.encode(texts), strict=True):
                if writer is None:
                    name = f"{folder}/_{uuid.uuid4().hex}.part"
                    writer = Writer(system.open_output_stream(name), encoder.width)
                    writer.name = name
                key = key_of(ident)
                repeat = repeat + 1 if key == last else 0
                last = key
                writer.add(key, repeat, ids)
                if writer.at >= SHARD_BYTES:
                    close()
                    writer, last = None, None
        if writer is not None:
            close()
        columns = list(zip(*made, strict=True)) if made else [[]] * 8
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        names = ("part", "number", "name", "first", "last", "rows", "tokens", "bytes")
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
        release()

    shards = rows.mapInArrow(run, "part int, number int, name string, first binary, last binary, rows bigint, tokens bigint, bytes bigint").collect()
    manifest, start = [], 0
    for r in sorted(shards, key=lambda r: (r.part, r.number)):
        manifest.append({"name": r.name, "first": bytes(r.first).hex(), "last": bytes(r.last).hex(), "rows": r.rows, "tokens": r.tokens, "bytes": r.bytes, "start": start, "text_ids": text})
        start += r.tokens
    system, folder = _open(path)
    system.create_dir(folder)
    with system.open_output_stream(f"{folder}/_manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_table(spark, path: str, manifest: list[dict], *, id_column: str = "doc_id", ids: bool = False) -> DataFrame:
    """Per row, from the files: the id, start (ids of all rows before it), n_tokens, ids_crc32 (over 32-bit ids) and, if asked for, ids."""
    text = bool(manifest) and manifest[0]["text_ids"]
    schema = f"i {'string' if text else 'bigint'}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids
    shards = spark.createDataFrame([(m["name"], m["start"]) for m in manifest], "name string, start bigint")
    shards = shards.repartition(max(1, len(manifest)), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _open(path)
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = system.get_file_info(f"{folder}/{name}").size
                with system.open_input_file(f"{folder}/{name}") as file:
                    reader = Reader(file, size)
                    for k in range(len(reader.places)):
                        rows = []
                        for key, data in reader.block(k):
                            own = reader.ids(data)
                            rows.append((ident_of(key[:-4], text), start, len(own), zlib.crc32(own.tobytes()), *([own.tolist()] if ids else [])))
                            start += len(own)
                        kinds = (pa.string() if text else pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                        columns = zip(*rows, strict=True)
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names=["i", "start", "n_tokens", "ids_crc32", "ids"][: 4 + ids])

    session(shards)
    return shards.mapInArrow(run, schema).withColumnRenamed("i", id_column)


def lookup(path: str, ident: int | str | None) -> list[np.ndarray]:
    """The token ids of every row with this id: the manifest's ranges, then each shard's own search."""
    system, folder = _open(path)
    with system.open_input_file(f"{folder}/_manifest.json") as file:
        manifest = json.loads(file.read())
    key, found = key_of(ident), []
    for m in manifest[max(0, bisect.bisect_left([m["last"] for m in manifest], key.hex())) :]:
        if m["first"] > key.hex():
            break
        with system.open_input_file(f"{folder}/{m['name']}") as file:
            found += Reader(file, m["bytes"]).get(key)
    return found


def tokens_on_disk(docs: DataFrame, tokenizer: str, *, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """Writes the table (to a new place in the shared folder if no path is given) and reads it back as read_table()."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    path = path if "://" in path else "file://" + path.removeprefix("file:")
    manifest = write_table(docs, path, tokenizer, end_id=end_id, id_column=id_column, text_column=text_column)
    return read_table(spark, path, manifest, id_column=id_column)


def shard_bytes(rows: list[tuple[bytes, bytes]], width: int) -> bytes:
    """One shard of (identifier, packed ids) in memory."""
    out = io.BytesIO()
    writer, last, repeat = Writer(out, width), None, 0
    for ident, ids in rows:
        repeat = repeat + 1 if ident == last else 0
        last = ident
        writer.add(ident, repeat, ids)
    writer.finish()
    return out.getvalue()
