"""SimHash near-duplicates with pivot distance tables.

Fingerprints: 64 majority bits over the XXH64 of a text's word shingles. Equal fingerprints are one node, whose id
is the smallest document id, so exact copies cost one row. Then:

1. Partitions. 64 bits are cut into B blocks. Two fingerprints that differ in at most r bits agree in at least B - r
   blocks, so they meet under one of the C(B, B - r) keys made of that many blocks. Nothing is lost. B follows from the
   number of nodes; every B gives the same links.
2. Pivot table. A node's row of the table holds its Hamming distances to 16 fixed reference fingerprints. By the triangle
   inequality two nodes within r have rows that differ by at most r in every coordinate. In a partition the nodes are
   sorted by the first coordinate and only a window of +-r of it is paired; a pair goes when the
   largest difference over the coordinates is above r.
3. Verification of the survivors by Hamming distance.

A partition's links leave as a spanning forest: as many rows as nodes at most. A partition of more than HOT nodes
is dealt into chunks, and each pair of chunks is a task of its own.

That finds all fingerprints within a small radius. Texts that share four fifths of their shingles differ in ten of 64 bits on average, a radius for which block keys
separate nothing. similar_documents() therefore takes several fingerprints of a text, of the same shingles under other hash functions, and calls texts similar
that differ in at most ``limit`` bits of all of them. Its partitions are those of equal least shingles under KEYS hash functions: texts of similarity
s meet with a chance of 1 - (1 - s) ** KEYS. The pivot table discards by the sum, over the fingerprints, of the largest coordinate differences, which is a lower
bound of the distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, comb, floor, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from grainmill.llm.common import field, map_rows, partitions, session, written
from grainmill.llm.components import components

PIVOTS, HOT, SMALL_RUN = 16, 8192, 64
#: Of similar_documents(): fingerprints of a text, pivots of each, keys by least shingles.
PRINTS, WIDE_PIVOTS, KEYS = 4, 64, 3
#: Bytes of ids that are sent to all tasks.
BROADCAST_BYTES = 32 << 20
#: Shingles hashed before their bits are counted: bounds memory for long texts.
SHINGLE_BLOCK = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _hashes(text: str | None, shingle_words: int, seed: int) -> Iterator[np.ndarray]:
    """The hashes of a text's word shingles, repeats included, in blocks; of fewer words, that of the whole sequence."""
    words = (text or "").encode().lower().split()
    if not words:
        return
    hashed = xxhash.xxh64_intdigest
    if len(words) < shingle_words:
        yield np.array([hashed(b" ".join(words), seed)], np.uint64)
        return
    for i in range(0, len(words) - shingle_words + 1, SHINGLE_BLOCK):
        part = words[i : i + SHINGLE_BLOCK + shingle_words - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(shingle_words)), strict=False))
        yield np.array([hashed(s, seed) for s in shingles], np.uint64)


def _other(values: np.ndarray, number: int) -> np.ndarray:
    """The values under another hash function; number 0 is the values themselves."""
    if not number:
        return values
    values = values * np.uint64((0x9E3779B97F4A7C15 + 2 * number) & (1 << 64) - 1) + np.uint64(number)
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def fingerprint(text: str | None, shingle_words: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the hashes; repeated shingles count each time, a text without words gives 0."""
    return int(wide_fingerprint(text, shingle_words, seed, 1)[0][0])


def wide_fingerprint(text: str | None, shingle_words: int = 5, seed: int = 42, prints: int = PRINTS, keys: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the same shingles under so many hash functions, and the least shingle under so many others."""
    votes, total, least = np.zeros((prints, 64), np.int64), 0, np.full(keys, (1 << 64) - 1, np.uint64)
    for values in _hashes(text, shingle_words, seed):
        total += len(values)
        for k in range(prints):
            own = _other(values, k).astype("<u8", copy=False).view(np.uint8)
            if len(values) < 1024:
                votes[k] += np.unpackbits(own.reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            else:
                for j in range(8):
                    votes[k, 8 * j : 8 * j + 8] += np.bincount(own[j::8], minlength=256) @ _BITS
        for k in range(keys):
            least[k] = min(least[k], _other(values, 100 + k).min())
    bits = (votes * 2 > total).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64), least


def fingerprints(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer with the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), shingle_words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(values)], names=["doc_id", "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    return map_rows(docs, [field(docs, id_column).alias("doc_id"), field(docs, text_column).cast("string").alias("text")], run, f"doc_id {kind}, fp bigint")


def block_plan(nodes: int, radius: int) -> list[tuple[tuple[int, int], ...]]:
    """The keys, each a choice of (shift, width) blocks, that cost least in rows made and expected pairs."""
    if radius >= 64:
        return [()]
    best = None
    for blocks in range(radius + 1, min(64, radius + 6) + 1):
        edges = [64 * i // blocks for i in range(blocks + 1)]
        spans = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
        equal = blocks - radius
        keys, bits = comb(blocks, equal), 64 * equal / blocks
        cost = keys * (1 + nodes / 2**bits / 32)
        if best is None or cost < best[0]:
            best = cost, list(combinations(spans, equal))
    return best[1]


def pivot_fingerprints(count: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", 0) for i in range(count)], np.uint64)


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of the fingerprints of each row, (rows, prints), to the pivots: (rows, prints, pivots)."""
    out = np.empty((*fps.shape, len(pivots)), np.int8)
    for p, pivot in enumerate(pivots):
        out[:, :, p] = np.bitwise_count(fps ^ pivot)
    return out


def left_by_pivots(table: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose largest coordinate differences, summed over the fingerprints, are within the limit."""
    bound = np.zeros((len(i), table.shape[1]), np.int8)
    for p in range(0, table.shape[2], 4):
        bound = np.maximum(bound, np.abs(table[i, :, p : p + 4] - table[j, :, p : p + 4]).max(axis=2))
        keep = bound.sum(axis=1, dtype=np.int64) <= limit
        if not keep.all():
            i, j, bound = i[keep], j[keep], bound[keep]
    return i, j


def _near(table: np.ndarray, fps: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) left by the pivot table, then by the Hamming distance."""
    i, j = left_by_pivots(table, i, j, limit)
    keep = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int64) <= limit
    return i[keep], j[keep]


def _forest(table: np.ndarray, fps: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links in one partition, whose rows are sorted by the first pivot distance."""
    rest, first = np.arange(len(fps)), table[:, 0, 0].astype(np.int64)
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            u = front.pop()
            lo, hi = np.searchsorted(first[rest], [first[u] - limit, first[u] + limit + 1])
            window = rest[lo:hi]
            _, found = _near(table, fps, np.full(len(window), u), window, limit)
            if len(found):
                yield from ((u, int(v)) for v in found)
                front.extend(found.tolist())
                rest = np.concatenate([rest[:lo], window[~np.isin(window, found, assume_unique=True)], rest[hi:]])


def _links(limit: int, prints: int, count: int):
    """mapInArrow over rows sorted by partition key: (key, lo, hi, f0, ..., node) to (a, b); count is the number of pivots."""

    def of(keys: np.ndarray, fps: np.ndarray, nodes: pa.Array, pivots: np.ndarray) -> tuple[list, list]:
        """Links of whole partitions: keys holds a number for each, in order."""
        table = pivot_table(fps, pivots)
        order = np.lexsort((table[:, 0, 0], keys))
        keys, fps, table = keys[order], fps[order], table[order]
        a, b, starts = [], [], np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        lengths, first = np.diff(np.r_[starts, len(keys)]), table[:, 0, 0].astype(np.int64)
        small = np.repeat(lengths <= SMALL_RUN, lengths)
        at, shift = np.flatnonzero(small), 1
        while len(at):
            at = at[at + shift < len(keys)]
            at = at[(keys[at] == keys[at + shift]) & (first[at + shift] - first[at] <= limit)]
            i, j = _near(table, fps, at, at + shift, limit)
            a += order[i].tolist()
            b += order[j].tolist()
            shift += 1
        for s, n in zip(starts[lengths > SMALL_RUN], lengths[lengths > SMALL_RUN], strict=True):
            for i, j in _forest(table[s : s + n], fps[s : s + n], limit):
                a.append(int(order[s + i]))
                b.append(int(order[s + j]))
        return nodes.take(pa.array(a, pa.int64())), nodes.take(pa.array(b, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, held = pivot_fingerprints(count), None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 50_000:
                continue
            whole, held = _cut(held)
            if whole is not None:
                yield _answer(of, whole, pivots, prints)
        if held is not None and held.num_rows:
            yield _answer(of, held, pivots, prints)

    return run


def _numbers(t: pa.Table) -> np.ndarray:
    """Runs of equal (key, lo, hi), counted."""
    new = np.zeros(t.num_rows, bool)
    for name in ("key", "lo", "hi"):
        v = t[name].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def _cut(t: pa.Table) -> tuple[pa.Table | None, pa.Table]:
    """All but the last partition, which may go on in the next batch; that last one."""
    runs = _numbers(t)
    at = int(np.searchsorted(runs, runs[-1]))
    return (t.slice(0, at) if at else None), t.slice(at)


def _answer(of, t: pa.Table, pivots: np.ndarray, prints: int) -> pa.RecordBatch:
    t = t.combine_chunks()
    fps = np.stack([t[f"f{k}"].to_numpy().view(np.uint64) for k in range(prints)], axis=1)
    a, b = of(_numbers(t), fps, t["node"].combine_chunks(), pivots)
    if isinstance(a, pa.ChunkedArray):
        a, b = a.combine_chunks(), b.combine_chunks()
    return pa.record_batch([a, b], names=["a", "b"])


def _linked(rows: DataFrame, limit: int, prints: int, pivots: int, most: int) -> DataFrame:
    """(key, f0, ..., node) to links (a, b) that join the same nodes as all links between rows of one key do. Keys of more than ``most`` rows are dealt into chunks, and pairs of chunks are tasks."""
    fs = [f"f{k}" for k in range(prints)]
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    hot = hot.select("key", F.ceil(F.col("n") / most).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64(*fs), F.col("chunks")).cast("int")
    rows = rows.join(hot, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", chunk)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), *fs, "node")
    rows = rows.repartition(partitions(session(rows)), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    kind = rows.schema["node"].dataType.simpleString()
    return rows.mapInArrow(_links(limit, prints, pivots), f"a {kind}, b {kind}")


def block_keys(fp: Column, count: int, radius: int) -> list[Column]:
    """The keys of block_plan() for a fingerprint column."""
    keys = []
    for k, blocks in enumerate(block_plan(count, radius)):
        key, used = F.lit(0).cast("bigint"), 0
        for shift, width in blocks:
            part = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
            key, used = key.bitwiseOR(F.shiftleft(part, used)), used + width
        keys.append(key.bitwiseOR(F.lit(k << 52).cast("bigint")) if used <= 52 and k < 1 << 11 else F.xxhash64(F.lit(k), key))
    return keys


def near_links(nodes: DataFrame, radius: int, count: int) -> DataFrame:
    """(fp, node), one row for each fingerprint, to links (a, b) that join the same nodes as all links within radius do."""
    rows = nodes.select(F.col("fp").alias("f0"), "node", F.explode(F.array(*block_keys(F.col("fp"), count, radius))).alias("key"))
    return _linked(rows, radius, 1, PIVOTS, HOT)


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 4, radius: int = 4) -> DataFrame:
    """Per row: the id, fingerprint (16 hex digits) and component_id, the smallest id it reaches over links of at most
    radius differing bits.

    Null, empty and wordless texts have fingerprint zero and link like any other. Rows that repeat an id link through
    it as one document. A null id is answered with its fingerprint's component, which is null if no row of that component has an id.
    An empty table gives an empty one; other columns are left out.
    """
    rows = written(fingerprints(docs, id_column=id_column, text_column=text_column, shingle_words=shingle_words), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    count = nodes.count()
    known = nodes.where(F.col("node").isNotNull())
    links = near_links(known, radius, count)
    # one id with several fingerprints: its rows are one document
    same = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("fp").alias("f"), F.max("fp").alias("g")).where("f <> g").select("doc_id")
    same = rows.join(same, "doc_id").join(nodes, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = components(links.union(same))
    placed = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(placed, "fp").select(F.col("doc_id").alias(id_column), hexed.alias("fingerprint"), "component_id")


def bit_limit(similarity: float, prints: int) -> int:
    """Bits in which nine tenths of the texts of that Jaccard similarity differ at most."""
    share = acos(2 * similarity / (1 + similarity)) / pi
    return floor(64 * prints * share + 1.28 * sqrt(64 * prints * share * (1 - share)))


def similar_documents(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 5, similarity: float = 0.8, prints: int = PRINTS, keys: int = KEYS) -> DataFrame:
    """Per row with an id: the id and component_id, the smallest id it reaches over links between texts of about ``similarity`` or more.

    Similarity is Jaccard's, of word shingles, as ``prints`` fingerprints tell it: texts link if they share a least shingle and differ in no more than bit_limit() bits.
    Null, empty and wordless texts are one class; texts of fewer words than a shingle are similar if they are equal but for case and white space. Rows that repeat an id
    link through it as one document; rows without one are left out. An empty table gives an empty one; other columns, whatever their names, are left out.
    Very long texts are hashed in blocks. Ties don't matter: links have no order.
    """
    kind, fs, ms = docs.schema[id_column].dataType.simpleString(), [f"f{k}" for k in range(prints)], [f"m{k}" for k in range(keys)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide_fingerprint(t.as_py(), shingle_words, 42, prints, keys) for t in batch.column(1)]
            both = [np.array([x[c] for x in found], np.uint64).reshape(len(found), -1).view(np.int64) for c in (0, 1)]
            columns = [pa.array(np.ascontiguousarray(x[:, k])) for x in both for k in range(x.shape[1])] if found else [pa.array([], pa.int64())] * (prints + keys)
            yield pa.record_batch([batch.column(0), *columns], names=["doc_id", *fs, *ms])

    rows = docs.where(field(docs, id_column).isNotNull())
    rows = map_rows(rows, [field(docs, id_column).alias("doc_id"), field(docs, text_column).cast("string").alias("text")], run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in fs + ms))
    rows = written(rows, "wide-fingerprints")
    nodes = written(rows.groupBy(*fs).agg(F.min("doc_id").alias("node"), *(F.min(m).alias(m) for m in ms)), "wide-nodes")
    keyed = nodes.select(*fs, "node", F.explode(F.array(*(F.xxhash64(F.lit(k), F.col(m)) for k, m in enumerate(ms)))).alias("key"))
    links = _linked(keyed, bit_limit(similarity, prints), prints, WIDE_PIVOTS, max(1, HOT // 8))
    own = rows.select("doc_id", *fs).join(nodes.select(*fs, "node"), fs).select("doc_id", "node")
    own = written(own, "wide-members")
    # one id with several fingerprints: its rows are one document
    several = own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id")
    same = own.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = components(links.union(same))
    out = own.join(found, "node", "left").select(F.col("doc_id").alias(id_column), F.coalesce("component", "node").alias("component_id"))
    return out.distinct()


def one_of_each(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, whose id is the smallest of its class in similar_documents(), one row for each id: of the rows of an id, the one whose other columns have the
    smallest hash. Rows without an id stay. Empty tables give empty ones."""
    # columns by number, so that any name works
    flat = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    ident, text = (f"c{docs.columns.index(c)}" for c in (id_column, text_column))
    found = similar_documents(flat, id_column=ident, text_column=text, **options)
    gone = found.where(F.col(ident) != F.col("component_id")).select(F.col(ident).alias("gone"))
    twice = written(flat.where(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("gone")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gone"), "repeated-ids")
    left = written(gone.union(twice), "leaving-ids")

    def sized(ids: DataFrame) -> DataFrame:
        """To all tasks, where the ids measure up to the bound: then no text is moved. Beyond it both sides of the join are."""
        size = ids.agg(F.coalesce(F.sum(F.octet_length(F.col("gone").cast("string")) + 32), F.lit(0))).first()[0]
        return F.broadcast(ids) if size <= BROADCAST_BYTES else ids

    plain = flat.join(sized(left), F.col(ident) == F.col("gone"), "left_anti")
    if not twice.limit(1).count():
        return plain.toDF(*docs.columns)
    first = flat.join(sized(twice), F.col(ident) == F.col("gone"), "left_semi").join(gone, F.col(ident) == F.col("gone"), "left_anti")
    sortable = [f.name for f in flat.schema if f.name != text and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    order = W.partitionBy(ident).orderBy(F.xxhash64(text), *sortable)
    first = first.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    return plain.union(first).toDF(*docs.columns)
