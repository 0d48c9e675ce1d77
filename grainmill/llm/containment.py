"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by their number of distinct word shingles, in powers of two. An item's signature is
its bottom-k MinHash: the k shingles with the smallest hashes. A document that holds a share t of an item's n
shingles lacks n - ceil(t n) of them at most, so k = that number + 1, taken at the partition's largest size, means that it
has one of the signature's shingles at least, however long it is. The search therefore looks
every shingle of a document up in the signatures: no candidate is lost. A candidate item is verified in place: the
share of its shingles that the document has, exactly.

Items of up to BLOCK_BYTES of text are an index that is broadcast, in which documents are searched and verified on the spot. Of more items only the 64-bit
hashes of the signatures are, SIGNATURES of them at a time, each such block with one pass over the documents; those that have one are written, join the
signatures and the items by hash and by number, and the pairs are verified. Documents that have none aren't shuffled. The document side has no
sketch: its shingles are looked up one by one, since the signature of a long document would leave out what a short item asks for.

Words are the runs left when ASCII white space, punctuation and control characters are taken out of the lower-cased text. An
item with fewer than five words is one shingle of its own length; an item without words matches nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import field, kept_rows, session, written

BLOCK_BYTES, SIGNATURES = 4 << 20, 8 << 20
#: ASCII letters, digits and every byte of a character beyond ASCII stay.
_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_SPACED).split()


def shingles(tokens: list[bytes], width: int) -> Iterator[bytes]:
    return map(b" ".join, zip(*(tokens[k:] for k in range(width)), strict=False))


def signature(own: frozenset[bytes], share: tuple[int, int]) -> list[bytes]:
    """The bottom-k shingles of an item; share is the least part of them that a document must have, as (numerator, denominator)."""
    n = len(own)
    top = (1 << n.bit_length()) - 1
    k = min(n, top - -(-top * share[0] // share[1]) + 1)
    return sorted(own, key=lambda s: (xxhash.xxh64_intdigest(s, 42), s))[:k]


def item_shingles(text: str | None, width: int) -> tuple[int, frozenset[bytes]]:
    """(words of a shingle, the shingles) of an item; no words give no shingles."""
    tokens = words(text)
    length = min(width, len(tokens))
    return length, frozenset(shingles(tokens, length)) if tokens else frozenset()


class Index:
    """Signatures and shingle sets of a block of items. ``threshold`` is a fraction (numerator, denominator)."""

    def __init__(self, items: list[tuple], threshold: tuple[int, int], width: int):
        self.up, self.down = threshold
        self.width = width
        self.items: list[tuple] = []
        #: by shingle length: shingle to numbers of items
        self.signatures: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
        for ident, text in items:
            length, own = item_shingles(text, width)
            number = len(self.items)
            if own:
                self.items.append((ident, length, own))
            for s in signature(own, threshold):
                self.signatures[length].setdefault(s, []).append(number)

    def matches(self, text: str | None) -> list[tuple]:
        """(item id, shared shingles, the item's shingles) of every item that the text holds."""
        tokens, found = words(text), []
        for length, table in self.signatures.items():
            hits = set(filter(table.__contains__, shingles(tokens, length)))
            if not hits:
                continue
            every = set(shingles(tokens, length))
            for number in sorted(set(chain.from_iterable(table[s] for s in hits))):
                ident, _, own = self.items[number]
                shared = len(own & every)
                if shared * self.down >= self.up * len(own):
                    found.append((ident, shared, len(own)))
        return found


def _item_rows(items: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, int]:
    """(i, t) and the bytes that they take."""
    session(items)
    rows = items.select(field(items, id_column).alias("i"), field(items, text_column).cast("string").alias("t"))
    return rows, rows.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]


def _index(rows: DataFrame, threshold: tuple[int, int], width: int):
    """The broadcast index of items whose bytes have been found to be few."""
    return rows.sparkSession.sparkContext.broadcast(Index([(r.i, r.t) for r in rows.collect()], threshold, width))


def _by_signatures(texts: DataFrame, rows: DataFrame, threshold: tuple[int, int], width: int) -> DataFrame:
    """(d, t) and items (i, t) to (d, t, i, n_shared, n_shingles) of every document row and item that it holds, for items of any number."""
    spark, kind = texts.sparkSession, texts.schema["d"].dataType.simpleString()
    known = written(rows.withColumn("u", F.monotonically_increasing_id()), "items")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [item_shingles(t.as_py(), width) for t in batch.column(1)]
            own = [[xxhash.xxh64_intdigest(s, 42) for s in signature(x, threshold)] for _, x in found]
            at = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            lengths = pa.array([n for n, _ in found], pa.int32())
            hashes = np.array([h for x in own for h in x], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0).take(at), lengths.take(at), pa.array(hashes)], names=["u", "length", "h"])

    signatures = written(known.select("u", "t").mapInArrow(signed, "u bigint, length int, h bigint"), "item-signatures")
    total, lengths = signatures.agg(F.count(F.lit(1)), F.collect_set("length")).first()
    blocks = max(1, -(-total // SIGNATURES))

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, hits = [], []
                for k, text in enumerate(batch.column(1)):
                    tokens = words(text.as_py())
                    every = np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for n in lengths for s in shingles(tokens, n)], np.uint64).view(np.int64))
                    at = np.minimum(np.searchsorted(shared.value, every), max(0, len(shared.value) - 1))
                    found = every[shared.value[at] == every] if len(shared.value) else every[:0]
                    if len(found):
                        rows.append(k)
                        hits.append(found.tolist())
                yield pa.record_batch([*(c.take(pa.array(rows, pa.int64())) for c in batch.columns), pa.array(hits, pa.list_(pa.int64()))], names=["d", "t", "hs"])

        return run

    # an item's signature lies in one block, so that no pair is found twice
    passes = []
    for b in range(blocks):
        own = signatures.where(F.pmod("u", F.lit(blocks)) == b).select("h").distinct().toArrow()["h"].to_numpy()
        passes.append(texts.mapInArrow(scan(spark.sparkContext.broadcast(np.sort(own))), f"d {kind}, t string, hs array<bigint>").withColumn("b", F.lit(b)))
    hits = written(reduce(DataFrame.union, passes).withColumn("p", F.monotonically_increasing_id()), "documents-with-signatures")
    pairs = hits.select("p", "b", F.explode("hs").alias("h")).join(signatures.select("u", "h"), "h").where(F.pmod("u", F.lit(blocks)) == F.col("b")).select("p", "u").distinct()
    pairs = pairs.join(known.select("u", "i", F.col("t").alias("item")), "u").join(hits.select("p", "d", "t"), "p").select("d", "t", "i", "item")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for text, item in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                length, own = item_shingles(item, width)
                counts.append((len(own.intersection(shingles(words(text), length))), len(own)))
            shared, n = (pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1))
            yield pa.record_batch([*batch.columns[:3], shared, n], names=["d", "t", "i", "n_shared", "n_shingles"])

    out = pairs.mapInArrow(verified, f"d {kind}, t string, i {rows.schema['i'].dataType.simpleString()}, n_shared bigint, n_shingles bigint")
    return out.where(F.col("n_shared") * threshold[1] >= F.col("n_shingles") * threshold[0])


def _share(threshold: float) -> tuple[int, int]:
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    return round(threshold * 10_000), 10_000


def find(docs: DataFrame, items: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", threshold: float = 0.8, width: int = 5) -> DataFrame:
    """One row for each document row and item that it holds: the ids, n_shared, n_shingles and containment.

    Null, empty and wordless texts on either side match nothing. Null and repeated ids are reported as they
    are, a row for each pair of rows. No items or no documents give an empty table.
    """
    share, kind, other = _share(threshold), docs.schema[id_column].dataType.simpleString(), items.schema[item_column].dataType
    schema = f"d {kind}, i {other.simpleString()}, n_shared bigint, n_shingles bigint"
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(other)

    texts = docs.select(field(docs, id_column).alias("d"), field(docs, text_column).cast("string").alias("t"))
    rows, size = _item_rows(items, item_column, item_text)
    if size > BLOCK_BYTES:
        out = _by_signatures(texts, rows, share, width)
    else:
        index = _index(rows, share, width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in batches:
                rows, found = [], []
                for k, text in enumerate(batch.column(1)):
                    for match in own.matches(text.as_py()):
                        rows.append(k)
                        found.append(match)
                columns = [pa.array([m[c] for m in found], t) for c, t in enumerate((arrow, pa.int64(), pa.int64()))]
                yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), *columns], names=["d", "i", "n_shared", "n_shingles"])

        out = texts.mapInArrow(run, schema)
    return out.select(F.col("d").alias(id_column), F.col("i").alias(item_column if item_column != id_column else f"{item_column}_item"), "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, *, text_column: str = "text", item_column: str = "item_id", item_text: str = "text", threshold: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of docs, all their columns, whatever their names, that hold no item. Null, empty and wordless texts stay, repeated rows are judged alike; no items keep all rows."""
    share = _share(threshold)
    rows, size = _item_rows(items, item_column, item_text)
    if size <= BLOCK_BYTES:
        index = _index(rows, share, width)
        return kept_rows(docs, text_column, lambda texts: [not index.value.matches(t) for t in texts])
    session(docs)
    flat, at = docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))), docs.columns.index(text_column)
    texts = flat.select(F.lit(0).alias("d"), F.col(f"c{at}").cast("string").alias("t"))
    held = _by_signatures(texts, rows, share, width).select(F.sha2("t", 256).alias("held")).distinct()
    return flat.join(held, F.sha2(F.col(f"c{at}").cast("string"), 256) == F.col("held"), "left_anti").toDF(*docs.columns)


ORACLE = r"""
WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s, least(len(w), 5) AS n FROM b WHERE len(w) > 0),
bn AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) >= 5)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_shingles) AS n_shingles, count(*)::DOUBLE / any_value(n_shingles) AS containment
FROM ds JOIN bs USING (s) JOIN bn USING (item_id) WHERE bs.n = 5
GROUP BY doc_id, item_id HAVING count(*) * 10 >= any_value(n_shingles) * 8
"""
