"""Line dedup over content-defined chunks.

A text's lines that have words are hashed; a rolling hash over the hashes of two neighbouring lines chooses boundaries: both lines of a pair
whose rolling hash is 0 modulo DIVISOR are anchors, the first one to start chunks and the second one to end them, and so is every line of
LONG_LINE words or more. Anchors follow from content near them, so lines inserted or dropped elsewhere don't move them. A chunk goes from
any line to the next end anchor behind it, or from the last start anchor ahead to any line: chunks overlap in as many phases
as there are lines, so that the edges of a passage that several documents share are chunk edges too. A chunk has two lines or
more. A passage of n lines is found whole if one of its n - 1 pairs makes an anchor or one of its lines is long: always, for two to six lines with
over 50 words, and else but for a chance of one half a pair, multiplied. A single line is a unit if it has ``passage`` words or more.

A unit whose hash occurs once stays without its text ever being moved. The texts of the others are compared
byte by byte, by grouping on the text itself; of equal units the first one, by (id, text hash, line), stays and the rest
are removed. If a line goes, an equal one stands at an earlier place, in the first copy of its unit: going back from copy to copy ends
at a line that stays, so something of every repeated passage is left.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import field, session, written

DIVISOR, LONG_LINE, PASSAGE = 2, 8, 50
#: A pair that stands among as many before it makes an anchor, so that no chunk of periodic lines grows long.
RECENT = 32
_PRIME, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def anchors(lines: list[bytes], divisor: int = DIVISOR, long_line: int = LONG_LINE) -> tuple[list[bool], list[bool]]:
    """Of lines with words: which ones start chunks and which ones end chunks."""
    starts = [len(x.split()) >= long_line for x in lines]
    ends, recent, before = list(starts), deque(maxlen=RECENT), 0
    for k, line in enumerate(lines):
        h = xxhash.xxh64_intdigest(line, 7)
        if k:
            # the low bits of a product depend on low bits only: decide by the high ones
            rolling = (before * _PRIME + h & _MASK) >> 32
            if rolling % divisor == 0 or rolling in recent:
                starts[k - 1] = ends[k] = True
            recent.append(rolling)
        before = h
    return starts, ends


def chunks(lines: list[bytes], divisor: int = DIVISOR, long_line: int = LONG_LINE) -> set[tuple[int, int]]:
    """(first, last) line of every chunk: from each line to the next end anchor, from the last start anchor to each line."""
    starts, ends = anchors(lines, divisor, long_line)
    out, at = set(), None
    for k in range(len(lines) - 2, -1, -1):
        if ends[k + 1]:
            at = k + 1
        if at is not None:
            out.add((k, at))
    at = None
    for k in range(1, len(lines)):
        if starts[k - 1]:
            at = k - 1
        if at is not None:
            out.add((at, k))
    return out


def units(text: str, passage: int = PASSAGE) -> list[tuple[int, int, int]]:
    """(first line, lines, signed hash) of the chunks, and of single lines with ``passage`` words or more; lines without words lie inside units only."""
    lines = text.encode().split(b"\n")
    at = [k for k, x in enumerate(lines) if x.strip()]
    own = [lines[k] for k in at]
    spans = chunks(own)
    if passage:
        spans |= {(k, k) for k, x in enumerate(own) if len(x) >= 2 * passage - 1 and len(x.split()) >= passage}
    places = ((at[a], at[b] + 1 - at[a]) for a, b in sorted(spans))
    hashes = ((a, n, xxhash.xxh64_intdigest(b"\n".join(lines[a : a + n]), n)) for a, n in places)
    return [(a, n, h - (1 << 64) if h >> 63 else h) for a, n, h in hashes]


def _units(batches: Iterator[pa.RecordBatch], passage: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, found = [], []
        for k, text in enumerate(batch.column(2)):
            own = units(text.as_py() or "", passage)
            rows += [k] * len(own)
            found += own
        first, lines, hashes = zip(*found, strict=True) if found else ((), (), ())
        at = pa.array(rows, pa.int64())
        yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(first, pa.int32()), pa.array(lines, pa.int32()), pa.array(hashes, pa.int64())], names=["i", "v", "first", "lines", "h"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, v, text, [(first, lines, h)]) to a row for each unit with its bytes."""
    for batch in batches:
        rows, first, lines, hashes, texts = [], [], [], [], []
        for k, (text, own) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), strict=True)):
            parts = text.as_py().encode().split(b"\n")
            for u in own:
                rows.append(k)
                first.append(u["first"])
                lines.append(u["lines"])
                hashes.append(u["h"])
                texts.append(b"\n".join(parts[u["first"] : u["first"] + u["lines"]]))
        at = pa.array(rows, pa.int64())
        yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(first, pa.int32()), pa.array(lines, pa.int32()), pa.array(hashes, pa.int64()), pa.array(texts, pa.binary())], names=["i", "v", "first", "lines", "h", "bytes"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, total, removed = [], [], []
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            text = text.as_py()
            if text is None:
                texts.append(None)
                total.append(0)
                removed.append(0)
                continue
            lines = text.split("\n")
            gone = set()
            for s in spans or ():
                gone.update(range(s["first"], s["first"] + s["lines"]))
            texts.append("\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text)
            total.append(len(lines))
            removed.append(len(gone))
        yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=["i", "text", "n_lines", "n_removed"])


def repeated_units(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", passage: int = PASSAGE) -> DataFrame:
    """(i, v, first, lines): the units to remove; v is the hash of the row's text, which tells rows of one id apart."""
    session(docs)
    ident = field(docs, id_column)
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(ident.alias("i"), field(docs, text_column).cast("string").alias("t")).where(F.col("t").isNotNull())
    rows = rows.select("i", F.xxhash64("t").alias("v"), "t")
    every = written(rows.mapInArrow(lambda b: _units(b, passage), f"i {kind}, v bigint, first int, lines int, h bigint"), "line-units")
    again = every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    per_row = every.join(again, "h").groupBy("i", "v").agg(F.collect_set(F.struct("first", "lines", "h")).alias("own"))
    same = F.col("r.i").eqNullSafe(F.col("p.i")) & (F.col("r.v") == F.col("p.v"))
    found = rows.alias("r").join(per_row.alias("p"), same).select("r.i", "r.v", "r.t", "p.own")
    found = written(found.mapInArrow(_texts, f"i {kind}, v bigint, first int, lines int, h bigint, bytes binary"), "line-candidates")
    place = F.struct("i", "v", "first")
    equal = found.groupBy("h", "bytes").agg(F.min(place).alias("stays"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "bytes", "stays")
    # as a table, so that both sides of the join are plain shuffles and Spark can split a passage that very many rows share
    equal = written(equal, "line-classes")
    return found.join(equal, ["h", "bytes"]).where(~place.eqNullSafe(F.col("stays"))).select("i", "v", "first", "lines")


def dedup_lines(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", passage: int = PASSAGE) -> DataFrame:
    """Per row: the id, the text without the removed lines, n_lines and n_removed.

    A null text stays null and has no lines; an empty one has one empty line. Rows that repeat an id are told apart by their text;
    rows that repeat both are one document and get the same answer. The smallest id, null first, keeps a passage.
    Other columns are left out; an empty table gives an empty one. ``passage`` 0 turns single lines off. Memory follows the longest
    text; runs of equal or periodic lines make no long chunks.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    gone = repeated_units(docs, id_column=id_column, text_column=text_column, passage=passage)
    gone = gone.groupBy("i", "v").agg(F.collect_set(F.struct("first", "lines")).alias("spans"))
    rows = docs.select(field(docs, id_column).alias("i"), field(docs, text_column).cast("string").alias("t")).withColumn("v", F.xxhash64("t"))
    same = F.col("r.i").eqNullSafe(F.col("g.i")) & (F.col("r.v") == F.col("g.v"))
    out = rows.alias("r").join(gone.alias("g"), same, "left").select("r.i", "r.t", "g.spans")
    out = out.mapInArrow(_kept, f"i {kind}, text string, n_lines bigint, n_removed bigint")
    return out.withColumnsRenamed({"i": id_column, "text": text_column})
