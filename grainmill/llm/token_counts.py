"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of at most ``chunk_chars`` characters is encoded as it is. A longer one is encoded in chunks that
overlap, each with character offsets, and two neighbours are spliced at a boundary that both encodings have in
their overlap and that is *proven* stable:

* sentencepiece BPE: the vocabulary is searched once. If no piece has U+2581 (the escaped space) after another
  character, no merge can cross from a non-space character to a space, so a token starts there whatever
  surrounds it. The normaliser must be the identity, else offsets and boundaries aren't the text's own.
* byte-level BPE of the tokenizers library with its built-in split pattern: no alternative of the pattern runs
  from a non-space character into a space, so a pre-token starts there.

The boundary must not be a chunk's first character: a chunk's start gets a dummy prefix, or loses context. If
the overlap has no such boundary it is doubled until it has one or ends with the text; with a tokenizer that
neither proof covers, every text is encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from grainmill.llm.common import field, map_rows

_PIECE_CUT = re.compile("(?<=[^ ▁])[ ▁]")
_BYTE_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85᠎​﻿]) (?=[^\s\x1c-\x1f\x85᠎​﻿])")


class PieceEncoder:
    """A sentencepiece model. Control and unknown pieces inside a text are ordinary characters, the library's default."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cut = _PIECE_CUT if self._proven() else None

    def _proven(self) -> bool:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(self.lib.serialized_model_proto())
        norm = model.normalizer_spec
        plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        bpe = model.trainer_spec.model_type == pb.TrainerSpec.BPE and not model.trainer_spec.treat_whitespace_as_suffix
        user = any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in model.pieces)
        return plain and bpe and not user and not any("▁" in p.piece.lstrip("▁") for p in model.pieces)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.lib.encode(texts, num_threads=1, return_type="numpy")]

    def starts(self, text: str) -> list[int]:
        return [a for a, _ in self.lib.encode(text, return_type="offset_mapping")["offsets"]]


class LibraryEncoder:
    """A tokenizers file, without special tokens added and without truncation or padding."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        spec = json.loads(self.lib.to_str())
        pre = spec["pre_tokenizer"] or {}
        added = any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        proven = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not added
        self.cut = _BYTE_CUT if proven else None

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.lib.encode_batch(texts, add_special_tokens=False)]

    def starts(self, text: str) -> list[int]:
        return [a for a, _ in self.lib.encode(text, add_special_tokens=False).offsets]


def load(path: str) -> PieceEncoder | LibraryEncoder:
    return PieceEncoder(path) if path.endswith(".model") else LibraryEncoder(path)


def spliced_count(encoder, text: str, chunk: int, overlap: int) -> tuple[int, int, int]:
    """Tokens, chunks and widenings of one text.

    ``at`` is where the last splice fell. A chunk starts ``overlap`` characters before it, so that ``at`` is
    inside the chunk, and the splice that ends it lies in its last ``overlap`` characters.
    """
    n, at, begin, total, chunks, widened = len(text), 0, 0, 0, 0, 0
    while True:
        size, room, end, cut = chunk, overlap, n, None
        while at + size < n:
            end = at + size
            lo = max(at + 1, end - room)
            cut = None
            for m in encoder.cut.finditer(text, lo, end - 1):
                cut = m.start()
            if cut is not None:
                break
            size, room, widened, end = size + room, room * 2, widened + 1, n
        starts = encoder.starts(text[begin:end])
        chunks += 1
        stop = cut if cut is not None else n
        own = [s for s in starts if at <= begin + s < stop]
        known = set(starts)
        if begin < at and at - begin not in known or cut is not None and cut - begin not in known:
            # the library shows no token at a boundary that was proven: trust the whole text only
            return encoder.counts([text])[0], chunks, widened + 1
        total += len(own)
        if cut is None:
            return total, chunks, widened
        at, begin = cut, max(0, cut - overlap)


def count_tokens(docs: DataFrame, tokenizer: str, *, id_column: str = "doc_id", text_column: str = "text", chunk_chars: int = 16384, overlap_chars: int = 256, limit: int = 4096) -> DataFrame:
    """Per row: the id, n_bytes (UTF-8), n_tokens, over_limit, n_chunks and n_widened.

    A null text counts as empty: 0 bytes, 0 tokens, 0 chunks. Ids may be null or repeated; each row is answered for
    itself, and further columns are left out. An empty table gives an empty one.
    """
    if not 0 < overlap_chars < chunk_chars:
        raise ValueError("overlap_chars must lie between 0 and chunk_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            short = [i for i, t in enumerate(texts) if t and (len(t) <= chunk_chars or not encoder.cut)]
            tokens, chunks, widened = [0] * len(texts), [0] * len(texts), [0] * len(texts)
            for i in range(0, len(short), 256):
                part = short[i : i + 256]
                for k, n in zip(part, encoder.counts([texts[k] for k in part]), strict=True):
                    tokens[k], chunks[k] = n, 1
            for k, t in enumerate(texts):
                if t and not chunks[k]:
                    tokens[k], chunks[k], widened[k] = spliced_count(encoder, t, chunk_chars, overlap_chars)
            sizes = [len(t.encode()) for t in texts]
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array(chunks, pa.int32()), pa.array(widened, pa.int32())],
                names=["__id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    out = map_rows(docs, [field(docs, id_column).alias("__id"), field(docs, text_column).cast("string").alias("__text")], run, f"__id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, n_chunks int, n_widened int")
    return out.withColumnRenamed("__id", id_column)
