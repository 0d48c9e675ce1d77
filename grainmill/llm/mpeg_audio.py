"""MPEG audio in a binary column: a resynchronising reader, and a writer that stores a payload losslessly.

Reader: ID3v2 and ID3v1 tags, MPEG-1/2/2.5 layers I to III, Xing, Info and VBRI tables, CRC-16 of protected frames of all layers, exact
durations in samples, byte offsets of all frames. A header counts only if the frame it announces is followed by
another header of the same stream (version, layer, sampling rate) or by the end of the audio; else the search for
a sync word goes on one byte later, and the bytes skipped are counted.

Writer: MPEG-1 layer III, 48 kHz, mono, 80 kbit/s, so that every frame has 240 bytes: 4 header, 2 CRC, 17 side
information (all zero: no Huffman data, silence), then 192 payload bytes and 25 zero bytes in the ancillary area,
which decoders skip. The first frame is an Info frame with the frame count, the byte count and a seek table. Before
it stands an ID3v2.4 tag whose TXXX frame holds the payload's length, after the frames an ID3v1 tag.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from grainmill.llm.common import field, map_rows

#: Fixed values of the MPEG audio standards: kbit/s by (low sampling rates, layer) and index, and Hz by version.
BITRATES = {
    (False, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (False, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (False, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (True, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (True, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (True, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: What the writer uses.
UNIT, FRAME, RATE, SAMPLES, SIDE = 192, 240, 48000, 1152, 17
HEADER = bytes((0xFF, 0xFA, 0x64, 0xC0))
#: Fixed values of layer II: the bits of a subband's allocation, from the lowest subband on, as (bits, subbands) runs.
ALLOCATION = {"a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)), "low": ((4, 4), (3, 7), (2, 19))}


def _crc_table() -> list[int]:
    table = []
    for value in range(256):
        crc = value << 8
        for _ in range(8):
            crc = (crc << 1 ^ (0x8005 if crc & 0x8000 else 0)) & 0xFFFF
        table.append(crc)
    return table


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for byte in data:
        crc = (crc << 8 & 0xFF00) ^ _CRC[crc >> 8 ^ byte]
    return crc


def _crc_of_bits(data: bytes, count: int) -> int:
    """The CRC of the first ``count`` bits."""
    crc = crc16(data[: count // 8])
    for k in range(count // 8 * 8, count):
        bit = data[k // 8] >> 7 - k % 8 & 1
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if crc >> 15 ^ bit else 0)
    return crc


def _allocation_table(version: int, kbit: int, rate: int, channels: int) -> str:
    each = kbit // channels
    if version != 3:
        return "low"
    if each < 56:
        return "d" if rate == 32000 else "c"
    return "a" if rate == 48000 or each < 96 else "b"


def guarded_bits(frame: bytes, head: tuple) -> int:
    """How many bits after the CRC word it guards: side information, or allocation, or allocation and scale factor selection."""
    version, layer, _, kbit, rate, _, _, channels, side = head
    if layer == 3:
        return 8 * side
    joint = frame[3] >> 6 == 1
    bound = 4 * (frame[3] >> 4 & 3) + 4 if joint else 32
    if layer == 1:
        return 4 * (channels * bound + 32 - bound)
    body, at, selected = int.from_bytes(frame[6:70].ljust(64, b"\0"), "big"), 0, 0
    widths = [bits for bits, n in ALLOCATION[_allocation_table(version, kbit, rate, channels)] for _ in range(n)]
    for band, bits in enumerate(widths):
        for _ in range(channels if band < bound else 1):
            at += bits
            if body >> 512 - at & (1 << bits) - 1:
                selected += 1 if band < bound else channels
    return at + 2 * selected


def checksum(frame: bytes, head: tuple) -> int:
    """What the CRC word of a protected frame should be."""
    bits = guarded_bits(frame, head)
    return _crc_of_bits((frame[2:4] + frame[6 : 6 + (bits + 7) // 8]).ljust(2 + (bits + 7) // 8, b"\0"), 16 + bits)


def _variable_rate(frame: bytes, layer: int, body: int) -> dict | None:
    """What a Xing, Info or VBRI table in the first frame says: kind, frames, bytes and toc, the bytes of its stretches; body is where the frame's data begins."""
    if layer != 3:
        return None
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        _, _, _, size, frames, entries, scale, width, each = struct.unpack(">HHHIIHHHH", frame[40:62])
        toc = [int.from_bytes(frame[62 + width * k : 62 + width * (k + 1)], "big") * scale for k in range(entries) if 62 + width * (k + 1) <= len(frame)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "frames_each": each}
    if frame[body : body + 4] not in (b"Xing", b"Info"):
        return None
    flags, found, p = int.from_bytes(frame[body + 4 : body + 8], "big"), {"kind": frame[body : body + 4].decode()}, body + 8
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            found[name] = int.from_bytes(frame[p : p + 4], "big")
            p += 4
    if flags & 4:
        found["toc"] = list(frame[p : p + 100])
    return found


def parse_header(four: bytes) -> tuple | None:
    """(version, layer, protected, kbit/s, Hz, bytes, samples, channels, side bytes), or None. Free format counts as none."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    rate_at, rate_index, padding = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version == 1 or layer == 4 or rate_at in (0, 15) or rate_index == 3 or four[3] & 3 == 2:
        return None
    low = version != 3
    kbit, rate, channels = BITRATES[low, layer][rate_at], RATES[version][rate_index], 1 if four[3] >> 6 == 3 else 2
    if layer == 1:
        length, samples = (12000 * kbit // rate + padding) * 4, 384
    else:
        samples = 576 if low and layer == 3 else 1152
        length = samples * 125 * kbit // rate + padding
    side = 0 if layer != 3 else (9 if channels == 1 else 17) if low else (17 if channels == 1 else 32)
    return version, layer, not four[1] & 1, kbit, rate, length, samples, channels, side


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _text_frame(key: str, value: str) -> bytes:
    body = b"\x03" + key.encode() + b"\0" + value.encode()
    return b"TXXX" + _synchsafe(len(body)) + b"\0\0" + body


def encode(payload: bytes, tags: dict[str, str] | None = None) -> bytes:
    """The payload, whose length must be a positive multiple of 192, as a file."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    side = bytes(SIDE)
    head = HEADER + struct.pack(">H", crc16(HEADER[2:] + side)) + side
    tail = bytes(FRAME - len(head) - UNIT)
    count = len(payload) // UNIT
    table = bytes(i * 256 // 100 for i in range(100))
    info = b"Info" + struct.pack(">III", 7, count, (count + 1) * FRAME) + table
    frames = [head + info + bytes(FRAME - len(head) - len(info))]
    frames += [head + payload[i : i + UNIT] + tail for i in range(0, len(payload), UNIT)]
    body = b"".join(_text_frame(k, v) for k, v in {"payload_bytes": str(len(payload)), **(tags or {})}.items())
    v1 = b"TAG" + b"payload".ljust(30, b"\0") + bytes(94) + b"\xff"
    return b"ID3\x04\0\0" + _synchsafe(len(body)) + body + b"".join(frames) + v1


def _tags(data: bytes) -> tuple[int, dict[str, str]]:
    """Where the audio starts, and the TXXX values of a leading ID3v2.3 or 2.4 tag."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 0x7F:
        return 0, {}
    size = data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
    end, at, found = min(len(data), 10 + size), 10, {}
    while at + 10 <= end and data[at : at + 4].strip(b"\0"):
        raw = data[at + 4 : at + 8]
        n = raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3] if data[3] >= 4 else int.from_bytes(raw, "big")
        body = data[at + 10 : min(end, at + 10 + n)]
        if data[at : at + 4] == b"TXXX" and b"\0" in body[1:]:
            key, _, value = body[1:].partition(b"\0")
            found[key.decode("utf-8", "replace")] = value.rstrip(b"\0").decode("utf-8", "replace")
        at += 10 + n
    return min(len(data), 10 + size + 10 * (data[5] >> 4 & 1)), found


def read(data: bytes, *, keep_bodies: bool = False) -> dict:
    """Everything the stored bytes say; never raises on damaged input.

    Keys: tags, id3v1, version, layer, rate, channels, kbit_min, kbit_max, frames, samples, duration_us (rounded down),
    crc_checked, crc_bad, skipped (bytes that belong to no frame), vbr (the table's frames, bytes and kind, or None),
    seek (byte offset of every frame) and, if asked for, bodies (after header, CRC and side information).
    """
    start, tags = _tags(data)
    end = len(data) - 128 if len(data) - start >= 128 and data[-128:-125] == b"TAG" else len(data)
    out: dict = {"tags": tags, "id3v1": end != len(data), "version": None, "layer": None, "rate": None, "channels": None, "kbit_min": None, "kbit_max": None, "frames": 0, "samples": 0, "crc_checked": 0, "crc_bad": 0, "skipped": 0, "vbr": None, "seek": []}
    at, bodies, known, checked, first = start, [], {}, {}, True
    while at + 4 <= end:
        four = data[at : at + 4]
        head = known.get(four)
        if head is None:
            head = known[four] = parse_header(four)
        good = False
        if head:
            after = at + head[5]
            if after == end:
                good = True
            elif after + 4 <= end:
                four2 = data[after : after + 4]
                head2 = known.get(four2)
                if head2 is None:
                    head2 = known[four2] = parse_header(four2)
                good = head2 is not None and head2[0] == head[0] and head2[1] == head[1] and head2[4] == head[4] or after in (end - 128, end)
        if not good:
            sync = data.find(b"\xff", at + 1, end)
            sync = end if sync < 0 else sync
            out["skipped"] += sync - at
            at = sync
            continue
        version, layer, protected, kbit, rate, length, samples, channels, side = head
        body = at + 4 + 2 * protected + side
        if protected:
            frame = data[at : at + length]
            # all the guarded bits of layer III; of the others the first 64 bytes hold them
            guarded = frame[2:4] + frame[6 : 6 + (side or 64)]
            crc = checked.get((head, guarded))
            if crc is None:
                crc = checksum(frame, head)
                if len(checked) < 4096:
                    checked[head, guarded] = crc
            out["crc_checked"] += 1
            out["crc_bad"] += crc != data[at + 4] << 8 | data[at + 5]
        if first:
            first = False
            out |= {"version": version, "layer": layer, "rate": rate, "channels": channels, "kbit_min": kbit, "kbit_max": kbit}
            out["vbr"] = _variable_rate(data[at : at + length], layer, body - at)
            if out["vbr"]:
                at += length
                continue
        out["seek"].append(at)
        out["frames"] += 1
        out["samples"] += samples
        if kbit < out["kbit_min"]:
            out["kbit_min"] = kbit
        elif kbit > out["kbit_max"]:
            out["kbit_max"] = kbit
        if keep_bodies:
            bodies.append(data[body : at + length])
        at += length
    out["skipped"] += max(0, end - at)
    out["duration_us"] = out["samples"] * 1_000_000 // out["rate"] if out["rate"] else 0
    return out | ({"bodies": bodies} if keep_bodies else {})


def payload_of(found: dict) -> bytes:
    """The payload that encode() stored."""
    return b"".join([b[:UNIT] for b in found["bodies"]])


def describe(found: dict) -> str:
    vbr = found["vbr"] or {}
    return (
        f"mpeg{ {3: '1', 2: '2', 0: '2.5', None: '?'}[found['version']]} layer{found['layer']} {found['rate']}Hz {found['channels']}ch {found['kbit_min']}-{found['kbit_max']}kbit"
        f" frames={found['frames']} samples={found['samples']} us={found['duration_us']} crc={found['crc_checked']}/{found['crc_bad']} skipped={found['skipped']}"
        f" vbr={vbr.get('kind')}:{vbr.get('frames')}:{vbr.get('bytes')} seek={zlib.crc32(','.join(map(str, found['seek'])).encode())}"
    )


FEATURES = "frames bigint, samples bigint, duration_us bigint, rate int, channels int, kbit_min int, kbit_max int, crc_checked bigint, crc_bad bigint, skipped bigint, vbr_frames bigint, vbr_bytes bigint, id3v1 boolean, tags map<string,string>, seek array<bigint>, feature string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, n_bytes, media)."""
    for batch in batches:
        raw = [(t.as_py() or "").encode() for t in batch.column(1)]
        media = [encode(r + b" " * (-len(r) % UNIT or UNIT * (not r))) for r in raw]
        yield pa.record_batch([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=["__k0", "__k1", "media"])


def _understood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(any columns, media) to (those columns, what the reader finds)."""
    wide, i32, text = pa.int64(), pa.int32(), pa.string()
    types = {"frames": wide, "samples": wide, "duration_us": wide, "rate": i32, "channels": i32, "kbit_min": i32, "kbit_max": i32, "crc_checked": wide, "crc_bad": wide, "skipped": wide, "vbr_frames": wide, "vbr_bytes": wide, "id3v1": pa.bool_(), "tags": pa.map_(text, text), "seek": pa.list_(wide), "feature": text, "payload_bytes": wide, "payload_sha256": text, "tail_crc32": wide, "media_bytes": wide, "media_sha256": text}
    for batch in batches:
        rows = []
        for data in batch.column(batch.num_columns - 1):
            data = data.as_py() or b""
            found = read(data, keep_bodies=True)
            payload, vbr = payload_of(found), found["vbr"] or {}
            row = found | {"vbr_frames": vbr.get("frames"), "vbr_bytes": vbr.get("bytes"), "tags": list(found["tags"].items()), "feature": describe(found), "bodies": None}
            row |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
            rows.append(row)
        yield pa.record_batch([*batch.columns[:-1], *(pa.array([r[k] for r in rows], t) for k, t in types.items())], names=[*(f"__k{i}" for i in range(batch.num_columns - 1)), *types])


def add_audio(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, media): every whole text, null as empty, as UTF-8 with spaces up to a positive multiple of 192, stored.

    Repeated rows are rows of their own, an empty table gives an empty one, other columns, whatever their names, are left out. Memory follows the longest text.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    out = map_rows(docs, [field(docs, id_column).alias("__k0"), field(docs, text_column).cast("string").alias("__text")], _stored, f"__k0 {kind}, __k1 bigint, media binary")
    return out.withColumnsRenamed({"__k0": id_column, "__k1": "n_bytes"})


def read_audio(media: DataFrame, *, media_column: str = "media", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and what the reader finds in each row's stored bytes.

    seek holds the byte offset of every frame. A null or unreadable value has no frames: counts 0, duration 0,
    rate and channels null, the hashes those of no bytes. Equal bytes give equal values, also in repeated rows. An empty table gives an empty one. A
    kept column that has the name of one of the reader's stands beside it.
    """
    keep = [c for c in media.columns if c != media_column] if keep is None else keep
    kinds = [f"__k{i} {media.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    out = map_rows(media, [*(field(media, c).alias(f"__k{i}") for i, c in enumerate(keep)), field(media, media_column).alias("__m")], _understood, ", ".join([*kinds, FEATURES]))
    return out.withColumnsRenamed({f"__k{i}": c for i, c in enumerate(keep)})


def stored_and_read(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """read_audio(add_audio(docs)) with both steps in one worker: the stored bytes exist for a batch at a time. Nulls, repeated rows, empty tables and clashing names as there."""
    kind = docs.schema[id_column].dataType.simpleString()
    columns = [field(docs, id_column).alias("__k0"), field(docs, text_column).cast("string").alias("__text")]
    out = map_rows(docs, columns, lambda batches: _understood(_stored(batches)), f"__k0 {kind}, __k1 bigint, {FEATURES}")
    return out.withColumnsRenamed({"__k0": id_column, "__k1": "n_bytes"})
