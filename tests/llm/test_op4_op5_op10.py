import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from grainmill.llm import mpeg_audio as M
from grainmill.llm import token_counts as C
from grainmill.llm import token_tables as T
from grainmill.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
TEXTS = ["", "a  b\n\n c\t\td  ", "<|endoftext|> x", "it's  we'll \x85 　 b", " lead", "trail ", "x\r\n\r\ny", "ﬁn\xa0 z !!! \x1c a", "日本 語 ​ q", "   ", "don't 12 3.5 $%^& *()\n-- x''s", "ÀÉ ×÷ µª", "<s> </s> ▁x a▁b"]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def test_cached_encoder_equals_the_library(spark):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = T.CachedEncoder(vocabulary(name), 2)
        want = [encoder.pack([*e.ids, 2]) for e in library(name).encode_batch(texts, add_special_tokens=False)]
        assert encoder.encode(texts) == want


def test_tables_hold_what_was_written(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd)
    path = f"file://{tmp_path}/t"
    got = T.tokens_on_disk(docs, vocabulary("byte_bpe_50k.json"), path=path).collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in docs.collect())
    encode = lambda t: [*library_.encode(t, add_special_tokens=False).ids, 2]
    library_ = library("byte_bpe_50k.json")
    ids = {t: encode(t) for _, t in rows}
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [k for k, _ in rows]
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert [s for s, _ in starts] == [0, *np.cumsum([n for _, n in starts])[:-1].tolist()]
    by_start = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert by_start == [k if has else None for (has, k), _ in rows]
    crc = lambda t: zlib.crc32(np.array(ids[t], "<u4").tobytes())
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got) == sorted(str((k if has else None, len(ids[t]), crc(t))) for (has, k), t in rows)
    assert sorted(x.tolist() for x in T.lookup(path, 1)) == sorted(ids[t] for (has, k), t in rows if has and k == 1)
    assert T.lookup(path, 10**9) == [] and len(T.lookup(path, None)) == 2


def test_string_ids_and_empty_tables(spark, none):
    docs = spark.createDataFrame([("b", "x y"), ("a", None), (None, "z")], "doc_id string, text string")
    got = T.tokens_on_disk(docs, vocabulary("byte_bpe_50k.json")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, "a", "b"] and got[1].n_tokens == 1
    assert T.tokens_on_disk(none, vocabulary("byte_bpe_50k.json")).count() == 0


def test_shards_are_searched_and_checked():
    import io

    random.seed(3)
    rows = [(T.key_of(i * 3), np.arange(random.randrange(0, 4000), dtype="<u2").tobytes()) for i in range(-200, 300)]
    rows.insert(7, rows[6])
    data = T.shard_bytes(rows, 2)
    reader = T.Reader(io.BytesIO(data), len(data))
    assert len(reader.places) > 3 and [(k[:-4], v) for k, v in reader] == rows
    assert all(len(reader.get(k)) == (2 if k == rows[6][0] else 1) for k, _ in rows)
    assert sum(reader.may_have(T.key_of(i * 3 + 1)) for i in range(1000)) < 60
    bad = bytearray(data)
    bad[40] ^= 1
    with pytest.raises(ValueError):
        list(T.Reader(io.BytesIO(bytes(bad)), len(bad)))


def test_a_hot_id_spreads_over_shards(spark):
    docs = spark.range(400).selectExpr("7L as doc_id", "concat('text ', id) as text")
    path = T.new_path(spark, "hot")
    manifest = T.write_table(docs, path, vocabulary("byte_bpe_50k.json"))
    assert len(manifest) > 1 and max(m["rows"] for m in manifest) < 300 and len(T.lookup(path, 7)) == 400


def test_media_round_trip(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd)
    for r, d in zip(M.stored_and_read(docs).collect(), docs.collect(), strict=True):
        raw = (d.text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (d.doc_id, len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.frames == len(payload) // 192 and r.duration_us == r.frames * 24000 and r.crc_bad == 0 and r.skipped == 0
        media = M.encode(payload)
        assert r.media_bytes == len(media) and r.media_sha256 == hashlib.sha256(media).hexdigest()
        assert r.tags == {"payload_bytes": str(len(payload))} and r.vbr_frames == r.frames
        assert all(media[s : s + 2] == M.HEADER[:2] for s in r.seek)
    assert M.read_audio(M.add_audio(none)).count() == 0


def bitwise_crc(bits):
    crc = 0xFFFF
    for b in bits:
        crc = (crc << 1 ^ (0x8005 if (crc >> 15 & 1) ^ b else 0)) & 0xFFFF
    return crc


def to_bits(data):
    return [b >> k & 1 for b in data for k in range(7, -1, -1)]


def layered(four, allocation, selected):
    """A protected frame of layer I or II: header, CRC, bits, zeros."""
    length = M.parse_header(four)[5]
    bits = allocation + selected
    body = bits + [0] * (8 * (length - 6) - len(bits))
    raw = bytes(int("".join(map(str, body[k : k + 8])), 2) for k in range(0, len(body), 8))
    return four + bitwise_crc(to_bits(four[2:4]) + bits).to_bytes(2, "big") + raw


@pytest.mark.parametrize(
    ("four", "widths", "shared"),
    [
        (bytes((0xFF, 0xFE, 0x80, 0xC0)), [4] * 32, 1),  # layer I, mono
        (bytes((0xFF, 0xFE, 0x80, 0x00)), [4] * 64, 2),  # layer I, stereo
        (bytes((0xFF, 0xFE, 0x80, 0x50)), [4] * (2 * 8 + 24), 2),  # layer I, joint stereo from subband 8 on
        (bytes((0xFF, 0xFC, 0x44, 0xC0)), [4] * 11 + [3] * 12 + [2] * 4, 1),  # layer II, 48 kHz, 64 kbit/s, mono
        (bytes((0xFF, 0xFC, 0xA0, 0xC0)), [4] * 11 + [3] * 12 + [2] * 7, 1),  # layer II, 44.1 kHz, 192 kbit/s, mono
        (bytes((0xFF, 0xFC, 0x18, 0xC0)), [4] * 2 + [3] * 10, 1),  # layer II, 32 kHz, 32 kbit/s, mono
        (bytes((0xFF, 0xFC, 0x14, 0xC0)), [4] * 2 + [3] * 6, 1),  # layer II, 48 kHz, 32 kbit/s, mono
        (bytes((0xFF, 0xF4, 0x80, 0xC0)), [4] * 4 + [3] * 7 + [2] * 19, 1),  # layer II of MPEG-2, mono
    ],
)
def test_checksums_of_layers_one_and_two(four, widths, shared):
    random.seed(7)
    values = [random.randrange(1 << w) if random.random() < 0.6 else 0 for w in widths]
    allocation = [b for v, w in zip(values, widths, strict=True) for b in map(int, f"{v:0{w}b}")]
    layer = 4 - (four[1] >> 1 & 3)
    selected = [random.randrange(2) for v in values if v for _ in range(2)] if layer == 2 else []
    frames = layered(four, allocation, selected) * 5
    assert (M.read(frames)["crc_checked"], M.read(frames)["crc_bad"], M.read(frames)["layer"]) == (5, 0, layer)
    damaged = bytearray(frames)
    damaged[6] ^= 0x10
    assert M.read(bytes(damaged))["crc_bad"] == 1


def test_joint_stereo_of_layer_two():
    """Above the bound, two channels share an allocation and have a selection each."""
    four = bytes((0xFF, 0xFC, 0x84, 0x40))  # 48 kHz, 128 kbit/s, joint stereo from subband 4 on
    widths = [4] * 8 + [4] * 7 + [3] * 12 + [2] * 4
    values = [(3 * k + 1) % (1 << w) for k, w in enumerate(widths)]
    allocation = [b for v, w in zip(values, widths, strict=True) for b in map(int, f"{v:0{w}b}")]
    selected = [1, 0] * (sum(v > 0 for v in values[:8]) + 2 * sum(v > 0 for v in values[8:]))
    found = M.read(layered(four, allocation, selected) * 4)
    assert (found["crc_checked"], found["crc_bad"], found["channels"]) == (4, 0, 2)


def test_vbri_table_and_all_seek_offsets():
    plain = M.encode(b"p" * 192 * 6)
    start = plain.index(M.HEADER)
    frame = bytearray(plain[start : start + M.FRAME])
    frame[36 : 36 + 26 + 6] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 7 * 240, 6, 3, 2, 2, 2) + struct.pack(">HHH", 240, 240, 240)
    found = M.read(plain[:start] + bytes(frame) + plain[start + M.FRAME :])
    assert found["vbr"] == {"kind": "VBRI", "frames": 6, "bytes": 1680, "toc": [480, 480, 480], "frames_each": 2}
    assert found["frames"] == 6 and found["seek"] == [start + M.FRAME * k for k in range(1, 7)] and M.read(plain)["vbr"]["kind"] == "Info"


def test_media_and_tokens_of_clashing_names(spark, clash, odd):
    from pyspark.sql import functions as F

    more = clash.select("*", *(F.lit(1).alias(c) for c in ("__k0", "__k1", "__text", "__m", "media", "seek", "frames", "d", "ids")))
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(M.stored_and_read(more)) == plain(M.stored_and_read(odd))
    path = vocabulary("byte_bpe_50k.json")
    assert plain(T.tokens_on_disk(more, path)) == plain(T.tokens_on_disk(odd, path)) and T.tokens_on_disk(more.limit(0), path).count() == 0


def test_plain_segments_are_those_of_the_pattern():
    random.seed(12)
    pieces = [" ", "  ", "\n", "\t", "\r\n", "'", "'s", "'re", "'ll", "'v", "'ve", "a", "re", "Zé", "ß", "0", "42", "!", "...", "-", "s", "'t", "''", "é'd", " '", "ɏ"]
    pattern = T.CachedEncoder.PLAIN
    for _ in range(400):
        texts = ["".join(random.choice(pieces) for _ in range(random.randrange(0, 14))) for _ in range(random.randrange(0, 6))]
        raw = [t.encode() for t in texts]
        data, ends = b"".join(raw), np.cumsum([len(r) for r in raw]).astype(np.int64)
        at = [*T.plain_segments(np.frombuffer(data, np.uint8), ends).tolist(), len(data)]
        assert [data[i:j].decode() for i, j in zip(at, at[1:], strict=False)] == [s for t in texts for s in pattern.findall(t)]


@pytest.mark.parametrize("size", [1, 40, 4 << 20])
def test_encoder_equals_the_library(monkeypatch, size):
    from tokenizers import Tokenizer

    monkeypatch.setattr(T, "PLAIN_CHARACTERS", size)
    path = vocabulary("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), T.CachedEncoder(path, 2)
    random.seed(13)
    words = ["the", " and", "'s", "'re", "\n\n", "  ", "Übung", " été", "12", " 345", "...", " (x)", "\t", "a'll", "<|endoftext|>", "日本", "\u00a0", " ", "é"]
    texts = ["", *("".join(random.choice(words[: random.choice((14, len(words)))]) for _ in range(random.randrange(40))) for _ in range(300))]
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u2" if encoder.width == 2 else "<u4").tolist() == [*library.encode(t, add_special_tokens=False).ids, 2]


def test_remembered_segments_are_bounded_by_characters():
    encoder = T.CachedEncoder(vocabulary("byte_bpe_50k.json"), 2)
    encoder.CACHE_CHARACTERS = 5000
    texts = [f"w{k}x" * 200 for k in range(60)]
    first = encoder.encode(texts[:1])
    for t in texts:
        encoder.encode([t])
        assert encoder.characters == sum(map(len, encoder.known)) <= 5000 and len(encoder.known) > 0
    assert encoder.encode(texts[:1]) == first


def test_reader_resynchronises_and_checks():
    good = M.encode(b"p" * 192 * 10)
    found = M.read(good[:800] + b"noise \xff\xfb\x90\x00 \xff" + good[800:], keep_bodies=True)
    assert found["skipped"] > 0 and 8 <= found["frames"] <= 10
    damaged = bytearray(good)
    at = M.read(good)["seek"][0]
    damaged[at + 8] ^= 0xFF
    assert M.read(bytes(damaged))["crc_bad"] == 1
    assert M.read(good[:-400])["frames"] < 10 and M.read(b"")["frames"] == 0
    assert M.read(bytes(random.Random(1).randbytes(5000)))["samples"] >= 0


@pytest.mark.parametrize(
    ("four", "want"),
    [
        (b"\xff\xfb\x90\x00", (3, 3, False, 128, 44100, 417, 1152, 2, 32)),
        (b"\xff\xfd\xa4\xc0", (3, 2, False, 192, 48000, 576, 1152, 1, 0)),
        (b"\xff\xff\x92\x00", (3, 1, False, 288, 44100, 316, 384, 2, 0)),
        (b"\xff\xf3\x80\xc0", (2, 3, False, 64, 22050, 208, 576, 1, 9)),
        (b"\xff\xe3\x18\xc4", None),
        (b"\xff\xfb\xf0\x00", None),
        (b"\xff\xeb\x90\x00", None),
    ],
)
def test_headers(four, want):
    if want is None and four[2] == 0x18:
        assert M.parse_header(four)[:2] == (0, 3)
    else:
        assert M.parse_header(four) == want


def test_crc16():
    assert M.crc16(b"123456789") == 0xAEE7


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_spliced_counts_equal_whole_ones(spark, name):
    encoder = C.load(vocabulary(name))
    assert encoder.cut is not None
    texts = [t * 40 for t in TEXTS] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["x" * 5000, "日本語" * 900, " " * 3000]
    for text in texts:
        for chunk, overlap in ((300, 20), (700, 100)):
            if len(text) > chunk:
                assert C.spliced_count(encoder, text, chunk, overlap)[0] == encoder.counts([text])[0]


def test_counts_by_the_library(spark, odd, none, clash):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd)
    got = C.count_tokens(docs, vocabulary("piece_bpe_32k.model")).collect()
    for r, d in zip(got, docs.collect(), strict=True):
        n = len(model.encode(d.text or ""))
        assert (r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) == (d.doc_id, len((d.text or "").encode()), n, n > 4096)
    assert max(r.n_chunks for r in got) > 3
    assert C.count_tokens(none, vocabulary("piece_bpe_32k.model")).count() == 0
    assert C.count_tokens(clash, vocabulary("word_bpe_49k.json")).count() == clash.count()
