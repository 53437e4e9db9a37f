"""Operators 4 and 7 against the tokenizers library and exact round trips."""

from __future__ import annotations

import hashlib
import random
import zlib

import pyarrow.parquet as pq
from tokenizers import Tokenizer

from docsluice.llm.bpe import Codec, bpe_encode, default_tokenizer, op4_bpe
from docsluice.llm.media import media_column, op7_media, read_audio, write_audio

DATA = "/root/testdata/sf0.01"


def library():
    tool = Tokenizer.from_file(default_tokenizer()[0])
    tool.no_truncation()
    tool.no_padding()
    return tool


def odd_texts():
    r = random.Random(3)
    return [None, "", " ", "\n\n  x", "a" * 5000, "ab" * 3001, "don't  STOP'S<|endoftext|>é漢字🙂 x<|endoftext|>", "�\x00 ", "١٢٣ 12345", "".join(chr(r.choice([32, 10, 97, 65, 233, 0x4E2D, 0x1F600, 0x300])) for _ in range(3000)), "x " * 60000]


def test_encode_as_the_library(spark):
    tool = library()
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, decoded string")
    got = {r.doc_id: r for r in bpe_encode(df, *default_tokenizer()).collect()}
    for i, t in enumerate(texts):
        ids = tool.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert bytes(got[i].token_ids) == b"".join(x.to_bytes(4, "little") for x in ids), i
        assert got[i].decoded == tool.decode(ids, skip_special_tokens=False)
    assert bpe_encode(df.limit(0), *default_tokenizer()).count() == 0


def test_long_words_as_the_library():
    import time

    r = random.Random(5)
    tool, codec = library(), Codec(*default_tokenizer())
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (256, 257, 300, 5_000, 50_000)]
    texts += ["a" * 1001, "abab" * 200 + "aab" * 99, "".join(r.choice("ab") for _ in range(4000)), "한국어中文日本" * 500, "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(3000)), f"{'x' * 700} {'y' * 700} {'x' * 700}"]
    ids, bounds = codec.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids for e in tool.encode_batch(texts, add_special_tokens=False)]
    assert not any(len(w.encode()) > 256 for w in codec.known)
    million = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    began = time.perf_counter()
    assert codec.encode([million])[0].tolist() == tool.encode(million, add_special_tokens=False).ids
    assert time.perf_counter() - began < 60


def test_documents_as_the_library(spark):
    tool = library()
    table = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"])
    want = set()
    for d, e in zip(table["doc_id"].to_pylist(), tool.encode_batch([t or "" for t in table["text"].to_pylist()], add_special_tokens=False)):
        text = tool.decode(e.ids, skip_special_tokens=False)
        want.add((d, len(e.ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in e.ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert {tuple(r) for r in op4_bpe(spark, DATA).collect()} == want


def test_small_table_of_known_words(monkeypatch):
    import docsluice.llm.bpe as bpe

    monkeypatch.setattr(bpe, "KNOWN_WORDS", 1)
    tool, codec = library(), Codec(*default_tokenizer())
    for t in ("one two three", "three four", "one"):
        assert codec.encode([t])[0].tolist() == tool.encode(t, add_special_tokens=False).ids


def test_media_round_trip(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    rows = {r.doc_id: r for r in media_column(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert bytes(rows[i].payload) == payload and rows[i].n_bytes == len(raw)
        assert rows[i].duration == len(payload) // 192 * 1152 / 48000
        assert len(rows[i].frame_offsets) == len(payload) // 192


def test_media_columns(spark):
    """All rows against a plain reading of the contract; offsets follow from the frames' sizes."""
    table = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"])
    texts = dict(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
    rows = op7_media(spark, DATA).collect()
    assert len(rows) == len(texts)
    for row in rows:
        raw = (texts[row.doc_id] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        n, media = len(payload) // 192, write_audio(payload)
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (row.media_bytes, row.media_sha256, row.duration, row.n_frames) == (len(media), hashlib.sha256(media).hexdigest(), n * 1152 / 48000, n)
        at, offsets = media.index(b"Xing") - 6 - 17 + 288, []
        for i in range(n):
            offsets.append(at)
            at += 288 if i % 8 == 7 else 240
        assert at == len(media) - 128 and row.offsets_sha256 == hashlib.sha256(",".join(map(str, offsets)).encode()).hexdigest()
        told = dict(x.split("=") for x in row.feature.split(";"))
        assert told["seek"] == ",".join(str(offsets[i * n // 100]) for i in range(100)) and (told["frames"], told["bad"], told["skipped"], told["tags"]) == (str(n), "0", "0", "ID3v2+ID3v1")
        assert told["level"] == f"{sum((b - 128) ** 2 for b in payload) / len(payload):.6f}" and told["peak"] == str(max(abs(b - 128) for b in payload))
        assert told["offsets"] == f"{zlib.crc32(b''.join(o.to_bytes(8, 'little') for o in offsets)):08x}"


def frame(mode: int, guarded: bool, fill: int) -> bytes:
    """A frame of 80 kbit/s at 48 kHz; its checksum bit by bit."""
    head = bytes([0xFF, 0xFA if guarded else 0xFB, 6 << 4 | 1 << 2, mode << 6])
    side = bytes([fill]) * (17 if mode == 3 else 32)
    crc = 0xFFFF
    for byte in head[2:] + side:
        for bit in range(7, -1, -1):
            crc = (crc << 1 ^ (0x8005 if (crc >> 15 ^ byte >> bit) & 1 else 0)) & 0xFFFF
    return (head + (crc.to_bytes(2, "big") if guarded else b"") + side).ljust(240, bytes([fill]))


def test_read_other_frames():
    frames = [frame(mode, guarded, 16 * mode + 2 * guarded + 1) for mode in (0, 1, 2, 3) for guarded in (True, False)]
    got = read_audio(b"".join(frames))
    assert (got["frames"], got["bad"], got["skipped"], got["vbr"]) == (8, 0, 0, None) and got["payload"] == b"".join(f[-192:] for f in frames)
    broken = bytearray(b"".join(frames))
    broken[240 * 4 + 10] ^= 8
    assert read_audio(bytes(broken))["bad"] == 1
    for flags, words in ((1, [7]), (2, [9]), (9, [7, 5]), (0, [])):
        first = bytearray(frame(0, False, 0))
        told = b"Info" + flags.to_bytes(4, "big") + b"".join(w.to_bytes(4, "big") for w in words)
        first[36 : 36 + len(told)] = told
        vbr = read_audio(bytes(first) + frames[0])["vbr"]
        assert [v for v in (vbr["frames"], vbr["bytes"], vbr["quality"]) if v is not None] == words and vbr["seek"] is None


def test_resynchronise():
    payload = bytes(range(32, 224)) * 40
    data = write_audio(payload)
    clean = read_audio(data)
    assert clean["vbr"]["frames"] == 40 and clean["payload"] == payload and clean["tags"] == ["ID3v2", "ID3v1"]
    cut = int(clean["offsets"][7])
    noisy = data[:cut] + b"\xff\xfa\x00junk\xff\xfa" + data[cut:]
    again = read_audio(noisy)
    assert again["payload"] == payload and again["skipped"] == 9
    broken = bytearray(data)
    broken[cut + 8] ^= 1
    assert read_audio(bytes(broken))["bad"] == 1
