"""Operator 7: media columns as MPEG audio.

A payload is carried by MPEG-1 layer III frames whose side information declares no coded audio, so
every player decodes silence and all bytes after the side information are ancillary data: the
payload, 192 bytes a frame. The file begins with an ID3v2 tag and a variable-bitrate frame (frame
count, byte count, table of 100 seek points) and ends with an ID3v1 tag. Short runs of frames use a
higher bitrate, so the table is needed.

Reading resynchronises on frame headers: a header counts if the one that its length points to, or
the end of the audio, is where it should be, or if its own checksum holds. Frames of one and of two
channels, with and without a checksum, are read; a variable-bitrate table is read by its flags. Each
frame's 16-bit checksum is verified; durations are exact (samples over sampling rate) and seek
offsets are the frames' own byte positions. The feature holds these, the seek offset of each
hundredth of the frames, a checksum over all offsets, and the level of the samples read back.

Defined cases: null and empty texts carry one frame of blanks; equal texts give equal files; very
long texts make more frames; other columns of the input pass through, but for those that are named
as one of the added.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import table
from .words import slices

UNIT = 192
SAMPLES, RATE = 1152, 48_000
#: Fixed values of the format: kbit/s of MPEG-1 layer III by header index, sampling rates, and the checksum's polynomial.
BITRATES = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
RATES = [44_100, 48_000, 32_000]
POLYNOMIAL = 0x8005
SIDE, SIDE_OF_TWO = 17, 32  # bytes of side information of one channel and of two
LOW, HIGH = 6, 7  # 80 and 96 kbit/s: frames of 240 and 288 bytes
#: Every eighth frame is a large one.
LARGE_EVERY = 8


def _crc_table() -> np.ndarray:
    out = np.zeros(256, dtype=np.uint16)
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = ((c << 1) ^ POLYNOMIAL) & 0xFFFF if c & 0x8000 else (c << 1) & 0xFFFF
        out[i] = c
    return out


CRC = _crc_table()


def checksums(rows: np.ndarray) -> np.ndarray:
    """The 16-bit checksum of each row's bytes: the last two of the header and the side information."""
    crc = np.full(len(rows), 0xFFFF, dtype=np.uint16)
    for j in range(rows.shape[1]):
        crc = ((crc << np.uint16(8)) & np.uint16(0xFFFF)) ^ CRC[(crc >> np.uint16(8)) ^ rows[:, j]]
    return crc


def frame_size(index: int, rate: int = RATE) -> int:
    return 144 * BITRATES[index] * 1000 // rate


def header(index: int) -> bytes:
    """Sync, MPEG-1, layer III, with checksum; bitrate and 48 kHz; one channel."""
    return bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])


def synchsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def write_audio(payload: bytes) -> bytes:
    """A file that carries a payload of a positive multiple of 192 bytes."""
    n = len(payload) // UNIT
    index = np.where(np.arange(n) % LARGE_EVERY == LARGE_EVERY - 1, HIGH, LOW)
    rows = np.zeros((n, frame_size(HIGH)), dtype=np.uint8)
    rows[:, :4] = np.frombuffer(header(0), np.uint8)
    rows[:, 2] = index << 4 | 1 << 2
    rows[:, 6 + SIDE : 6 + SIDE + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    crc = checksums(np.concatenate([rows[:, 2:4], rows[:, 6 : 6 + SIDE]], axis=1))
    rows[:, 4], rows[:, 5] = crc >> 8, crc & 255
    sizes = np.where(index == HIGH, frame_size(HIGH), frame_size(LOW))
    audio = rows[np.arange(rows.shape[1]) < sizes[:, None]].tobytes()
    first = bytearray(frame_size(HIGH))
    first[:4] = header(HIGH)
    first_crc = int(checksums(np.frombuffer(bytes(first[2:4]) + bytes(SIDE), np.uint8)[None, :])[0])
    first[4:6] = first_crc.to_bytes(2, "big")
    starts = np.cumsum(sizes) - sizes + len(first)
    total = len(first) + len(audio)
    seek = starts[np.minimum(np.arange(100) * n // 100, n - 1)] * 256 // total
    table_ = b"Xing" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + total.to_bytes(4, "big") + seek.astype(np.uint8).tobytes()
    first[6 + SIDE : 6 + SIDE + len(table_)] = table_
    name = b"\x00payload frames"
    text = b"TIT2" + len(name).to_bytes(4, "big") + b"\x00\x00" + name
    head = b"ID3\x03\x00\x00" + synchsafe(len(text)) + text
    tail = b"TAG" + b"payload frames".ljust(125, b"\x00")
    return head + bytes(first) + audio + tail


def _sides(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bytes of side information of the frames at these places."""
    return np.where(flat[at + 3] >> 6 == 3, SIDE, SIDE_OF_TWO)


def _checks(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the checksum that follows each header holds."""
    out = np.zeros(len(at), dtype=bool)
    stored = flat[at + 4].astype(np.uint16) << np.uint16(8) | flat[at + 5]
    sides = _sides(flat, at)
    for side in (SIDE, SIDE_OF_TWO):
        own = np.flatnonzero((sides == side) & (at + 6 + side <= len(flat)))
        guarded = flat[np.concatenate([at[own, None] + [2, 3], at[own, None] + np.arange(6, 6 + side)], axis=1)]
        out[own] = stored[own] == checksums(guarded)
    return out


def _table(data: bytes, at: int) -> dict | None:
    """The variable-bitrate table at a place, by its flags: frames, bytes, 100 seek points, quality."""
    if data[at : at + 4] not in (b"Xing", b"Info") or at + 8 > len(data):
        return None
    flags, at = int.from_bytes(data[at + 4 : at + 8], "big"), at + 8
    out = {"frames": None, "bytes": None, "seek": None, "quality": None}
    for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "seek", 100), (8, "quality", 4)):
        if flags & bit and at + size <= len(data):
            out[name] = list(data[at : at + size]) if name == "seek" else int.from_bytes(data[at : at + size], "big")
            at += size
    return out


def read_audio(data: bytes) -> dict:
    """Tags, frames, checksums, duration and ancillary bytes of a file, whatever lies between its frames."""
    flat = np.frombuffer(data, np.uint8)
    begin, end = 0, len(data)
    tags = []
    while data[begin : begin + 3] == b"ID3" and begin + 10 <= end:
        s = data[begin + 6 : begin + 10]
        begin += 10 + (s[0] << 21 | s[1] << 14 | s[2] << 7 | s[3])
        tags.append("ID3v2")
    if end - begin >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags.append("ID3v1")
    # a header: 11 bits of sync, MPEG-1, layer III, a bitrate and a sampling rate that exist
    at = np.flatnonzero((flat[begin : max(begin, end - 3)] == 0xFF) & (flat[begin + 1 : max(begin + 1, end - 2)] & 0xFE == 0xFA)) + begin
    b2 = flat[at + 2]
    ok = (b2 >> 4 != 0) & (b2 >> 4 != 15) & (b2 >> 2 & 3 != 3)
    at, b2 = at[ok], b2[ok]
    rate = np.array([*RATES, 1])[b2 >> 2 & 3]
    size = 144_000 * np.array([*BITRATES, 0])[b2 >> 4] // rate + (b2 >> 1 & 1)
    follows = np.isin(at + size, at) | (at + size == end)
    alone = np.flatnonzero(~follows & (at + size <= end) & (flat[at + 1] & 1 == 0))
    follows[alone] = _checks(flat, at[alone])
    position, frames = begin, []
    candidates = at[follows].tolist()
    sizes = size[follows].tolist()
    skipped = 0
    for p, s in zip(candidates, sizes):
        if p >= position:
            skipped += p - position
            frames.append((p, s))
            position = p + s
    skipped += end - position
    result = {"tags": tags, "skipped": skipped, "vbr": None}
    if frames:
        p = frames[0][0]
        for start in (4, 6):  # some writers leave the place of the checksum out, whatever the header says
            result["vbr"] = result["vbr"] or _table(data, p + start + int(_sides(flat, np.array([p]))[0]))
        if result["vbr"]:
            result["first"] = p
            frames = frames[1:]
    where = np.array([p for p, _ in frames], dtype=np.int64)
    if len(where):
        guarded = flat[where + 1] & 1 == 0
        good = np.ones(len(where), dtype=bool)
        good[guarded] = _checks(flat, where[guarded])
        rate = np.array([*RATES, 1])[flat[where + 2] >> 2 & 3]
        seconds = (SAMPLES / rate).sum() if len(set(rate.tolist())) > 1 else len(where) * SAMPLES / int(rate[0])
        start = 4 + 2 * guarded + _sides(flat, where)
        holds = good & (start + UNIT <= np.array([s for _, s in frames]))
        payload = flat[(where + start)[holds, None] + np.arange(UNIT)].tobytes()
    else:
        good, seconds, payload = np.zeros(0, bool), 0.0, b""
    return result | {"frames": len(where), "bad": int((~good).sum()), "seconds": seconds, "offsets": where, "sizes": np.array([s for _, s in frames], dtype=np.int64), "payload": payload}


def feature(read: dict) -> str:
    """Counts, exact duration, seek offsets (of each hundredth of the frames, and a checksum over all), and the level of the samples."""
    n = read["frames"]
    seek = read["offsets"][np.arange(100) * n // 100].tolist() if n else []
    samples = np.frombuffer(read["payload"], np.uint8).astype(np.int64) - 128
    level = int((samples**2).sum()) / max(len(samples), 1)
    crossings = int((np.diff(samples >= 0)).sum()) if len(samples) else 0
    vbr = read["vbr"] or {}
    return (
        f"frames={n};bad={read['bad']};skipped={read['skipped']};samples={n * SAMPLES};seconds={read['seconds']:.6f};kbps={int(8 * read['sizes'].sum() * RATE / (SAMPLES * max(n, 1)) / 1000)};vbr={vbr.get('frames', -1)},{vbr.get('bytes', -1)};"
        f"offsets={zlib.crc32(read['offsets'].astype('<i8').tobytes()):08x};seek={','.join(map(str, seek))};level={level:.6f};peak={int(np.abs(samples).max()) if len(samples) else 0};crossings={crossings};tags={'+'.join(read['tags'])}"
    )


def media_column(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with media (the stored file), what is read back from it, its frames' offsets and its feature."""
    added = {"n_bytes": "long", "media": "binary", "payload": "binary", "duration": "double", "frame_offsets": "array<long>", "feature": "string"}
    own = [c for c in docs.columns if c.lower() not in {"text", *added}]
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in own) + ", ".join(f"{k} {v}" for k, v in added.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                sizes, files, reads = [], [], []
                for text in piece.column("text").to_pylist():
                    raw = (text or "").encode()
                    sizes.append(len(raw))
                    files.append(write_audio(raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT))))
                    reads.append(read_audio(files[-1]))
                columns = [
                    *(piece.column(c) for c in own), pa.array(sizes, pa.int64()), pa.array(files, pa.binary()), pa.array([r["payload"] for r in reads], pa.binary()),
                    pa.array([r["seconds"] for r in reads], pa.float64()), pa.array([r["offsets"] for r in reads], pa.list_(pa.int64())), pa.array([feature(r) for r in reads], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*own, *added])

    return docs.select(*own, F.col("text").cast("string").alias("text")).mapInArrow(run, fields)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media_column(table(spark, sf_dir, "documents").select("doc_id", "text"))
    tail = F.expr("substring(payload, length(payload) - 15, 16)")
    return stored.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).cast("long").alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
        "duration", F.size("frame_offsets").cast("long").alias("n_frames"), F.sha2(F.array_join("frame_offsets", ",").cast("binary"), 256).alias("offsets_sha256"),
    )


__all__ = ["media_column", "op7_media", "read_audio", "write_audio"]
