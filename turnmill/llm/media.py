"""Telephony audio columns.

Stored forms are WAV files with mu-law, A-law or IMA ADPCM data. mu-law and A-law
are expanded by 256-entry tables, ADPCM blocks are decoded with numpy for all
blocks of a batch at once (one step of the recurrence handles every block), and
the 8 kHz result is doubled to 16 kHz by a half-band filter and stored as PCM.

Cases: a null payload counts as empty; the payload is padded with zero bytes to
a positive multiple of 64; equal payloads give equal files and features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 64
#: Bytes of stored files that are decoded together; their PCM takes four to eight times as much.
GROUP_BYTES = 2 << 20
RATE = 8000
CODECS = ("mulaw", "alaw", "ima")
FORMATS = {"mulaw": 7, "alaw": 6, "ima": 0x11, "pcm": 1}

# Fixed values of the IMA ADPCM format: step sizes and index changes by code.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int64) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int64) ^ 0x55
    step, part = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(step == 0, part + 8, (part + 0x108) << np.maximum(step - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks: (blocks, 4 + bytes) uint8 to (blocks, 1 + 2 * bytes) int16. All blocks advance together."""
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.uint16).view(np.int16).astype(np.int32)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, 88)
    out[0] = value
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(2 * (width - 4)):
        code = (data[k >> 1] >> 4 if k & 1 else data[k >> 1] & 0x0F).astype(np.int32)
        step = STEPS[index]
        size = code & 7
        delta = (step >> 3) + (step >> 2) * (size & 1) + (step >> 1) * (size >> 1 & 1) + step * (size >> 2)
        value = np.clip(value + np.where(code & 8, -delta, delta), -32768, 32767)
        index = np.clip(index + CHANGES[size], 0, 88)
        out[k + 1] = value
    return np.ascontiguousarray(out.T)


def to_wav(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A WAV file that holds the payload losslessly: as 8-bit samples, or for ima as the data of blocks of UNIT bytes that start at 0."""
    if codec == "ima":
        blocks = np.zeros((len(payload) // UNIT, 4 + UNIT), np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        data, align, per_block = blocks.tobytes(), 4 + UNIT, 1 + 2 * UNIT
        fmt = struct.pack("<HHIIHHHH", FORMATS[codec], 1, rate, rate * align // per_block, align, 4, 2, per_block)
    elif codec == "pcm":
        data, fmt = payload, struct.pack("<HHIIHH", FORMATS[codec], 1, rate, rate * 2, 2, 16)
    else:
        data, fmt = payload, struct.pack("<HHIIHHH", FORMATS[codec], 1, rate, rate, 1, 8, 0)
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def from_wav(media: bytes) -> tuple[str, int, int, memoryview]:
    """Codec, rate, block size and data of a WAV file."""
    view, at, fmt, data = memoryview(media), 12, None, None
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        body = view[at + 8 : at + 8 + size]
        if media[at : at + 4] == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", body)
        elif media[at : at + 4] == b"data":
            data = body
        at += 8 + size + (size & 1)
    codec = next(name for name, tag in FORMATS.items() if tag == fmt[0])
    return codec, fmt[2], fmt[4], data


def payload_of(media: bytes) -> bytes:
    """The payload that to_wav stored."""
    codec, _, align, data = from_wav(media)
    if codec != "ima":
        return bytes(data)
    return np.frombuffer(data, np.uint8).reshape(-1, align)[:, 4:].tobytes()


def double_rate(pcm: np.ndarray) -> np.ndarray:
    """Twice the samples: each one kept, and between two the half-band value (-1, 9, 9, -1) / 16, rounded; ends are repeated."""
    if not len(pcm):
        return pcm
    x = np.concatenate([pcm[:1], pcm, pcm[-1:], pcm[-1:]]).astype(np.int32)
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    out[1::2] = np.clip((9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4, -32768, 32767)
    return out


def decode_all(files: list[bytes]) -> list[np.ndarray]:
    """PCM at twice the stored rate of each file; the ADPCM blocks of all files of one block size are decoded together."""
    out: list = [None] * len(files)
    ima: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, media in enumerate(files):
        codec, _, align, data = from_wav(media)
        raw = np.frombuffer(data, np.uint8)
        if codec == "ima":
            ima.setdefault(align, []).append((i, raw.reshape(-1, align)))
        else:
            out[i] = double_rate({"mulaw": MULAW, "alaw": ALAW}[codec][raw] if codec != "pcm" else raw.view(np.int16))
    for parts in ima.values():
        pcm, at = decode_ima(np.concatenate([x for _, x in parts])), 0
        for i, x in parts:
            out[i] = double_rate(pcm[at : at + len(x)].reshape(-1))
            at += len(x)
    return out


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Bounds of successive groups of rows of about GROUP_BYTES; a longer row is a group of its own."""
    lo, total = 0, 0
    for k, size in enumerate(sizes):
        if k > lo and total + size > GROUP_BYTES:
            yield lo, k
            lo, total = k, 0
        total += size
    if len(sizes) > lo:
        yield lo, len(sizes)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
        for lo, hi in _groups(pc.binary_length(texts).to_pylist()):
            sizes, files = [], []
            for value in texts[lo:hi]:
                raw = value.as_py()
                sizes.append(len(raw))
                payload = raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))
                files.append(to_wav(payload, CODECS[zlib.crc32(payload) % len(CODECS)]))
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["id", "n_bytes", "media"])


def store(frame: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(id, n_bytes, media): each payload in a WAV file whose codec is one of CODECS by the payload's CRC."""
    return frame.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("binary").alias("payload")).mapInArrow(_encode, "id long, n_bytes long, media binary")


def _decode(keep_pcm: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _groups(pc.binary_length(batch.column(2)).to_pylist()):
                part = batch.slice(lo, hi - lo)
                files = [x.as_py() for x in part.column(2)]
                rows: list[tuple] = []
                for media, pcm in zip(files, decode_all(files), strict=True):
                    payload = payload_of(media)
                    raw = pcm.tobytes()
                    signs = np.signbit(pcm)
                    feature = f"{from_wav(media)[0]};samples={len(pcm)};rms={int(np.sqrt(np.dot(pcm.astype(np.float32), pcm.astype(np.float32)) / len(pcm)))};peak={int(np.abs(pcm.astype(np.int32)).max())};crossings={int(np.count_nonzero(signs[1:] != signs[:-1]))};pcm={zlib.crc32(raw):08x}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, to_wav(raw, "pcm", 2 * RATE) if keep_pcm else None))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())))],
                    ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"],
                )

    return run


def read(files: DataFrame, keep_pcm: bool = True) -> DataFrame:
    """What `store` wrote, read back: digests of payload and file, features, and the resampled PCM as a WAV file (null without keep_pcm)."""
    return files.select("id", "n_bytes", "media").mapInArrow(
        _decode(keep_pcm),
        "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary",
    )
