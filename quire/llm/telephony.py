"""Telephony audio: mu-law and A-law by table, IMA ADPCM blocks, resampling, and WAVE files.

Companded samples expand through 256-entry tables that are built from the rules of ITU-T G.711. ADPCM blocks are
independent, so they are decoded side by side: one step of the predictor runs over all blocks of a chunk at once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import batch_bytes, fresh, text_of

#: WAVE format tags.
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 0x11

# Fixed values of the IMA ADPCM format: change of the step index by code, and the step sizes.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
STEP_SIZES = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767,
], np.int32)


def mulaw_table() -> np.ndarray:
    """16-bit linear value of each mu-law code (G.711: inverted bits, 3-bit exponent, 4-bit mantissa, bias 132)."""
    code = ~np.arange(256, dtype=np.uint8)
    exponent, mantissa = (code >> 4 & 7).astype(np.int32), (code & 15).astype(np.int32)
    size = ((mantissa << 3) + 132 << exponent) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit linear value of each A-law code (G.711: even bits inverted, 3-bit exponent, 4-bit mantissa)."""
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    exponent, mantissa = (code >> 4 & 7).astype(np.int32), (code & 15).astype(np.int32)
    size = np.where(exponent == 0, (mantissa << 4) + 8, (mantissa << 4) + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


EXPAND = {MULAW: mulaw_table(), ALAW: alaw_table()}


def decode_adpcm(data: bytes | np.ndarray, block_bytes: int) -> np.ndarray:
    """Decode mono IMA ADPCM blocks: int16 samples, one row per block.

    A block is a header (first sample as little-endian int16, step index, one reserved byte) and packed 4-bit codes,
    low nibble first. A step index over 88 counts as 88; bytes after the last whole block are ignored.
    """
    raw = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    blocks = raw[: len(raw) // block_bytes * block_bytes].reshape(-1, block_bytes)
    sample = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * (block_bytes - 4), len(blocks)), np.int16)
    out[0] = sample
    for j, pair in enumerate(codes):
        for half, code in enumerate((pair & 15, pair >> 4)):
            step = STEP_SIZES[index]
            change = step >> 3
            change = change + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
            sample = np.clip(np.where(code & 8, sample - change, sample + change), -32768, 32767)
            index = np.clip(index + INDEX_CHANGE[code], 0, 88)
            out[1 + 2 * j + half] = sample
    return out.T


def encode_adpcm(pcm: np.ndarray, block_bytes: int) -> bytes:
    """Encode int16 samples as mono IMA ADPCM blocks; the last block is padded with its last sample."""
    per = 1 + 2 * (block_bytes - 4)
    pad = -len(pcm) % per
    rows = np.concatenate((pcm, np.full(pad, pcm[-1] if len(pcm) else 0))).astype(np.int32).reshape(-1, per)
    sample, index = rows[:, 0].copy(), np.zeros(len(rows), np.int32)
    out = np.zeros((len(rows), block_bytes), np.uint8)
    out[:, :2] = rows[:, :1].astype("<i2").view(np.uint8)
    for j in range(1, per):
        step = STEP_SIZES[index]
        gap = rows[:, j] - sample
        code, rest, change = np.where(gap < 0, 8, 0), np.abs(gap), step >> 3
        for bit, shift in ((4, 0), (2, 1), (1, 2)):
            hit = rest >= step >> shift
            code, rest, change = code | np.where(hit, bit, 0), rest - np.where(hit, step >> shift, 0), change + np.where(hit, step >> shift, 0)
        sample = np.clip(np.where(code & 8, sample - change, sample + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code], 0, 88)
        out[:, 4 + (j - 1) // 2] |= (code << 4 * ((j - 1) % 2)).astype(np.uint8)
    return out.tobytes()


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to another rate, in integer arithmetic (rounded half up); the last sample is held."""
    if rate == to or len(pcm) == 0:
        return pcm.astype(np.int16)
    if to == 2 * rate:  # the common case of 8 to 16 kHz, without index arithmetic
        out = np.empty(2 * len(pcm), np.int16)
        out[::2] = pcm
        wide = pcm.astype(np.int32)
        out[1:-1:2] = (wide[:-1] + wide[1:] + 1) >> 1
        out[-1] = pcm[-1]
        return out
    at = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    left, part = at // to, at % to
    a, b = pcm[left].astype(np.int64), pcm[np.minimum(left + 1, len(pcm) - 1)].astype(np.int64)
    return ((2 * (a * (to - part) + b * part) + to) // (2 * to)).astype(np.int16)


@dataclass
class Wave:
    tag: int
    rate: int
    bits: int
    block: int
    data: bytes


def write_wave(tag: int, rate: int, data: bytes, block: int = 1, bits: int = 8) -> bytes:
    """A mono RIFF WAVE file; the data chunk is padded to an even length, as the format asks."""
    per_second = rate * block if tag != IMA_ADPCM else rate * block // (1 + 2 * (block - 4))
    extra = struct.pack("<HH", 2, 1 + 2 * (block - 4)) if tag == IMA_ADPCM else b"" if tag == PCM else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", tag, 1, rate, per_second, block, bits) + extra
    fact = b"" if tag == PCM else b"fact" + struct.pack("<II", 4, len(data) // block * (1 + 2 * (block - 4) if tag == IMA_ADPCM else 1))
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> Wave | None:
    """Parse a mono RIFF WAVE file; None if it is not one or is cut off."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        at += 8
        if at + size > len(media):
            return None
        if name == b"fmt " and size >= 16:
            fmt = struct.unpack_from("<HHIIHH", media, at)
        elif name == b"data" and fmt:
            return Wave(fmt[0], fmt[2], fmt[5], fmt[4], media[at : at + size]) if fmt[1] == 1 else None
        at += size + size % 2
    return None


def samples(wave: Wave) -> np.ndarray:
    """16-bit samples of a WAVE file: PCM, mu-law, A-law or IMA ADPCM."""
    if wave.tag in EXPAND:
        return EXPAND[wave.tag][np.frombuffer(wave.data, np.uint8)]
    if wave.tag == IMA_ADPCM:
        return decode_adpcm(wave.data, wave.block).ravel()
    if wave.tag == PCM and wave.bits == 16:
        return np.frombuffer(wave.data, "<i2")
    if wave.tag == PCM and wave.bits == 8:
        return (np.frombuffer(wave.data, np.uint8).astype(np.int16) - 128) << 8
    raise ValueError(f"format {wave.tag} of {wave.bits} bits")


DECODED = T.StructType([
    T.StructField("codec", T.StringType()), T.StructField("sample_rate", T.IntegerType()), T.StructField("n_samples", T.LongType()),
    T.StructField("peak", T.IntegerType()), T.StructField("energy", T.LongType()), T.StructField("crossings", T.LongType()), T.StructField("pcm", T.BinaryType()),
])
CODECS = {PCM: "pcm", ALAW: "alaw", MULAW: "mulaw", IMA_ADPCM: "ima_adpcm"}


def measures(pcm: np.ndarray) -> tuple[int, int, int]:
    """Peak, mean square (rounded down) and sign changes, all exact integers."""
    if not len(pcm):
        return 0, 0, 0
    wide = pcm.astype(np.int64)
    negative = pcm < 0
    return int(np.abs(wide).max()), int(wide @ wide) // len(pcm), int(np.count_nonzero(negative[1:] != negative[:-1]))


def decode_media(docs: DataFrame, media: str = "media", rate: int = 16000) -> DataFrame:
    """Decode a column of WAVE files: all columns of ``docs`` and a struct ``audio`` (another name if it is taken).

    ``pcm`` is a 16-bit WAVE file at ``rate``. Null, broken or unsupported media give a null struct; an empty data chunk
    gives zero samples.
    """

    @arrow_udf(DECODED)
    def decode(column: pa.Array) -> pa.Array:
        out = []
        for blob in column.to_pylist():
            wave = read_wave(blob) if blob else None
            if wave is None or wave.tag not in CODECS or not (wave.tag != PCM or wave.bits in (8, 16)) or (wave.tag == IMA_ADPCM and wave.block < 5):
                out.append(None)
                continue
            pcm = resample(samples(wave), wave.rate, rate)
            peak, energy, crossings = measures(pcm)
            out.append({"codec": CODECS[wave.tag], "sample_rate": rate, "n_samples": len(pcm), "peak": peak, "energy": energy, "crossings": crossings, "pcm": write_wave(PCM, rate, pcm.astype("<i2").tobytes(), 2, 16)})
        return pa.array(out, to_arrow(DECODED))

    (audio,) = fresh(docs, "audio")
    return docs.withColumn(audio, decode(F.col(media)))


def to_arrow(schema: T.StructType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(schema)


def store_texts(docs: DataFrame, text: str = "text", unit: int = 576) -> DataFrame:
    """All columns of ``docs`` and ``media`` (another name if taken): the text as mu-law samples of 8 kHz in a WAVE file.

    The samples are the bytes of the text, filled with bytes 255 (mu-law silence) to a positive multiple of ``unit``. Null
    texts count as empty: one unit of fill. Equal texts give equal media; an empty table gives an empty table.
    """

    @arrow_udf(T.BinaryType())
    def store(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data = batch_bytes(texts)
            yield pa.array([write_wave(MULAW, 8000, x + b"\xff" * ((-len(x) % unit) or (0 if x else unit))) for x in data], pa.binary())

    (media,) = fresh(docs, "media")
    return docs.withColumn(media, store(text_of(text)))


STORED = T.StructType([
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()), T.StructField("pcm_samples", T.LongType()), T.StructField("pcm_crc32", T.LongType()),
])
STORED_PCM = T.StructType([*STORED.fields, T.StructField("pcm", T.BinaryType())])


def describe_batch(media: list[bytes], unit: int = 576, chunk: int = 4 << 20, pcm_too: bool = False) -> list[dict | None]:
    """Digests and features of mu-law WAVE files, from their samples; None for anything else.

    The features are the mu-law signal, expanded and resampled to 16 kHz, the same bytes expanded as A-law, and the same
    bytes decoded as ADPCM blocks of ``unit`` bytes, each with peak, mean square and sign changes. The ADPCM blocks of many
    files are decoded at once.
    """
    out, held = [], []

    def settle() -> None:
        joined = np.concatenate([np.frombuffer(p, np.uint8)[: len(p) // unit * unit] for _, p in held])
        decoded = decode_adpcm(joined, unit)
        at = 0
        for row, p in held:
            n = len(p) // unit
            row["feature"] += f";adpcm={','.join(map(str, measures(decoded[at : at + n].ravel())))}"
            at += n
        held.clear()

    size = 0
    for blob in media:
        wave = read_wave(blob) if blob else None
        if wave is None or wave.tag != MULAW:
            out.append(None)
            continue
        codes = np.frombuffer(wave.data, np.uint8)
        pcm = resample(samples(wave), wave.rate, 16000)
        feature = ";".join(f"{name}={','.join(map(str, measures(x)))}" for name, x in (("mulaw", pcm), ("alaw", EXPAND[ALAW][codes])))
        flat = pcm.astype("<i2", copy=False)
        out.append({
            "payload_bytes": len(wave.data), "payload_sha256": hashlib.sha256(wave.data).hexdigest(), "tail_crc32": zlib.crc32(wave.data[-32:]),
            "media_bytes": len(blob), "media_sha256": hashlib.sha256(blob).hexdigest(), "feature": feature, "pcm_samples": len(pcm), "pcm_crc32": zlib.crc32(flat),
        })
        if pcm_too:
            out[-1]["pcm"] = write_wave(PCM, 16000, flat.tobytes(), 2, 16)
        held.append((out[-1], wave.data))
        size += len(wave.data)
        if size >= chunk:
            settle()
            size = 0
    if held:
        settle()
    return out


def describe_media(docs: DataFrame, media: str = "media", unit: int = 576, pcm: bool = True) -> DataFrame:
    """All columns of ``docs`` and a struct ``stored`` (another name if taken): digests and features of a media column as
    :func:`store_texts` makes it, and ``pcm``, the signal resampled to 16 kHz as a 16-bit WAVE file, unless that is not wanted.

    Null or other media give a null struct; equal media give equal values; an empty table gives an empty table.
    """
    shape = STORED_PCM if pcm else STORED

    @arrow_udf(shape)
    def describe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = to_arrow(shape)
        for files in batches:
            yield pa.array(describe_batch(files.to_pylist(), unit, pcm_too=pcm), kind)

    (stored,) = fresh(docs, "stored")
    return docs.withColumn(stored, describe(F.col(media)))
