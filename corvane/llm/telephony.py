"""Telephony audio: G.711 mu-law and A-law, IMA ADPCM, WAV containers and resampled PCM.

Bytes expand to 16-bit samples through 256-entry tables built from the codes' rules. ADPCM blocks decode together: numpy
steps along the samples of a block and across all blocks of a batch at once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import with_arrow

#: Payloads are multiples of this many bytes: one ADPCM block, 72 ms of 8 kHz telephony.
BLOCK_BYTES = 576
RATE = 8000

# Fixed values of the WAVE format: format tags.
TAG_PCM, TAG_ALAW, TAG_MULAW, TAG_IMA = 1, 6, 7, 17
# Fixed values of IMA ADPCM: how the low three bits of a code move the step index.
INDEX_MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)


@lru_cache(maxsize=1)
def mulaw_table() -> np.ndarray:
    """16-bit sample of each mu-law byte: inverted sign, three exponent and four mantissa bits with bias 33, times 4."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 0x0F) << 1) + 33) << (code >> 4 & 7)) - 33
    return np.where(code & 0x80, -size, size).astype(np.int16) * np.int16(4)


@lru_cache(maxsize=1)
def alaw_table() -> np.ndarray:
    """16-bit sample of each A-law byte: even bits inverted, sign, three exponent and four mantissa bits, times 8."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = code >> 4 & 7, code & 0x0F
    size = np.where(exponent == 0, 2 * mantissa + 1, (2 * mantissa + 33) << np.maximum(exponent - 1, 0)) * 8
    return np.where(code & 0x80, size, -size).astype(np.int16)


@lru_cache(maxsize=1)
def ima_steps() -> np.ndarray:
    """The 89 step sizes of IMA ADPCM: each about a tenth above the one before, 7 to 32767 (the standard's values)."""
    # Fixed values of the standard.
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
        7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ], np.int32)


@lru_cache(maxsize=1)
def _ima_moves() -> tuple[np.ndarray, np.ndarray]:
    """Difference and next index for each (index, code), so that a step of decoding is two lookups."""
    step, code = ima_steps()[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    moved = np.clip(np.arange(89)[:, None] + np.asarray(INDEX_MOVES)[code & 7], 0, 88)
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), (moved * 16).astype(np.int32).ravel()


def ima_decode(blocks: np.ndarray) -> np.ndarray:
    """Samples (blocks x (1 + 2 * data bytes), int16) of mono IMA ADPCM blocks (blocks x bytes, uint8).

    A block begins with its first sample (int16), its step index (values above 88 count as 88) and a reserved byte; each
    byte after that holds two codes, the lower half first.
    """
    blocks = np.ascontiguousarray(blocks, np.uint8)
    n, width = blocks.shape
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    at = np.minimum(blocks[:, 2].astype(np.int32), 88) * 16
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    out[0] = value
    moves, following = _ima_moves()
    for k in range(width - 4):
        for half, code in enumerate((codes[k] & 15, codes[k] >> 4)):
            cell = at + code
            value = value + moves[cell]
            np.clip(value, -32768, 32767, out=value)
            at = following[cell]
            out[1 + 2 * k + half] = value
    return out.T


def ima_encode(samples: np.ndarray) -> np.ndarray:
    """ADPCM blocks for rows of 1 + 2m samples; a row's first sample is stored as it is, the step index starts at 0."""
    samples = np.asarray(samples, np.int32)
    n, count = samples.shape
    value, index = samples[:, 0].copy(), np.zeros(n, np.int32)
    moves, following = _ima_moves()
    steps = ima_steps()
    codes = np.zeros((n, count - 1), np.uint8)
    for k in range(1, count):
        gap = samples[:, k] - value
        rest, step, code = np.abs(gap), steps[index], np.zeros(n, np.int32)
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            take = rest >= part
            code |= np.where(take, bit, 0)
            rest = rest - np.where(take, part, 0)
        code |= np.where(gap < 0, 8, 0)
        cell = index * 16 + code
        value = np.clip(value + moves[cell], -32768, 32767)
        index = following[cell] // 16
        codes[:, k - 1] = code
    blocks = np.zeros((n, 4 + (count - 1) // 2), np.uint8)
    blocks[:, :2] = samples[:, :1].astype("<i2").view(np.uint8)
    blocks[:, 4:] = codes[:, 0::2] | codes[:, 1::2] << 4
    return blocks


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: old samples with half-way values between, by the four-point rule (-1, 9, 9, -1) / 16 in integers.

    Ends are held. All arithmetic is on integers, so equal inputs give equal bytes anywhere.
    """
    if not len(pcm):
        return np.zeros(0, np.int16)
    x = np.pad(pcm.astype(np.int32), (1, 2), mode="edge")
    between = 9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8 >> 4
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2], out[1::2] = pcm, np.clip(between, -32768, 32767)
    return out


def wav_build(data: bytes, tag: int, rate: int = RATE, bits: int = 8, block: int = 1) -> bytes:
    """A mono RIFF/WAVE file: format, fact (samples) and data chunks."""
    per_second = rate * bits // 8 if tag != TAG_IMA else rate * block // (1 + 2 * (block - 4))
    samples = len(data) * 8 // bits if tag != TAG_IMA else len(data) // block * (1 + 2 * (block - 4))
    extra = struct.pack("<HH", 2, 1 + 2 * (block - 4)) if tag == TAG_IMA else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", tag, 1, rate, per_second, block, 4 if tag == TAG_IMA else bits) + extra
    chunks = b"".join(name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2) for name, body in ((b"fmt ", fmt), (b"fact", struct.pack("<I", samples)), (b"data", data)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def wav_parse(media: bytes) -> tuple[int, int, int, memoryview]:
    """Format tag, rate, block size and data of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            if form is None:
                raise ValueError("data before format")
            return form[0], form[2], form[4], memoryview(media)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data")


def expand(data: bytes | memoryview, tag: int, block: int = BLOCK_BYTES) -> np.ndarray:
    """16-bit samples of coded bytes; an ADPCM tail shorter than a block is left out of the samples."""
    raw = np.frombuffer(data, np.uint8)
    if tag == TAG_MULAW:
        return mulaw_table()[raw]
    if tag == TAG_ALAW:
        return alaw_table()[raw]
    if tag == TAG_IMA:
        return ima_decode(raw[: len(raw) // block * block].reshape(-1, block)).ravel()
    if tag == TAG_PCM:
        return np.frombuffer(data, "<i2")
    raise ValueError(f"format tag {tag}")


def store(docs: DataFrame, text: str = "text", media: str = "media", tag: int = TAG_MULAW, block: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``media``: each text's UTF-8 bytes as the codes of a WAVE file, and ``n_bytes``, their number.

    The payload is filled up with bytes 255 to a positive multiple of ``block``; null and empty texts make one block of
    filling. Nothing is lost: ``payload`` returns the bytes. Rows and other columns stay, those named like an added one
    give way. No shuffle.
    """

    def kernel(part: pa.RecordBatch) -> dict[str, pa.Array]:
        raw = [(t or "").encode() for t in part.column(text).to_pylist()]
        made = [wav_build(x.ljust(max(1, -(-len(x) // block)) * block, b"\xff"), tag, block=block if tag == TAG_IMA else 1) for x in raw]
        return {media: pa.array(made, pa.binary()), "n_bytes": pa.array([len(x) for x in raw], pa.int64())}

    return with_arrow(docs, kernel, f"`{media}` binary, n_bytes bigint", text, keep)


def decode(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """``df`` with payload (the coded bytes of each WAVE file), pcm (16-bit little-endian samples at twice the rate) and
    pcm_rate. A null file gives nulls; bytes that are no WAVE file fail the task."""

    def kernel(part: pa.RecordBatch) -> dict[str, pa.Array]:
        payloads, pcms, rates = [], [], []
        for x in part.column(media).to_pylist():
            if x is None:
                payloads.append(None), pcms.append(None), rates.append(None)
                continue
            tag, rate, block, data = wav_parse(x)
            payloads.append(bytes(data))
            pcms.append(resample_double(expand(data, tag, block)).tobytes())
            rates.append(2 * rate)
        return {"payload": pa.array(payloads, pa.binary()), "pcm": pa.array(pcms, pa.binary()), "pcm_rate": pa.array(rates, pa.int32())}

    return with_arrow(df, kernel, "payload binary, pcm binary, pcm_rate int", media, keep)


def pcm_file(media: bytes) -> bytes:
    """A WAVE file of the samples that ``media`` codes, as 16-bit PCM at twice the rate."""
    tag, rate, block, data = wav_parse(media)
    return wav_build(resample_double(expand(data, tag, block)).tobytes(), TAG_PCM, 2 * rate, 16, 2)


def store_pcm(df: DataFrame, media: str = "media", out: str = "pcm_media", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``out``, the resampled samples of each file as a WAVE file of 16-bit PCM. A null file gives null; rows and
    other columns stay, an input column named ``out`` gives way. No shuffle."""

    def kernel(part: pa.RecordBatch) -> dict[str, pa.Array]:
        return {out: pa.array([None if x is None else pcm_file(x) for x in part.column(media).to_pylist()], pa.binary())}

    return with_arrow(df, kernel, f"`{out}` binary", media, keep)


def pcm_parts(stored: bytes) -> tuple[str, int, str]:
    """Samples and CRC-32 of the data read back from a WAVE file of PCM, as the part of a feature; the file's size and digest."""
    tag, rate, _, samples = wav_parse(stored)
    if tag != TAG_PCM:
        raise ValueError(f"format tag {tag} is not PCM")
    return f"pcm{rate // 1000}k:{len(samples) // 2},{zlib.crc32(samples)}", len(stored), hashlib.sha256(stored).hexdigest()


def pcm_features(df: DataFrame, pcm: str = "pcm_media", keep: list[str] | None = None) -> DataFrame:
    """``df`` with pcm_feature, pcm_bytes and pcm_sha256 of the PCM files of ``store_pcm``, as they were stored. A null file
    gives nulls, one of another format fails the task; rows and other columns stay, those named like an added one give way; an
    empty table stays empty. No shuffle."""

    def kernel(part: pa.RecordBatch) -> dict[str, pa.Array]:
        rows = [(None, None, None) if x is None else pcm_parts(x) for x in part.column(pcm).to_pylist()]
        return {n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate((("pcm_feature", pa.string()), ("pcm_bytes", pa.int64()), ("pcm_sha256", pa.string())))}

    return with_arrow(df, kernel, "pcm_feature string, pcm_bytes bigint, pcm_sha256 string", pcm, keep)


def features(df: DataFrame, media: str = "media", keep: list[str] | None = None, stored: str | None = None) -> DataFrame:
    """``df`` with payload_bytes, payload_sha256 and tail_crc32 of the bytes read back from each file, media_bytes and
    media_sha256 of the file, a ``feature`` string, and pcm_bytes and pcm_sha256 of its ``pcm_file``.

    The feature names, for the payload read as mu-law, as A-law and as ADPCM blocks of 576 bytes: samples, mean absolute
    value, peak and sign changes, and samples and CRC-32 of the file's PCM. It depends on the bytes alone. With ``stored``
    the PCM file becomes a column of that name instead, for ``pcm_features`` to describe once it is stored. A null file gives nulls; rows and
    other columns stay, those named like an added one give way; an empty table stays empty. No shuffle.
    """
    added = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    added += f", `{stored}` binary" if stored else ", pcm_bytes bigint, pcm_sha256 string"
    types = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = [(n.strip("`"), types[t]) for n, t in (x.rsplit(" ", 1) for x in added.split(", "))]

    def kernel(part: pa.RecordBatch) -> dict[str, pa.Array]:
        files = part.column(media).to_pylist()
        data = [b"" if x is None else wav_parse(x)[3] for x in files]
        whole = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum([len(x) for x in data])
        # ADPCM blocks of all files of the slice decode together.
        adpcm = ima_decode(whole.reshape(-1, BLOCK_BYTES)) if len(whole) else np.zeros((0, 1), np.int16)
        rows = []
        for file, x, end in zip(files, data, ends, strict=True):
            if file is None:
                rows.append([None] * len(kinds))
                continue
            parts = []
            codes = np.frombuffer(x, np.uint8)
            for name, sound in (("mulaw", mulaw_table()[codes]), ("alaw", alaw_table()[codes]), ("adpcm", adpcm[(end - len(x)) // BLOCK_BYTES : end // BLOCK_BYTES].ravel())):
                size = np.abs(sound.astype(np.int32))
                negative = sound < 0
                parts.append(f"{name}:{len(sound)},{int(size.sum()) // max(1, len(sound))},{int(size.max(initial=0))},{int(np.count_nonzero(negative[1:] != negative[:-1]))}")
            made = pcm_file(file)
            part, *of_pcm = (None, made) if stored else pcm_parts(made)
            parts += [] if stored else [part]
            rows.append([len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-32:]), len(file), hashlib.sha256(file).hexdigest(), ";".join(parts), *of_pcm])
        return {n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(kinds)}

    return with_arrow(df, kernel, added, media, keep)
