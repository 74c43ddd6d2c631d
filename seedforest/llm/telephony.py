"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers, decoded to 16-bit PCM and resampled.

mu-law and A-law bytes expand through tables of 256 entries built from the codecs' rule. ADPCM blocks are independent, so all blocks of
an Arrow batch are decoded together: one numpy step per nibble position, across blocks. Resampling is a polyphase filter with
integer taps, so equal bytes give equal PCM whatever shares their batch.

An undecodable container gives null PCM. Null bytes count as empty; empty audio has zero samples and features of zero; repeated rows are decoded one by one; very long
audio is decoded whole, one batch of a few MB (one container at least) at a time; an empty table gives an empty table. store_audio reads no other columns; decode_audio and audio_features
pass other columns on, but for those named like one of their results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, spans_of_texts, text_buffer

MULAW, ALAW, ADPCM = 7, 6, 0x11
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "adpcm"}
BLOCK = 64
RATE = 8000
#: Fixed values of the IMA ADPCM format: index changes by code.
INDEX_STEPS = (-1, -1, -1, -1, 2, 4, 6, 8)


@lru_cache(1)
def step_sizes() -> np.ndarray:
    """Fixed values of the IMA ADPCM format: the 89 quantizer steps."""
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253,
        279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660,
        4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ], np.int32)


@lru_cache(2)
def expansion(codec: int) -> np.ndarray:
    """The 16-bit value of each of the 256 codes of G.711."""
    code = np.arange(256)
    if codec == MULAW:
        code = ~code & 0xFF
        value = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
        return np.where(code & 0x80, -value, value).astype(np.int16)
    code = code ^ 0x55
    exponent, mantissa = (code >> 4) & 7, (code & 0x0F) << 4
    value = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, value, -value).astype(np.int16)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """blocks: uint8 [n, BLOCK], mono, each with its own predictor and index. Returns int16 [n, 2 * BLOCK - 7]."""
    n = len(blocks)
    head = blocks[:, :4].astype(np.int32)
    value = (head[:, 0] | head[:, 1] << 8).astype(np.uint16).view(np.int16).astype(np.int32)
    index = np.minimum(head[:, 2], 88)
    # byte k of every block lies together; so does sample k of every block
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * codes.shape[0] + 1, n), np.int16)
    out[0] = value
    changes, steps = np.array(INDEX_STEPS, np.int32), step_sizes()
    for k in range(codes.shape[0]):
        for half in (0, 1):
            code = (codes[k] >> 4) if half else (codes[k] & 15)
            step = steps[index]
            delta = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
            value = np.clip(np.where(code & 8, value - delta, value + delta), -32768, 32767)
            index = np.clip(index + changes[code & 7], 0, 88)
            out[2 * k + half + 1] = value
    return out.T


@lru_cache(8)
def taps(up: int, down: int, half: int = 4) -> np.ndarray:
    """[up, 2 * half] integer taps (sum 1 << 14) of a Hann-windowed sinc for each phase."""
    cutoff = min(1.0, up / down)
    at = np.arange(-half + 1, half + 1)[None, :] - np.arange(up)[:, None] / up
    filt = np.sinc(at * cutoff) * np.cos(np.clip(at / (half + 1), -1, 1) * np.pi / 2) ** 2
    whole = np.round(filt / filt.sum(1, keepdims=True) * (1 << 14)).astype(np.int32)
    whole[np.arange(up), np.abs(whole).argmax(1)] += (1 << 14) - whole.sum(1)
    return whole


def resample(pcm: np.ndarray, up: int, down: int) -> np.ndarray:
    """int16 samples at up / down times the rate."""
    if up == down or not len(pcm):
        return pcm
    filt = taps(up, down)
    half = filt.shape[1] // 2
    wide = np.concatenate([np.zeros(half - 1, np.int32), pcm.astype(np.int32), np.zeros(half + 1, np.int32)])
    n = len(pcm) * up // down
    out = np.empty(n, np.int16)
    for first in range(up):  # outputs first, first + up, ... share a phase
        k = np.arange(first, n, up, dtype=np.int64) * down
        phase, base = int(first * down % up), k // up
        start, step = (int(base[0]), down) if len(base) else (0, down)
        if not len(base):
            continue
        total = np.zeros(len(base), np.int32)
        for j in range(2 * half):
            total += wide[start + j : start + j + step * (len(base) - 1) + 1 : step] * filt[phase, j]
        out[first::up] = np.clip((total + (1 << 13)) >> 14, -32768, 32767)
    return out


def wav(codec: int, payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF container whose data chunk is the payload."""
    if codec == ADPCM:
        samples = 2 * BLOCK - 7
        form = struct.pack("<HHIIHHHH", codec, 1, rate, rate * BLOCK // samples, BLOCK, 4, 2, samples)
        count = len(payload) // BLOCK * samples
    else:
        form, count = struct.pack("<HHIIHHH", codec, 1, rate, rate, 1, 8, 0), len(payload)
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, count) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(stored: bytes | None) -> tuple[int, int, bytes] | None:
    """Codec, rate and data of a container; None where it isn't one of the three."""
    if not stored or stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        return None
    at, form, data = 12, None, None
    while at + 8 <= len(stored):
        name, length = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", stored, at + 8)
        elif name == b"data":
            data = stored[at + 8 : at + 8 + length]
        at += 8 + length + (length & 1)
    if form is None or data is None or form[0] not in NAMES or form[1] != 1 or (form[0] == ADPCM and (form[4] != BLOCK or len(data) % BLOCK)):
        return None
    return form[0], form[2], data


def codec_for(payload: bytes) -> int:
    """Which codec a payload is stored in, from its own bytes only."""
    return (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]


def pcm_of(batch: list[bytes | None]) -> list[tuple[int, int, np.ndarray, bytes] | None]:
    """Codec, rate, PCM and data of each container; the ADPCM blocks of all of them are decoded in one go."""
    parsed = [read_wav(b) for b in batch]
    together = [p[2] for p in parsed if p and p[0] == ADPCM]
    blocks = np.frombuffer(b"".join(together), np.uint8).reshape(-1, BLOCK)
    decoded, at = decode_adpcm(blocks) if len(blocks) else np.zeros((0, 2 * BLOCK - 7), np.int16), 0
    out: list = []
    for p in parsed:
        if p is None:
            out.append(None)
        elif p[0] == ADPCM:
            n = len(p[2]) // BLOCK
            out.append((p[0], p[1], decoded[at : at + n].reshape(-1), p[2]))
            at += n
        else:
            out.append((p[0], p[1], expansion(p[0])[np.frombuffer(p[2], np.uint8)], p[2]))
    return out


def _batches(column, most: int = 1 << 22):
    buffer, offsets = text_buffer(column)
    for a, b in spans_of_texts(offsets, most):
        yield a, [buffer[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]


def store_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, media: each text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, as the samples of a WAV file."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in _batches(batch.column(1)):
                padded = [t + b"\0" * (-len(t) % BLOCK or (0 if t else BLOCK)) for t in texts]
                media = [wav(codec_for(p), p) for p in padded]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    return map_arrow(narrow, store, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def _read(media: DataFrame, schema: str, row) -> DataFrame:
    made_names = {f.split()[0].lower() for f in schema.split(", ")}
    keep = [c for c in media.columns if c != "media" and c.lower() not in made_names]
    kinds = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep)
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [f.name for f in StructType.fromDDL(schema)]
    types = [f.type for f in to_arrow_schema(StructType.fromDDL(schema))]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, stored in _batches(batch.column(batch.schema.get_field_index("media"))):
                rows = [row(b, p) for b, p in zip(stored, pcm_of(stored), strict=True)]
                made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).slice(a, len(stored)) for c in keep), *made], names=keep + names)

    return map_arrow(media, decode, f"{kinds}, {schema}")


def decode_audio(media: DataFrame, rate: int = 16000) -> DataFrame:
    """The columns beside `media`, codec, n_samples and pcm: little-endian 16-bit samples at `rate`."""

    def row(stored, p):
        if p is None:
            return None, None, None
        pcm = resample(p[2], *_ratio(p[1], rate))
        return NAMES[p[0]], len(pcm), pcm.astype("<i2").tobytes()

    return _read(media, "codec string, n_samples long, pcm binary", row)


def _ratio(rate: int, to: int) -> tuple[int, int]:
    common = int(np.gcd(rate, to))
    return to // common, rate // common


def feature(codec: int, pcm: np.ndarray) -> str:
    """Codec, samples, peak, root mean square, zero crossings and checksum of the resampled PCM."""
    wide = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    power = int((wide * wide).sum()) // max(1, len(pcm))
    return f"{NAMES[codec]};n={len(pcm)};peak={int(np.abs(wide).max(initial=0))};rms={int(power**0.5)};zc={crossings};crc={zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def audio_features(media: DataFrame, rate: int = 16000) -> DataFrame:
    """The columns beside `media`, and what is read back: digests of the payload and of the stored form, and features of the resampled PCM."""

    def row(stored, p):
        if p is None:
            return None, None, None, len(stored), hashlib.sha256(stored).hexdigest(), None
        data = p[3]
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(p[0], resample(p[2], *_ratio(p[1], rate)))

    return _read(media, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", row)
