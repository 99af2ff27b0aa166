"""Telephony audio columns.

G.711 mu-law and A-law samples are expanded through 256-entry lookup tables.
ADPCM is decoded block by block, with numpy running across all blocks of a
batch at each sample step.  Decoded audio is resampled to PCM.

``store_payloads`` keeps any byte string as 8-bit mu-law samples in a WAV
container; ``read_payload`` gives the same bytes back.

Edge cases: a null or empty text is a payload of 64 zero bytes; equal texts
give equal values in every column but the ids; repeated rows stay; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagloom.llm.common import load, stored
from dagloom.llm.words import text_bytes

RATE = 8000
MULAW, ALAW, IMA = 7, 6, 17
BLOCK = 64  # bytes of an ADPCM block: four of header, the rest two samples each


def mulaw_table() -> np.ndarray:
    """Linear values of the 256 mu-law codes, by the rule of G.711."""
    code = ~np.arange(256, dtype=np.uint8)
    size = ((code & 15).astype(np.int32) * 8 + 132) << (code >> 4 & 7)
    return np.where(code & 128, 132 - size, size - 132).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear values of the 256 A-law codes, by the rule of G.711."""
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    exp = (code >> 4 & 7).astype(np.int32)
    low = (code & 15).astype(np.int32) * 16 + 8
    size = np.where(exp == 0, low, (low + 256) << np.maximum(exp - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


# Fixed values of the IMA ADPCM format: index moves by code, and step sizes.
INDEX_MOVE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
STEP_SIZE = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97,
        107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
        876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871,
        5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623,
        27086, 29794, 32767,
    ],
    np.int32,
)
_STATES = len(STEP_SIZE)
# change of the predictor, and next index, for each (index, code)
_code = np.arange(16)
_CHANGE = (
    (STEP_SIZE[:, None] >> 3)
    + np.where(_code & 4, STEP_SIZE[:, None], 0)
    + np.where(_code & 2, STEP_SIZE[:, None] >> 1, 0)
    + np.where(_code & 1, STEP_SIZE[:, None] >> 2, 0)
) * np.where(_code & 8, -1, 1)
_CHANGE = _CHANGE.astype(np.int32).ravel()
_NEXT = (np.clip(np.arange(_STATES)[:, None] + INDEX_MOVE, 0, _STATES - 1) * 16).astype(np.int32).ravel()
MU, A = mulaw_table(), alaw_table()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """uint8 blocks (n, BLOCK) to int16 samples (n, 2 * (BLOCK - 4) + 1).

    Header: predictor (int16, little-endian), index (kept in 0..88), reserved.
    """
    blocks = np.ascontiguousarray(blocks.T)
    held = blocks[:2].T.copy().view("<i2").astype(np.int32).ravel()
    state = np.minimum(blocks[2], _STATES - 1).astype(np.int32) * 16
    out = np.empty((2 * (len(blocks) - 4) + 1, blocks.shape[1]), np.int16)
    out[0] = held
    for k, byte in enumerate(blocks[4:]):
        for half, code in enumerate((byte & 15, byte >> 4)):
            at = state + code
            held += _CHANGE.take(at, mode="clip")
            np.minimum(held, 32767, out=held)
            np.maximum(held, -32768, out=held)
            state = _NEXT.take(at, mode="clip")
            out[2 * k + half + 1] = held
    return out.T


def resample(pcm: np.ndarray, up: int, down: int) -> np.ndarray:
    """Linear interpolation of int16 samples by up/down, in whole numbers."""
    if not len(pcm):
        return pcm
    at = np.arange(len(pcm) * up // down, dtype=np.int64) * down
    low = at // up
    part = (at % up).astype(np.int32)
    wide = pcm.astype(np.int32)
    high = np.minimum(low + 1, len(pcm) - 1)
    return ((wide[low] * (up - part) + wide[high] * part) // up).astype(np.int16)


def expand(codes: np.ndarray, law: int) -> np.ndarray:
    return (MU if law == MULAW else A).take(codes)


def wav(payload: bytes, law: int = MULAW) -> bytes:
    """A WAV file of 8-bit companded samples."""
    form = struct.pack("<HHIIHHH", law, 1, RATE, RATE, 1, 8, 0)
    fact = struct.pack("<I", len(payload))
    body = b"".join(
        n + struct.pack("<I", len(x)) + x + b"\0" * (len(x) & 1)
        for n, x in ((b"fmt ", form), (b"fact", fact), (b"data", payload))
    )
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def read_payload(media: bytes) -> tuple[int, bytes]:
    """Format tag and sample bytes of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, law, data = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            law = struct.unpack_from("<H", media, at + 8)[0]
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if law is None or data is None:
        raise ValueError("a chunk is missing")
    return law, data


def padded(text: bytes) -> bytes:
    return text + b"\0" * (64 if not text else -len(text) % 64)


def store_payloads(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): texts as mu-law WAV files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                raw, off = text_bytes(part.column(1))
                texts = [raw[x:y].tobytes() for x, y in zip(off[:-1], off[1:])]
                yield pa.record_batch(
                    [part.column(0), pa.array(np.diff(off), pa.int64()), pa.array([wav(padded(x)) for x in texts], pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _per(sums: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(sums, first)


def audio_features(payloads: list[bytes]) -> list[str]:
    """One string for each payload (each a positive multiple of 64 bytes).

    mu/A: mean square of the samples in that law and of the differences of
    neighbours; adpcm: mean square and last sample of the payload read as
    ADPCM blocks; pcm16k: checksum of the mu-law audio at 16 kHz.
    """
    if not payloads:
        return []
    size = np.array([len(x) for x in payloads])
    codes = np.frombuffer(b"".join(payloads), np.uint8)
    first = np.cumsum(size) - size
    columns = []
    for law in (MULAW, ALAW):
        pcm = expand(codes, law).astype(np.int64)
        step = np.diff(pcm, prepend=0)
        step[first] = 0
        columns += [_per(pcm * pcm, first) // size, _per(step * step, first) // size]
    blocks = codes.reshape(-1, BLOCK)
    power, last = np.empty(len(blocks), np.int64), np.empty(len(blocks), np.int64)
    for at in range(0, len(blocks), 8192):
        out = decode_ima(blocks[at : at + 8192])
        wide = out.astype(np.float64)
        power[at : at + 8192] = np.einsum("ij,ij->i", wide, wide).astype(np.int64)
        last[at : at + 8192] = out[:, -1]
    n = size // BLOCK
    end = np.cumsum(n)
    samples = n * (2 * (BLOCK - 4) + 1)
    columns += [_per(power, end - n) // samples, last[end - 1]]
    crc = [zlib.crc32(resample(MU.take(codes[a : a + s]), 2, 1).tobytes()) for a, s in zip(first.tolist(), size.tolist())]
    return [
        f"mu={a},{b};a={c},{d};adpcm={e},{f};pcm16k={g:08x}"
        for a, b, c, d, e, f, g in zip(*(x.tolist() for x in columns), crc)
    ]


def decoded(media: DataFrame, rate: int = 16000) -> DataFrame:
    """(doc_id, rate, pcm binary) of WAV files, resampled int16 little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                law, data = read_payload(x)
                codes = np.frombuffer(data, np.uint8)
                pcm = decode_ima(codes[: len(codes) // BLOCK * BLOCK].reshape(-1, BLOCK)).ravel() if law == IMA else expand(codes, law)
                out.append(resample(pcm, rate // 1000, RATE // 1000).astype("<i2").tobytes())
            yield pa.record_batch([b.column(0), pa.array([rate] * len(out), pa.int32()), pa.array(out, pa.binary())], ["doc_id", "rate", "pcm"])

    return media.select("doc_id", "media").where("media is not null").mapInArrow(run, "doc_id long, rate int, pcm binary")


def stored_pcm(media: DataFrame, rate: int = 16000, name: str = "pcm") -> DataFrame:
    """decoded, as a table in the shared folder: zstd finds most of what
    interpolated samples repeat."""
    return stored(decoded(media, rate), name, compression="zstd")


def digests(media: DataFrame) -> DataFrame:
    """What a reader of the stored files finds in them."""
    names = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                files = part.column(2).to_pylist()
                got = [read_payload(x)[1] for x in files]
                yield pa.record_batch(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(x) for x in got], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in got]),
                        pa.array([zlib.crc32(x[-64:]) for x in got], pa.int64()),
                        pa.array([len(x) for x in files], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in files]),
                        pa.array(audio_features(got)),
                    ],
                    [x.split()[0] for x in names.split(", ")],
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, names)


def op8_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(stored(store_payloads(load(spark, sf_dir, "documents")), "op8-media"))
