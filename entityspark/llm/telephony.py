"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV files, decoded to resampled PCM.

Companded samples are expanded through 256-entry tables. ADPCM is sequential inside a block
only, so all blocks of a step are decoded side by side: one numpy operation handles the k-th
code of every block. Everything stays inside the row's task; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityspark.llm.textio import STEP_BYTES, steps, texts

#: WAV format tags (fixed values).
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}

#: Payload bytes in an ADPCM block, besides its four-byte header.
BLOCK = 192

#: IMA ADPCM index changes for the eight magnitudes (fixed values of the format).
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int64)

#: IMA ADPCM quantiser steps (fixed values of the format).
STEP_SIZE = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int64)


def mulaw_table() -> np.ndarray:
    """PCM16 of every mu-law code: inverted sign-exponent-mantissa, bias 132."""
    code = ~np.arange(256) & 255
    magnitude = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -magnitude, magnitude).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM16 of every A-law code: even bits inverted, sign-exponent-mantissa."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = code >> 4 & 7, code & 15
    magnitude = np.where(exponent == 0, (mantissa << 4) + 8, (mantissa << 4) + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, magnitude, -magnitude).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM16 of IMA ADPCM blocks (rows of header and codes), all decoded side by side."""
    head = np.ascontiguousarray(blocks[:, :4])
    value = head[:, :2].copy().view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(head[:, 2], 88).astype(np.int64)
    codes = blocks[:, 4:].T
    out = np.empty((2 * codes.shape[0], blocks.shape[0]), dtype=np.int16)
    for k in range(out.shape[0]):
        code = codes[k // 2] >> 4 if k % 2 else codes[k // 2] & 15
        step = STEP_SIZE[index]
        change = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_STEP[code & 7], 0, 88)
        out[k] = value
    return out.T


def wav(codec: str, data: bytes, rate: int = 8000) -> bytes:
    """A mono WAV file of already coded data."""
    align, bits = (BLOCK + 4, 4) if codec == "adpcm" else (1, 8)
    per_block = 2 * BLOCK if codec == "adpcm" else 1
    extra = struct.pack("<HH", 2, per_block) if codec == "adpcm" else struct.pack("<H", 0)
    head = struct.pack("<HHIIHH", TAGS[codec], 1, rate, rate * align // per_block, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[str, bytes]:
    """(codec, coded data) of a WAV file that ``wav`` wrote or of another with these codecs."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
        elif name == b"data":
            return next(k for k, v in TAGS.items() if v == tag), media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data in the WAV file")


def blocks_of(payload: bytes) -> bytes:
    """ADPCM blocks that carry ``payload`` as their codes, each with a zero header."""
    rows = np.zeros((len(payload) // BLOCK, BLOCK + 4), np.uint8)
    rows[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    return rows.tobytes()


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: samples stay, and four neighbours give the sample between two (-1 9 9 -1)/16."""
    wide = np.concatenate([pcm[:1], pcm, pcm[-1:], pcm[-1:]]).astype(np.int32)
    between = (9 * (wide[1:-2] + wide[2:-1]) - wide[:-3] - wide[3:] + 8) >> 4
    out = np.empty(2 * len(pcm), "<i2")
    out[0::2], out[1::2] = pcm, np.clip(between, -32768, 32767)
    return out


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", codec: str | None = None) -> DataFrame:
    """``(id_col, n_bytes, media)``: every text's UTF-8 bytes, filled up with blanks, as telephony audio.

    The payload is a positive multiple of 192 bytes. Without ``codec`` the payload's SHA-256
    chooses mu-law, A-law or ADPCM, so equal texts give equal files. Null counts as empty.
    Repeated rows and null ids are kept; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "t"):
            sizes, media = [], []
            for text in texts(batch, "t"):
                payload = text.ljust(max(1, -(-len(text) // BLOCK)) * BLOCK)
                kind_of = codec or ("mulaw", "alaw", "adpcm")[hashlib.sha256(payload).digest()[0] % 3]
                sizes.append(len(text))
                media.append(wav(kind_of, blocks_of(payload) if kind_of == "adpcm" else payload))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.large_binary()).cast(pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def decode(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """Reads stored WAV files back; adds ``codec, payload_bytes, payload_sha256, tail_crc32, rms,
    peak, crossings, pcm`` (little-endian PCM16 at twice the rate). Null media give nulls.
    """
    names = ["codec", "payload_bytes", "payload_sha256", "tail_crc32", "rms", "peak", "crossings", "pcm"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.binary()]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields]
    given = list(stored.columns)
    at = given.index(media_col)

    def expand(found: list[tuple[str, bytes] | None]) -> list[tuple[str, bytes, np.ndarray] | None]:
        rows = [x[1] for x in found if x and x[0] == "adpcm"]
        blocks = [np.frombuffer(r[: len(r) // (BLOCK + 4) * (BLOCK + 4)], np.uint8).reshape(-1, BLOCK + 4) for r in rows]
        pcm = decode_adpcm(np.concatenate(blocks)) if blocks else np.empty((0, 0), np.int16)
        out, used, k = [], 0, 0
        for x in found:
            if x is None:
                out.append(None)
            elif x[0] == "adpcm":
                n = len(blocks[k])
                out.append(("adpcm", blocks[k][:, 4:].tobytes(), pcm[used : used + n].reshape(-1)))
                used, k = used + n, k + 1
            else:
                out.append((*x, (MULAW if x[0] == "mulaw" else ALAW)[np.frombuffer(x[1], np.uint8)]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _media_steps(batches, at):
            rows = []
            for x in expand([None if m is None else read_wav(m) for m in batch.column(at).to_pylist()]):
                if x is None:
                    rows.append((None,) * len(names))
                    continue
                codec, payload, pcm = x
                loud = float(np.sqrt(np.mean(np.square(pcm, dtype=np.float64)))) if len(pcm) else 0.0
                peak = int(np.abs(pcm.astype(np.int32)).max()) if len(pcm) else 0
                crossings = int(np.count_nonzero(np.diff(pcm < 0)))
                rows.append((codec, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), loud, peak, crossings, resample(pcm).tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=[*given, *names])

    return stored.mapInArrow(run, ", ".join(fields) + ", codec string, payload_bytes long, payload_sha256 string, tail_crc32 long, rms double, peak long, crossings long, pcm binary")


def _media_steps(batches: Iterator[pa.RecordBatch], at: int, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum([0] + [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(at)])
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def features(stored: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Digest columns of stored audio: what ``decode`` reads back, the file's digest and one feature string."""
    pcm = F.crc32("pcm")
    feature = F.concat_ws(":", "codec", F.format_number("rms", 3), "peak", "crossings", (F.octet_length("pcm") / 2).cast("long"), F.lpad(F.lower(F.hex(pcm)), 8, "0"))
    return decode(stored, media_col).select(
        id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length(media_col).cast("long").alias("media_bytes"), F.sha2(F.col(media_col), 256).alias("media_sha256"), feature.alias("feature"),
    )
