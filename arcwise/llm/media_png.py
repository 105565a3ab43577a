"""Media columns: byte payloads as 8-bit grey PNG images in binary columns.

An image is its signature and the chunks IHDR, IDAT (zlib) and IEND, each
with a CRC that reading tests. Rows are filtered before compression and
unfiltered with numpy. Features are hashes of the low frequencies of the
cosine transform of a small mean image.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import BIN, LONG, STR, byte_column, keep, schema, small_batches

SIGNATURE = b"\x89PNG\r\n\x1a\n"
UNIT, WIDTH, SIDE, LOW = 576, 576, 32, 8


class DamagedImage(ValueError):
    """A signature, checksum, length or filter that does not fit."""


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of the unit."""
    return data + b"\xff" * ((-len(data)) % UNIT or (0 if data else UNIT))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 4) -> bytes:
    """payload as rows of width samples; each row takes the smoother of no filter and Sub."""
    rows = np.frombuffer(payload, "u1").reshape(-1, width)
    sub = rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    kind = (np.abs(sub.view("i1").astype("i2")).sum(1) < rows.astype("i4").sum(1) // 4).astype("u1")
    out = np.empty((len(rows), width + 1), "u1")
    out[:, 0] = kind
    out[:, 1:] = np.where(kind[:, None] == 1, sub, rows)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(out.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey image; any damage raises DamagedImage."""
    if data[:8] != SIGNATURE:
        raise DamagedImage("signature")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise DamagedImage("cut chunk")
        (n,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + part):
            raise DamagedImage(f"checksum of {kind!r}")
        head = part if kind == b"IHDR" else head
        body += [part] if kind == b"IDAT" else []
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise DamagedImage("missing chunk")
    width, height, depth, colour, method, filters, lace = struct.unpack(">IIBBBBB", head)
    if (depth, colour, method, filters, lace) != (8, 0, 0, 0, 0):
        raise DamagedImage("not an 8-bit grey image")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), "u1")
    except zlib.error as e:
        raise DamagedImage(str(e)) from e
    if len(raw) != height * (width + 1):
        raise DamagedImage("length")
    return unfilter(raw.reshape(height, width + 1))


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Undo the five row filters; bytes per sample is one."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise DamagedImage("filter")
    if kinds.max(initial=0) < 2:  # no row looks at another: all at once
        sub = kinds == 1
        out[sub] = np.cumsum(out[sub], axis=1, dtype="u1")
        return out
    above = np.zeros(out.shape[1], "u1")
    for y, kind in enumerate(kinds):
        row = out[y]
        if kind == 1:
            row[:] = np.cumsum(row, dtype="u1")
        elif kind == 2:
            row += above
        elif kind >= 3:
            left = corner = 0
            for x in range(len(row)):
                up = int(above[x])
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    pa_, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
                    guess = left if pa_ <= pb and pa_ <= pc else up if pb <= pc else corner
                left = row[x] = (int(row[x]) + guess) & 255
                corner = up
        above = row
    return out


@functools.cache
def _cosines() -> np.ndarray:
    k, n = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * SIDE))


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits: which low frequencies of a 32 x 32 mean image exceed their median."""
    flat = image.reshape(-1).astype("f8")
    at = (np.arange(SIDE * SIDE + 1) * len(flat)) // (SIDE * SIDE)
    total = np.concatenate([[0.0], np.cumsum(flat)])
    # Images under 1024 samples repeat samples instead of averaging them.
    size = np.maximum(at[1:] - at[:-1], 1)
    first = np.minimum(at[:-1], len(flat) - 1)
    small = ((total[first + size] - total[first]) / size).reshape(SIDE, SIDE)
    c = _cosines()
    low = np.round(c @ small @ c.T, 6).reshape(-1)
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary PNG) of docs(doc_id, text).

    Null text counts as empty and gives one row of padding; extra columns are
    ignored; equal texts give equal images.
    """
    small_batches(docs.sparkSession)

    def encode(batches):
        for batch in batches:
            texts = byte_column(batch, "text")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([encode_png(pad(x)) for x in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(encode, schema(doc_id=LONG, n_bytes=LONG, media=BIN))


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features computed from the stored images alone; damage fails the job."""

    def read(batches):
        for batch in batches:
            rows = []
            for data in byte_column(batch, "media"):
                image = decode_png(data)
                payload = image.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(image)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=OUT.names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, OUT)


OUT = schema(doc_id=LONG, n_bytes=LONG, payload_bytes=LONG, payload_sha256=STR, tail_crc32=LONG, media_bytes=LONG, media_sha256=STR, feature=STR)


def op7_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every document as an image, read the images back, compute features."""
    return media_features(keep(store_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media"))
