"""Media columns: types by signature, checked by structure.

Aho-Corasick finds the magic bytes of all formats in one pass over the bytes; a validator for each format walks its
structure, so that a chance match is no find, and gives its length. What starts at byte 0 corrects the declared type,
what starts later is carved as embedded media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "application/octet-stream"


def _png(b: bytes, at: int) -> int | None:
    """Length of a PNG: chunks with right checksums from IHDR to IEND."""
    k, first = at + 8, True
    while k + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, k)
        if k + 12 + n > len(b) or first != (kind == b"IHDR") or zlib.crc32(memoryview(b)[k + 4 : k + 8 + n]) != struct.unpack_from(">I", b, k + 8 + n)[0]:
            return None
        k, first = k + 12 + n, False
        if kind == b"IEND":
            return k - at
    return None


def _wav(b: bytes, at: int) -> int | None:
    """Length of a RIFF file of type WAVE: its chunks fill it and hold fmt and data."""
    if at + 12 > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    k, kinds = at + 12, set()
    while k + 8 <= end <= len(b):
        kind, n = struct.unpack_from("<4sI", b, k)
        kinds.add(kind)
        k += 8 + n + n % 2
    return end - at if k in (end, end + 1) and end <= len(b) and {b"fmt ", b"data"} <= kinds else None


def _gif(b: bytes, at: int) -> int | None:
    """Length of a GIF: blocks to the trailer."""
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    k = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    while k < len(b):
        if b[k] == 0x3B:
            return k + 1 - at
        if b[k] == 0x21:
            k += 2
        elif b[k] == 0x2C and k + 10 < len(b):
            k += 11 + (3 << (b[k + 9] & 7) + 1 if b[k + 9] & 128 else 0)
        else:
            return None
        while k < len(b) and b[k]:
            k += b[k] + 1
        k += 1
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    """Length of a JPEG: segments to the scan, then entropy-coded data to the end marker."""
    k = at + 2
    while k + 4 <= len(b) and b[k] == 0xFF:
        kind, n = b[k + 1], struct.unpack_from(">H", b, k + 2)[0]
        k += 2 + n
        if kind == 0xDA:
            end = b.find(b"\xff\xd9", k)
            return end + 2 - at if end >= 0 else None
    return None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 30 > len(b):
        return None
    size, zero, start, head = struct.unpack_from("<IIII", b, at + 2)
    return size if zero == 0 and head in (12, 40, 52, 56, 108, 124) and 14 + head <= start <= size <= len(b) - at else None


#: Magic bytes of each format.
MAGIC: dict[bytes, tuple[str, Callable[[bytes, int], int | None]]] = {
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"RIFF": ("audio/wav", _wav),
    b"GIF87a": ("image/gif", _gif),
    b"GIF89a": ("image/gif", _gif),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"BM": ("image/bmp", _bmp),
}


@lru_cache(maxsize=1)
def _signatures():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for magic in MAGIC:
        machine.add_word(magic.decode("latin-1"), magic)
    machine.make_automaton()
    return machine


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of all media in the bytes, none within another."""
    found, free = [], 0
    for last, magic in _signatures().iter(data.decode("latin-1")):
        at = last + 1 - len(magic)
        if at >= free and (n := MAGIC[magic][1](data, at)):
            found.append((MAGIC[magic][0], at, n))
            free = at + n
    return found


_FOUND = "actual_type string, offset long, length long, embedded array<struct<type: string, offset: long, length: long>>"


def sniff_media(rows: DataFrame, media: str = "media", declared: str | None = None) -> DataFrame:
    """rows with actual_type, offset, length, embedded and, where a declared type is named, mistyped.

    What is found at byte 0 gives the type; bytes that hold nothing known there are UNKNOWN with their whole length.
    embedded lists the media that begin later, null for null bytes, for which type and length are null too. Empty bytes
    are UNKNOWN of length 0. Columns of rows that have one of these names are replaced.
    """
    keep = [c for c in rows.columns if c not in ("actual_type", "offset", "length", "embedded", "mistyped")]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes) + ", " + _FOUND
    kind = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types, offsets, lengths, inside = [], [], [], []
            for data in batch.column(media).to_pylist():
                if data is None:
                    types.append(None), offsets.append(None), lengths.append(None), inside.append(None)
                    continue
                found = sniff(data)
                head = found.pop(0) if found and found[0][1] == 0 else (UNKNOWN, 0, len(data))
                for to, value in zip((types, offsets, lengths), head, strict=True):
                    to.append(value)
                inside.append([{"type": t, "offset": o, "length": n} for t, o, n in found])
            new = [pa.array(types, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(inside, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "actual_type", "offset", "length", "embedded"])

    out = rows.select(*keep).mapInArrow(run, schema)
    return out.withColumn("mistyped", ~F.col(declared).eqNullSafe(F.col("actual_type"))) if declared else out


WIDTH, FILL = 576, b"\xff"


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """A grey image of 8-bit samples, a row for every `width` bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # each after the number of its filter, 0: none
    lines[:, 1:] = rows
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes(), 1)) + part(b"IEND", b"")


def png_samples(data: bytes) -> np.ndarray:
    """Samples of a grey 8-bit image without filters, by rows."""
    width, height, depth, colour = struct.unpack_from(">IIBB", data, 16)
    if (depth, colour) != (8, 0):
        raise ValueError("not an 8-bit grey image")
    parts, k = [], 8
    while k < len(data):
        n, kind = struct.unpack_from(">I4s", data, k)
        if kind == b"IDAT":
            parts.append(data[k + 8 : k + 8 + n])
        k += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:]


def store_payloads(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Columns doc_id, n_bytes, declared_type, media: each text's UTF-8 bytes, filled up to a positive multiple of WIDTH, as an image. Null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                media = []
                for x in batch.column("payload").to_pylist():
                    media.append(to_png(x + FILL * (max(1, -(-len(x) // WIDTH)) * WIDTH - len(x))))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    data = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(data).cast("long").alias("n_bytes"), data.alias("payload"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary").withColumn("declared_type", F.lit(UNKNOWN))


def read_payloads(media: DataFrame) -> DataFrame:
    """Features of sniffed images: digests of the samples read back and of the stored bytes, and a short description."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for data, kind, n in zip(batch.column("media").to_pylist(), batch.column("actual_type").to_pylist(), batch.column("length").to_pylist(), strict=True):
                samples = png_samples(data[:n])
                payload = samples.tobytes()
                shade = np.bincount(samples.reshape(-1) >> 5, minlength=8) * 100 // len(payload)
                values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), f"{kind} {samples.shape[1]}x{samples.shape[0]} mean {samples.mean():.3f} shades {'/'.join(map(str, shade))}")
                for to, value in zip(out.values(), values, strict=True):
                    to.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)), batch.column("mistyped")], ["doc_id", "n_bytes", *out, "mistyped"])

    return media.select("doc_id", "n_bytes", "media", "actual_type", "length", "mistyped").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, mistyped boolean")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_payloads(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_payloads(sniff_media(stored, "media", "declared_type"))
