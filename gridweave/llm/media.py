"""Media columns: payloads in content-addressed tar shards, rows that carry digest, offset and length.

write_shards() stores each row's samples as an 8-bit greyscale PNG (lossless; WIDTH samples a line) in a tar shard of its
partition, under <shared folder>/media-*. A member is named by the SHA-256 of its bytes; a shard holds each digest once.
The row keeps shard, digest, offset and length. read_media() opens a shard by range: first the 33 bytes of a member's
header alone, which fill the metadata columns (width, height, bit depth, colour type), then, where asked for, the member itself.
No payload is shuffled. A shard is written under a temporary name and moved when whole, so a task that runs again replaces
it by the same bytes; the index is checkpointed, so shards are written once.

Defined cases: a null text is an empty one; its payload is one line of padding; equal texts have equal values and are stored
once a shard; no rows give no rows and empty shards; other columns are ignored. The shards are the operator's output and stay.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, table

WIDTH, PAD, LEVEL, HEADER = 576, 255, 1, 33
_SIGN = b"\x89PNG\r\n\x1a\n"
INDEX = "doc_id long, n_bytes long, shard string, media_sha256 string, media_offset long, media_bytes long"
MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long, bit_depth int, colour_type int, shard string, media_offset long"


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes([PAD]) * (-len(raw) % WIDTH if raw else WIDTH)


def encode_png(samples: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """8-bit greyscale, one unfiltered line for each `width` samples."""
    lines = np.frombuffer(samples, np.uint8).reshape(-1, width)
    data = zlib.compress(np.pad(lines, ((0, 0), (1, 0))).tobytes(), level)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _SIGN + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(lines), 8, 0, 0, 0, 0)) + chunk(b"IDAT", data) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """width, height, bit depth, colour type from the first HEADER bytes."""
    if head[:8] != _SIGN or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIBB", head[16:26])


def decode_png(media: bytes) -> np.ndarray:
    """The samples, (height, width), of what encode_png() made."""
    width, height, depth, colour = png_header(media[:HEADER])
    if (depth, colour) != (8, 0):
        raise ValueError("only 8-bit greyscale")
    at, data = 8, []
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        if kind == b"IDAT":
            data.append(media[at + 8 : at + 8 + n])
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Mean, standard deviation, entropy in bits, and a 64-bit hash of which of 64 equal parts lie above the mean of the parts."""
    flat = samples.reshape(-1)
    counts = np.bincount(flat, minlength=256)
    p = counts[counts > 0] / flat.size
    mean = float(counts @ np.arange(256)) / flat.size
    var = float(counts @ np.arange(256) ** 2) / flat.size - mean**2
    parts = np.add.reduceat(flat.astype(np.int64), np.arange(64) * flat.size // 64) / np.diff(np.arange(65) * flat.size // 64)
    bits = int.from_bytes(np.packbits(parts > parts.mean()).tobytes(), "big")
    return f"{mean:.4f};{max(var, 0.0) ** 0.5:.4f};{-float(p @ np.log2(p)):.4f};{bits:016x}"


def _writer(folder: str, width: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        pid, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(path, recursive=True)
        shard, tmp = f"{path}/part-{pid:06d}.tar", f"{path}/.part-{pid:06d}-{attempt}"
        name = f"{folder}/part-{pid:06d}.tar"
        places: dict[bytes, tuple[int, int]] = {}
        with store.open_output_stream(tmp) as out:
            at = 0
            for b in batches:
                rows = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                    n, body = payload(text.as_py())
                    media = encode_png(body, width, level)
                    digest = hashlib.sha256(media).digest()
                    if digest not in places:
                        info = tarfile.TarInfo(f"{digest.hex()}.png")
                        info.size = len(media)
                        head = info.tobuf(tarfile.USTAR_FORMAT)
                        out.write(head + media + bytes(-len(media) % 512))
                        places[digest] = at + len(head), len(media)
                        at += len(head) + len(media) + -len(media) % 512
                    rows.append((doc_id, n, name, digest.hex(), *places[digest]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, _INDEX_TYPES)], _INDEX_NAMES)
            out.write(bytes(1024))
        store.move(tmp, shard)

    return run


_INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]
_INDEX_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def write_shards(docs: DataFrame, folder: str | None = None, width: int = WIDTH, level: int = LEVEL) -> DataFrame:
    """INDEX: one row for each row of docs (doc_id, text). folder: a URI that all executors reach."""
    folder = folder or f"{shared_dir(docs.sparkSession).rstrip('/')}/media-{uuid.uuid4().hex}"
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_writer(folder, width, level), INDEX))


def _reader(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        opened: dict = {}
        for b in batches:
            rows = []
            for doc_id, n, shard, digest, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if shard not in opened:
                    opened.clear()
                    store, path = fs.FileSystem.from_uri(shard) if "://" in shard else (fs.LocalFileSystem(), shard)
                    opened[shard] = store.open_input_file(path)
                meta = png_header(opened[shard].read_at(HEADER, offset))
                made = (None,) * 4
                if whole:
                    media = opened[shard].read_at(length, offset)
                    if hashlib.sha256(media).hexdigest() != digest:
                        raise OSError(f"{shard}: {digest} is damaged")
                    samples = decode_png(media)
                    body = samples.tobytes()
                    made = len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]), feature(samples)
                rows.append((doc_id, n, *made[:3], length, digest, made[3], *meta, shard, offset))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 14, _MEDIA_TYPES)], _MEDIA_NAMES)

    return run


_MEDIA_NAMES = [c.split()[0] for c in MEDIA.split(", ")]
_MEDIA_TYPES = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in MEDIA.split(", ")]


def read_media(index: DataFrame, whole: bool = True) -> DataFrame:
    """MEDIA for the rows of an index; with whole=False only headers are read, and the payload's columns are null."""
    return index.select(*_INDEX_NAMES).mapInArrow(_reader(whole), MEDIA)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    # where a text is stored depends on its partition; equal texts have equal values in all other columns
    return read_media(write_shards(table(spark, sf_dir, "documents"))).drop("shard", "media_offset")
