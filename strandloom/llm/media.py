"""Content-addressed media payloads in tar shards.

A payload is stored losslessly as an 8-bit greyscale PNG, 64 samples wide, in a tar shard in the folder the
executors share.  A member's name is the payload's SHA-256; within a shard each payload is stored once, and
over all shards the index keeps one place per digest.  Rows carry digest, shard, offset and length.  Metadata
columns (width, height, bit depth) are filled by range reads of PNG headers alone; features read the stored
bytes back.

Null and empty texts have the payload of 64 zero bytes.  Repeated rows share one stored payload and get the
same values; extra columns are ignored; an empty table writes no shard.  A shard is written under a name of
its own and only its finished attempt is in the index, so lost executors and repeated attempts leave at most
unreferenced files.
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
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks

WIDTH = 64
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, IHDR chunk (length, type, 13 bytes, CRC).
HEADER_BYTES = 8 + 25


def pad(text: bytes) -> bytes:
    """The payload: zero bytes up to a positive multiple of 64."""
    return text + b"\0" * ((-len(text)) % WIDTH or (0 if text else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes, level: int = 6) -> bytes:
    """The payload as a PNG of 8-bit samples, filter type 0 in every row."""
    rows = len(payload) // WIDTH
    raw = np.zeros((rows, WIDTH + 1), np.uint8)
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    return PNG_SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first :data:`HEADER_BYTES` of a stored payload."""
    if first[:8] != PNG_SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a stored payload")
    return struct.unpack(">IIB", first[16:25])


def decode(stored: bytes) -> bytes:
    """The payload of a stored PNG; every chunk's CRC is checked."""
    width, height, depth = header(stored)
    if (width, depth) != (WIDTH, 8):
        raise ValueError("unexpected sample format")
    at, data = 8, []
    while at < len(stored):
        (n,) = struct.unpack_from(">I", stored, at)
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    if raw[:, 0].any():
        raise ValueError("unexpected filter")
    return raw[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean, deviation, row-to-row change and coarse histogram of the samples, in fixed notation."""
    x = np.frombuffer(payload, np.uint8)
    total, squares = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    rows = x.reshape(-1, WIDTH).astype(np.int16)
    change = int(np.abs(np.diff(rows, axis=0)).sum(dtype=np.int64))
    mean = total / len(x)
    bins = np.bincount(x >> 5, minlength=8)
    return f"mean={mean:.6f};sd={max(0.0, squares / len(x) - mean * mean) ** 0.5:.6f};change={change};bins=" + "/".join(map(str, bins))


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _uri(folder: str) -> str:
    return folder if "://" in folder else "file://" + folder.removeprefix("file:")


INDEX = "doc_id long, digest string, n_bytes long, shard string, offset long, length long"


def store(docs: DataFrame, folder: str, shard_bytes: int = 16 << 20) -> DataFrame:
    """Write the texts of ``docs(doc_id, text)`` to tar shards of about ``shard_bytes`` and return their index.

    One map stage: every task fills its own shards, so payloads are never shuffled.  The index is materialised
    in the checkpoint folder.  Where shards hold the same digest, all its rows point to the least place.
    """
    folder = _uri(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "digest", "n_bytes", "shard", "offset", "length"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        system, path = _open(folder)
        buffer, places, rows = io.BytesIO(), {}, []
        tar = tarfile.open(fileobj=buffer, mode="w", format=tarfile.USTAR_FORMAT)

        def close() -> pa.RecordBatch | None:
            nonlocal buffer, places, rows, tar
            tar.close()
            name = f"shard-{uuid.uuid4().hex}.tar"
            batch = None
            if rows:
                with system.open_output_stream(f"{path}/{name}") as out:
                    out.write(buffer.getvalue())
                cols = list(zip(*((d, g, n, name, *places[g]) for d, g, n in rows), strict=True))
                batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
            buffer, places, rows = io.BytesIO(), {}, []
            tar = tarfile.open(fileobj=buffer, mode="w", format=tarfile.USTAR_FORMAT)
            return batch

        for block in blocks.row_blocks(batches, "text"):
            for doc, text in zip(block.column(0).to_pylist(), block.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                payload = pad(raw)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in places:
                    stored = encode(payload)
                    info = tarfile.TarInfo(digest + ".png")
                    info.size = len(stored)
                    places[digest] = (buffer.tell() + tarfile.BLOCKSIZE, len(stored))
                    tar.addfile(info, io.BytesIO(stored))
                rows.append((doc, digest, len(raw)))
                if buffer.tell() >= shard_bytes:
                    yield close()
        last = close()
        if last is not None:
            yield last

    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    return blocks.cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, INDEX))


def places(index: DataFrame) -> DataFrame:
    """One place per digest: ``digest, shard, offset, length`` (partial aggregation before the shuffle)."""
    best = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p"))
    return best.select("digest", "p.shard", "p.offset", "p.length")


def _ranges(folder: str, keys: list[str], read, fields: str, whole: bool):
    """A map over places sorted by shard, which reads a range per row and never a whole shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        name, source = None, None
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                made = []
                for shard, offset, length in zip(*(part.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                    if shard != name:
                        name, source = shard, system.open_input_file(f"{path}/{shard}")
                    made.append(read(source.read_at(length if whole else HEADER_BYTES, offset)))
                cols = list(zip(*made, strict=True))
                kinds = [pa.int64() if f.split()[1] == "long" else pa.string() for f in fields.split(", ")]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keys] + [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], keys + [f.split()[0] for f in fields.split(", ")])

    return run


def metadata(found: DataFrame, folder: str) -> DataFrame:
    """Metadata columns of :func:`places` by header-only range reads."""
    fields = "width long, height long, bit_depth long"
    run = _ranges(_uri(folder), ["digest", "shard", "offset", "length"], header, fields, False)
    return found.mapInArrow(run, "digest string, shard string, offset long, length long, " + fields)


def _measure(stored: bytes) -> tuple:
    payload = decode(stored)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(payload)


def measure(found: DataFrame, folder: str) -> DataFrame:
    """Digests and features of each place, from the stored bytes read back."""
    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    keys = ["digest", "shard", "offset", "length", "width", "height", "bit_depth"]
    run = _ranges(_uri(folder), keys, _measure, fields, True)
    return found.mapInArrow(run, "digest string, shard string, offset long, length long, width long, height long, bit_depth long, " + fields)


def media_columns(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Store, index, and describe: one row per row of ``docs``."""
    index = store(docs, folder)
    # Sorted by shard within few-row partitions, a task opens each of its shards once.
    found = places(index).repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    made = measure(metadata(found, folder), folder)
    return index.select("doc_id", "digest", "n_bytes").join(made, "digest")
