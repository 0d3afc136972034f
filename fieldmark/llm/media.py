"""Media columns: content-addressed payloads in tar shards, metadata from header-only reads.

A task writes the payloads of its rows as grayscale PNG members of a tar shard
in the shared folder, each named by its payload's SHA-256 and stored once per
shard. A row keeps only ``digest, shard, offset, length``. A digest that stands
in several shards is then read from one of them alone (the least place), so
equal payloads have equal columns; the other members are never referred to.

Metadata columns come from range reads of the first bytes of a member, the
pixels from a second range read only where they are asked for.

A shard's name holds the task attempt, and only rows of attempts that
succeeded are kept, so a retried task leaves no wrong reference. Payloads are
held one at a time.

Cases: a null text is empty; the payload is padded with bytes 0 to a positive
multiple of 64, so an empty one has 64; equal texts and repeated rows share all
values; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import dealt, filesystem, free, map_batches, scratch, split_join, stage

ROW = 64
SHARD_BYTES = 256 << 20
_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Signature and IHDR chunk: all that a header-only read fetches.
HEADER_BYTES = 33


def padded(text: bytes) -> bytes:
    """The payload of a text: a positive multiple of 64 bytes."""
    return text + bytes(max(ROW, -(-len(text) // ROW) * ROW) - len(text))


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encoded(payload: bytes) -> bytes:
    """The payload as an 8-bit grayscale PNG, 64 samples wide."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(samples), ROW + 1), np.uint8)  # filter byte 0 before each line
    lines[:, 1:] = samples
    header = struct.pack(">IIBBBBB", ROW, len(samples), 8, 0, 0, 0, 0)
    return _MAGIC + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def size_of(head: bytes) -> tuple[int, int]:
    """Width and height from a PNG's first bytes."""
    if head[:8] != _MAGIC or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not a PNG header")
    return struct.unpack(">II", head[16:24])


def decoded(png: bytes) -> bytes:
    """The samples of a PNG that ``encoded`` wrote; every chunk's checksum is held against its bytes."""
    (width, height), at, data = size_of(png), 8, []
    while at < len(png):
        n = struct.unpack(">I", png[at : at + 4])[0]
        kind, body, check = png[at + 4 : at + 8], png[at + 8 : at + 8 + n], png[at + 8 + n : at + 12 + n]
        if struct.pack(">I", zlib.crc32(kind + body)) != check:
            raise ValueError(f"damaged {kind!r} chunk")
        data += [body] * (kind == b"IDAT")
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def mean_hash(payload: bytes) -> str:
    """16 hex digits: of 64 equal parts of the samples, which have a mean above the whole's."""
    parts = np.frombuffer(payload, np.uint8).reshape(64, -1).sum(1, dtype=np.int64)
    return np.packbits(parts * 64 > parts.sum()).tobytes().hex()


def write_shards(docs: DataFrame) -> DataFrame:
    """Store each row's text; rows ``(doc_id, n_bytes, digest, shard, offset, length)``."""
    folder = scratch(docs.sparkSession, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        out, name, at, count, known = None, "", 0, 0, {}
        for batch in batches:
            rows = []
            for text in batch.column("text").cast(pa.large_binary()):
                text = text.as_py() or b""
                payload = padded(text)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in known:
                    if out is None or at > SHARD_BYTES:
                        if out is not None:
                            out.write(bytes(2 * tarfile.BLOCKSIZE))
                            out.close()
                        name, at = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}-{count}.tar", 0
                        out, count, known = fs.open_output_stream(filesystem(name)[1]), count + 1, {}
                    member = tarfile.TarInfo(f"{digest}.png")
                    body = encoded(payload)
                    member.size = len(body)
                    head = member.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head + body + bytes(-len(body) % tarfile.BLOCKSIZE))
                    known[digest] = (name, at + len(head), len(body))
                    at += len(head) + len(body) + -len(body) % tarfile.BLOCKSIZE
                rows.append((len(text), digest, *known[digest]))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            types = pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()
            arrays = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if out is not None:
            out.write(bytes(2 * tarfile.BLOCKSIZE))
            out.close()

    rows = map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long")
    return stage(rows, "media-rows")


def catalogue(rows: DataFrame) -> DataFrame:
    """One place ``(digest, shard, offset, length)`` for each digest and how many rows have it."""
    place = F.min(F.struct("shard", "offset", "length")).alias("p")
    found = rows.groupBy("digest").agg(place, F.count(F.lit(1)).alias("times"))
    return stage(found.select("digest", "p.*", "times"), "media-places")


def in_order(places: DataFrame) -> DataFrame:
    """``places`` dealt over tasks by the bytes they name and sorted by shard, so that a task reads few of them."""
    count, size = places.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    dealt_out = dealt(places.select("digest", "shard", "offset", "length"), count, size, "shard", "offset")
    return dealt_out.sortWithinPartitions("shard", "offset")


def ranges(batch: pa.RecordBatch, opened: dict, most: int | None = None) -> Iterator[bytes]:
    """The bytes of each row's member, or the first ``most`` of them; ``opened`` keeps one shard open."""
    for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
        if shard not in opened:
            for f in opened.values():
                f.close()
            opened.clear()
            fs, path = filesystem(shard)
            opened[shard] = fs.open_input_file(path)
        yield opened[shard].read_at(length if most is None else min(most, length), offset)


def with_metadata(places: DataFrame) -> DataFrame:
    """``places`` with ``width, height`` from header-only range reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for b in batches:
            sizes = [size_of(head) for head in ranges(b, opened, HEADER_BYTES)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([s[i] for s in sizes], pa.int64()) for i in (0, 1))], [*b.schema.names, "width", "height"])

    return map_batches(places, run, "digest string, shard string, offset long, length long, width long, height long")


def with_features(places: DataFrame) -> DataFrame:
    """``places`` (with metadata) read back whole: sizes and hashes of payload and stored form, and the mean hash."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for b in batches:
            rows = []
            for png in ranges(b, opened):
                payload = decoded(png)
                digests = hashlib.sha256(payload).hexdigest(), hashlib.sha256(png).hexdigest()
                rows.append((len(payload), digests[0], zlib.crc32(payload[-ROW:]), len(png), digests[1], mean_hash(payload)))
            columns = zip(*rows, strict=True) if rows else [()] * 6
            types = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*b.schema.names, *names])

    schema = "digest string, shard string, offset long, length long, width long, height long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(places, run, schema)


def media_columns(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with what its stored payload shows, read back from the shards."""
    rows = write_shards(docs)
    places = catalogue(rows)
    seen = with_features(with_metadata(in_order(places)))
    seen = stage(seen.join(places.select("digest", "times"), "digest"), "media-features")
    free(places)
    columns = "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "shard", "offset", "length"
    return split_join(rows.select("doc_id", "n_bytes", "digest"), seen, ["digest"], "times").select("doc_id", "n_bytes", *columns)
