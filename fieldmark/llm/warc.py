"""WARC archives: writing with revisits, and a salvage reader.

Archives are ``.warc.gz`` files with one gzip member per record; the reader
also takes members of many records. It goes from member to member. A record
that fails its checks (version line, headers, Content-Length, block and payload
digest) is not the end: inside a member that unpacks, the reader goes on at the
next ``WARC/1.`` of the content from which a whole valid record can be read. A
damaged member is unpacked up to the error and read the same way, as far as
block digests vouch for its records; from there, and from anything else that is
no record, the next gzip magic, or in plain bytes the next ``WARC/1.`` line, is
searched in the file. All that is passed over is logged as a quarantined gap;
a gap inside a member has the member's place and says which bytes of its content.

Cases: a null html is an empty payload; of equal payloads of at least
``revisit_bytes`` bytes the record with the largest page_id is the response
and the others revisit it; repeated rows with that page_id are all responses; a
null page_id is smaller than any; further columns are ignored; an empty table
gives no archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import dealt, filesystem, map_batches, scratch, split_join, stage

ARCHIVE_BYTES = 64 << 20
WINDOW = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = b"\x1f\x8b\x08"
CUT = "the member is cut short"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page {page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, so the full payload's length, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class BadRecord(ValueError):
    """A record that fails a check."""


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``; raises BadRecord where a check fails."""
    end = data.find(b"\r\n\r\n", at)
    if not data.startswith(b"WARC/1.", at) or end < 0:
        raise BadRecord("no version line or header end")
    head = data[at:end].decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
    if not fields.get("content-length", "").isdigit():
        raise BadRecord("no Content-Length")
    start, stop = end + 4, end + 4 + int(fields["content-length"])
    block = data[start:stop]
    if len(block) < stop - start or data[stop : stop + 4] != b"\r\n\r\n":
        raise BadRecord("the block ends elsewhere")
    if (want := fields.get("warc-block-digest")) and want != f"sha1:{sha1_base32(block)}":
        raise BadRecord("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields.get("warc-type") == "response" and (want := fields.get("warc-payload-digest")) and want != f"sha1:{sha1_base32(payload)}":
        raise BadRecord("payload digest")
    return fields, block, stop + 4


def _up_to_error(unpack, data: bytes) -> Iterator[bytes]:
    """What ``data`` unpacks to before the byte that fails."""
    step = len(data)
    while step := step // 2:
        before = unpack.copy()
        try:
            out = unpack.decompress(data[:step])
        except zlib.error:
            unpack = before
            continue
        yield out
        data = data[step:]
        step = len(data) + 1


def records_in(data: bytes, damage: str = "") -> Iterator[tuple]:
    """``("record", start, end, fields, block)`` and ``("gap", start, end, reason, None)`` of a member's content.

    If the member has ``damage``, only records that a digest vouches for count,
    and where it is cut, only those that more content follows.
    """
    at, gap, why = 0, None, ""
    while at < len(data):
        try:
            fields, block, end = parse_record(data, at)
            if damage and "warc-block-digest" not in fields:
                raise BadRecord(f"{damage}, and no block digest")
            if damage == CUT and end == len(data):
                raise BadRecord(damage)
        except BadRecord as e:
            gap, why = (at, str(e)) if gap is None else (gap, why)
            at = data.find(b"WARC/1.", at + 1)
            if at < 0:
                break
            continue
        if gap is not None:
            yield "gap", gap, at, why, None
            gap = None
        yield "record", at, end, fields, block
        at = end
    if gap is not None:
        yield "gap", gap, len(data), why, None


class Source:
    """Random access over an archive; at most the asked range is held."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size = file, file.size()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(min(n, max(0, self.size - at)), at)

    def find(self, needles: tuple[bytes, ...], at: int) -> int:
        """The first place from ``at`` on of any needle, or the end."""
        keep = max(map(len, needles)) - 1
        while at < self.size:
            data = self.read(at, WINDOW)
            if found := [p for p in (data.find(x) for x in needles) if p >= 0]:
                return at + min(found)
            if at + len(data) >= self.size:
                break
            at += len(data) - keep
        return self.size

    def member(self, at: int) -> tuple[bytes, int, str]:
        """The content of the gzip member at ``at``, where it ends, and what is wrong with it: then the content goes up to there."""
        unpack, out, start = zlib.decompressobj(31), [], at
        while not unpack.eof:
            data = self.read(at, WINDOW if at > start else 1 << 16)
            if not data:
                return b"".join(out), at, CUT
            before = unpack.copy()
            try:
                out.append(unpack.decompress(data))
            except zlib.error as e:
                return b"".join([*out, *_up_to_error(before, data)]), at, str(e)
            at += len(data) - len(unpack.unused_data)
        return b"".join(out), at, ""

    def packed(self, at: int, n: int) -> int:
        """A place in the member at ``at`` before which at most ``n`` bytes are unpacked from."""
        unpack, size = zlib.decompressobj(31), 0
        while data := self.read(at, WINDOW):
            for p in range(0, len(data), 16):
                try:
                    size += len(unpack.decompress(data[p : p + 16]))
                except zlib.error:
                    return at + p
                if size > n or unpack.eof:
                    return at + p
            at += len(data)
        return at

    def plain(self, at: int) -> tuple[dict[str, str], bytes, int]:
        """The uncompressed record at ``at``, from as many bytes as it names."""
        data, n = self.read(at, 1 << 16), 1 << 16
        while True:
            try:
                fields, block, end = parse_record(data)
                return fields, block, at + end
            except BadRecord:
                head = data.find(b"\r\n\r\n")
                length = next((x.partition(b":")[2].strip() for x in data[: max(head, 0)].split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
                need = head + 8 + int(length) if head >= 0 and length.isdigit() else 0
                if need <= len(data) or at + need > self.size or need <= n:
                    raise
                data, n = self.read(at, need), need


def salvage(file: pa.NativeFile) -> Iterator[tuple]:
    """What can be read: ``("record", start, end, fields, block)`` and ``("gap", start, end, reason, None)``."""
    source, at, gap, why = Source(file), 0, None, ""
    while at < source.size:
        found, damage, good, head = [], "", 0, source.read(at, 8)
        try:
            if head.startswith(_MAGIC):
                data, end, damage = source.member(at)
                found = list(records_in(data, damage))
                good = max((x[2] for x in found if x[0] == "record"), default=0)
                if not good and (data or damage):
                    raise BadRecord(damage or found[0][3])
            elif head.startswith(b"WARC/1."):
                fields, block, end = source.plain(at)
                found.append(("record", at, end, fields, block))
            else:
                raise BadRecord("neither a member nor a version line")
        except BadRecord as e:
            if gap is None:
                gap, why = at, str(e)
            at = source.find((_MAGIC, b"WARC/1."), at + 1)
            continue
        if gap is not None:
            yield "gap", gap, at, why, None
            gap = None
        for kind, start, stop, what, block in found:
            if kind == "record":
                yield "record", at, at if damage else end, what, block
            elif not damage or start < good:
                yield "gap", at, end, f"{what}; bytes {start} to {stop} of the member's content", None
        if damage:  # what follows the last whole record is a gap up to the next place to read from
            gap, why = source.packed(at, good), f"{damage}; after byte {good} of the member's content"
            at = source.find((_MAGIC, b"WARC/1."), max(gap, at + 1))
        else:
            at = end
    if gap is not None:
        yield "gap", gap, source.size, why, None


def decided(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """``pages`` ``(page_id, url, html)`` with ``refers_to``: the response that a page revisits, else null."""
    keyed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumns(
        {"digest": F.sha1("html"), "size": F.octet_length("html"), "rk": F.coalesce(F.col("page_id").cast("long"), F.lit(-(2**63)))}
    )
    digests = keyed.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.max("rk").alias("last"), F.count(F.lit(1)).alias("n"))
    last = stage(digests.where("n > 1"), "responses")
    met = split_join(keyed, last, ["digest"], "n", "left", narrow=True)  # html moves only where the repeated digests are too many to broadcast
    earlier = (F.col("rk") < F.col("last")) & (F.col("size") >= revisit_bytes)
    return met.select("page_id", "url", "html", F.when(earlier, F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (with ``refers_to``) as archives in the shared folder; rows ``(archive, bytes, records)``."""
    folder = scratch(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        out, name, count, size, n, done = None, "", 0, 0, 0, []
        for b in batches:
            for page_id, url, html, refers_to in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").cast(pa.large_binary()), b.column("refers_to").to_pylist(), strict=True):
                if out is not None and size > ARCHIVE_BYTES:
                    out.close()
                    done.append((name, size, n))
                    out = None
                if out is None:
                    name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{count}.warc.gz"
                    out, size, n, count = fs.open_output_stream(filesystem(name)[1], compression=None), 0, 0, count + 1
                member = gzip.compress(record(page_id, url, html.as_py() or b"", refers_to), 6, mtime=0)
                out.write(member)
                size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            done.append((name, size, n))
        columns = zip(*done, strict=True) if done else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["archive", "bytes", "records"])

    return stage(map_batches(pages, run, "archive string, bytes long, records long"), "archives")


_FOUND = "archive string, start long, stop long, error string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of ``archives`` ``(archive, bytes, records)`` and every quarantined gap (``error`` is set), through the salvage reader.

    ``payload`` is null for revisits, and for all if not asked for; length and
    digest are the full payload's for both kinds, computed from the bytes read
    where they are there. Archives are dealt over tasks by their bytes.
    """
    names = [x.split()[0] for x in _FOUND.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    kinds = [types[x.split()[1]] for x in _FOUND.split(", ")]

    def number(text: str | None) -> int | None:
        return int(text) if text and text.lstrip("-").isdigit() else None

    def row(archive: str, found: tuple) -> tuple:
        kind, start, stop, fields, block = found
        if kind == "gap":
            return (archive, start, stop, fields, *[None] * 7)
        http, _, payload = block.partition(b"\r\n\r\n")
        response = fields.get("warc-type") == "response"
        stated = next((x.partition(b":")[2].strip().decode() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        size, digest = (len(payload), sha1_base32(payload)) if response else (number(stated), fields.get("warc-payload-digest", "").removeprefix("sha1:"))
        ids = number(fields.get("x-page-id")), fields.get("warc-target-uri"), fields.get("warc-type"), number(fields.get("x-refers-to-page-id"))
        return archive, start, stop, None, *ids, size, digest, payload if response and payloads else None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column("archive").to_pylist():
                fs, path = filesystem(archive)
                with fs.open_input_file(path) as file:
                    rows, held = [], 0
                    for found in salvage(file):
                        rows.append(row(archive, found))
                        held += len(rows[-1][-1] or b"")
                        if held > 4 * WINDOW or len(rows) >= 1000:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    count, size = archives.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return map_batches(dealt(archives.select("archive"), count, size, "archive"), run, _FOUND)


class LostRecords(RuntimeError):
    """Archives gave back other numbers of records than were written."""


def checked(archives: DataFrame, found: DataFrame) -> DataFrame:
    """The records of ``found``, what was read of ``archives``; raises LostRecords, naming the gap log, if any archive lacks some."""
    spark = found.sparkSession
    seen = stage(found.drop("payload"), "read-back")
    read = seen.groupBy("archive").agg(F.count_if(F.col("error").isNull()).alias("read"), F.count_if(F.col("error").isNotNull()).alias("gaps"))
    odd = archives.join(read, "archive", "left").where("coalesce(read, 0) != records or gaps > 0")
    if not odd.isEmpty():
        log = scratch(spark, "warc-gaps")
        seen.where(F.col("error").isNotNull()).select("archive", "start", "stop", "error").write.parquet(log)
        lost = odd.agg(F.count(F.lit(1)), F.sum(F.col("records") - F.coalesce("read", F.lit(0)))).first()
        raise LostRecords(f"{lost[0]} archives lack {lost[1]} records; gaps are logged in {log}")
    return seen


def archived(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives and read them back: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``.

    All records must come back: a gap, or a count that differs from what was written, raises LostRecords.
    """
    archives = write_archives(decided(pages, revisit_bytes))
    found = checked(archives, read_archives(archives, payloads=False))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
