r"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

Records are WARC/1.1, one gzip member each (or plain). ``write_pages`` finds equal payloads by
SHA-1 and length; of the rows that share one, the largest page_id becomes the response and the
others revisit records that refer to it. ``read_archives`` checks each record (member checksum,
version line, header block, declared length, end of record, payload digest); where a check fails
it searches on for the next member or version line that starts a valid record, goes on from there,
and reports the skipped bytes as a gap with its reason. A member may hold several records: they share
its place in the file, and only the part of it that fails is a gap. A file is streamed by one task, so
memory follows the largest member (or plain record) and not the archive.

A null html is an empty payload, a null or empty url an absent target. White space and control characters
of a url are written as %XX, as a header can't hold them. Page ids are read as longs. Rows with a null page_id are
responses unless a row with an id has the same payload; if several rows share the largest id they
are all responses. Other columns of the pages are left alone. Archives go to the shared folder by
pyarrow's file systems under names made from the partition, so a task that runs again after a lost
executor writes the same files again."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import bloom, bloom_hit, settle, shared_dir, tune

ROLL_BYTES = 64 << 20
READ_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Equal payloads of at least so many bytes are revisited.
MIN_REVISIT = 0
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\xa0\u2028\u2029]")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
#: A fixed date keeps archives of the same rows equal.
DATE = "2024-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}:{digest}"


def page_of(urn: str | None) -> int | None:
    part = (urn or "").strip("<>").split(":")
    return int(part[2]) if len(part) == 4 and part[2] else None


def target_uri(url: str) -> str:
    """url with its control characters and white space as %XX."""
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def render(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """A response record, or a revisit record (without payload) of refers_to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id, digest)}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + target_uri(url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"WARC-Refers-To-Date: {DATE}"]
        if refers_url:
            head.append("WARC-Refers-To-Target-URI: " + target_uri(refers_url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def _open_dir(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_pages(pages: DataFrame, uri: str, min_revisit: int = MIN_REVISIT, roll: int = ROLL_BYTES, compress: bool = True) -> DataFrame:
    """Write page_id, url, html as archives under uri; returns path, n_records, n_bytes of each file."""
    tune(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html")).withColumn("digest", F.xxhash64("sha", "size"))
    # digests alone find the payloads that occur twice; only rows that may have one (by a Bloom filter) take part in
    # the join, where AQE splits a hot one, and the others are written where they are read
    twins = rows.where(F.col("size") >= min_revisit).groupBy("sha", "size").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first"), F.max_by("url", "page_id").alias("first_url")).where("n > 1")
    twins = settle(twins.select("sha", "size", "first", "first_url"), "warc-twins")
    hit = bloom_hit(pages.sparkSession, "digest", bloom(twins.select(F.xxhash64("sha", "size").alias("digest"))))
    first, revisit = F.col("first"), ~(F.col("page_id").eqNullSafe(F.col("first")) | F.col("first").isNull())
    marked = rows.where(hit).join(twins, ["sha", "size"], "left").select("page_id", "url", first, "first_url", revisit.alias("revisit"), "html")
    none = [F.lit(None).cast("long").alias("first"), F.lit(None).cast("string").alias("first_url"), F.lit(False).alias("revisit")]
    marked = rows.where(~hit).select("page_id", "url", *none, "html").unionByName(marked)
    suffix = "warc.gz" if compress else "warc"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open_dir(uri)
        files.create_dir(root, recursive=True)
        task, k, out, n, size = TaskContext.get(), 0, None, 0, 0
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            out.close()
            files.move(temp, name)
            done.append((name, n, size))

        for b in batches:
            for page_id, url, first, first_url, revisit, html in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name = f"{root}/part-{task.partitionId():06d}-{k:04d}.{suffix}"
                    temp = f"{name}.{task.taskAttemptId()}.tmp"
                    out, n, size, k = files.open_output_stream(temp), 0, 0, k + 1
                payload = html.encode()
                data = render(page_id, url, payload, digest32(payload), first if revisit else None, first_url if revisit else None)
                data = member(data) if compress else data
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            p, n_, s = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(n_, pa.int64()), pa.array(s, pa.int64())], ["path", "n_records", "n_bytes"])

    return settle(marked.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-files")


class _Stream:
    """Bytes of a file by absolute position; what lies before ``drop`` is given up."""

    def __init__(self, f):
        self.f, self.base, self.buf, self.end = f, 0, bytearray(), False

    def fill(self, upto: int) -> bool:
        """Whether the bytes before position upto are there."""
        while not self.end and self.base + len(self.buf) < upto:
            b = self.f.read(max(READ_BYTES, upto - self.base - len(self.buf)) if upto - self.base < 64 * READ_BYTES else READ_BYTES)
            self.end = not b
            self.buf += b
        return self.base + len(self.buf) >= upto

    def drop(self, pos: int) -> None:
        if pos - self.base > READ_BYTES:
            del self.buf[: pos - self.base]
            self.base = pos

    def size(self) -> int:
        return self.base + len(self.buf)

    def find_start(self, pos: int) -> int:
        """First place at or after pos where a member or a version line may start, or -1; no byte after it is given up."""
        while True:
            at = _START.search(self.buf, pos - self.base)
            if at:
                return self.base + at.start()
            if self.end:
                return -1
            pos = max(pos, self.size() - 6)  # a start is 7 bytes at most
            self.drop(pos)
            self.fill(self.size() + READ_BYTES)


class Bad(ValueError):
    pass


def _headers(block: bytes) -> dict[str, str]:
    if any(c < 32 and c not in (9, 10, 13) for c in block):
        raise Bad("control character in a header")
    out: dict[str, str] = {}
    for line in block.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Bad("header line without a name")
        out[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def _check(head: dict[str, str], block: bytes) -> dict:
    """Fields of a record whose block is complete; Bad if a declared digest doesn't hold."""
    kind = head.get("warc-type")
    if not kind or "warc-record-id" not in head:
        raise Bad("mandatory header missing")
    http, payload, length = {}, block, len(block)
    if head.get("content-type", "").startswith("application/http"):
        top, gap, payload = block.partition(b"\r\n\r\n")
        if not gap or not top.startswith(b"HTTP/"):
            raise Bad("http header block")
        http = _headers(top.partition(b"\r\n")[2]) if b"\r\n" in top else {}
        length = int(http["content-length"]) if http.get("content-length", "").isdigit() else len(payload)
    declared = head.get("warc-payload-digest", "")
    if kind != "revisit" and declared.startswith("sha1:") and declared[5:] != digest32(payload):
        raise Bad("payload digest")
    if kind != "revisit" and "content-length" in http and length != len(payload):
        raise Bad("payload length")
    return {"type": kind, "id": head["warc-record-id"], "target": head.get("warc-target-uri"), "refers": head.get("warc-refers-to"), "digest": declared.removeprefix("sha1:") or None, "payload": payload, "payload_bytes": length}


def _parse(get) -> tuple[dict, int]:
    """A record from get(n) -> first n bytes (fewer at the end); its fields and its length."""
    n = 4096
    while (cut := (raw := get(n)).find(b"\r\n\r\n")) < 0:
        if len(raw) < n:
            raise Bad("header block without end")
        n *= 4
    lines = raw[:cut].partition(b"\r\n")
    if lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise Bad("version line")
    head = _headers(lines[2])
    if not head.get("content-length", "").isdigit():
        raise Bad("content length")
    size = int(head["content-length"])
    total = cut + 4 + size + 4
    raw = get(total)
    if len(raw) < total:
        raise Bad("cut short")
    if raw[total - 4 : total] != b"\r\n\r\n":
        raise Bad("end of record")
    return _check(head, bytes(raw[cut + 4 : total - 4])), total


def _member_at(s: _Stream, pos: int) -> tuple[list[tuple[str, object]], int]:
    """What the gzip member at pos holds, records and gaps, and where the member ends."""
    d, out, at = zlib.decompressobj(31), [], pos
    while not d.eof:
        if not s.fill(at + 1):
            raise Bad("member cut short")
        piece = bytes(s.buf[at - s.base : at - s.base + READ_BYTES])
        try:
            out.append(d.decompress(piece))
        except zlib.error as e:
            raise Bad(f"member: {str(e)[:40]}") from None
        if len(out) == 1 and not b"WARC/1.".startswith(out[0][:7]):
            raise Bad("member without a record")
        at += len(piece) - len(d.unused_data)
    inner = list(salvage(io.BytesIO(b"".join(out)), members=False))
    if not any(kind == "record" for kind, *_ in inner):
        raise Bad(inner[0][3] if inner else "member without a record")
    return [(kind, got if kind == "record" else f"bytes {a} to {z} of the member: {got}") for kind, a, z, got in inner], at


def _plain_at(s: _Stream, pos: int) -> tuple[list[tuple[str, object]], int]:
    def get(n: int) -> bytes:
        s.fill(pos + n)
        return bytes(s.buf[pos - s.base : pos - s.base + n])

    got, size = _parse(get)
    return [("record", got)], pos + size


def salvage(f, members: bool = True) -> Iterator[tuple[str, int, int, object]]:
    """("record", start, end, fields) and ("gap", start, end, reason) that together cover the file, in order.
    Without members a gzip member is not a start."""
    s = _Stream(f)
    pos, gap, why = 0, None, ""
    while s.fill(pos + 1):
        s.fill(pos + 8)
        start = bytes(s.buf[pos - s.base : pos - s.base + 7])
        kind = _member_at if members and start[:3] == b"\x1f\x8b\x08" else _plain_at if start == b"WARC/1." else None
        try:
            if kind is None:
                raise Bad("no record starts here")
            found, end = kind(s, pos)
        except Bad as e:
            if gap is None:
                gap, why = pos, str(e)
            pos = s.find_start(pos + 1)
            if pos < 0:
                break
            continue
        if gap is not None:
            yield "gap", gap, pos, why
            gap = None
        for what, got in found:
            yield what, pos, end, got
        pos = end
        s.drop(pos)
    if gap is not None:
        yield "gap", gap, s.size(), why


RECORDS = "path string, kind string, start long, stop long, reason string, record_type string, record_id string, target string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read_archives(files: DataFrame, uri: str, payloads: bool = True) -> DataFrame:
    """Records and gaps (kind) of the archives in files.path, which are paths of uri's file system.

    For a revisit record payload_bytes is the length that its HTTP header declares for the payload."""
    names = [c.split(" ")[0] for c in RECORDS.split(", ")]
    types = [pa.int64() if c.endswith(" long") else pa.binary() if c.endswith(" binary") else pa.string() for c in RECORDS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open_dir(uri)
        for b in batches:
            for path in b.column("path").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path) as f:
                    for kind, start, end, got in salvage(f):
                        if kind == "gap":
                            rows.append((path, kind, start, end, got, *[None] * 7))
                        else:
                            data = got["payload"] if payloads else None
                            rows.append((path, kind, start, end, None, got["type"], got["id"], got["target"], got["refers"], got["digest"], got["payload_bytes"], data))
                            held += len(data or b"")
                        if held > READ_BYTES or len(rows) >= 4096:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    n = max(1, min(files.count(), 4096))
    return files.select("path").repartition(n).mapInArrow(read, RECORDS)


def roundtrip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to (page_id of the response), target. An error if the archives give
    back another number of records than were written, or any gap."""
    uri = f"{shared_dir(pages.sparkSession)}/pagequarry-warc-{uuid.uuid4().hex}"
    files = write_pages(pages, uri)
    number = lambda c: F.expr(f"try_cast(split_part({c}, ':', 3) AS BIGINT)")
    fields = [number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "target"]
    found = settle(read_archives(files, uri, payloads=False).select("kind", *fields), "warc-found")
    wrote = files.agg(F.coalesce(F.sum("n_records"), F.lit(0))).first()[0]
    read, gaps = found.agg(F.expr("count_if(kind = 'record')"), F.expr("count_if(kind = 'gap')")).first()
    if (read, gaps) != (wrote, 0):
        raise ValueError(f"{wrote} records written, {read} read with {gaps} gaps")
    return found.drop("kind")
