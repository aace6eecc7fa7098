"""WARC archives: a writer with revisit records and a salvage reader.

The writer makes one gzip member per record.  Of pages with equal payloads (SHA-256) of
``min_bytes`` or more, the one with the smallest page_id is a response and the others are
revisits that name it and carry no payload.  Files are rolled at ``roll_bytes`` and named by
attempt; the manifest lists those of the attempts that Spark committed.

The salvage reader checks each record (gzip checksum, version line, length, closing line ends,
payload digest).  When a check fails it searches for the next gzip member or version line
that starts a record that passes, goes on from there, and reports the bytes between as a
quarantined gap with the reason.  It reads plain and compressed records, also mixed.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlab.llm.common import commit_file, new_path, open_fs, tasks_for, written

VERSION, MEMBER, END = b"WARC/1.1\r\n", b"\x1f\x8b\x08", b"\r\n\r\n"
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SALTS, STEP = 16, 16384
FOUND = "path string, gap boolean, at long, end long, reason string, page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"


def with_references(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses.

    Null html is an empty payload.  Rows that repeat the smallest page_id of their payload are
    responses too; rows without a page_id are revisits where another row of the payload has one."""
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    shared = rows.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    shared = shared.select(F.col("digest").alias("_digest"), "first", salts.alias("_salt"))  # a payload that fills a third of all rows goes to SALTS tasks
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    rows = rows.join(shared, (F.col("digest") == F.col("_digest")) & (F.col("salt") == F.col("_salt")), "left")
    return rows.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One uncompressed record.  Control characters of a URL are percent-encoded."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(lines).encode() + END + block + END


def write(pages: DataFrame, folder: str, *, date: str = "1970-01-01T00:00:00Z", roll_bytes: int = 16 << 20, compressed: bool = True, **columns) -> DataFrame:
    """Writes the archives below ``folder``; returns the manifest (path, n_records, n_bytes)."""
    def save(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        row, name, k = next(rows, None), f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}", 0
        while row:
            done = [0, 0]

            def fill(out, done=done):
                nonlocal row
                while row and done[1] < roll_bytes:
                    raw = record(*row, date)
                    if compressed:
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        raw = z.compress(raw) + z.flush()
                    out.write(raw)
                    done[0], done[1] = done[0] + 1, done[1] + len(raw)
                    row = next(rows, None)

            path = f"{name}-{k:05d}.warc" + ".gz" * compressed
            commit_file(path, fill)
            k += 1
            yield pa.RecordBatch.from_pylist([{"path": path, "n_records": done[0], "n_bytes": done[1]}])

    rows = with_references(pages, **columns).select("page_id", "url", "payload", "digest", "refers_to")
    return written(rows.mapInArrow(save, "path string, n_records long, n_bytes long"), "archives")


class Bad(ValueError):
    """A record that fails a check."""


def parse(data: bytes, at: int, upto: int) -> tuple[dict, int]:
    """The record that starts at ``at`` of plain bytes and its end; raises ``Bad``."""
    if not START.match(data, at) or data[at:at + 4] != b"WARC":
        raise Bad("no version line")
    head = data.find(END, at, upto)
    if head < 0:
        raise Bad("header without end")
    try:
        fields = dict((k.strip().lower(), v.strip()) for k, v in (x.split(":", 1) for x in data[at:head].decode().split("\r\n")[1:]))
        n, kind = int(fields["content-length"]), fields["warc-type"]
        ident = lambda x: int(x[len("<urn:page:"):-1]) if x and x != "<urn:page:>" else None
        page_id, refers = ident(fields["warc-record-id"]), ident(fields.get("warc-refers-to", ""))
        method, digest = fields["warc-payload-digest"].split(":")
    except (KeyError, ValueError, UnicodeDecodeError) as e:
        raise Bad("bad header") from e
    body = head + len(END)
    end = body + n + len(END)
    if n < 0 or end > upto or data[end - len(END):end] != END:
        raise Bad("wrong length")
    block = data[body:body + n]
    http = block.find(END)
    size = re.search(rb"(?i)\r\ncontent-length:\s*([0-9]+)", block[:http]) if http >= 0 else None
    if not size or method != "sha256":
        raise Bad("bad block")
    payload = block[http + len(END):]
    if kind == "response" and (len(payload) != int(size[1]) or hashlib.sha256(payload).hexdigest() != digest):
        raise Bad("payload digest differs")
    if kind == "revisit" and (payload or refers is None) or kind not in ("response", "revisit"):
        raise Bad("bad type")
    return {"page_id": page_id, "record_type": kind, "refers_to": refers, "url": fields.get("warc-target-uri"), "payload_bytes": int(size[1]),
            "payload_digest": hashlib.sha256(payload).hexdigest() if kind == "response" else digest, "payload": payload}, end


def one(data: bytes, at: int) -> tuple[dict, int]:
    """The record or gzip member of one record at ``at``; raises ``Bad``."""
    if data.startswith(MEMBER, at):
        z, parts, view, to = zlib.decompressobj(31), [], memoryview(data), at
        try:
            while not z.eof and to < len(data):  # in steps: what follows the member is copied each time
                parts.append(z.decompress(view[to:to + STEP]))
                to += STEP
        except zlib.error as e:
            raise Bad("damaged member") from e
        if not z.eof:
            raise Bad("cut member")
        raw = b"".join(parts)
        found, end = parse(raw, 0, len(raw))
        if end != len(raw):
            raise Bad("bytes after the record")
        return found, min(to, len(data)) - len(z.unused_data)
    return parse(data, at, len(data))


def salvage_bytes(data: bytes):
    """Yields (gap, at, end, reason, record or None) that cover ``data`` from start to end."""
    at = 0
    while at < len(data):
        try:
            found, end = one(data, at)
            yield False, at, end, None, found
            at = end
            continue
        except Bad as e:
            reason, to = str(e), len(data)
        for m in START.finditer(data, at + 1):
            try:
                one(data, m.start())
                to = m.start()
                break
            except Bad:
                continue
        yield True, at, to, reason, None
        at = to


def salvage(manifest: DataFrame, *, payloads: bool = False) -> DataFrame:
    """Records and quarantined gaps (``gap``, byte range ``at``..``end``, ``reason``) of every file
    of a manifest with a column ``path``.  A file is read whole, which its roll size bounds."""
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("gap", pa.bool_()), ("at", pa.int64()), ("end", pa.int64()), ("reason", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
                            ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = open_fs(path)
                with fs.open_input_file(at) as f:
                    data = f.read()
                rows = []
                for gap, start, end, reason, found in salvage_bytes(data):
                    row = {"path": path, "gap": gap, "at": start, "end": end, "reason": reason} | (found or {})
                    rows.append(row if payloads else row | {"payload": None})
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return manifest.select("path").repartition(tasks_for(manifest.sparkSession)).mapInArrow(run, FOUND)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every record read
    back from archives in the shared folder.

    An empty table writes no archive and gives an empty result; repeated rows are written each;
    columns other than the three named ones are not read."""
    found = salvage(write(pages, new_path(pages.sparkSession, "warc"), **options))
    return found.where("not gap").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
