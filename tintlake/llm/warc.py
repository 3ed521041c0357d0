"""Operator 4: WARC archives, one gzip member a record, and a reader that splits them.

Writing: equal payloads of some size are stored once. The (page id, digest) of the copies that become revisits are
found by an aggregation over digests; pages that surely aren't among them, by a bitmap of bounded size, are written
where they are read, and only the others are shuffled. Each task writes files of its own
through ``pyarrow.fs`` under names that no other attempt has, and its rows in the manifest, which Spark commits with
the task, say which files count; so a task that is lost or run twice leaves no record twice.

Reading: a task scans a byte range of a file for the gzip magic, takes a candidate only if it decodes to a WARC header,
and owns the members that start inside its range, however far they reach beyond. A member may hold any number of
records; it is decoded piece by piece, so one record at a time is in memory. A member that begins as a record and then
doesn't decode, has a wrong check sum or is cut off is told of, in a row or by an error, never passed over. Files that
aren't compressed are cut where their records' lengths say that one ends.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_folder, scratch, sieved, small_batches

MAGIC = b"\x1f\x8b\x08"
#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_REVISIT = 1000
CHUNK = 1 << 20
#: Parts of each payload's pages in the join that finds copies.
SALTS = 8
MANIFEST = "file string, bytes long, records long"
#: offset and place: of the member, and of the record in it. error: why what stands there is no whole record; then all
#: else is null.
RECORD = "file string, offset long, place int, error string, record_type string, record_id string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_FIELDS = ("file", "offset", "place", "error", "record_type", "record_id", "page_id", "url", "payload_bytes", "payload_digest", "refers_to", "payload")
_KINDS = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())


def _open(uri: str):
    """The file system and the path of a URI, on whatever machine this runs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit without the payload if it refers to another page. ``digest``: hex SHA-1."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}" if m[0] != "%" else "%", url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, file_bytes: int = 1 << 29) -> DataFrame:
    """Writes (page_id, url, html) as archives under ``folder``; the manifest of files that count."""
    p = small_batches(pages).select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    large = p.where(F.octet_length("payload") >= LEAST_REVISIT).select("page_id", "digest")
    shared = large.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("kept").isNotNull())
    # one payload may be that of a third of all pages, so each is dealt out to several tasks
    shared = shared.select("digest", "kept", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    large = large.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    later = large.join(shared, ["digest", "salt"]).where(F.col("page_id").isNull() | (F.col("page_id") < F.col("kept")))
    with scratch() as keep:
        later = keep(cut(later.select(F.struct("page_id", "digest").alias("later"), "kept").distinct(), "warc-later"))
    key = F.xxhash64("page_id", "digest")
    x = sieved(p, key, later.select(F.xxhash64("later.page_id", "later.digest").alias("k")), "maybe")
    some = x.where("maybe").join(later, F.struct("page_id", "digest") == F.col("later"), "left").select("page_id", "url", "payload", "digest", "kept")
    rows = x.where("NOT maybe").select("page_id", "url", "payload", "digest", F.lit(None).cast("long").alias("kept")).unionByName(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, path = _open(folder)
        files.create_dir(path, recursive=True)
        name, out, size, n, done = "", None, 0, 0, []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", size, n))
                out = None

        for batch in batches:
            for page_id, url, payload, digest, kept in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if out is None:
                    name, size, n = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                member = gzip.compress(record(page_id, url, payload, digest, kept), mtime=0)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "bytes", "records"])

    return cut(rows.mapInArrow(run, MANIFEST), "warc-manifest")


#: Records of a member or file: place, the record's bytes, and what is wrong with it.
Found = tuple[int, bytes, str | None]


class _Records:
    """Cuts a stream of decoded bytes into records by their lengths."""

    def __init__(self):
        self.held, self.need, self.place = bytearray(), None, 0

    def _size(self) -> int | None:
        """The size of the first record with the line ends that follow it, once its header is here; -1 if it tells none,
        or is no record's."""
        end = self.held.find(b"\r\n\r\n")
        if end < 0:
            return None
        length = _headers(bytes(self.held[:end])).get("content-length", "") if self.held.startswith(b"WARC/1.") else ""
        return end + 4 + int(length) + 4 if length.isdigit() else -1

    def add(self, data: bytes) -> Iterator[Found]:
        self.held += data
        while True:
            if self.need is None:
                self.need = self._size()
            if self.need is None or self.need < 0 or len(self.held) < self.need:
                return
            yield self._take(self.need, None)

    def _take(self, size: int, error: str | None) -> Found:
        out = (self.place, bytes(self.held[:size]), error)
        del self.held[:size]
        self.need, self.place = None, self.place + 1
        return out

    def end(self, error: str | None = None) -> Iterator[Found]:
        """What is left at the end: the last record, which may have no length or no line ends after it."""
        left = len(self.held)
        if error is None and not bytes(self.held).strip():
            return
        if error is None and self.need is not None and self.need >= 0 and left < self.need - 4:
            error = f"the record is cut off: {left} of {self.need - 4} bytes"
        if error is None and (self.need is None or not self.held.startswith(b"WARC/1.")):
            error = "what stands here is no record"
        yield self._take(left, error)


def member(stream, at: int) -> Iterator[Found | int]:
    """The records of the gzip member at ``at``, then its length; only 0 if it doesn't begin as a record."""
    d, records, read, begun = zlib.decompressobj(31), _Records(), 0, False
    stream.seek(at)
    try:
        while not d.eof:
            chunk = stream.read(CHUNK if begun else 4096)
            if not chunk:
                break
            read += len(chunk)
            if not begun:
                head = d.decompress(chunk, 64)  # a little first: an error in what follows must not hide how it began
                if not head.startswith(b"WARC/1."):
                    yield 0
                    return
                begun = True
                yield from records.add(head)
                chunk = d.unconsumed_tail
            while chunk and not d.eof:
                yield from records.add(d.decompress(chunk, 4 * CHUNK))
                chunk = d.unconsumed_tail
    except zlib.error as e:
        if begun:
            yield from records.end(f"the member doesn't decode: {e}")
        yield 1 if begun else 0  # how long it is isn't known; what follows is searched
        return
    if begun:
        yield from records.end(None if d.eof else "the member is cut off")
    yield read - len(d.unused_data) if begun else 0


def members(stream, start: int, end: int) -> Iterator[tuple[int, int, bytes, str | None]]:
    """(offset, place, record, error) of the members that start in [start, end)."""
    at = start
    while at < end:
        stream.seek(at)
        window = stream.read(min(CHUNK, end + len(MAGIC) - 1 - at))
        hit = window.find(MAGIC)
        if hit < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            if len(window) < len(MAGIC):
                return
            continue
        at += hit
        length = 0
        for found in member(stream, at):
            if isinstance(found, int):
                length = found
            else:
                yield at, *found
        at += max(1, length)


def plain_records(stream, start: int, end: int) -> Iterator[tuple[int, int, bytes, str | None]]:
    """The same of a range of a file without compression that begins with a record; place is 0."""
    stream.seek(start)
    records, at = _Records(), start
    while at < end:
        chunk = stream.read(min(CHUNK, end - at))
        if not chunk:
            break
        for _, data, error in records.add(chunk):
            yield start, 0, data, error
            start += len(data)
        at += len(chunk)
    for _, data, error in records.end():
        yield start, 0, data, error


def plain_ranges(stream, size: int, split_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``split_bytes`` of whole records, found by reading headers alone and going on by their lengths."""
    start = at = 0
    while at < size:
        stream.seek(at)
        head, more = b"", b"-"
        while b"\r\n\r\n" not in head and more:
            more = stream.read(4096)
            head += more
        found = head.find(b"\r\n\r\n")
        length = _headers(head[: max(found, 0)]).get("content-length", "")
        if not head.startswith(b"WARC/1.") or not length.isdigit():
            break  # the rest is one range, whose reader tells what is wrong
        at += found + 4 + int(length) + 4
        if at - start >= split_bytes:
            yield start, min(at, size)
            start = at
    if start < size:
        yield start, size


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _whole(body: bytes) -> bytes:
    """A body that was sent in chunks, put together; what isn't in chunks is left."""
    out, at = [], 0
    while at < len(body):
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip()
        if end < 0 or not re.fullmatch(rb"[0-9a-fA-F]+", size):
            return body
        n = int(size, 16)
        if n == 0:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + n + 4
    return b"".join(out)


def _sha1(value: str | None) -> str | None:
    """Hex of a digest header in base 32 or hex; null for other digests."""
    kind, _, code = (value or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if re.fullmatch("[0-9a-fA-F]{40}", code):
        return code.lower()
    return base64.b32decode(code.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", code) else None


def parse(data: bytes) -> dict:
    """The fields of a record. The payload of an HTTP response or revisit is the body, of other records the block.

    Headers that a record doesn't have are null; a response without a digest gets that of its payload. A payload that
    differs from a SHA-1 in its header, without chunks or an encoding in between, is an error.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _headers(head)
    kind = warc.get("warc-type")
    length = int(warc["content-length"]) if warc.get("content-length", "").isdigit() else len(rest)
    block, http = rest[:length], {}
    if kind in ("response", "revisit") and block.startswith(b"HTTP/"):
        top, _, block = block.partition(b"\r\n\r\n")
        http = _headers(top)
        if http.get("transfer-encoding", "").lower() == "chunked":
            block = _whole(block)
    digest = _sha1(warc.get("warc-payload-digest"))
    if kind == "revisit":
        size = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    else:
        size = len(block)
        own = hashlib.sha1(block).hexdigest()
        plain = not {"transfer-encoding", "content-encoding"} & http.keys() and http.get("content-length", str(size)) == str(size)
        if kind == "response" and digest not in (None, own) and plain:
            raise ValueError(f"the payload of {warc.get('warc-record-id')} is not what its headers say")
        digest = digest or (own if kind == "response" else None)
    return {
        "record_type": kind, "record_id": warc.get("warc-record-id"), "page_id": _page(warc.get("warc-record-id")), "url": warc.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest,
        "refers_to": _page(warc.get("warc-refers-to")), "payload": None if kind == "revisit" else block,
    }


def _ranges(split_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, path = _open(file)
                with files.open_input_file(path) as stream:
                    found = list(plain_ranges(stream, size, split_bytes))
                columns = [pa.array([file] * len(found), pa.string()), pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["file", "start", "end"])

    return run


def read(manifest: DataFrame, split_bytes: int = 8 << 20, payloads: bool = True, damaged: str = "raise") -> DataFrame:
    """The records of the manifest's files, RECORD; without payloads that column is null.

    Files are gzip members, or plain records if their names end in .warc. What begins as a record but isn't whole, by its
    length, its check sum or its digest, raises, or with ``damaged="keep"`` is a row with an error.
    """
    if damaged not in ("raise", "keep"):
        raise ValueError(f"damaged is raise or keep, not {damaged}")
    plain = F.lower("file").endswith(".warc")
    total = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes)).alias("n")).first().n or 1
    splits = manifest.where(~plain & (F.col("bytes") > 0)).select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    splits = splits.select("file", "start", F.least(F.col("start") + split_bytes, "bytes").alias("end"))
    whole = manifest.where(plain & (F.col("bytes") > 0)).select("file", "bytes")
    if not whole.isEmpty():
        splits = splits.unionAll(whole.mapInArrow(_ranges(split_bytes), "file string, start long, end long"))

    def row(file: str, offset: int, place: int, data: bytes, error: str | None) -> dict:
        out = {"file": file, "offset": offset, "place": place, "error": error}
        if error is None:
            try:
                return dict.fromkeys(_FIELDS) | out | parse(data) | ({} if payloads else {"payload": None})
            except ValueError as e:
                error = out["error"] = str(e)
        if damaged == "raise":
            raise ValueError(f"{file} at {offset}, record {place}: {error}")
        return dict.fromkeys(_FIELDS) | out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, end in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                files, path = _open(file)
                rows, size = [], 0
                with files.open_input_file(path) as stream:
                    for found in (plain_records if file.lower().endswith(".warc") else members)(stream, start, end):
                        rows.append(row(file, *found))
                        size += len(found[2])
                        if size > 16 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                yield _batch(rows)

    # a task for each few ranges: rows are tiny, so Spark must not put them together by their size
    return splits.repartition(int(min(total, 50_000)), "file", "start").mapInArrow(run, RECORD)


def read_folder(spark: SparkSession, folder: str, split_bytes: int = 8 << 20, payloads: bool = True, damaged: str = "keep") -> DataFrame:
    """The records of all archives below a folder, *.warc.gz and *.warc, whoever wrote them, RECORD; splits come from the
    files' sizes. What isn't whole is a row with an error, or raises with ``damaged="raise"``.

    page_id and refers_to are null for records that aren't of our writer; record_id is as it stands.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc.gz,warc}").option("recursiveFileLookup", True).load(folder)
    uri = F.regexp_replace("path", "^file:/+", "file:///")
    return read(found.select(uri.alias("file"), F.col("length").alias("bytes")), split_bytes, payloads, damaged)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(_FIELDS, _KINDS)], list(_FIELDS))


def round_trip(pages: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """Archives ``pages`` in the shared folder and reads them back: per page page_id, payload_bytes, payload_digest,
    record_type, refers_to.

    A null html is an empty payload. A null url has no target header, a null page id an id without a number; such a
    page revisits the largest page id of its payload, if there is one. Rows that repeat a page id and its payload are
    alike: all response or all revisit. An empty table writes and gives nothing. Other columns aren't read. An archive
    that doesn't read back whole raises.
    """
    spark: SparkSession = pages.sparkSession
    found = read(write(pages, new_folder(spark, "warc")), split_bytes, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
d AS (SELECT page_id, payload_bytes, sha1(h) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS kept FROM d WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN d.page_id < k.kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.page_id < k.kept THEN k.kept END AS refers_to
FROM d LEFT JOIN k ON d.payload_digest = k.payload_digest AND d.payload_bytes >= {LEAST_REVISIT}
"""
