"""WARC archives (operator 2): a writer with revisit records, and a splittable reader.

Writing: a record a page, each a gzip member of its own. Of the records with equal payloads of at least ``LEAST`` bytes
the one with the smallest page_id is a response, the others are revisit records without body that name it; the HTTP
header, with the full payload's length, stays. A task writes files of its own name; only those of tasks that ended
well are in the manifest, so repeated attempts do no harm.

Reading: a task scans a byte range for gzip magic, takes a candidate as a member only if its head inflates to a WARC
header with a type and a length, and owns the members that begin inside its range, following the last one past its end.
A member may hold several records. (Payloads that themselves hold gzipped archives, stored without compression, could
pass for members where a range begins within them.)

Defined results: a null html is an empty payload, null urls become ``urn:page:<id>``. Rows with equal page_id and
payload are all responses if theirs is the smallest page_id; rows without page_id are revisits of a payload that has
one, else responses. Repeated rows are records of their own. An empty table gives an empty archive. Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import shared_folder, slices, written

#: Smallest payload that is revisited; bytes of a file before the next begins; bytes of a range that a task reads.
LEAST, FILE_BYTES, SPLIT_BYTES = 0, 256 << 20, 4 << 20
#: Repeated payloads (28 bytes each) that may be broadcast; parts of the rows of one payload, where they may not; ranges
#: that a task reads in the mean.
FIRSTS, SALTS, RANGES = 500_000, 16, 2
DATE = "2024-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _id(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def record(page: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One WARC record: a revisit of page ``first``, or a response where that is None."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else _name(page)[1:-1]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(first)}"]
        payload = b""
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def write(pages: DataFrame, folder: str | None = None, least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write an archive of ``pages`` (page_id, url, html) to a new folder under ``folder`` (by default the shared one),
    which all executors must reach; returns the manifest: path, length, records."""
    folder = f"{folder or shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    pages = pages.withColumn("key", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    # only payloads that more than one row has; where these are too many to be broadcast, the rows of each are dealt over
    # SALTS tasks, so that pages of one common payload don't meet
    firsts = pages.where(F.octet_length("html") >= least).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = written(firsts.where("n > 1").select("key", "first"), "firsts")
    if firsts.limit(FIRSTS + 1).count() <= FIRSTS:
        pages = pages.join(F.broadcast(firsts), "key", "left")
    else:
        firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pages = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(firsts, ["key", "salt"], "left")
    first = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task, files, out, length, count = TaskContext.get(), [], None, 0, 0
        base = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        for batch in slices(batches, "html"):
            for page, url, html, since in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first"))):
                if out is None:
                    path, length, count = f"{root}/{base}-{len(files):03d}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                squeeze = zlib.compressobj(5, zlib.DEFLATED, 31)
                member = squeeze.compress(record(page, url, html.encode("utf-8", "surrogatepass"), since)) + squeeze.flush()
                out.write(member)
                length, count = length + len(member), count + 1
                if length >= file_bytes:
                    out.close()
                    files.append((f"{folder}/{path.rpartition('/')[2]}", length, count))
                    out = None
        if out is not None:
            out.close()
            files.append((f"{folder}/{path.rpartition('/')[2]}", length, count))
        columns = zip(*files) if files else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["path", "length", "records"])

    pages = pages.select("page_id", "url", "html", first.alias("first"))
    return written(pages.mapInArrow(run, "path string, length long, records long"), "manifest")


def listed(spark, folder: str) -> DataFrame:
    """path and length of the archives under a folder, for ``read``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz")
    return files.load(folder).select("path", "length")


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:])
    return {a.strip().lower(): b.strip() for a, _, b in pairs}


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in an inflated member."""
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head = _headers(data[at:end])
        size = int(head.get("content-length", 0))
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size
        while data[at : at + 2] == b"\r\n":
            at += 2


def _is_member(data: bytes) -> bool:
    """Whether the bytes at the magic inflate to a WARC header."""
    try:
        head = zlib.decompressobj(31).decompress(data, 4096)
    except zlib.error:
        return False
    return head.startswith(b"WARC/") and b"WARC-Type:" in head and (b"Content-Length:" in head or len(head) == 4096)


def members(file: pa.NativeFile, size: int, start: int, end: int) -> Iterator[bytes]:
    """Inflated members of the file that begin in [start, end)."""
    data = file.read_at(min(end + 2, size) - start, start)  # magic may lie across the end
    at = 0
    while 0 <= (at := data.find(MAGIC, at)) < end - start:
        head = data[at : at + 65536]
        if len(head) < 65536:
            head = file.read_at(min(65536, size - start - at), start + at)
        if not _is_member(head):
            at += 1
            continue
        inflate, parts, pos = zlib.decompressobj(31), [], start + at
        chunk = head
        try:
            while chunk and not inflate.eof:
                parts.append(inflate.decompress(chunk))
                pos += len(chunk)
                chunk = b"" if inflate.eof else file.read_at(min(1 << 20, size - pos), pos) if pos < size else b""
        except zlib.error:
            at += 1
            continue
        if not inflate.eof:  # a file that was cut off
            return
        yield b"".join(parts)
        at = pos - len(inflate.unused_data) - start
        if at >= end - start:
            return


_READ = [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]


def _row(head: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind = head.get("warc-type")
    http, gap, body = block.partition(b"\r\n\r\n")
    if head.get("content-type", "").startswith("application/http") and gap:
        length = int(_headers(http).get("content-length", len(body))) if kind == "revisit" else len(body)
    else:
        body, length = block, len(block)
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") if kind == "revisit" else digest_of(body)
    return head.get("warc-record-id"), kind, head.get("warc-target-uri"), head.get("warc-refers-to"), digest, length, body if payloads and kind != "revisit" else None


def read(files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """A row for each record of ``files`` (path, length): record_id, record_type, target_uri, refers_to,
    payload_digest (of responses it is computed anew), payload_bytes (of the full payload) and payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), _READ)], names=[n for n, _ in _READ])

        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "start"))):
                store, own = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///"))
                with store.open_input_file(own) as file:
                    rows, held = [], 0
                    for data in members(file, size, start, min(start + split_bytes, size)):
                        for head, block in records(data):
                            rows.append(_row(head, block, payloads))
                            held += len(block) if payloads else 100
                        if held > 4_000_000:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    files = files.where("length > 0")
    # one number from the driver's side: how many ranges there are. A given number of partitions isn't merged by Spark.
    ranges = files.agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0] or 1
    files = files.select("path", "length", F.explode(F.expr(f"sequence(0L, length - 1, {split_bytes}L)")).alias("start"))
    return files.repartition(max(1, int(ranges) // RANGES), F.col("path"), F.col("start")).mapInArrow(
        run, "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
    )


def page_of(name: str):
    """The page_id in a column of record names."""
    found = F.regexp_extract(F.col(name), r"^<urn:page:(-?\d+)>$", 1)
    return F.when(found != "", found.cast("long"))
