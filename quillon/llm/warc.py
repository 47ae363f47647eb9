"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

``write`` makes one gzip stream over all records of a file. ``normalise`` inflates such a file once, as a stream, rewrites
every record as a gzip member of its own and writes a sidecar index (offset, length and headers' essentials, one
tab-separated line for each record). ``read`` opens members by the sidecar's offsets.

Of records with equal payloads (SHA-256, SHA-1 and length) of at least REVISIT_BYTES bytes the one of least page_id is a response;
the others are revisits without a payload that refer to it.

Scale: one shuffle by payload digest carries the payloads (a join whose hot digests Spark can split; the least id of
each digest is summed before the shuffle). Tasks stream: a record at a time, files of about FILE_BYTES. Files lie in
the shared folder under names of their own; only those that a finished task reported are read, so a lost executor's
half-written files don't matter. Any store that pyarrow.fs opens will do.

Edge cases: a null html is an empty payload; a null url is an empty target; a null page_id is written as an empty id and
takes part as a revisit only; repeated page_ids of equal payloads are responses all; line breaks in urls are escaped.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import new_path, stored

REVISIT_BYTES = 0
FILE_BYTES = 64 << 20
LEVEL = 4
FILES = "path string, records long"  # the path is a whole URI
CHUNK = 1 << 20


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder's full URI in the shared folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(new_path(spark, name))
    store = path.getFileSystem(conf)
    store.mkdirs(path)
    uri = store.makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A WARC/1.1 record: a response, or a revisit of the page first."""
    revisit = first is not None
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    name = "" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if revisit else payload
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(": ")
        out[k.lower()] = v
    return out


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _open(folder)
        out = pack = None
        held = count = 0
        done = []

        def close():
            nonlocal out
            if out is not None:
                out.write(pack.flush())
                out.close()
                done.append((f"{folder}/{path.rpartition('/')[2]}", count))
                out = None

        for b in batches:
            for page_id, url, html, sha, first in zip(*(b.column(c) for c in ("page_id", "url", "html", "sha", "first")), strict=True):
                if out is None:
                    path = f"{top}/{uuid.uuid4().hex}.warc.gz"
                    out, pack, held, count = fs.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                payload = (html.as_py() or "").encode()
                raw = record(page_id.as_py(), url.as_py(), payload, base64.b32encode(bytes.fromhex(sha.as_py())).decode(), first.as_py())
                out.write(pack.compress(raw))
                held += len(raw)
                count += 1
                if held >= FILE_BYTES:
                    close()
        close()
        yield pa.record_batch([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return run


def records(stream) -> Iterator[tuple[bytes, bytes, bytes]]:
    """(whole record, head, body) of each record of a gzip stream of any number of members, inflated once in chunks."""
    inflate, left = zlib.decompressobj(31), bytearray()
    ended = False

    def more() -> bool:
        nonlocal inflate, ended
        while not ended:
            raw = inflate.unused_data if inflate.eof else b""
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            raw = raw or stream.read(CHUNK)
            if not raw:
                ended = True
                break
            got = inflate.decompress(raw)
            if got:
                left.extend(got)
                return True
        return False

    at = 0
    while True:
        while (end := left.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if len(left) > at and bytes(left[at:]).strip():
                    raise ValueError("the last record is cut off")
                return
        head = bytes(left[at:end])
        need = end + 4 + int(headers(head)["content-length"]) + 4
        while len(left) < need:
            if not more():
                raise ValueError("the last record is cut off")
        yield bytes(left[at:need]), head, bytes(left[end + 4 : need - 4])
        at = need
        if at > CHUNK:
            del left[:at]
            at = 0


def _normaliser(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, top = _open(folder)
        for b in batches:
            for uri in b.column("path").to_pylist():
                fs, source = _open(uri)
                path, n, at = f"{top}/{uuid.uuid4().hex}.warc.gz", 0, 0
                with fs.open_input_stream(source, compression=None) as src, to.open_output_stream(path, compression=None) as out, to.open_output_stream(path + ".idx", compression=None) as index:
                    for raw, head, _ in records(src):
                        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = pack.compress(raw) + pack.flush()
                        out.write(member)
                        h = headers(head)
                        index.write(f"{at}\t{len(member)}\t{h['warc-type']}\t{h['warc-record-id']}\t{h['warc-target-uri']}\n".encode())
                        at += len(member)
                        n += 1
                yield pa.record_batch([pa.array([f"{folder}/{path.rpartition('/')[2]}"]), pa.array([n], pa.int64())], names=["path", "records"])

    return run


def _page(text: str) -> int | None:
    return int(text[10:-1]) if text[10:-1] else None


def _reader():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def batch(rows: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=names)

        for b in batches:
            for uri in b.column("path").to_pylist():
                fs, path = _open(uri)
                with fs.open_input_stream(path + ".idx", compression=None) as f:
                    index = f.read().decode().split("\n")[:-1]
                rows, held = [], 0
                with fs.open_input_file(path) as f:
                    for line in index:
                        at, size = map(int, line.split("\t", 2)[:2])
                        f.seek(at)
                        raw = zlib.decompress(f.read(size), 31)
                        head, _, body = raw.partition(b"\r\n\r\n")
                        h, body = headers(head), body[:-4]
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        revisit = h["warc-type"] == "revisit"
                        if not revisit and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                            raise ValueError(f"{path} at {at}: the payload doesn't have its digest")
                        rows.append((_page(h["warc-record-id"]), h["warc-target-uri"], int(h["x-payload-length"]), digest, h["warc-type"], _page(h["warc-refers-to"]) if revisit else None, None if revisit else body))
                        held += len(body)
                        if held > 4 * CHUNK or len(rows) > 5000:
                            yield batch(rows)
                            rows, held = [], 0
                yield batch(rows)

    return run


def write(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Monolithic archives of pages (page_id, url, html); returns their paths (FILES)."""
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    raw = F.col("html").cast("binary")
    df = df.withColumns({"sha": F.sha1(raw), "wide": F.unhex(F.sha2(raw, 256)), "size": F.octet_length("html")})
    keys = ["wide", "sha", "size"]
    leads = df.groupBy(*keys).agg(F.min("page_id").alias("lead"))
    told = df.join(leads, keys).withColumn("first", F.when((F.col("size") >= least) & F.col("lead").isNotNull() & ~F.col("lead").eqNullSafe(F.col("page_id")), F.col("lead")))
    folder = _folder(pages.sparkSession, "warc")
    return stored(told.select("page_id", "url", "html", "sha", "first").mapInArrow(_writer(folder), FILES), "warc-files")


def normalise(files: DataFrame, spark: SparkSession) -> DataFrame:
    """Archives of a member for each record, with sidecars; files are spread over tasks by path."""
    folder = _folder(spark, "warc-members")
    n = max(1, spark.sparkContext.defaultParallelism)
    return stored(files.repartition(n, "path").mapInArrow(_normaliser(folder), FILES), "warc-files")


def read(files: DataFrame, spark: SparkSession) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of each record (null payload: a revisit)."""
    n = max(1, spark.sparkContext.defaultParallelism)
    return files.repartition(n, "path").mapInArrow(_reader(), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
