"""WARC archives as a chunked record table: written and read as rows of record identifier and chunk number.

Writing has three steps. Payloads are read in chunks under a running SHA-1, which yields a digest row per page. Of each digest
(and length) the smallest page id is found by a partial aggregate and joined back. Then every page is cut into chunk
rows, which find the page's decision by id and digest, are sorted by record and chunk number, and are fed to the archive's
compressor one by one: a gzip member per record, an archive per partition. Reading streams an archive through the decompressor
and gives rows of record identifier, chunk number, bytes and the digest so far; the last chunk of a record has the whole
payload's. Beyond the cell of the input table, no step holds more of a record than a few chunks.

Archives lie in a folder that driver and executors share. Every task attempt writes to a name of its own, and only the names that the
written table lists are archives; what failed attempts leave behind is deleted by ``tidy``. Nothing is renamed.

Defined cases: a null payload is empty. Payloads of fewer than ``least`` bytes are always responses. A null page id sorts last; it is written as
an empty id and read back as null. Rows with the digest's smallest page id are responses, also if several rows have that id. An empty table
gives no archive. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblattice.sources.scratch import cut

CHUNK = 1 << 16
#: The version line, the profile of a revisit and the header of the payload's length.
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORD_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI, for Python workers."""
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def running(payload: bytes, size: int = CHUNK) -> Iterator[tuple[int, memoryview, "hashlib._Hash"]]:
    """Chunks of a payload by number, each with the digest up to its end; an empty payload is one empty chunk."""
    digest, view = hashlib.sha1(), memoryview(payload)
    for k in range(max(1, -(-len(view) // size))):
        part = view[k * size : (k + 1) * size]
        digest.update(part)
        yield k, part, digest


def base32(digest: "hashlib._Hash") -> str:
    return base64.b32encode(digest.digest()).decode()


def payload_digests(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """page_id, payload_bytes and payload_digest of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for value in batch.column(1):
                payload = value.as_buffer() or b""
                for _, _, digest in running(payload):
                    pass
                sizes.append(len(payload))
                digests.append(base32(digest))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests)], names=["page_id", "payload_bytes", "payload_digest"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(payload_col).cast("binary").alias("payload"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, payload_bytes long, payload_digest string")


def decisions(digests: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest and refers_to (null for responses), once for each id and payload."""
    # written, so that the join can split the rows of a payload that very many pages have
    first = cut(digests.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first")), "first")
    rows = digests.distinct().join(first, ["payload_digest", "payload_bytes"])
    refers = F.when((F.col("payload_bytes") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.select("page_id", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def record_id(page_id: object) -> str:
    return f"<{uuid.uuid5(RECORD_SPACE, f'page:{page_id}').urn}>"


def _head(page_id: object, url: str | None, size: int, digest: str, refers_to: object) -> bytes:
    """The headers of one record, up to its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    fields = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page_id), "WARC-Date": DATE,
        "WARC-Target-URI": "".join(c for c in url or "" if c not in "\r\n"), "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-ID": "" if page_id is None else page_id,
    }
    if revisit:
        fields |= {"WARC-Profile": REVISIT, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-ID": refers_to}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(http) + (0 if revisit else size)}
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + http


def payload_chunks(pages: DataFrame, size: int = CHUNK, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Chunk rows of every page: page_id, url (with the first chunk), payload_bytes, payload_digest, row_no (of the page), chunk_no, chunk and last."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "row_no", "chunk_no", "chunk", "last"]
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # tells rows apart that are equal in all they have; all chunks of a page come from one attempt of one task
        row_no = TaskContext.get().partitionId() << 40
        for batch in batches:
            held, waiting = [], 0
            ids = batch.column(0)
            kinds = [ids.type, pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
            full = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)  # noqa: E731, B023
            for k in range(batch.num_rows):
                payload = batch.column(2)[k].as_buffer() or b""
                digest = hashlib.sha1()
                for _, _, digest in running(payload, size):
                    pass
                whole, row_no = base32(digest), row_no + 1
                page_id, url = ids[k].as_py(), batch.column(1)[k].as_py()
                view, chunks = memoryview(payload), max(1, -(-len(payload) // size))
                for c in range(chunks):
                    part = bytes(view[c * size : (c + 1) * size])
                    held.append((page_id, url if c == 0 else None, len(payload), whole, row_no, c, part, c + 1 == chunks))
                    waiting += len(part)
                    if waiting >= 16 * CHUNK or len(held) >= 1024:
                        yield full()
                        held, waiting = [], 0
            if held:
                yield full()

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, payload_bytes long, payload_digest string, row_no long, chunk_no long, chunk binary, last boolean")


def write(pages: DataFrame, folder: str, least: int = 0, level: int = 1, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the archives of ``pages`` to ``folder``; the names of the files and their numbers of records."""
    chosen = decisions(cut(payload_digests(pages, id_col, payload_col), "digests"), least)
    chosen = chosen.select(F.col("page_id").alias("id"), F.col("payload_digest").alias("of"), "refers_to")
    chunks = payload_chunks(pages, CHUNK, id_col, url_col, payload_col)
    # one decision for each id and digest, so that no row is joined with another page's
    joined = chunks.join(chosen, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("payload_digest") == F.col("of"))).where("chunk_no = 0 OR refers_to IS NULL")
    joined = joined.select("page_id", "payload_digest", "row_no", "chunk_no", "url", "payload_bytes", "refers_to", "chunk", "last").sortWithinPartitions("page_id", "payload_digest", "row_no", "chunk_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = _at(folder)
        name = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out = packer = None
        count = 0
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, digest, _, chunk_no, url, size, refers = (batch.column(c)[k].as_py() for c in range(7))
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                if chunk_no == 0:
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(packer.compress(_head(page_id, url, size, digest, refers)))
                    count += 1
                if refers is None:
                    out.write(packer.compress(memoryview(batch.column(7)[k].as_buffer())))
                if refers is not None or batch.column(8)[k].as_py():
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["file", "records"])

    return joined.mapInArrow(run, "file string, records long")


def tidy(written: DataFrame, folder: str) -> int:
    """Delete the files in ``folder`` that ``written`` does not list, which failed attempts of tasks have left; their number. No task may be writing."""
    spark = written.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    names = {r["file"] for r in written.select("file").collect()}  # one for each partition
    left = [x.getPath() for x in fs.listStatus(path) if x.getPath().getName() not in names]
    return sum(bool(fs.delete(x, False)) for x in left)


class _Stream:
    """Decompressed bytes of a run of gzip members, read by line or by number."""

    def __init__(self, source, step: int = CHUNK):
        self.source, self.step, self.packed, self.plain, self.unpacker = source, step, b"", b"", zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            if self.unpacker.eof:
                self.packed, self.unpacker = self.unpacker.unused_data, zlib.decompressobj(31)
            if not self.packed:
                self.packed = self.source.read(self.step)
                if not self.packed:
                    return False
            got = self.unpacker.decompress(self.packed, self.step)
            self.packed = self.unpacker.unconsumed_tail
            if self.unpacker.eof and not self.unpacker.unused_data:
                self.unpacker = zlib.decompressobj(31)
            if got:
                self.plain += got
                return True

    def line(self) -> bytes | None:
        while (end := self.plain.find(b"\r\n")) < 0:
            if not self._more():
                return None
        line, self.plain = self.plain[:end], self.plain[end + 2 :]
        return line

    def take(self, count: int) -> Iterator[bytes]:
        while count:
            if not self.plain and not self._more():
                raise ValueError("an archive ends within a record")
            part, self.plain = self.plain[:count], self.plain[count:]
            count -= len(part)
            yield part

    def headers(self) -> dict[str, str] | None:
        found = {}
        while line := self.line():
            key, _, value = line.decode().partition(":")
            found[key.strip().lower()] = value.strip()
        return found


def records(source) -> Iterator[tuple[dict[str, str], dict[str, str], Iterator[bytes]]]:
    """WARC headers, HTTP headers and payload pieces of each record of an open archive; the pieces must be used up first."""
    stream = _Stream(source)
    while (line := stream.line()) is not None:
        if line != VERSION:
            if line:
                raise ValueError("not a WARC record")
            continue
        warc = stream.headers()
        before = int(warc["content-length"])
        status = stream.line()
        http, used = {}, len(status) + 2
        while line := stream.line():
            used += len(line) + 2
            key, _, value = line.decode().partition(":")
            http[key.strip().lower()] = value.strip()
        yield warc, http, stream.take(before - used - 2)


def read_chunks(spark: SparkSession, written: DataFrame, folder: str, size: int = CHUNK) -> DataFrame:
    """The record table: record_id, page_id, record_type, refers_to, payload_bytes, payload_digest, chunk_no, chunk, digest (so far) and last.

    ``written`` names the files. A revisit is one empty chunk.
    """
    names = ["record_id", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk_no", "chunk", "digest", "last"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.bool_()]

    def rows(source) -> Iterator[tuple]:
        for warc, http, pieces in records(source):
            digest, held, k = hashlib.sha1(), b"", 0
            number = lambda key: int(warc[key]) if warc.get(key) else None
            fixed = (warc["warc-record-id"], number("x-page-id"), warc["warc-type"], number("x-refers-to-page-id"), int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:"))
            for piece in pieces:
                held += piece
                while len(held) > size:
                    part, held = held[:size], held[size:]
                    digest.update(part)
                    yield (*fixed, k, part, base32(digest), False)
                    k += 1
            digest.update(held)
            yield (*fixed, k, held, base32(digest), True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _at(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None) as source:
                    waiting, held = [], 0
                    for row in rows(source):
                        waiting.append(row)
                        held += len(row[7])
                        if held >= 16 * size or len(waiting) >= 1024:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting, strict=True), kinds, strict=True)], names=names)
                            waiting, held = [], 0
                    if waiting:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting, strict=True), kinds, strict=True)], names=names)

    schema = "record_id string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk_no long, chunk binary, digest string, last boolean"
    return written.select("file").repartition(max(1, written.count()), "file").mapInArrow(run, schema)


def index(chunks: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type and refers_to; fails on a response whose digest is not that of its bytes."""
    ends = chunks.where("last")
    wrong = (F.col("record_type") == "response") & (F.col("digest") != F.col("payload_digest"))
    digest = F.when(wrong, F.raise_error(F.concat(F.lit("wrong digest in record "), F.col("record_id"))).cast("string")).otherwise(F.col("payload_digest"))
    return ends.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex || '0', (1 + i * 5 // 4)::INT, 2))::INT) >> (3 - i * 5 % 4)::INT) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
