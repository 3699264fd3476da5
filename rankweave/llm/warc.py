"""WARC archives from pages and back, through a chunked record table.

The JVM cuts a payload into rows ``(record, chunk number, bytes)``: chunk numbers are exploded first, then one piece is cut
for each, so beside the value that Spark's reader hands over there is never more than a piece. Rows reach the writer in batches
of a few MB; it streams them into gzip members while it carries the record's SHA-1 along, and the reader gives the same kind of
rows back, each with the digest of the payload so far. Of equal payloads of at least ``REVISIT_BYTES`` bytes, that of the largest page_id
is written as a response, the others as revisits that refer to it.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pages, shared_dir, small

REVISIT_BYTES = 1000
CHUNK = 1 << 16
#: Most bytes of chunk rows in a batch on its way to the writer.
BATCH_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
RECORDS = "page_id long, record_id string, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk int, data binary, last boolean"


def record_uri(page_id: int | None) -> str:
    """The same in every run; a revisit can name its response without having seen it."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}"


def record_chunks(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """page_id, url, refers_to, payload_bytes, payload_digest, chunk, n_chunks, data: the rows that the writer streams.

    Which record answers for a payload is decided on digests alone: sums per digest before any shuffle, no text moved.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = df.select("page_id", "url", body.alias("body")).withColumn("key", F.sha2("body", 256)).withColumn("n", F.octet_length("body").cast("long"))
    groups = rows.where(F.col("n") >= REVISIT_BYTES).groupBy("key").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("rows"))
    groups = small(materialize(groups.where("rows > 1 and first_id is not null").drop("rows").withColumnRenamed("key", "group_key"), "warc-groups"))
    joined = rows.join(groups, (F.col("key") == F.col("group_key")) & (F.col("n") >= REVISIT_BYTES), "left")
    refers = F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    n_chunks = F.when(F.col("refers_to").isNull(), F.greatest(F.ceil(F.col("n") / chunk), F.lit(1))).otherwise(1).cast("int")
    # the digest is taken below the explosion, so once for a payload
    whole = joined.withColumn("refers_to", refers).select(
        "page_id", "url", "refers_to", F.col("n").alias("payload_bytes"), F.sha1("body").alias("payload_digest"), n_chunks.alias("n_chunks"), "body"
    )
    numbered = whole.select("*", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"))
    piece = F.when(F.col("refers_to").isNull(), F.substring("body", F.col("chunk") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    return numbered.select("page_id", "url", "refers_to", "payload_bytes", "payload_digest", "chunk", piece.alias("data"), "n_chunks")


def _header(row: dict) -> bytes:
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"] or f"urn:page:{row['page_id']}")
    http = HTTP.format(row["payload_bytes"]).encode()
    fields = [
        ("WARC-Type", "response" if row["refers_to"] is None else "revisit"),
        ("WARC-Record-ID", f"<{record_uri(row['page_id'])}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
        ("X-Page-Id", "" if row["page_id"] is None else row["page_id"]),
        ("X-Payload-Length", row["payload_bytes"]),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if row["refers_to"] is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_uri(row['refers_to'])}>"), ("X-Refers-To-Page-Id", row["refers_to"])]
    fields.append(("Content-Length", len(http) + (row["payload_bytes"] if row["refers_to"] is None else 0)))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + http


def write_archives(df: DataFrame, folder: str, chunk: int = CHUNK, level: int = 6) -> DataFrame:
    """Archives below ``folder``, one for each task, and a table of them: archive, records, bytes. A lost or repeated
    attempt leaves a file that no row of the table names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = pafs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        at = TaskContext.get()
        name = f"part-{at.partitionId():06d}-{at.taskAttemptId()}.warc.gz"
        records = size = 0
        with where.open_output_stream(f"{base}/{name}", compression=None) as out:
            for b in batches:
                heads, data = b.drop_columns(["data"]), b.column("data")
                for i in range(b.num_rows):
                    row, part = heads.slice(i, 1).to_pylist()[0], data[i].as_buffer()
                    if row["chunk"] == 0:
                        gz, sha = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1()
                        out.write(gz.compress(_header(row)))
                    sha.update(part)
                    out.write(gz.compress(part))
                    size += len(part)
                    if row["chunk"] == row["n_chunks"] - 1:
                        if row["refers_to"] is None and sha.hexdigest() != row["payload_digest"]:
                            raise ValueError(f"page {row['page_id']}: its chunks do not make up its payload")
                        out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                        records += 1
        if records:
            yield pa.RecordBatch.from_pylist([{"archive": f"{folder.rstrip('/')}/{name}", "records": records, "bytes": size}], pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))
        else:
            where.delete_file(f"{base}/{name}")

    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key, None)
    conf.set(key, str(BATCH_BYTES))
    try:
        return materialize(record_chunks(df, chunk).mapInArrow(run, "archive string, records long, bytes long"), "warc-list")
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


class _Stream:
    """Lines and counted bytes of a file of gzip members, a piece at a time."""

    def __init__(self, file, piece: int = CHUNK):
        self.file, self.piece, self.buf, self.gz, self.raw = file, piece, bytearray(), zlib.decompressobj(31), b""

    def _more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.file.read(self.piece)
                if not self.raw:
                    return False
            if self.gz.eof:
                self.gz = zlib.decompressobj(31)
            got = self.gz.decompress(self.raw, self.piece)
            self.raw = self.gz.unused_data if self.gz.eof else self.gz.unconsumed_tail
            if got:
                self.buf += got
                return True

    def line(self) -> bytes | None:
        while (i := self.buf.find(b"\n")) < 0:
            if not self._more():
                return None
        out = bytes(self.buf[:i]).rstrip(b"\r")
        del self.buf[: i + 1]
        return out

    def some(self, most: int) -> bytes:
        if not self.buf and not self._more():
            raise EOFError("an archive ends within a record")
        out = bytes(self.buf[:most])
        del self.buf[: len(out)]
        return out

    def exactly(self, n: int) -> bytes:
        parts = []
        while n:
            parts.append(got := self.some(n))
            n -= len(got)
        return b"".join(parts)


def _fields(s: _Stream) -> dict[str, str]:
    out = {}
    while line := s.line():
        k, _, v = line.decode().partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def parse(s: _Stream, chunk: int = CHUNK, data: bool = True) -> Iterator[dict]:
    """Chunk rows of every record; ``payload_bytes`` and ``payload_digest`` are those of the payload up to this chunk,
    and of the whole payload in the last."""
    while (line := s.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        h = _fields(s)
        left = int(h["content-length"])
        revisit = h["warc-type"] == "revisit"
        while True:  # the HTTP header
            line = s.line()
            left -= len(line) + 2
            if not line:
                break
        number = lambda k: int(h[k]) if h.get(k) else None
        row = {"page_id": number("x-page-id"), "record_id": h["warc-record-id"].strip("<>"), "url": h["warc-target-uri"], "record_type": h["warc-type"], "refers_to": number("x-refers-to-page-id")}
        sha, total, k, told = hashlib.sha1(), 0, 0, h["warc-payload-digest"].removeprefix("sha1:")
        while True:
            part = s.exactly(min(chunk, left))
            left -= len(part)
            sha.update(part)
            total += len(part)
            if revisit:
                yield row | {"payload_bytes": number("x-payload-length"), "payload_digest": told, "chunk": 0, "data": b"" if data else None, "last": True}
                break
            if not left and (sha.hexdigest() != told or total != number("x-payload-length")):
                raise ValueError(f"{row['record_id']}: payload does not match its digest")
            yield row | {"payload_bytes": total, "payload_digest": sha.hexdigest(), "chunk": k, "data": part if data else None, "last": not left}
            if not left:
                break
            k += 1


def read_archives(archives: DataFrame, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunked record table of the archives, one task for each archive; without ``data`` the bytes stay behind."""
    n = max(1, archives.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("chunk", pa.int32()), ("data", pa.binary()), ("last", pa.bool_())])
        for b in batches:
            for archive in b.column("archive").to_pylist():
                where, path = pafs.FileSystem.from_uri(archive)
                with where.open_input_stream(path, compression=None) as f:
                    rows, size = [], 0
                    for row in parse(_Stream(f), chunk, data):
                        rows.append(row)
                        size += 200 + len(row["data"] or b"")
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("archive").repartition(n).mapInArrow(run, RECORDS)


def round_trip(df: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, read back from the archives.

    Defined results: null html is an empty payload; a null url is written as an identifier made from the page_id; a null
    page_id is carried along, and answers for a payload only if no other does (then all its rows are responses); rows
    repeated with the largest page_id are all responses; an empty table gives no archive and an empty result; other
    columns are ignored.
    """
    archives = write_archives(df, shared_dir(df.sparkSession, "warc"))
    return read_archives(archives, data=False).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(pages(spark, sf_dir))


SQL_OP4 = f"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, octet_length(b) AS payload_bytes, max(page_id) OVER (PARTITION BY b) AS keep FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND keep <> page_id THEN keep END AS refers_to
FROM g
"""
