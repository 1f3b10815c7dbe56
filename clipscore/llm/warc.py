"""Pages as WARC archives in the shared folder, with an index of byte ranges, and range reads along the index."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipscore.llm.common import attach, cut, in_arrow, shared_folder

REVISIT_BYTES = 1000
ROLL_BYTES = 1 << 30
GAP_BYTES = 1 << 16
CHUNK_BYTES = 4 << 20
TASK_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"  # pages have no date of capture
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "<urn:x-page:{}>"
INDEX = "page_id {kind}, file string, offset bigint, length bigint, url string, payload_digest string"


def folder_of(place: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a folder named as Spark names it."""
    if place.startswith("file:"):
        place = "/" + place[len("file:") :].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(place.replace("s3a://", "s3://", 1))


def _line(value: str) -> str:
    """A header value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def record(kind: str, page: object, url: str | None, payload: bytes, size: int, sha1: str, refers: object) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header (with the full length) and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_ID.format('' if page is None else page)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_ID.format(refers)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """Type, ids, url, payload (none for a revisit), length and digest of the full payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != full or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    page = lambda name: fields[name][len("<urn:x-page:") : -1] or None if name in fields else None
    return {
        "page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "refers_to": page("WARC-Refers-To"), "payload_bytes": full, "payload_digest": digest, "payload": None if revisit else payload,
    }


def _packed(data: bytes) -> bytes:
    """A gzip member of its own, so that a byte range of the archive can be read alone."""
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def decided(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null: a response) of every page.

    Payloads of at least ``revisit_bytes`` are equal if their SHA-1, xxHash and lengths are; the largest page_id
    of a group is found with partial maxima, and only groups of several rows are joined back.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    long_ = F.col("payload_bytes") >= revisit_bytes
    same = F.when(long_, F.concat_ws(":", "payload_digest", F.hex(F.xxhash64("payload")), "payload_bytes"))
    named = rows.withColumn("same", same)
    groups = cut(named.where(long_).groupBy("same").agg(F.max("page_id").alias("latest"), F.count("*").alias("rows")).where("rows > 1"))
    found = attach(named, groups, "same", "rows")
    other = F.col("latest").isNotNull() & ~F.col("latest").eqNullSafe(F.col("page_id"))
    return found.withColumn("refers_to", F.when(other, F.col("latest"))).drop("same", "latest")


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write one record a page to archives in ``folder``; the written index (see ``INDEX``), one row a record.

    Every attempt of a task writes files of its own, named at random, and only rows of the attempt that
    succeeded reach the index; archives of lost attempts are never read.
    """
    fs, path = folder_of(folder)
    fs.create_dir(path, recursive=True)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = folder_of(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index: list[tuple] = []
                for i in range(batch.num_rows):
                    page, url, payload, size, sha1, refers = (c[i].as_py() for c in batch.columns)
                    if out is None or at >= roll_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                        about = b"software: clipscore\r\nformat: WARC File Format 1.1\r\n"
                        info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n"
                        at += out.write(_packed(info.encode() + about + b"\r\n\r\n"))
                    packed = _packed(record("response" if refers is None else "revisit", page, url, payload.encode(), size, sha1, refers))
                    out.write(packed)
                    index.append((page, name, at, len(packed), url, sha1))
                    at += len(packed)
                columns = list(zip(*index)) if index else [[]] * 6
                kinds = [batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["page_id", "file", "offset", "length", "url", "payload_digest"])
        finally:
            if out is not None:
                out.close()

    rows = decided(pages, revisit_bytes).select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")
    in_arrow(rows, run, INDEX.format(kind=kind)).write.mode("errorifexists").parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP_BYTES, chunk: int = CHUNK_BYTES) -> list[tuple[str, int, int, int]]:
    """(file, start, end, how many) of reads that cover (file, offset, length) rows in their order.

    Neighbours at most ``gap`` bytes apart share a read of at most ``chunk`` bytes; a longer record is read alone.
    """
    out: list[tuple[str, int, int, int]] = []
    for file, offset, length in rows:
        if out and out[-1][0] == file and 0 <= offset - out[-1][2] <= gap and offset + length - out[-1][1] <= chunk:
            out[-1] = (file, out[-1][1], offset + length, out[-1][3] + 1)
        else:
            out.append((file, offset, offset + length, 1))
    return out


def read_records(index: DataFrame, folder: str, payloads: bool = True, gap: int = GAP_BYTES, chunk: int = CHUNK_BYTES) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest (and payload) of the records of ``index``.

    ``index`` is what :func:`write_archives` gives or any selection of it.  Rows are dealt by ranges of (file,
    offset); a task reads neighbours in one go and checks every payload against its digest.
    """
    kind = index.schema["page_id"].dataType.simpleString()
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    dealt = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = folder_of(folder)
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]
        opened: tuple = ("", None)
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            first = 0
            for file, start, end, count in ranges(rows, gap, chunk):
                if opened[0] != file:
                    if opened[1] is not None:
                        opened[1].close()
                    opened = (file, fs.open_input_file(f"{path}/{file}"))
                data = opened[1].read_at(end - start, start)
                found = [parsed(zlib.decompress(data[o - start : o - start + n], 31)) for _, o, n in rows[first : first + count]]
                first += count
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in zip(names, kinds)], names)
        if opened[1] is not None:
            opened[1].close()

    schema = "page_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string" + ", payload binary" * payloads
    read = in_arrow(dealt, run, schema)
    return read.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from its archive.

    Null html is an empty payload.  Of the rows with equal payloads of ``REVISIT_BYTES`` or more those of the largest
    page_id are responses (each of them where rows repeat), the others revisit it; a null page_id revisits any
    other, and is a response where there is none.  Null urls are left out of the record.  An empty table gives an
    empty one; other columns are not looked at.  Archives go to a new folder below the shared one.
    """
    folder = folder or new_folder(pages.sparkSession)
    index = write_archives(pages, folder)
    return read_records(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


def archive_sql(revisit_bytes: int = REVISIT_BYTES) -> str:
    """DuckDB SQL for :func:`archive`."""
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS latest FROM pages),
q AS (SELECT *, octet_length(encode(h)) >= {revisit_bytes} AND page_id IS DISTINCT FROM latest AS again FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN latest END AS refers_to FROM q"""
