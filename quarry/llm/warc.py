"""WARC archives: writing, normalising whole-file gzip streams to one member a record, an offset index, and reading by it."""

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

from .common import dropped, new_path, slices, table, trimming, written

VERSION, CHUNK, LEVEL = b"WARC/1.0", 1 << 20, 1
#: What a revisit of an identical payload names as its profile, and a date for pages that carry none.
PROFILE, UNDATED = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record. The payload of a revisit isn't stored; its digest and size are those of the full payload."""
    head = [
        VERSION.decode(),
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {UNDATED}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    body = payload if refers_to is None else b""
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join([*head, "", ""]).encode() + body + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if lines[0].encode() != VERSION:
        raise ValueError(f"no record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def inflated(stream, size: int = CHUNK) -> Iterator[bytes]:
    """The bytes of a gzip stream, one or many members, read once from front to end."""
    engine = zlib.decompressobj(31)
    while data := stream.read(size):
        while data:
            yield engine.decompress(data, 4 * CHUNK)
            if engine.eof:
                data, engine = engine.unused_data, zlib.decompressobj(31)
            else:
                data = engine.unconsumed_tail
    yield engine.flush()


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream. At most a record and a few chunks are held."""
    held, at = bytearray(), 0

    def more() -> bool:
        for x in chunks:
            if x:
                held.extend(x)
                return True
        return False

    while True:
        while True:  # the line ends between records may come with the next chunk
            while held.startswith(b"\r\n", at):
                at += 2
            if len(held) - at >= 2 or not more():
                break
        end = held.find(b"\r\n\r\n", at)
        while end < 0 and more():
            end = held.find(b"\r\n\r\n", max(at, 0))
        if end < 0:
            if held[at:].strip():
                raise ValueError("the stream ends within a record")
            return
        head = bytes(held[at:end]).lower()
        length = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.startswith(b"content-length:"))
        stop = end + 4 + length
        while len(held) < stop and more():
            pass
        if len(held) < stop:
            raise ValueError("the stream ends within a payload")
        yield bytes(held[at:stop]) + b"\r\n\r\n"
        at = stop
        if at > 4 * CHUNK:
            del held[:at]
            at = 0


def member(raw: bytes, level: int = LEVEL) -> bytes:
    engine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return engine.compress(raw) + engine.flush()


class Whole:
    """A file that takes its name only when it is whole; a second try of a task replaces it with the same bytes."""

    def __init__(self, path: str):
        self.fs, self.path = pafs.FileSystem.from_uri(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.draft = f"{self.path}.{uuid.uuid4().hex}"

    def __enter__(self):
        self.file = self.fs.open_output_stream(self.draft)
        return self.file

    def __exit__(self, kind, *_):
        self.file.close()
        if kind is None:
            self.fs.move(self.draft, self.path)
        else:
            self.fs.delete_file(self.draft)


def deduplicated(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with refers_to: of equal payloads the largest page_id, for all rows but those of that page.

    Only digests are grouped. What refers to a page is a table of its own, by page and digest, and html isn't shuffled while
    that is small enough for Spark to broadcast by its files' size.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select("page_id", F.sha2(payload, 256).alias("digest"))
    largest = own.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    largest = written(largest.select("digest", "refers_to"), "payloads")
    revisits = own.join(largest, "digest").where("NOT page_id <=> refers_to").select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), "refers_to")
    revisits = written(revisits.distinct(), "revisits")
    same = F.col("page_id").eqNullSafe(F.col("__page")) & (F.sha2("html", 256) == F.col("__digest"))
    return pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("html")).join(revisits, same, "left").drop("__page", "__digest")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """(archive) paths of gzip files, each one stream of a task's records. pages: page_id, url, html, refers_to."""

    def write(batches):
        path, any_ = f"{folder}/whole-{TaskContext.get().partitionId():06d}.warc.gz", False
        with Whole(path) as out:
            engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            for batch in slices(batches):
                for row in batch.to_pylist():
                    any_ = True
                    out.write(engine.compress(record(row["page_id"], row["url"], (row["html"] or "").encode(), row["refers_to"])))
            out.write(engine.flush())
        if any_:
            yield pa.record_batch({"archive": pa.array([path])})

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(trimming(write), "archive string")


INDEX = "archive string, record_id string, type string, offset long, length long"


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with one gzip member a record, beside a sidecar of offsets; the sidecars' rows are returned.

    An archive is inflated once, as a stream. The sidecar stands beside it as tab-separated lines: offset, length, type, id.
    """

    def rewrite(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, plain = pafs.FileSystem.from_uri(path)
                target = f"{folder}/{path.rpartition('/')[2].removeprefix('whole-')}"
                rows, at = [], 0
                with fs.open_input_stream(plain, compression=None) as stream, Whole(target) as out:
                    for raw in records(inflated(stream)):
                        fields = parsed(raw[: raw.index(b"\r\n\r\n") + 4])[0]
                        packed = member(raw)
                        out.write(packed)
                        rows.append((target, fields["warc-record-id"], fields["warc-type"], at, len(packed)))
                        at += len(packed)
                with Whole(f"{target}.idx") as out:
                    for _, name, kind, offset, n in rows:
                        out.write(f"{offset}\t{n}\t{kind}\t{name}\n".encode())
                kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in INDEX.split(", ")])

    return archives.mapInArrow(trimming(rewrite), INDEX)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def read(index: DataFrame, content: bool = True) -> DataFrame:
    """The records that an index names, each inflated alone from its offset; with content their payloads' text.

    A response's size and digest are those of the payload read, and must be those that its header names.
    """
    schema = READ if content else READ.rpartition(", ")[0]

    def get(batches):
        opened: tuple = ("", None)
        for batch in slices(batches, 256):
            rows = []
            for x in batch.to_pylist():
                if opened[0] != x["archive"]:
                    if opened[1]:
                        opened[1].close()
                    fs, plain = pafs.FileSystem.from_uri(x["archive"])
                    opened = (x["archive"], fs.open_input_file(plain))
                opened[1].seek(x["offset"])
                fields, payload = parsed(zlib.decompress(opened[1].read(x["length"]), 31))
                number = lambda name: int(x) if (x := fields.get(name, "").strip("<>").rpartition(":")[2]) else None  # noqa: E731, B023
                size, said = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-type"] == "response" and (size, said) != (len(payload), digest(payload)):
                    raise ValueError(f"{fields['warc-record-id']}: the payload isn't what its header names")
                rows.append((number("warc-record-id"), size, said, fields["warc-type"], number("warc-refers-to"), payload.decode() if content else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)
        if opened[1]:
            opened[1].close()

    return index.mapInArrow(trimming(get), schema)


def archived(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) as normalised archives in folder, and return their index.

    A null html is an empty payload; empty payloads revisit each other like others; a null url is left out. Each row is a
    record of its own: repeated rows of a page that others revisit are all responses, other repeated rows all revisits. A null
    page_id makes a record without a number that none refers to; where all pages of a payload are such, all are responses.
    An empty table gives an empty index; other columns aren't read. The whole-file streams are removed at the end.
    """
    spark = pages.sparkSession
    whole = new_path(spark, "warc-whole")
    archives = written(write_archives(deduplicated(pages), whole), "archives")
    # A file is one task's work: as many tasks as files, each with its own.
    n = max(1, archives.count())
    index = written(normalise(archives.repartitionByRange(n, "archive"), folder), "warc-index")
    dropped(spark, whole)
    return index


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from its archive; see archived for nulls and empty payloads."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return read(archived(pages, new_path(spark, "warc")), content=False)


#: Base 32 of a SHA-1: each hexadecimal digit as four bits, each five bits as a letter.
OP4_SQL = """
WITH d AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages),
b AS (SELECT page_id, m, strlen(h)::BIGINT AS payload_bytes, array_to_string(list_transform(string_split(sha1(h), ''),
  lambda c: right('000' || bin(strpos('0123456789abcdef', c) - 1), 4)), '') AS bits FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + list_sum(list_transform(range(5), lambda j: substring(bits, 5 * i + j + 1, 1)::INT * (16 >> j)))::INT, 1)), '') AS payload_digest,
  CASE WHEN m = page_id THEN 'response' ELSE 'revisit' END AS record_type, nullif(m, page_id) AS refers_to FROM b
"""
