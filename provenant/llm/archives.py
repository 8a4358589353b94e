"""Web archives (WARC) with a two-level capture index.

1. Payloads are hashed. Of records with equal payloads of at least ``LEAST`` bytes the one with the smallest page_id is a response, the
   others are revisits that refer to it and hold no payload.
2. Each task writes archives of its own, one gzip member per record, and notes where each record lies. Only the notes of
   tasks that ended count: what a lost task has written is never read.
3. The notes, keyed by reversed host, the rest of the URL and page_id, are range-partitioned and sorted. Each partition becomes an
   index file of compressed blocks of ``LINES`` lines, followed by a sparse directory of the blocks' first keys. Only one
   line per index file (first key, place of its directory) goes to the driver and back to the tasks.
4. A lookup searches the index files' first keys and the directory by bisection, reads one block by its byte range, and bisects its
   lines. Records are then read by byte range in order of archive and offset.

Frequent hosts and URLs are split over index files, as page_id is a part of the sorted key. All names are new for each
write, so that a repeated task does not disturb another.

Defined results: a null html is an empty payload; a null url is an empty one; rows that repeat a page_id are records each, and rows with the smallest
page_id of a payload are all responses; a null page_id refers to the others and is never referred to; an empty table gives an
empty table. Other columns are not read.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import re
import struct
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import new_folder, rows, stored

LEAST = 100
LINES = 500
ARCHIVE_BYTES = 512 << 20
# Payload bytes that a reading task hands on at once.
READ_BYTES = 32 << 20

NOTE = "key string, page_id long, archive string, start long, length long"
RECORD = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def url_key(url: str | None) -> str:
    """Reversed host, then port, path and query, without scheme, user and fragment; blanks do not occur in it."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url or "")
    host, port, rest = m.groups() if m else ("", "", (url or "").partition("#")[0])
    return quote(",".join(reversed(host.lower().split("."))) + (port or "") + ")" + (rest or "/"), safe="!$&'()*+,/:;=?@-._~%")


def _file_system(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path) if ":/" in path else f"file://{path}")


def _identity(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(identity: str) -> int | None:
    return int(n) if (n := identity.strip("<>").rpartition(":")[2]) else None


def record(page: int | None, url: str | None, payload: bytes, size: int, digest: str, first: int | None, date: str) -> bytes:
    """One record as a gzip member. ``first`` is the page that a revisit refers to; its payload of ``size`` bytes is not given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_identity(page)}", f"WARC-Date: {date}",
             f"WARC-Target-URI: {quote(url or '', safe=_URI)}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if first is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_identity(first)}"]
    out = zlib.compressobj(1, wbits=31)
    return out.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + out.flush()


# A URL is written as it is, but for characters that a header line cannot hold; "%" is kept apart from escapes of our own.
_URI = "!#$&'()*+,/:;=?@[]-._~"


def parse(member: bytes) -> dict:
    """Fields of one record; the digest is of the payload, or as noted where a revisit holds none."""
    data = zlib.decompress(member, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "url": unquote(fields["WARC-Target-URI"]), "record_type": fields["WARC-Type"],
        "payload": payload if fields["WARC-Type"] == "response" else None, "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "refers_to": _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
    }


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id, url, payload, size, digest, first`` of ``pages(page_id, url, html)``; the payload of a revisit is empty."""
    given = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    hashed = given.withColumn("digest", F.sha2("payload", 256))
    firsts = (
        hashed.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND first IS NOT NULL").select("digest", "first")
    )
    # decided on ids and digests; payloads meet the decisions by page, so the copies of one payload spread over tasks
    revisits = (
        hashed.select("page_id", "digest").distinct().join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
        .select(F.col("page_id").alias("page"), F.col("digest").alias("same"), "first")
    )
    joined = hashed.join(revisits, F.col("page_id").eqNullSafe(F.col("page")) & (F.col("digest") == F.col("same")), "left")
    return joined.select("page_id", "url", F.when(F.col("first").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"),
                         F.octet_length("payload").cast("long").alias("size"), "digest", "first")


def write(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Write the archives below ``folder``; one note per record of where it lies."""
    folder = folder or new_folder(pages.sparkSession)
    date = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def archived(batches):
        system, top = _file_system(folder)
        system.create_dir(top, recursive=True)
        stream, name, at = None, None, 0
        for batch in batches:
            notes = []
            for page, url, payload, size, digest, first in rows([batch], "page_id", "url", "payload", "size", "digest", "first"):
                if stream is None or at >= ARCHIVE_BYTES:
                    if stream is not None:
                        stream.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    stream = system.open_output_stream(f"{top}/{name}", compression=None)
                data = record(page, url, payload, size, digest, first, date)
                stream.write(data)
                notes.append((url_key(url), page, name, at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_pylist([dict(zip(_NOTE.names, n, strict=True)) for n in notes], _NOTE)
        if stream is not None:
            stream.close()

    return stored(plan(pages, least).mapInArrow(archived, NOTE)).withColumn("archive", F.concat(F.lit(f"{folder}/"), "archive"))


_NOTE = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("start", pa.int64()), ("length", pa.int64())])


def _line(key: str, page: int | None, archive: str, start: int, length: int) -> str:
    return f"{key} {_sortable(page)} {start} {length} {quote(archive, safe='')}"


def _sortable(page: int | None) -> str:
    """Text that sorts as the page does; null first."""
    return "-" if page is None else f"{page + (1 << 63):020d}"


def build_index(notes: DataFrame, folder: str | None = None) -> list[dict]:
    """Write the index; one entry per index file."""
    spark = notes.sparkSession
    folder = folder or new_folder(spark)

    def indexed(batches):
        system, top = _file_system(folder)
        system.create_dir(top, recursive=True)
        stream, name, at, directory, lines = None, uuid.uuid4().hex, 0, [], []

        def block():
            nonlocal at, lines
            data = zlib.compress("\n".join(lines).encode())
            stream.write(data)
            directory.append(struct.pack("<qq", at, len(data)).hex() + " " + _key_of(lines[0]))
            at, lines = at + len(data), []

        for values in rows(batches, *_NOTE.names):
            stream = stream or system.open_output_stream(f"{top}/{name}.idx", compression=None)
            lines.append(_line(*values))
            if len(lines) == LINES:
                block()
        if stream is not None:
            if lines:
                block()
            data = zlib.compress("\n".join(directory).encode())
            stream.write(data)
            stream.close()
            yield pa.RecordBatch.from_pylist([{"first": directory[0].partition(" ")[2], "path": f"{folder}/{name}.idx", "start": at, "length": len(data)}])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.encode("key", "utf-8"), F.col("page_id")]  # as bytes, so that blocks sort as they are searched
    files = notes.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(indexed, "first string, path string, start long, length long")
    # at most one short entry per shuffle partition comes to the driver
    return sorted((r.asDict() for r in files.collect()), key=lambda r: r["first"].encode())


def _key_of(line: str) -> str:
    return " ".join(line.split(" ", 2)[:2])


class Index:
    """Lookups in the index files; the last directory and block that were read are kept."""

    def __init__(self, files: list[dict]):
        self.files, self.firsts = files, [f["first"].encode() for f in files]
        self.open = functools.lru_cache(4)(self._open)
        self.directory = functools.lru_cache(4)(self._directory)
        self.block = functools.lru_cache(8)(self._block)

    def _open(self, path: str):
        system, name = _file_system(path)
        return system.open_input_file(name)

    def _directory(self, i: int) -> tuple[list[bytes], list[tuple[int, int]]]:
        f = self.files[i]
        entries = [e.partition(" ") for e in zlib.decompress(self.open(f["path"]).read_at(f["length"], f["start"])).decode().split("\n")]
        return [k.encode() for _, _, k in entries], [struct.unpack("<qq", bytes.fromhex(a)) for a, _, _ in entries]

    def _block(self, i: int, start: int, length: int) -> tuple[list[bytes], list[str]]:
        lines = zlib.decompress(self.open(self.files[i]["path"]).read_at(length, start)).decode().split("\n")
        return [_key_of(x).encode() for x in lines], lines

    def find(self, key: str, page: int | None) -> list[tuple[str, int, int]]:
        """Archive, start and length of the captures of a key and page; equal keys may go on in the next block or file."""
        wanted, found = f"{key} {_sortable(page)}".encode(), []
        i = max(0, bisect.bisect_left(self.firsts, wanted) - 1)
        while i < len(self.files) and self.firsts[i] <= wanted:
            keys, places = self.directory(i)
            b = max(0, bisect.bisect_left(keys, wanted) - 1)
            while b < len(keys) and keys[b] <= wanted:
                inside, lines = self.block(i, *places[b])
                for line in lines[bisect.bisect_left(inside, wanted) : bisect.bisect_right(inside, wanted)]:
                    _, _, start, length, archive = line.split(" ")
                    found.append((unquote(archive), int(start), int(length)))
                b += 1
            i += 1
        return found


def locate(wanted: DataFrame, files: list[dict]) -> DataFrame:
    """``archive, start, length`` of the captures of each distinct ``(url, page_id)``."""
    spark = wanted.sparkSession
    shipped = spark.sparkContext.broadcast(files)

    def keyed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string()), batch.column("page_id")], ["key", "page_id"])

    def found(batches):
        index, last = Index(shipped.value), None
        for batch in batches:
            out = []
            for pair in rows([batch], "key", "page_id"):
                if pair != last:
                    last = pair
                    out += index.find(*pair)
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "start", "length"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = wanted.select("url", F.col("page_id").cast("long")).mapInArrow(keyed, "key string, page_id long").distinct()
    return keys.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(found, "archive string, start long, length long")


def read(located: DataFrame) -> DataFrame:
    """The records at ``(archive, start, length)``, read by byte range in order of place."""

    def records(batches):
        opened = functools.lru_cache(4)(lambda path: (lambda system, name: system.open_input_file(name))(*_file_system(path)))
        for batch in batches:
            out, held = [], 0
            for archive, start, length in rows([batch], "archive", "start", "length"):
                out.append(parse(opened(archive).read_at(length, start)))
                held += len(out[-1]["payload"] or b"")
                if held >= READ_BYTES:
                    yield pa.RecordBatch.from_pylist(out, _RECORD)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, _RECORD)

    parts = int(located.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return located.repartitionByRange(parts, "archive", "start").sortWithinPartitions("archive", "start").mapInArrow(records, RECORD)


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                     ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages``, index the captures, look every page up and read its record back."""
    files = build_index(write(pages))
    return read(locate(pages.select("url", "page_id"), files))


def digest(records: DataFrame) -> DataFrame:
    """The digest of a payload that is there is taken anew."""
    return records.select("page_id", F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
                          F.coalesce(F.sha2("payload", 256), "payload_digest").alias("payload_digest"), "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {LEAST} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       nullif(first, page_id) AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""
