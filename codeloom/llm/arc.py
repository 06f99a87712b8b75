"""Legacy web archives (ARC, versions 1 and 2) to WARC.

An ARC file is a version block and a run of documents, each behind one line that
ends with its declared length; which fields the line has is said by the version
block. Reading follows the declared lengths as a stream, so a task holds one
document at a time. The converter gives every document a WARC identifier derived
from its content, a timestamp, a type and digests; a document whose payload has come
before becomes a revisit record that refers to the one with the smallest id.

Archives are written by Spark's text writer, one record per row and the blank
lines between records as the line separator, and read back through their URIs in
tasks. Any file system that both Spark and pyarrow reach will do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch
from codeloom.sources.spread import dealt

# Documents handed on at once by a reading task, in bytes.
_CHUNK = 8 << 20

# The fields of a document's line by version, and what a WARC record says.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_HEADER = "X-Page-Id"

ARC_SCHEMA = (
    "archive string, position long, version int, url string, ip string, date string, mime string, status string, head binary, payload binary, "
    "payload_bytes long, payload_digest string, page_id long, problem string"
)
WARC_SCHEMA = (
    "archive string, position long, record_type string, record_id string, refers_to string, target_uri string, date string, "
    "payload_bytes long, payload_digest string, page_id long, payload binary, problem string"
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# Writing ARC


def write_arc(
    pages: DataFrame, path: str, version: int = 1, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    ip: str = "0.0.0.0", date: str = "20260101000000",
) -> None:
    """One ARC file per partition below ``path``, gzip-compressed, each beginning with its version block.

    The document is an HTTP response whose head carries the id. Blanks and control
    characters of a url are percent-encoded, a null url is ``unknown:``, a null page
    is an empty one.
    """
    url = F.coalesce(F.col(url_col), F.lit("unknown:"))
    url = F.regexp_replace(url, "[ \\x00-\\x1F]", "%20")
    page = F.coalesce(F.col(html_col), F.lit(""))
    length = F.octet_length(page).cast("string")
    named = F.coalesce(F.concat(F.lit(f"{ID_HEADER}: "), F.col(id_col).cast("string"), F.lit("\r\n")), F.lit(""))
    document = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit("\r\n"), named, F.lit("\r\n"), page)
    size = F.octet_length(document).cast("string")
    between = f" {ip} {date} text/html "
    if version == 2:
        between += "200 - - 0 pages.arc "
    line = F.concat(url, F.lit(between), size, F.lit("\n"))
    body = f"{version} 0 codeloom\n{' '.join(ARC_FIELDS[version])}\n"
    opening = f"filedesc://pages.arc {ip} {date} text/plain " + ("200 - - 0 pages.arc " if version == 2 else "") + f"{len(body)}\n{body}\n"
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    record = F.concat(F.when(first, F.lit(opening)).otherwise(F.lit("")), line, document)
    pages.select(record.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


# Reading


def _files(spark: SparkSession, path: str) -> DataFrame:
    """One row per archive, dealt to tasks by the archives' sizes; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return dealt(Scratch(spark, "archives").keep(found), "path", size="length").select("path")


def _open(uri: str):
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    system, name = fs.FileSystem.from_uri(uri)
    stream = io.BufferedReader(system.open_input_stream(name, compression=None), 1 << 20)
    return io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20) if stream.peek(2)[:2] == b"\x1f\x8b" else stream


def _in_batches(read: Callable, schema: pa.Schema):
    """A function for ``mapInArrow`` that reads the archives its rows name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def out():
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                for row in read(uri):
                    rows.append(row)
                    held += len(row.get("payload") or b"") + 500
                    if held >= _CHUNK:
                        yield out()
                        rows, held = [], 0
        if rows:
            yield out()

    return run


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


def _split_head(document: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with the blank line) and payload; a document without a head is all payload."""
    if not document.startswith(b"HTTP/"):
        return b"", document
    end = re.search(rb"\r?\n\r?\n", document)
    return (document[:end.end()], document[end.end():]) if end else (document, b"")


def _page_id(head: bytes) -> int | None:
    found = re.search(rb"(?im)^" + ID_HEADER.encode() + rb":\s*(-?\d+)\s*$", head)
    return int(found[1]) if found else None


def arc_documents(stream, archive: str, with_payload: bool = True) -> Iterator[dict]:
    """The documents of one archive; a version block is one only as the first of it.

    A line or length that can't be followed ends it with a row that names the problem.
    """
    version, position, first = 0, 0, True
    while True:
        start, line = position, stream.readline()
        position += len(line)
        if not line:
            return
        if not line.strip():
            continue
        words = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        fields = ARC_FIELDS.get(version) or (ARC_FIELDS[2] if len(words) >= len(ARC_FIELDS[2]) else ARC_FIELDS[1])
        row = {"archive": archive, "position": start, "version": version or None}
        if len(words) < len(fields) or not words[-1].isdigit():
            yield row | {"problem": "header line"}
            return
        extra = len(words) - len(fields) + 1  # blanks inside the url
        values = dict(zip(fields, [" ".join(words[:extra]), *words[extra:]]))
        size = int(words[-1])
        document = stream.read(size)
        position += len(document)
        if len(document) < size:
            yield row | {"url": values["URL"], "problem": "shorter than declared"}
            return
        if first and values["URL"].startswith("filedesc:"):
            version, first = 2 if document[:1] == b"2" else 1, False
            continue
        first = False
        head, payload = _split_head(document)
        status = values.get("Result-code") or (head.split(b" ", 2)[1][:3].decode("ascii", "replace") if head.count(b" ") else None)
        yield row | {
            "url": values["URL"], "ip": values["IP-address"], "date": values["Archive-date"], "mime": values["Content-type"], "status": status,
            "head": head if with_payload else None, "payload": payload if with_payload else None, "payload_bytes": len(payload),
            "payload_digest": sha1_base32(payload), "page_id": _page_id(head), "problem": None,
        }


def read_arc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """(archive, position, …) of the documents of all archives below ``path``; ``problem`` is null for whole ones."""
    def read(uri: str) -> Iterator[dict]:
        with _open(uri) as stream:
            yield from arc_documents(stream, uri, with_payload)

    return _files(spark, path).mapInArrow(_in_batches(read, _arrow(ARC_SCHEMA)), ARC_SCHEMA)


# Converting


def _iso(date: str | None) -> str:
    digits = re.sub(r"\D", "", date or "").ljust(14, "0")[:14]
    month, day = max(digits[4:6], "01"), max(digits[6:8], "01")
    return f"{digits[:4]}-{month}-{day}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def record_urn(url: str | None, date: str | None, digest: str, key: object) -> str:
    """The identifier of a converted record: the same document gets the same one in every run."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {key}')}"


def warc_record(doc: dict) -> bytes:
    """One WARC record without the two blank lines behind it; ``doc['refers']`` makes it a revisit."""
    digest, http = doc["payload_digest"], bool(doc["head"])
    refers = doc.get("refers")
    key = doc["page_id"] if doc["page_id"] is not None else f"at {doc['position']}"
    block = doc["head"] if refers else doc["head"] + doc["payload"]
    lines = [
        WARC_VERSION,
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: <{record_urn(doc['url'], doc['date'], digest, key)}>",
        f"WARC-Date: {_iso(doc['date'])}",
        f"WARC-Target-URI: {doc['url']}",
        f"WARC-IP-Address: {doc['ip']}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"Content-Type: {'application/http; msgtype=response' if http else doc['mime']}",
    ]
    if refers:
        lines += [
            f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{record_urn(refers['url'], refers['date'], digest, refers['key'])}>",
            f"WARC-Refers-To-Target-URI: {refers['url']}", f"WARC-Refers-To-Date: {_iso(refers['date'])}",
        ]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block


def revisits(documents: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(archive, position, refers) of the documents whose payload an earlier one has: that with the smallest id, null ids last.

    ``documents`` has the columns of ``read_arc``, payloads not needed. Payloads of
    fewer than ``min_bytes`` bytes are never revisits.
    """
    whole = documents.filter(F.col("problem").isNull() & (F.col("payload_bytes") >= min_bytes))
    key = F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("at "), F.col("position").cast("string")))
    first = whole.groupBy("payload_digest", "payload_bytes").agg(F.min(F.struct(
        F.col("page_id").isNull().alias("absent"), "page_id", "archive", "position", "url", "date", key.alias("key"))).alias("first"), F.count(F.lit(1)).alias("n"))
    again = whole.select("archive", "position", "payload_digest", "payload_bytes").join(
        first.filter("n > 1"), ["payload_digest", "payload_bytes"])
    itself = (F.col("archive") == F.col("first.archive")) & (F.col("position") == F.col("first.position"))
    return again.filter(~itself).select("archive", "position", F.struct("first.url", "first.date", "first.key").alias("refers"))


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0, whole_only: bool = False) -> None:
    """Write the documents of all archives below ``arc_path`` as WARC files below ``warc_path``.

    Documents that can't be read whole are left out (``read_arc`` lists them), or with
    ``whole_only`` an error.
    """
    scratch = Scratch(spark, "arc")
    seen = scratch.keep(read_arc(spark, arc_path, with_payload=False).drop("head", "payload"))
    broken = seen.filter("problem is not null").first() if whole_only else None
    if broken:
        raise ValueError(f"broken document: {broken.archive} {broken.position} {broken.problem}")
    again = revisits(seen, min_bytes)
    columns = ["archive", "position", "url", "ip", "date", "mime", "head", "payload", "payload_digest", "page_id", "refers"]
    documents = read_arc(spark, arc_path).filter("problem is null").join(
        again.hint("shuffle_hash"), ["archive", "position"], "left").select(*columns)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = [warc_record(doc) for doc in batch.slice(at, 64).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["record"])

    documents.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value")).write.option(
        "lineSep", "\r\n\r\n").option("compression", "gzip").text(warc_path)
    scratch.drop(seen)


def warc_records(stream, archive: str, with_payload: bool = True) -> Iterator[dict]:
    """The records of one WARC file, by their declared lengths."""
    position = 0
    while True:
        start, line = position, stream.readline()
        position += len(line)
        if not line:
            return
        if not line.strip():
            continue
        row = {"archive": archive, "position": start}
        if not line.startswith(b"WARC/"):
            yield row | {"problem": "version line"}
            return
        named = {}
        while (line := stream.readline()).strip():
            position += len(line)
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            named[name.strip().lower()] = value.strip()
        position += len(line)
        size = named.get("content-length", "")
        block = stream.read(int(size)) if size.isdigit() else b""
        position += len(block)
        if not size.isdigit() or len(block) < int(size):
            yield row | {"problem": "shorter than declared"}
            return
        head, payload = _split_head(block)
        revisit = named.get("warc-type") == "revisit"
        digest = named.get("warc-payload-digest", "").removeprefix("sha1:")
        found = digest if revisit else sha1_base32(payload)
        yield row | {
            "record_type": named.get("warc-type"), "record_id": named.get("warc-record-id", "").strip("<>"),
            "refers_to": named["warc-refers-to"].strip("<>") if "warc-refers-to" in named else None,
            "target_uri": named.get("warc-target-uri"), "date": named.get("warc-date"),
            "payload_bytes": None if revisit else len(payload), "payload_digest": found, "page_id": _page_id(head),
            "payload": payload if with_payload and not revisit else None, "problem": None if found == digest else "payload digest",
        }


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all WARC files below ``path``; ``problem`` names what does not hold.

    A revisit record has the digest it declares and no payload of its own.
    """
    def read(uri: str) -> Iterator[dict]:
        with _open(uri) as stream:
            yield from warc_records(stream, uri, with_payload)

    return _files(spark, path).mapInArrow(_in_batches(read, _arrow(WARC_SCHEMA)), WARC_SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """Revisit records with length and id of the record they refer to: (page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri).

    A record with a problem is an error.
    """
    failed = F.raise_error(F.concat_ws(" ", F.lit("broken record:"), "archive", F.col("position").cast("string"), "problem"))
    whole = records.filter(F.when(F.col("problem").isNull(), F.lit(True)).otherwise(failed.cast("boolean")))
    # Rows repeated with one id and one payload have one record id.
    responses = whole.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(
        F.min("payload_bytes").alias("_bytes"), F.min("page_id").alias("_page"))
    found = whole.filter("refers_to is not null").join(responses, "refers_to", "left")
    columns = lambda size, page: ["page_id", size.alias("payload_bytes"), "payload_digest", "record_type", page.alias("refers_to"), "target_uri"]
    return found.select(*columns(F.col("_bytes"), F.col("_page"))).unionByName(
        whole.filter("refers_to is null").select(*columns(F.col("payload_bytes"), F.lit(None).cast("long"))))
