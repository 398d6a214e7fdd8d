"""Web archives: a converter from the legacy ARC format to WARC, a writer and a reader.

The converter reads an archive's version block, takes the field names of its header lines from there (version 1:
URL, address, date, type, length; version 2 adds result code, checksum, location, offset and file name), and cuts
records by their declared lengths. A header line is read from its ends: the fields after the type from the right, then
the date and the address before it, so that a URL may hold blanks and a type parameters. For each record it makes up what
WARC asks for and ARC lacks: a record identifier (a name-based UUID), an ISO timestamp, the record type, and SHA-1
digests of block and payload. A record that can't be read (a header line that isn't one, a record that is cut off) is
set aside with its offset and the reason, and reading goes on at the next line that is a header line.

`converted` takes a folder of `.arc` and `.arc.gz` files, of either version, and `archived` takes pages, each batch of
which becomes an ARC archive in memory first. Spark's own writer puts the WARC records into gzip files in the shared
folder, a file for every FILE_BYTES (or one record, if that is larger); `read_back` parses those files. Identifiers
depend on the record and its place only, so a task that runs again gives the same ones.

Among equal payloads of at least `min_bytes` bytes the smallest page_id is a response and the others revisit it; a
revisit holds no payload, only its digest and, in its HTTP header, its length.

Null html counts as an empty payload. A null page_id is never referred to and refers to nothing. Rows repeated with
one page_id are responses alike. URLs are percent-encoded where the header line asks for it; a null one is `-`. Other
columns are ignored, and an empty table or folder gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pictorium.llm.common import shared_folder, slices, written

#: Text of one file of records; a larger record is a file of its own.
FILE_BYTES = 8_000_000
BROADCAST_DIGESTS = 500_000
CAPTURED = "20240101000000"
#: The field lines of the two versions of the ARC format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed value: the profile of a revisit of an identical payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_ID = "X-Page-Id"
#: Fixed value: what closes a WARC record.
CLOSE = b"\r\n\r\n"


class ArcRecord(NamedTuple):
    url: str
    address: str
    date: str
    kind: str
    block: bytes
    offset: int


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_arc(name: str, records: Iterable[tuple[str, bytes]], version: int = 1) -> bytes:
    """An ARC archive of (url, block) records."""
    about = f"{version} 0 pictorium\n{FIELDS[version]}\n\n".encode()
    more = " 200 - - 0 -" if version == 2 else ""
    out = [f"filedesc://{name} 0.0.0.0 {CAPTURED} text/plain{more} {len(about)}\n".encode(), about]
    at = sum(map(len, out))
    for url, block in records:
        extra = f" 200 {sha1(block)} - {at} {name}" if version == 2 else ""
        record = f"{url} 0.0.0.0 {CAPTURED} text/html{extra} {len(block)}\n".encode() + block + b"\n"
        out.append(record)
        at += len(record)
    return b"".join(out)


class Unread(NamedTuple):
    """What couldn't be read of an archive: where it begins and why."""

    offset: int
    reason: str


_DATE = re.compile(r"[0-9]{8,14}")
_ADDRESS = re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}|[0-9A-Fa-f]*:[0-9A-Fa-f:.]*|-")


def header_fields(line: bytes, names: list[str]) -> dict[str, str] | None:
    """The fields of a header line by their names; None if it isn't one. Only the URL and the type may hold blanks."""
    parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
    tail = names[names.index("Content-type") + 1 :]
    if len(parts) < 4 + len(tail) or not parts[-1].isdecimal():
        return None
    head = parts[: len(parts) - len(tail)]
    for k in range(len(head) - 2, 1, -1):
        if _DATE.fullmatch(head[k]) and _ADDRESS.fullmatch(head[k - 1]):
            first = " ".join(head[: k - 1]), head[k - 1], head[k], " ".join(head[k + 1 :])
            return dict(zip(names, first, strict=False)) | dict(zip(tail, parts[len(parts) - len(tail) :], strict=True)) if first[0] else None
    return None


def read_arc(data: bytes) -> Iterator[ArcRecord | Unread]:
    """The records of an ARC archive of either version, without its version block, and what couldn't be read."""
    end = data.find(b"\n") + 1
    first = data[:end].split()
    if not end or not first or not first[-1].isdigit() or len(lines := data[end : end + int(first[-1])].split(b"\n")) < 2 or b"Content-type" not in lines[1]:
        yield Unread(0, "no version block")
        return
    names = lines[1].decode("utf-8", "replace").split()
    at = end + int(first[-1])
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at) + 1 or len(data)
        fields = header_fields(data[at:end], names)
        if fields is None:
            yield Unread(at, "not a header line")
            begin = at
            while end < len(data):
                at, end = end, data.find(b"\n", end) + 1 or len(data)
                if header_fields(data[at:end], names):
                    break
            else:
                return
            if at <= begin:
                return
            continue
        length = int(fields["Archive-length"])
        if end + length > len(data):
            yield Unread(at, f"cut off: {len(data) - end} bytes of {length}")
            return
        yield ArcRecord(fields["URL"], fields["IP-address"], fields["Archive-date"], fields["Content-type"], data[end : end + length], at)
        at = end + length


def unpacked(data: bytes) -> tuple[bytes, str | None]:
    """The bytes of a gzip file of any number of members, and why they end early, if they do."""
    out = []
    while data:
        member = zlib.decompressobj(wbits=31)
        try:
            out.append(member.decompress(data))
        except zlib.error as error:
            return b"".join(out), str(error)
        if not member.eof:
            return b"".join(out), "cut off"
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out), None


def http_split(block: bytes) -> tuple[bytes, bytes]:
    head, gap, payload = block.partition(b"\r\n\r\n")
    return head + gap, payload


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?mi)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode() if found else None


def record_id(*about: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, about)))}>"


def to_warc(record: ArcRecord, identity: str, refers_to: str | None = None) -> bytes:
    """The WARC record (without the two line ends that close it) of an ARC record."""
    head, payload = http_split(record.block)
    web = head.startswith(b"HTTP/")
    block = head if refers_to else record.block
    moment = re.sub(r"(....)(..)(..)(..)(..)(..)", r"\1-\2-\3T\4:\5:\6Z", record.date.ljust(14, "0"))
    fields = [("WARC-Type", "revisit" if refers_to else "response" if web else "resource"), ("WARC-Record-ID", identity), ("WARC-Date", moment), ("WARC-Target-URI", record.url), ("WARC-IP-Address", record.address)]
    if refers_to:
        fields += [("WARC-Refers-To", refers_to), ("WARC-Profile", SAME_PAYLOAD)]
    fields += [("WARC-Payload-Digest", f"sha1:{sha1(payload if web else record.block)}"), ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Type", "application/http; msgtype=response" if web else record.kind), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (in lower case) and block of every record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        begin = end + 4
        at = begin + int(fields["content-length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} isn't closed where its length says")
        yield fields, data[begin:at]
        at += 4


def page_record_id(page_id: object) -> str:
    return record_id("page", page_id)


def _block(page_id: int | None, payload: bytes) -> bytes:
    shown = "-" if page_id is None else page_id
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{PAGE_ID}: {shown}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def _bundles(records: Iterable[bytes], file_bytes: int = FILE_BYTES) -> Iterator[pa.RecordBatch]:
    """Records together, as the text of one file each."""
    schema = pa.schema([("value", pa.binary())])
    held: list[bytes] = []
    size = 0
    for record in records:
        if held and size + len(record) > file_bytes:
            yield pa.RecordBatch.from_pydict({"value": [CLOSE.join(held)]}, schema)
            held, size = [], 0
        held.append(record)
        size += len(record)
    if held:
        yield pa.RecordBatch.from_pydict({"value": [CLOSE.join(held)]}, schema)


def _converter(version: int, file_bytes: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[bytes]:
        place = 0
        for part in slices(batches, size="html", as_bytes=True):
            urls = [quote(u, safe=":/?#[]@!$&'()*+,;=%-._~") if u else "-" for u in part["url"]]
            arc = write_arc("pages.arc", zip(urls, map(_block, part["page_id"], part["html"]), strict=True), version)
            for record, page_id, first in zip(read_arc(arc), part["page_id"], part["first"], strict=True):
                own = page_record_id(page_id) if page_id is not None else record_id(record.url, sha1(record.block), _task(), place)
                yield to_warc(record, own, None if first is None else page_record_id(first))
                place += 1

    return lambda batches: _bundles(records(batches), file_bytes)


def _task() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def _written(bundles: DataFrame) -> str:
    """Puts bundles of records into gzip files, one each."""
    folder = shared_folder(bundles.sparkSession)
    # a string column may hold any bytes: payloads stay as they are
    bundles.select(F.col("value").cast("string").alias("value")).write.option("lineSep", CLOSE.decode()).option("compression", "gzip").option("maxRecordsPerFile", 1).text(folder)
    return folder


def archived(pages: DataFrame, *, min_bytes: int = 0, version: int = 2, file_bytes: int = FILE_BYTES) -> str:
    """Writes a WARC record for every page and returns the folder. `version`: of the ARC archives in between."""
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = given.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    equal = given.where(F.octet_length("html") >= min_bytes).groupBy(F.sha1(F.encode("html", "UTF-8")).alias("digest")).agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    equal = written(equal)  # digests that occur more than once, with their first page: no page moves if they are few
    typed = keyed.join(F.broadcast(equal) if equal.count() <= BROADCAST_DIGESTS else equal, "digest", "left").withColumn("first", F.when(F.col("page_id") != F.col("least"), F.col("least")))
    return _written(typed.select("page_id", "url", "html", "first").mapInArrow(_converter(version, file_bytes), "value binary"))


def _arc_files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(F.col("path").rlike(r"\.arc(\.gz)?$")).select("path", "content")


def _opened(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, ArcRecord | Unread]]:
    """The records of each file, a file at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            path, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            data, short = unpacked(content) if path.endswith(".gz") else (content, None)
            for record in read_arc(data):
                yield path, record
            if short:
                yield path, Unread(len(data), f"gzip: {short}")


def converted(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    """Converts a folder's `.arc` and `.arc.gz` files; the folder of the WARC files, and path, offset and reason of what
    couldn't be read. A file is read whole by one task: archives are some hundred megabytes by custom."""
    files = _arc_files(spark, folder)

    def convert(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _bundles(to_warc(r, record_id(r.url, r.date, sha1(r.block), path.rsplit("/", 1)[-1], r.offset)) for path, r in _opened(batches) if isinstance(r, ArcRecord))

    def unread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(path, r.offset, r.reason) for path, r in _opened(batches) if isinstance(r, Unread)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["path", "offset", "reason"])

    return _written(files.mapInArrow(convert, "value binary")), files.mapInArrow(unread, "path string, offset long, reason string")


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers", pa.string()), ("url", pa.string())])
    for batch in batches:
        for content in batch.column(0):
            out = []
            for fields, block in read_warc(gzip.decompress(content.as_py())):
                kind = fields["warc-type"]
                head, payload = http_split(block) if fields["content-type"].startswith("application/http") else (b"", block)
                page = http_field(head, PAGE_ID)
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if sha1(block) != fields["warc-block-digest"].removeprefix("sha1:") or kind != "revisit" and sha1(payload) != digest:
                    raise ValueError(f"digest of {fields['warc-record-id']} doesn't match")
                size = len(payload) if kind != "revisit" else int(http_field(head, "Content-Length") or 0)
                out.append((None if page in (None, "-") else int(page), size, digest, kind, fields["warc-record-id"], fields.get("warc-refers-to"), fields["warc-target-uri"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], schema.types[k]) for k in range(len(schema))], schema=schema)


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of a folder of WARC files; refers_to is the page_id of the record that a revisit names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    # parsed once; each file is bounded in bytes and opened on its own
    records = written(files.mapInArrow(_parsed, "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers string, url string"))
    # a page whose row is repeated is one record for those that name it
    named = records.where("record_type = 'response' and page_id is not null").groupBy("record_id").agg(F.min("page_id").alias("refers_to"))
    wanted = records.where("record_type = 'revisit'").select(F.col("refers").alias("record_id")).distinct()
    revisits = records.where("record_type = 'revisit'").join(named.join(wanted, "record_id", "left_semi").withColumnRenamed("record_id", "refers"), "refers", "left")
    return records.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits)
