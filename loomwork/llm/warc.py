"""Web archives: the legacy ARC format parsed and converted to WARC 1.0, and both written and read by Spark.

ARC. An archive begins with a block `filedesc://...` that names the version and, in a line of field names, the fields of the
header lines that follow: five in version 1, ten in version 2. A record is such a line, as many bytes as its last field
declares, and a line feed. Lines are split by the archive's own field names, from the right, as old crawlers left blanks in
addresses. A record cut short by the end of its file is kept and marked.

WARC. The converter writes a warcinfo record for the block and a record for each other one. Record ids are UUIDs of (archive,
offset, address, date), dates become ISO, a block that begins as an HTTP response is a response and any other a resource,
digests are base32 SHA-1 of block and payload. Of responses with one payload of at least `least` bytes the first by the number in a
header of the HTTP block (KEY_HEADER) is stored, the others become revisits: headers alone, with the payload's digest, the
profile of identical payloads, and id, address and date of the first.

Files. An archive is a row of bytes made in a task: gzip members, one for each record, at most ARCHIVE_BYTES before
compression (or one record). Spark's text writer puts each row into a file of its own, through its commit protocol, so
a lost task leaves nothing; the byte that it puts at the end is a zero, which gzip takes for padding. Archives are read by
Spark's reader of binary files, a file being a row, so foreign ones must be below 2 GB and fit a task. Payloads are never
shuffled: the digests of an archive's records are, and what was decided on them comes back by archive.

Defined cases: null html is an empty payload; a null address is urn:page:<id>; characters that a header line can't hold are
percent-encoded; null page_id comes after all others and stays null; of rows with one page_id and payload one is the
response; an empty table gives no archive and no row; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import join_keyed, only, scratch, slices, unknown
from loomwork.sources.tables import file_system, shared_dir

#: Bytes of an archive before compression.
ARCHIVE_BYTES = 8_000_000
LEVEL = 1
#: Archives with decisions (a few bytes a record) that are sent to every task.
MOST_ARCHIVES = 2_000
KEY_HEADER = "X-Page-Id"
SOFTWARE = "loomwork"
#: When a page without a date was fetched: so many seconds after this as its id says.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
#: The field lines of the two versions, as the format defines them. Fixed values.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: The profile of a revisit with an equal payload. Fixed value.
IDENTICAL = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
MADE_BY = {1: "1 0", 2: "2 0"}


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def line_safe(url: str) -> str:
    return quote(url, safe="".join(map(chr, range(33, 127))))


def member(data: bytes) -> bytes:
    return zlib.compress(data, LEVEL, wbits=31)


def inflated(data: bytes, piece: int = 16_384) -> bytes:
    """The bytes of concatenated gzip members, or data itself if it isn't compressed. Zeros after a member are padding."""
    if data[:2] != b"\x1f\x8b":
        return data
    view, at, out = memoryview(data), 0, []
    while at < len(data) and data[at]:
        unpack = zlib.decompressobj(31)
        while not unpack.eof and at < len(data):
            out.append(unpack.decompress(view[at : at + piece]))
            at += piece
        at = min(at, len(data)) - len(unpack.unused_data)
    return b"".join(out)


# --- ARC


def seconds_after(page_id) -> str:
    """The 14 digits of a page's date."""
    n = page_id % 1_000_000_000 if isinstance(page_id, int) else 0
    return (EPOCH + timedelta(seconds=n)).strftime("%Y%m%d%H%M%S")


def arc_block(name: str, version: int) -> bytes:
    body = f"{MADE_BY[version]} {SOFTWARE}\n{FIELDS[version]}\n".encode()
    known = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": EPOCH.strftime("%Y%m%d%H%M%S"), "Content-type": "text/plain", "Archive-length": str(len(body))}
    return arc_line(known, version) + body + b"\n"


def arc_line(known: dict[str, str], version: int) -> bytes:
    return (" ".join(known.get(f, "-") for f in FIELDS[version].split(" ")) + "\n").encode()


def arc_record(name: str, offset: int, version: int, page_id, url: str | None, html: bytes) -> bytes:
    key = "" if page_id is None else f"{KEY_HEADER}: {page_id}\r\n"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n{key}\r\n".encode() + html
    address = line_safe(url) if url and url.strip() else f"urn:page:{page_id}"
    known = {"URL": address, "IP-address": "192.0.2.1", "Archive-date": seconds_after(page_id), "Content-type": "text/html", "Archive-length": str(len(block))}
    if version > 1:
        known |= {"Result-code": "200", "Checksum": sha1(html), "Offset": str(offset), "Filename": name}
    return arc_line(known, version) + block + b"\n"


class Packer:
    """Records, packed into archives of a bounded size; each begins with the record that head(name) makes."""

    def __init__(self, tag: str, head):
        self.tag, self.head, self.no = tag, head, 0
        self.start()

    def start(self) -> None:
        self.name = f"{self.tag}-{TaskContext.get().partitionId():06d}-{self.no:06d}"
        self.no += 1
        first = self.head(self.name)
        self.members, self.offset, self.count = [member(first)], len(first), 0

    def full(self, more: int) -> bool:
        return self.count > 0 and self.offset + more > ARCHIVE_BYTES

    def add(self, record: bytes) -> None:
        self.members.append(member(record))
        self.offset += len(record)
        self.count += 1

    def packed(self) -> Iterator[pa.RecordBatch]:
        """The archive so far, and a new one."""
        if self.count:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(self.members)], pa.binary())], ["data"])
            self.start()


def put_files(archives: DataFrame, path: str) -> None:
    """Each row of data (binary) as a file below path."""
    archives.select(F.col("data").cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the archives below path."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_arc(df: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", tag: str = "pages") -> None:
    """df as ARC archives below path, by turns of version 1 and 2."""
    unknown(df, [key, url, html])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = lambda name: 1 + (int(name.rpartition("-")[2]) + TaskContext.get().partitionId()) % 2
        out = Packer(tag, lambda name: arc_block(f"{name}.arc.gz", version(name)))
        for whole in batches:
            for b in slices(whole, html):
                for i, u, h in zip(b.column(key).to_pylist(), b.column(url).to_pylist(), b.column(html).cast(pa.binary()).to_pylist(), strict=True):
                    if out.full(len(h or b"")):
                        yield from out.packed()
                    out.add(arc_record(f"{out.name}.arc.gz", out.offset, version(out.name), i, u, h or b""))
        yield from out.packed()

    put_files(only(df, key, url, html).mapInArrow(run, "data binary"), path)


@dataclass
class ArcRecord:
    archive: str
    offset: int
    version: int
    fields: dict[str, str]
    block: bytes
    truncated: bool

    @property
    def url(self) -> str:
        return self.fields["URL"]

    @property
    def is_http(self) -> bool:
        return self.block[:5] == b"HTTP/"

    def parts(self) -> tuple[bytes, bytes]:
        """HTTP headers with the empty line, and payload; without headers all is payload."""
        return http_parts(self.block) if self.is_http else (b"", self.block)

    def date(self) -> str:
        """The date as WARC has it; digits that an old crawler left out are the least they can be."""
        d = re.sub(r"\D", "", self.fields.get("Archive-date", ""))[:14]
        d += "00000101000000"[len(d) :]
        return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"

    def id(self) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.archive}#{self.offset} {self.url} {self.date()}')}>"


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    at = block.find(b"\r\n\r\n")
    return (block[: at + 4], block[at + 4 :]) if at >= 0 else (block, b"")


def http_header(headers: bytes, name: str) -> str | None:
    found = re.search(rb"^" + re.escape(name.encode()) + rb":[ \t]*(.*?)[ \t]*\r?$", headers, re.M | re.I)
    return found[1].decode("utf-8", "replace") if found else None


def arc_records(data: bytes) -> Iterator[ArcRecord]:
    """The records of one archive's bytes, the version block first."""
    data = inflated(data)
    at, archive, names, version = 0, "", [], 1
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if data[at : at + 1] in (b"", b"\x00"):
            return
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        start = end + 1 if end >= 0 else len(data)
        if line.startswith("filedesc://"):
            # the names of the fields stand in the block itself; its own line has the length last in either version
            first, *rest = line.split(" ")
            length = int(rest[-1])
            said = data[start : start + length].decode("utf-8", "replace").split("\n")
            version, names, archive = int(said[0].split(" ")[0]), said[1].strip().split(" "), first.removeprefix("filedesc://")
        if not names:
            raise ValueError("an ARC archive without a version block")
        values = line.rsplit(" ", len(names) - 1)
        if len(values) < len(names) or not values[-1].isdigit():
            raise ValueError(f"a header line at {at} of {archive} that isn't one of version {version}")
        fields = dict(zip(names, values, strict=True))
        length = int(fields[names[-1]])
        block = data[start : start + length]
        yield ArcRecord(archive, at, version, fields, block, len(block) < length)
        at = start + length


ARC_KINDS = "path string, archive string, record_offset bigint, version int, url string, ip string, date string, mime string, key string, record_id string, is_http boolean, truncated boolean, payload_bytes bigint, payload_digest string"


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """What is known of each record but the version blocks, without its payload; key is the HTTP block's KEY_HEADER."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.split()[0], {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[f.split()[1]]) for f in ARC_KINDS.split(", ")])
        for whole in batches:
            for b in slices(whole, "content"):
                for at, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                    rows = []
                    for r in arc_records(data):
                        if not r.url.startswith("filedesc://"):
                            head, payload = r.parts()
                            rows.append((at, r.archive, r.offset, r.version, r.url, r.fields.get("IP-address"), r.date(), r.fields.get("Content-type"), http_header(head, KEY_HEADER), r.id(), r.is_http, r.truncated, len(payload), sha1(payload)))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files(spark, path).mapInArrow(run, ARC_KINDS)


# --- WARC


def warc_record(kind: str, record_id: str, date: str, block: bytes, content_type: str, more: dict[str, str | None]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": date, **more, "WARC-Block-Digest": f"sha1:{sha1(block)}", "Content-Type": content_type, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"".join((b"WARC/1.0\r\n", lines.encode(), b"\r\n", block, b"\r\n\r\n"))


def warcinfo(name: str, source: str = "-") -> bytes:
    block = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.0\r\ndescription: converted from {source}\r\n".encode()
    date = EPOCH.strftime("%Y-%m-%dT%H:%M:%SZ")
    return warc_record("warcinfo", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", date, block, "application/warc-fields", {"WARC-Filename": name})


def converted(r: ArcRecord, first: tuple[str, str, str] | None) -> bytes:
    """The WARC record of an ARC record; first has id, address and date of the response that it revisits."""
    head, payload = r.parts()
    more = {"WARC-Target-URI": r.url, "WARC-IP-Address": None if r.fields.get("IP-address") in (None, "-", "0.0.0.0") else r.fields["IP-address"], "WARC-Payload-Digest": f"sha1:{sha1(payload)}", "WARC-Truncated": "length" if r.truncated else None}
    if first:
        more |= {"WARC-Profile": IDENTICAL, "WARC-Refers-To": first[0], "WARC-Refers-To-Target-URI": first[1], "WARC-Refers-To-Date": first[2]}
        return warc_record("revisit", r.id(), r.date(), head, "application/http; msgtype=response", more)
    if r.is_http:
        return warc_record("response", r.id(), r.date(), r.block, "application/http; msgtype=response", more)
    return warc_record("resource", r.id(), r.date(), r.block, r.fields.get("Content-type", "application/octet-stream"), more)


def revisits(known: DataFrame, least: int = 0, order: str = "bigint") -> DataFrame:
    """path, decisions: for each archive the offsets of records whose payload an earlier response has, with that one's id, address and date.

    known is a table of read_arc(). Groups are reduced to their first response before they meet; an archive's list is bounded by
    the archive.
    """
    own = known.filter(F.col("is_http") & ~F.col("truncated") & (F.col("payload_bytes") >= least))
    place = F.struct(F.col("key").isNull().alias("lacks"), F.col("key").cast(order).alias("k"), "record_id", "url", "date")
    firsts = own.groupBy("payload_digest", "payload_bytes").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    named = join_keyed(own.select("path", "record_offset", "record_id", "payload_digest", "payload_bytes"), scratch(firsts, "warc-firsts"), ["payload_digest", "payload_bytes"])
    later = named.filter(F.col("record_id") != F.col("first.record_id"))
    return later.groupBy("path").agg(F.collect_list(F.struct("record_offset", F.col("first.record_id").alias("id"), F.col("first.url").alias("url"), F.col("first.date").alias("date"))).alias("decisions"))


def convert(spark: SparkSession, arc: str, warc: str, least: int = 0, order: str = "bigint", tag: str = "converted") -> None:
    """The ARC archives below arc as WARC archives below warc."""
    decided = scratch(revisits(scratch(read_arc(spark, arc), "arc-records"), least, order), "warc-decisions")
    found = files(spark, arc).join(F.broadcast(decided) if decided.count() <= MOST_ARCHIVES else decided, "path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Packer(tag, lambda name: warcinfo(f"{name}.warc.gz"))
        for whole in batches:
            for b in slices(whole, "content"):
                for data, decisions in zip(b.column("content").to_pylist(), b.column("decisions").to_pylist(), strict=True):
                    first = {d["record_offset"]: (d["id"], d["url"], d["date"]) for d in decisions or []}
                    for r in arc_records(data):
                        if not r.url.startswith("filedesc://"):
                            record = converted(r, first.get(r.offset))
                            if out.full(len(record)):
                                yield from out.packed()
                            out.add(record)
        yield from out.packed()

    put_files(found.select("content", "decisions").mapInArrow(run, "data binary"), warc)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of one archive's bytes."""
    data = inflated(data)
    at = 0
    while data[at : at + 5] == b"WARC/":
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError(f"a WARC header at {at} without an end")
        fields = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        length = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + length]
        at = end + 4 + length + 4


WARC_KINDS = "record_type string, record_id string, date string, url string, refers_to_id string, key string, payload_bytes bigint, payload_digest string, intact boolean, payload binary"


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records but the warcinfo ones. payload_bytes and payload_digest are the full payload's: of stored bytes they are worked out
    anew, of a revisit they come from its headers. intact says whether the digests in the headers are those of the bytes.
    payload is null for revisits, or if it isn't asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [f.split()[1] for f in WARC_KINDS.split(", ")]
        schema = pa.schema([(f.split()[0], {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[k]) for f, k in zip(WARC_KINDS.split(", "), kinds, strict=True)])
        for whole in batches:
            for b in slices(whole, "content"):
                for data in b.column("content").to_pylist():
                    rows = []
                    for f, block in warc_records(data):
                        if f["warc-type"] == "warcinfo":
                            continue
                        head, body = http_parts(block) if block[:5] == b"HTTP/" else (b"", block)
                        said, digest = f.get("warc-payload-digest", "").removeprefix("sha1:"), sha1(body)
                        again = f["warc-type"] == "revisit"
                        intact = f.get("warc-block-digest", "") in ("", f"sha1:{sha1(block)}") and (again or said in ("", digest))
                        size = int(http_header(head, "Content-Length") or 0) if again else len(body)
                        rows.append((f["warc-type"], f["warc-record-id"], f["warc-date"], f.get("warc-target-uri"), f.get("warc-refers-to"), http_header(head, KEY_HEADER), size, said if again else digest, intact, body if payload and not again else None))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files(spark, path).mapInArrow(run, WARC_KINDS)


def with_originals(records: DataFrame) -> DataFrame:
    """records (a table) with refers_to: the key of the response that a revisit names, looked up by its record id."""
    asked = records.filter(F.col("refers_to_id").isNotNull()).select(F.col("refers_to_id").alias("record_id")).distinct()
    found = records.select("record_id", "key").join(asked, "record_id", "left_semi").select(F.col("record_id").alias("refers_to_id"), F.col("key").alias("refers_to"))
    return join_keyed(records, scratch(found, "warc-originals"), "refers_to_id", "left")


def report(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the pages' records, read back from the archives.

    The archives are deleted when their records have been read.
    """
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType.simpleString()
    folder = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_arc(pages, f"{folder}/arc")
    convert(spark, f"{folder}/arc", f"{folder}/warc", least, kind)
    back = scratch(read_warc(spark, f"{folder}/warc", payload=False).drop("payload"), "warc-records")
    fs, p = file_system(spark, folder)
    fs.delete(p, True)
    out = with_originals(back)
    return out.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
