"""WARC archives: write pages as records, and read archives back, damaged ones too.

``write`` makes a folder of archives of some ARCHIVE_BYTES each (a larger record
has one of its own): a warcinfo record, then a record a page, each in a gzip member
of its own, or plain. Of pages with equal payloads of at least REVISIT_BYTES the
one of the least id is a response, the others are revisits, which hold the head
and the digest but not the payload. Spark's own writer commits the archives.

``salvage`` reads a folder of archives, a task an archive. A member must inflate
and match its checksum, a record's head must parse, its block be as long as stated
and match its digests. Where a check fails, the reader looks for the next gzip
member or version line from which a whole record can be read that passes all
checks, goes on there, and returns the bytes in between as a gap with the reason.
If the damaged record's own extent is sure (a member that inflates, a plain block
whose end is followed by a record), nothing inside it is taken for a record.

Defined cases: a null html is an empty payload; a null url leaves the head out,
and control characters and blanks in a url are percent-encoded; a null page_id is
never the least of its group and refers to the least known one, and if there is no
other all are responses; repeated rows of the least id are all responses; an empty
table makes no archive, and an empty folder no rows. Only page_id, url and html are
read, so other columns, whatever their names, do not matter. A record is held whole
while it is written or read, as is an archive, which may take 2 GB at most.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.leastid import least_ids, sized

VERSION = b"WARC/1.1"
#: Bytes of an archive, as written, after which the next one begins.
ARCHIVE_BYTES = 8 << 20
#: Payloads below so many bytes are never revisits.
REVISIT_BYTES = 100
#: The table has no time of fetching; archives must have one.
FETCHED = "1970-01-01T00:00:00Z"
LEVEL = 6

# Fixed values of the format.
_GZIP, _END = b"\x1f\x8b\x08", b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_ID = re.compile(r"<urn:page:(-?\d*):([0-9a-f]{64})>")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def page_of(record: str | None) -> int | None:
    """The page_id that a record id was made of."""
    found = _ID.fullmatch(record or "")
    return int(found[1]) if found and found[1] else None


def record(kind: str, rid: str, block: bytes, fields: list[tuple[str, str | None]] = ()) -> bytes:
    """One record as bytes, ended by the two empty lines."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), *fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return b"".join([VERSION, b"\r\n", *(f"{k}: {v}\r\n".encode() for k, v in head if v is not None), b"\r\n", block, _END])


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = FETCHED) -> bytes:
    """A response, or a revisit of that page. Both have the head of the page as fetched, only the response its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = None if url is None else re.sub(r"[\x00-\x20\x7f-\x9f]", lambda c: "".join(f"%{b:02X}" for b in c[0].encode()), url)
    fields = [("WARC-Date", date), ("WARC-Target-URI", target), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is None:
        return record("response", record_id(page_id, digest), http + payload, fields)
    return record("revisit", record_id(page_id, digest), http, [*fields, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))])


def member(content: bytes) -> bytes:
    """A gzip member; no time or name is in its head, so equal records are equal members."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


def _archives(batches: Iterator[pa.RecordBatch], compress: bool, most: int) -> Iterator[pa.RecordBatch]:
    """A row for each archive, without its last byte, which the text writer puts back."""
    held: list[bytes] = []
    size = 0

    def add(content: bytes) -> None:
        nonlocal size
        held.append(member(content) if compress else content)
        size += len(held[-1])

    def flush() -> pa.RecordBatch:
        nonlocal size
        content = b"".join(held).removesuffix(_last(compress))
        held.clear()
        size = 0
        return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["archive"])

    for batch in batches:
        for page, url, payload, digest, refers in zip(*batch.columns, strict=True):
            if not held:
                info = b"software: siltstone\r\nformat: WARC File Format 1.1\r\n"
                add(record("warcinfo", f"<urn:warcinfo:{hashlib.sha256(info).hexdigest()}>", info, [("WARC-Date", FETCHED), ("Content-Type", "application/warc-fields")]))
            add(page_record(page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py()))
            if size >= most:
                yield flush()
    if held:
        yield flush()


def _last(compress: bool) -> bytes:
    """A member of a record below 16 MiB ends with a zero byte, its length's highest; behind another one, the zero is padding."""
    return b"\0" if compress else b"\n"


def with_revisits(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is the least page of an equal payload, null for responses."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    large = whole.where(F.length("payload") >= least_bytes).select("page_id", "digest")
    least = least_ids(large, "digest", "page_id").withColumnsRenamed({"digest": "of", "least": "first"})
    joined = whole.join(sized(least), (whole["digest"] == least["of"]) & (F.length("payload") >= least_bytes), "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return joined.select("page_id", "url", "payload", "digest", F.when(again, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, to: str, compress: bool = True, archive_bytes: int = ARCHIVE_BYTES, least_bytes: int = REVISIT_BYTES) -> None:
    """Write pages (page_id, url, html) as a new folder of archives."""
    archives = with_revisits(pages, least_bytes).mapInArrow(lambda batches: _archives(batches, compress, archive_bytes), "archive binary")
    # The text writer puts a string's bytes and the separator into the file, whatever the bytes are.
    archives.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", _last(compress).decode()).text(to)


class Found(NamedTuple):
    """What a stretch of an archive holds: a record, or a gap (then only reason is set)."""

    offset: int
    length: int
    reason: str | None = None
    kind: str | None = None
    record: str | None = None
    url: str | None = None
    refers_to: str | None = None
    payload_bytes: int | None = None
    payload_digest: str | None = None
    payload: bytes | None = None


class Damaged(ValueError):
    """A failed check. end: where the damaged stretch ends, if that is sure."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.end = end


def _inflated(content: bytes, at: int) -> tuple[bytes, int]:
    """A member's content and its end."""
    unpacker = zlib.decompressobj(31)
    parts, pos = [], at
    try:
        while not unpacker.eof and pos < len(content):
            # In pieces, so that a member's end is found without a copy of what follows it.
            piece = memoryview(content)[pos : pos + (1 << 16)]
            parts.append(unpacker.decompress(piece))
            pos += len(piece)
    except zlib.error as e:
        raise Damaged("member: " + re.sub(r"^Error (-?\d+) .*: (.*)$", r"\2", str(e))) from None
    if not unpacker.eof:
        raise Damaged("member: cut off")
    return b"".join(parts), pos - len(unpacker.unused_data)


def _digest(fields: dict[str, str], name: str) -> str | None:
    """Of a labelled digest the SHA-256; other algorithms aren't checked."""
    label, _, value = fields.get(name, "").partition(":")
    return value.strip().lower() if label.strip().lower() in ("sha256", "sha-256") else None


def _parsed(content: bytes, at: int, end: int) -> tuple[Found, int]:
    """The record that begins at a place, checked, and its end; no record goes beyond end."""
    line = _VERSION_LINE.match(content, at, end)
    if not line:
        raise Damaged("no version line")
    stop = content.find(_END, line.end() - 2, end)
    if stop < 0:
        raise Damaged("head: no end")
    fields: dict[str, str] = {}
    for row in content[line.end() : stop].split(b"\r\n") if stop > line.end() else ():
        name, colon, value = row.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise Damaged("head: not a field")
        fields[name.decode().lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length) or "warc-type" not in fields or "warc-record-id" not in fields:
        raise Damaged("head: a field is missing")
    first = stop + 4
    past = first + int(length)
    if past + 4 > end:
        raise Damaged("block: cut off")
    if content[past : past + 4] != _END:
        raise Damaged("block: not as long as stated")
    # From here on the record's extent is sure if another record, or nothing, follows it.
    sure = past + 4 if past + 4 == end or _VERSION_LINE.match(content, past + 4, end) else None
    block = memoryview(content)[first:past]
    stated = _digest(fields, "warc-block-digest")
    if stated and stated != hashlib.sha256(block).hexdigest():
        raise Damaged("block: digest", sure)
    kind, payload, size, own = fields["warc-type"], bytes(block), len(block), None
    if fields.get("content-type", "").replace(" ", "").startswith("application/http"):
        http = content.find(_END, first, past)
        if http < 0:
            raise Damaged("block: no end of the HTTP head", sure)
        payload = content[http + 4 : past]
        size = len(payload)
        if kind == "revisit":  # the payload is elsewhere; the head says how long it is
            found = re.search(rb"\r\nContent-Length:[ \t]*([0-9]{1,18})\r\n", content[first : http + 2], re.IGNORECASE)
            size = int(found[1]) if found else None
    digest = _digest(fields, "warc-payload-digest")
    if kind != "revisit":
        own = hashlib.sha256(payload).hexdigest()
        if digest and digest != own:
            raise Damaged("payload: digest", sure)
    return Found(at, past + 4 - at, None, kind, fields["warc-record-id"], fields.get("warc-target-uri"), fields.get("warc-refers-to"), size, own or digest, None if kind == "revisit" else payload), past + 4


def _read_at(content: bytes, at: int) -> tuple[list[Found], int]:
    """The records that begin at a place, several if a member holds several, and where the next may begin; Damaged if none is whole."""
    if content.startswith(b"\x1f\x8b", at):
        inside, end = _inflated(content, at)
        out, pos = [], 0
        try:
            while pos < len(inside):
                found, pos = _parsed(inside, pos, len(inside))
                out.append(found._replace(offset=at, length=end - at))
        except Damaged as e:
            raise Damaged(str(e), end) from None
        return out, end
    found, end = _parsed(content, at, len(content))
    return [found], end


def _candidates(content: bytes, at: int) -> Iterator[int]:
    """Places from at on where a member or a version line may begin, in order."""
    gzip, line = content.find(_GZIP, at), _VERSION_LINE.search(content, at)
    while gzip >= 0 or line:
        if line and (gzip < 0 or line.start() < gzip):
            yield line.start()
            line = _VERSION_LINE.search(content, line.start() + 1)
        else:
            yield gzip
            gzip = content.find(_GZIP, gzip + 1)


def scan(content: bytes) -> Iterator[Found]:
    """All that an archive holds, in order: records that pass every check, and the gaps between them."""
    at = 0
    while at < len(content):
        if content[at] == 0 and not content[at:].strip(b"\0"):
            return  # padding
        try:
            found, at = _read_at(content, at)
            yield from found
            continue
        except Damaged as e:
            reason, start, sure = str(e), at, e.end
        at, found = sure or len(content), []
        for place in () if sure else _candidates(content, start + 1):
            try:
                found, end = _read_at(content, place)
            except Damaged as e:
                if e.end is None:
                    continue
                end = place  # damaged too, but its extent is sure: the next round makes it a gap of its own
            at = place
            break
        yield Found(start, at - start, reason)
        if found:
            yield from found
            at = end


_SCHEMA = "archive string, offset long, length long, reason string, kind string, record string, url string, refers_to string, payload_bytes long, payload_digest string, payload binary"
_ARROW = [pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]


def _salvaged(batches: Iterator[pa.RecordBatch], with_payload: bool, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    names = ["archive", *Found._fields]

    def rows(path: str, held: list[Found]) -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([path] * len(held), pa.string()), *(pa.array(c, kind) for c, kind in zip(columns, _ARROW, strict=True))], names)

    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            held, size = [], 0
            for found in scan(content.as_py()):
                held.append(found if with_payload else found._replace(payload=None))
                size += 500 + len(held[-1].payload or b"")
                if size >= most:
                    yield rows(path.as_py(), held)
                    held, size = [], 0
            if held:
                yield rows(path.as_py(), held)


def salvage(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """What the archives of a folder hold, a row for each record and each gap.

    (archive, offset, length, reason, kind, record, url, refers_to, payload_bytes, payload_digest, payload):
    reason is null for a record, and all that follows is null for a gap. Offsets and lengths are in the
    archive as it is stored. A revisit's payload is null, its bytes and digest are those of the page it saw.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(folder).select("path", "content")
    return files.mapInArrow(lambda batches: _salvaged(batches, with_payload), _SCHEMA)


def gaps(salvaged: DataFrame) -> DataFrame:
    """The log of quarantined bytes: (archive, offset, length, reason)."""
    return salvaged.where("reason is not null").select("archive", "offset", "length", "reason")


def unresolved(salvaged: DataFrame) -> DataFrame:
    """(refers_to, revisits): records that revisits refer to and that were not salvaged as responses of that digest."""
    wanted = salvaged.where("kind = 'revisit'").groupBy("refers_to", "payload_digest").agg(F.count("*").alias("revisits"))
    there = salvaged.where("kind = 'response'").select(F.col("record").alias("refers_to"), "payload_digest").distinct()
    return wanted.join(there, ["refers_to", "payload_digest"], "left_anti").select("refers_to", "revisits")


def page(column: str) -> Column:
    """The page_id in a record id's column."""
    found = F.regexp_extract(column, _ID.pattern, 1)
    return F.when(found != "", found.cast("long"))


def digest(salvaged: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page's record."""
    pages = salvaged.where("kind in ('response', 'revisit')")
    return pages.select(page("record").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), page("refers_to").alias("refers_to"))


ORACLE = r"""
WITH whole AS (
  SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages
), first AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload) AS least FROM whole
)
SELECT page_id, payload_bytes, sha256(payload) AS payload_digest,
       CASE WHEN payload_bytes >= 100 AND least IS NOT NULL AND (page_id IS NULL OR page_id > least) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND least IS NOT NULL AND (page_id IS NULL OR page_id > least) THEN least END AS refers_to
FROM first
"""
