"""Legacy archive converter: ARC files, versions 1 and 2, to WARC files.

ARC header lines differ by version; the version block at a file's head names the fields. Each record is a header line and
as many bytes as the line declares. The converter turns these into WARC records with identifiers, timestamps, types and
digests of their own, writes WARC files with Spark, and reads such files back by their declared lengths.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fpsample.llm.common import new_path, prepare, sized_broadcast, spread_join, written

#: Payloads shorter than this are never turned into revisits.
MIN_REVISIT_BYTES = 100
#: An ARC file is closed at about this many payload bytes.
ARC_BYTES = 4 << 20
#: Payload bytes up to which, and most records of a WARC file of such payloads: files hold some 128 MB at most, or one larger record.
WARC_FILES = ((1 << 16, 2000), (1 << 22, 32), (None, 1))
#: Revisits that are broadcast to the records, counted first (some 30 MB); beyond these both meet by record.
MOST_BROADCAST = 200_000
#: Payload bytes of a batch of records that a task gives out.
BATCH_BYTES = 8 << 20
#: Field names of the header line by version of the ARC format (fixed values).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space for URLs
_RECORD = "page_id long, record_type string, url string, ip string, date string, mime string, status int, record_id string, http string, payload binary, payload_bytes long, payload_digest string"


def arc_date_to_warc(date: str) -> str:
    """YYYYMMDDhhmmss, or its first 8 to 13 digits, as an ISO 8601 time in UTC."""
    d = (date + "00000000000000")[:14] if date.isdigit() and len(date) >= 8 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts: object) -> str:
    """A URN that is the same whenever the same record is converted again."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(0).join(map(str, parts)))}>"


def write_arc(records: list[tuple[str, str, str, bytes]], version: int, name: str) -> bytes:
    """An ARC file of (url, date, content type, network document) records; blanks in URLs are escaped."""
    body = f"{version} 0 archive\n{ARC_FIELDS[version]}\n\n".encode()
    tail = {1: f"text/plain {len(body)}", 2: f"text/plain 200 - - 0 {name} {len(body)}"}[version]
    parts = [f"filedesc://{name} 0.0.0.0 19960923142103 {tail}\n".encode(), body]
    offset = sum(map(len, parts))
    for url, date, mime, doc in records:
        url = "".join("%{:02X}".format(ord(c)) if c.isspace() else c for c in url) or "-"
        middle = {1: "", 2: f" 200 {hashlib.md5(doc).hexdigest()} - {offset} {name}"}[version]
        head = f"{url} 0.0.0.0 {date} {mime}{middle} {len(doc)}\n".encode()
        parts += [head, doc, b"\n"]
        offset += len(head) + len(doc) + 1
    return b"".join(parts)


def read_arc(content: bytes, filedesc: bool = False) -> Iterator[dict[str, object]]:
    """The records of an ARC file (gzipped or not) as dicts of the version's fields, with ``body`` and ``offset``; with ``filedesc``, version blocks as well.

    Header lines are read from the right, so that a URL may hold blanks. Raises ValueError where a header line or a declared
    length is broken: what follows cannot be found then.
    """
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at, fields = 0, ARC_FIELDS[1].split()
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):  # between records
            at += 1
            continue
        end = content.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line at {at} has no end")
        line = content[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if not (line[-1].isascii() and line[-1].isdigit()) or end + 1 + int(line[-1]) > len(content):
            raise ValueError(f"record at {at} declares {line[-1]!r} bytes")
        body = content[end + 1 : end + 1 + int(line[-1])]
        version = line[0].startswith("filedesc://")
        if version and body.count(b"\n") > 1:
            fields = body.split(b"\n")[1].decode("utf-8", "replace").split()
        if len(line) < len(fields):
            raise ValueError(f"header line at {at} has {len(line)} fields, not {len(fields)}")
        if filedesc or not version:
            rest = len(line) - len(fields) + 1
            yield dict(zip(fields, [" ".join(line[:rest]), *line[rest:]], strict=True)) | {"body": body, "offset": at}
        at = end + 1 + len(body)


def _pages_to_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files of alternating versions; each closes at ARC_BYTES."""
    held: list[tuple[str, str, str, bytes]] = []
    size = made = 0

    def close() -> pa.RecordBatch:
        nonlocal size, made
        made += 1
        blob = write_arc(held, 1 + made % 2, f"pages-{made}.arc")
        held.clear()
        size = 0
        return pa.RecordBatch.from_arrays([pa.array([f"pages-{made}.arc"]), pa.array([blob], pa.binary())], ["path", "content"])

    for b in batches:
        for page, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            payload = (html or "").encode()
            head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + ("" if page is None else f"X-Page-Id: {page}\r\n") + f"Content-Length: {len(payload)}\r\n\r\n"
            held.append((url or "", "20240101000000", "text/html", head.encode() + payload))
            size += len(payload)
            if size >= ARC_BYTES:
                yield close()
    if held:
        yield close()


def pages_to_arc(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """ARC files (path, content) of pages (page_id, url, html), within each partition; html is written in UTF-8, null as empty."""
    return prepare(spark) and pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_pages_to_arc, "path string, content binary")


def _number(text: object, other: int | None = None) -> int | None:
    """A decimal number of ASCII digits that fits 64 bits; ``other`` for anything else."""
    found = re.fullmatch(r"-?[0-9]{1,18}", str(text).strip())
    return int(found[0]) if found else other


def _split_http(body: bytes) -> tuple[str, bytes, int, int | None]:
    """Head, payload, status, page id; a body without an HTTP head is payload alone."""
    cut = body.find(b"\r\n\r\n")
    if not body.startswith(b"HTTP/") or cut < 0:
        return "", body, 0, None
    head = body[: cut + 4].decode("latin-1")
    page = next((x[11:] for x in head.split("\r\n") if x[:11].lower() == "x-page-id: "), None)
    return head, body[cut + 4 :], _number([*head.split(None, 2), "", ""][1], 0), _number(page)


def _record_row(r: dict[str, object]) -> tuple:
    """A WARC record's fields from an ARC record's: the version block is a warcinfo, an HTTP response a response, anything else a resource."""
    head, payload, status, page = _split_http(r["body"])
    kind = "warcinfo" if r["URL"].startswith("filedesc://") else "response" if head else "resource"
    digest = hashlib.sha256(payload).hexdigest()
    key = record_id(r["URL"], r["Archive-date"], page, digest)
    return (page, kind, r["URL"], r["IP-address"], arc_date_to_warc(str(r["Archive-date"])), r["Content-type"], status or _number(r.get("Result-code"), 0), key, head, payload, len(payload), digest)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _RECORD.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in _RECORD.split(", ")]
    for b in batches:
        for content in b.column("content").to_pylist():
            rows, size = [], 0
            try:
                for r in read_arc(content, filedesc=True):
                    rows.append(_record_row(r))
                    size += len(rows[-1][9])
                    if size > BATCH_BYTES:
                        yield _batch(rows, names, kinds)
                        rows, size = [], 0
            except ValueError:  # arc_rejects tells of it
                pass
            yield _batch(rows, names, kinds)


def _rejects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            n = 0
            try:
                for _ in read_arc(content, filedesc=True):
                    n += 1
            except ValueError as error:
                rows.append((path, n, str(error)))
        yield _batch(rows, ["path", "records_before", "reason"], [pa.string(), pa.int64(), pa.string()])


def arc_to_records(spark: SparkSession, arcs: DataFrame) -> DataFrame:
    """The records of ARC files (path, content), as Spark's binaryFile source gives them, with synthesised WARC identifiers, times, types (warcinfo, response, resource) and SHA-256 payload digests. Of a broken file the records before the break are given; arc_rejects names it."""
    return prepare(spark) and arcs.select("path", "content").mapInArrow(_convert, _RECORD)


def arc_rejects(spark: SparkSession, arcs: DataFrame) -> DataFrame:
    """(path, records_before, reason) of each ARC file that is broken: from there on its records cannot be found."""
    return prepare(spark) and arcs.select("path", "content").mapInArrow(_rejects, "path string, records_before long, reason string")


def find_revisits(spark: SparkSession, records: DataFrame) -> DataFrame:
    """(record_id, refers_to, refers_to_id) of each response that repeats a payload: of equal payloads of MIN_REVISIT_BYTES or more the one with the smallest page_id (then record_id) is the response. Only digests and ids are shuffled, never payloads; a digest of a great share of all records is spread."""
    slim = records.filter((F.col("payload_bytes") >= MIN_REVISIT_BYTES) & (F.col("record_type") == "response")).select("record_id", F.col("page_id").alias("own"), "payload_digest", "payload_bytes")
    slim = slim.withColumn("same", F.concat_ws(":", "payload_digest", "payload_bytes")).select("record_id", "own", "same")
    first = F.min(F.struct(F.col("own").isNull().alias("no_id"), F.col("own").alias("page_id"), F.col("record_id").alias("id")))
    groups = written(spark, slim.groupBy("same").agg(F.count("*").alias("n"), first.alias("first")).filter("n > 1"), "equal-payloads")
    found = spread_join(slim, groups, "same", "n", F.col("record_id")).filter(F.col("first.id") != F.col("record_id"))
    return found.select("record_id", F.col("first.page_id").alias("refers_to"), F.col("first.id").alias("refers_to_id")).distinct()


def _warc_record(r: DataFrame) -> Column:
    """A record as text: header lines, an empty line, the block. The writer ends each record with two line breaks."""
    revisit, info = F.col("refers_to_id").isNotNull(), F.col("record_type") == "warcinfo"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    block = F.when(revisit, F.col("http").cast("binary")).otherwise(F.concat(F.col("http").cast("binary"), F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.col("record_type"))),
        line("WARC-Record-ID", F.col("record_id")),
        F.when(info, line("WARC-Filename", F.substring_index("url", "/", -1))).otherwise(line("WARC-Target-URI", F.col("url"))),
        line("WARC-Date", F.col("date")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.col("refers_to_id")), F.when(F.col("refers_to").isNull(), F.lit("")).otherwise(line("X-Refers-To-Page-Id", F.col("refers_to").cast("string"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.when(F.col("record_type") == "response", F.lit("application/http; msgtype=response")).when(info, F.lit("text/plain")).otherwise(F.col("mime"))),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(head.cast("binary"), block)


def write_warc(spark: SparkSession, records: DataFrame, path: str | None = None) -> str:
    """Writes records as gzipped WARC files, sizes by WARC_FILES, into a new folder by Spark's own writer, which reaches any store; returns the folder. ``records`` is read several times: pass a written table.

    The text writer puts the bytes of a value unchanged and then the separator, which is the end of a WARC record.
    """
    path = path or new_path(spark, "warc")
    revisits = written(spark, find_revisits(spark, records), "revisits")
    whole = records.join(sized_broadcast(revisits, MOST_BROADCAST), "record_id", "left")
    text = whole.select("payload_bytes", _warc_record(whole).cast("string").alias("value"))
    least = -1
    for most, n in WARC_FILES:
        here = F.col("payload_bytes") > least
        here = here & (F.col("payload_bytes") <= most) if most else here
        if most == WARC_FILES[0][0] or not records.filter(here).select("payload_bytes").isEmpty():
            text.filter(here).select("value").write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", n).text(path)
        least = most
    return path


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a WARC file, gzipped or not, by declared length."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at {at}")
        head = dict(x.split(": ", 1) for x in content[at:end].decode().split("\r\n")[1:])
        head = {k.lower(): v for k, v in head.items()}
        start, n = end + 4, int(head["content-length"])
        if content[start + n : start + n + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end after {n} bytes")
        yield head, content[start : start + n]
        at = start + n + 4


_READ = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _record_read(head: dict[str, str], block: bytes) -> tuple:
    kind = head["warc-type"]
    payload, page = (block, None) if kind in ("warcinfo", "resource") else _split_http(block)[1::2]
    digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
    n, kept = len(payload), payload
    if kind == "revisit":  # its block is the HTTP head alone
        n, kept = _number(head.get("x-payload-length")), None
    elif digest and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {head['warc-record-id']} does not have its digest")
    return (head["warc-record-id"], page, head.get("warc-target-uri"), head["warc-date"], kind, head.get("warc-refers-to"), _number(head.get("x-refers-to-page-id")), n, digest, kept)


def _reader(payloads: bool):
    fields = [f for f in _READ if payloads or f.name != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content").to_pylist():
                rows, size = [], 0
                for head, block in parse_warc(content):
                    rows.append(_record_read(head, block)[: len(fields)])
                    size += len(block) if payloads else 64
                    if size > BATCH_BYTES:
                        yield _batch(rows, [f.name for f in fields], [f.type for f in fields])
                        rows, size = [], 0
                yield _batch(rows, [f.name for f in fields], [f.type for f in fields])

    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the WARC files in a folder, payloads checked against their digests; a revisit's payload is null, its length and digest are the full payload's."""
    files = prepare(spark).read.format("binaryFile").load(path).select("content")
    kinds = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    return files.mapInArrow(_reader(payloads), ", ".join(f"{f.name} {kinds[f.type]}" for f in _READ if payloads or f.name != "payload"))


def pages_through_warc(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages as ARC files, converted to WARC files in the shared folder, read back: one row per page with record_type and refers_to (the response's page_id).

    Null html is an empty payload, a null url "-"; null ids stay null. Pages repeated whole are one record each with the
    same identifier; where their payload is long enough, pages of one id and payload are the same record, so none revisits
    itself. Very long pages are records of files of their own. Columns besides page_id, url and html are not carried, whatever
    their names. An empty table writes no record and gives no row.
    """
    records = written(spark, arc_to_records(spark, pages_to_arc(spark, pages)), "arc-records")
    return read_warc(spark, write_warc(spark, records), payloads=False).filter(F.col("record_type").isin("response", "revisit"))
