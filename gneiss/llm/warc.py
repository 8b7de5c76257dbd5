"""WARC archives, and a converter from the older ARC format that parses both of its header versions."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import look_up, new_path

#: Fixed values of the two formats: the fields of an ARC header line by version, and the line that declares them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARC_VERSIONS = {1: "1 0", 2: "2 0"}
WARC_VERSION = "WARC/1.1"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: How archives are written: gzip at its fastest.
COMPRESSED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Records of an archive, its first one that describes it included; after so many the next archive begins.
ARCHIVE_RECORDS = 1024


def header_value(text: str | None, missing: str = "-") -> str:
    """A value for a header line: white space and control characters are percent-encoded."""
    out = re.sub(r"[\x00-\x20\x7f\u0085   -     　]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text or "")
    return out or missing


def arc_record(version: int, url: str, ip: str, date: str, kind: str, content: bytes, file: str = "-", offset: int = 0, status: str = "200") -> bytes:
    more = [] if version == 1 else [status, hashlib.sha1(content).hexdigest(), "-", str(offset), file]
    return " ".join([url, ip, date, kind, *more, str(len(content))]).encode() + b"\n" + content


def arc_start(version: int, name: str, date: str) -> bytes:
    """The version block that begins an ARC file."""
    return arc_record(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", f"{ARC_VERSIONS[version]} gneiss\n{ARC_FIELDS[version]}\n".encode(), file=name)


def parse_arc(data: bytes) -> Iterator[dict]:
    """The version block of an ARC file, which says what fields a header line has, and its records. The declared
    length, the last field, says where a record ends; so lines in the content are never taken for headers. Each has `at`, its
    place in the file."""
    at, fields = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)]
        if not line.strip():
            at += len(line) + 1
            continue
        values = line.decode("utf-8", "replace").rstrip("\r").split(" ")
        if fields is None:
            content = data[end + 1 : end + 1 + int(values[-1])]
            said = content.decode("utf-8", "replace").split("\n")
            version, fields = int(said[0].split()[0]), said[1].split()
            if " ".join(fields) != ARC_FIELDS.get(version):
                raise ValueError(f"not an ARC version block: {said[:2]}")
            yield dict(zip(fields, values if len(values) == len(fields) else [*values[:4], *[""] * (len(fields) - 5), values[-1]], strict=True)) | {"version": version, "content": content, "at": at}
            at = end + 1 + len(content)
            continue
        if len(values) != len(fields):
            raise ValueError(f"an ARC header line of version {version} has {len(fields)} fields, not {len(values)}")
        record = dict(zip(fields, values, strict=True)) | {"version": version, "at": at}
        size = int(record["Archive-length"])
        record["content"] = data[end + 1 : end + 1 + size]
        if len(record["content"]) != size:
            raise ValueError(f"an ARC record of {record['URL']} declares {size} bytes and has {len(record['content'])}")
        yield record
        at = end + 1 + size


def http_parts(content: bytes) -> tuple[bytes, bytes]:
    head, _, body = content.partition(b"\r\n\r\n")
    return head + b"\r\n\r\n", body


def warc_date(arc_date: str) -> str:
    """The 14 digits of an ARC date, or fewer from the left, as a WARC date."""
    digits = (arc_date + "00000101000000"[len(arc_date) :])[:14]
    return datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def warc_id(*about: str) -> str:
    """An identifier that depends on the record alone, so a repeated task makes the same one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(about))}>"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record; declared lengths say where records end."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not head[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {data[at : at + 40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        size = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a WARC record of {headers.get('warc-target-uri')} doesn't end where it declares")
        at += 4


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20240101000000") -> None:
    """Writes ARC files of ARCHIVE_RECORDS records each, those of even partitions in version 1 and of odd ones in version 2.
    A record is an HTTP response with the html in UTF-8, and the id, of any type, as text in a header of its own. Null
    html is empty, and a null id has no header. Version 2 says where in its file a record begins."""
    from pyspark import TaskContext

    def records(batches):
        part, at, number = TaskContext.get().partitionId(), 0, 0
        version, name, offset = part % 2 + 1, "", 0
        for batch in batches:
            out = []
            for who, url, html in zip(*(batch[c].to_pylist() for c in ("id", "url", "html")), strict=True):
                if at % ARCHIVE_RECORDS == 0:  # the sink begins a file with this row
                    name, offset, number, at = f"part-{part}-{number}.arc", 0, number + 1, at + 1
                    out.append(arc_start(version, name, date).removesuffix(b"\n"))
                    offset += len(out[-1]) + 1
                body = (html or "").encode()
                mark = b"" if who is None else f"X-Page-Id: {quote(who, safe='')}\r\n".encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n".encode() + mark + b"\r\n" + body
                out.append(arc_record(version, header_value(url), "0.0.0.0", date, "text/html", http, name, offset))
                offset, at = offset + len(out[-1]) + 1, at + 1
            yield pa.record_batch({"value": pa.array([x.decode() for x in out], pa.string())})

    own = pages.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    own.mapInArrow(records, "value string").write.options(**COMPRESSED, lineSep="\n", maxRecordsPerFile=ARCHIVE_RECORDS).text(path)


def files(spark, path: str) -> DataFrame:
    """The bytes of each file; files have ARCHIVE_RECORDS records at most."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def content_of(path: str, data: bytes) -> bytes:
    return gzip.decompress(data) if path.endswith(".gz") else data


def rows_of(parse, schema: pa.Schema, rows: int = 256):
    """A function from batches of files to batches of what parse finds in each file."""

    def run(batches):
        held = []
        for batch in batches:
            for path, data in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                for row in parse(content_of(path, data.as_py())):
                    held.append(row)
                    if len(held) == rows:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], names=schema.names)
                        held = []
        if held:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], names=schema.names)

    return run


ARC_SCHEMA = pa.schema({"url": pa.string(), "ip": pa.string(), "date": pa.string(), "kind": pa.string(), "version": pa.int32(), "file": pa.string(), "at": pa.int64(), "page": pa.string(), "size": pa.int64(), "payload_digest": pa.string(), "content": pa.binary()})
FILEDESC = "filedesc://"


def read_arc(spark, path: str, packed: bool = False) -> DataFrame:
    """(url, ip, date, kind, version, file, at, page, size, payload_digest, content): the records of ARC files, version blocks
    among them; file is the name that the version block gives, and at the place in it. content is the HTTP response, as
    a zstd frame if packed, page its X-Page-Id as text, size and payload_digest those of its body."""

    def parse(data: bytes):
        import zstandard

        pack, file = zstandard.ZstdCompressor(level=1).compress if packed else bytes, None
        for r in parse_arc(data):
            about = r["URL"].startswith(FILEDESC)
            file = r["URL"].removeprefix(FILEDESC) if about else file
            head, body = (b"", r["content"]) if about else http_parts(r["content"])
            page = re.search(rb"(?i)\r\nX-Page-Id:[ ]?([^\r\n]*)", head)
            yield (r["URL"], r["IP-address"], r["Archive-date"], r["Content-type"], r["version"], file, r["at"], unquote(page[1].decode()) if page else None, len(body), hashlib.sha256(body).hexdigest(), pack(r["content"]))

    return files(spark, path).mapInArrow(rows_of(parse, ARC_SCHEMA), "url string, ip string, date string, kind string, version int, file string, at long, page string, size long, payload_digest string, content binary")


def arc_to_warc(arc: DataFrame, path: str, page_type: str = "long") -> None:
    """Writes the WARC equivalents of ARC records (the columns of read_arc, packed).

    The record id, date, types and digests, which ARC lacks, are made from the record and its place. A version block becomes
    a warcinfo record, which the records of its file refer to. Of records with equal payloads of at least LEAST_REVISIT
    bytes the one with the smallest X-Page-Id, taken as a page_type, stays a response, and the others become revisits that
    refer to it and keep the HTTP header alone; records with the same page id as that one are responses as well.
    Records without a page id come after all others; if all lack one, the one first by url, date, file and place is the
    response, and the others revisit it. Digests are grouped before the shuffle and joined by several tasks for a digest,
    so a payload in very many records is no task's alone.
    """
    whose = F.struct(F.col("page").isNull().alias("none"), F.col("page").cast(page_type).alias("order"), "page", "url", "date", "file", "at")
    slim = arc.where((F.col("size") >= LEAST_REVISIT) & ~F.col("url").startswith(FILEDESC)).select("payload_digest", whose.alias("first"))
    firsts = slim.groupBy("payload_digest").agg(F.min("first").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    marked = look_up(arc.withColumn("_place", F.xxhash64("file", "at")), "payload_digest", firsts, "_place")

    def identity(r: dict, digest: str) -> str:
        return warc_id(r["url"], r["date"], r["file"], str(r["at"]), digest)

    def records(batches):
        import zstandard

        unpacked = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                date, first, whole = warc_date(r["date"]), r["first"], unpacked(r["content"])
                info = warc_id(FILEDESC, r["file"])
                if r["url"].startswith(FILEDESC):
                    head = [WARC_VERSION, "WARC-Type: warcinfo", f"WARC-Record-ID: {info}", f"WARC-Date: {date}", f"WARC-Filename: {r['file']}", f"Content-Type: {r['kind']}", f"WARC-Block-Digest: sha256:{hashlib.sha256(whole).hexdigest()}", f"Content-Length: {len(whole)}"]
                    out.append("\r\n".join(head) + END + whole.decode())
                    continue
                same = first is not None and (first["page"] == r["page"] if r["page"] is not None else (first["file"], first["at"]) == (r["file"], r["at"]))
                revisit = first is not None and r["size"] >= LEAST_REVISIT and not same
                block = http_parts(whole)[0] if revisit else whole
                head = [WARC_VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {identity(r, r['payload_digest'])}", f"WARC-Warcinfo-ID: {info}", f"WARC-Date: {date}", f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}", "Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{r['payload_digest']}", f"Content-Length: {len(block)}"]
                if revisit:
                    head += [f"WARC-Refers-To: {identity(first, r['payload_digest'])}", f"WARC-Refers-To-Target-URI: {first['url']}", f"WARC-Refers-To-Date: {warc_date(first['date'])}", f"WARC-Profile: {REVISIT_PROFILE}", *([] if first["page"] is None else [f"X-Refers-To-Page-Id: {quote(first['page'], safe='')}"])]
                out.append("\r\n".join(head) + END + block.decode())
            yield pa.record_batch({"value": pa.array(out, pa.string())})

    own = marked.select("url", "ip", "date", "kind", "file", "at", "content", "payload_digest", "page", "size", F.col("first").dropFields("order").alias("first"))
    own.mapInArrow(records, "value string").write.options(**COMPRESSED, lineSep=END, maxRecordsPerFile=ARCHIVE_RECORDS).text(path)


WARC_SCHEMA = pa.schema({"record_id": pa.string(), "record_type": pa.string(), "url": pa.string(), "date": pa.string(), "page_id": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.string(), "payload": pa.binary(), "warcinfo": pa.string()})


def read_warc(spark, path: str, payloads: bool = True) -> DataFrame:
    """(record_id, record_type, url, date, page_id, payload_bytes, payload_digest, refers_to, payload, warcinfo): the records of
    WARC files; a revisit has no payload, and its length is that of its HTTP header. Every payload is checked against its
    digest; without payloads the column is null. Of a warcinfo record url is the name of the archive that it describes, and payload
    its text. Records that another program wrote may lack page ids, digests and HTTP lengths, which are null then."""

    def parse(data: bytes):
        for h, block in parse_warc(data):
            kind = h["warc-type"]
            if kind == "warcinfo":
                yield (h["warc-record-id"], kind, h.get("warc-filename"), h["warc-date"], None, len(block), None, None, block if payloads else None, None)
                continue
            head, body = http_parts(block)
            http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
            whole, digest, refers = kind == "response", h.get("warc-payload-digest", "").removeprefix("sha256:") or None, h.get("x-refers-to-page-id")
            if whole and digest and hashlib.sha256(body).hexdigest() != digest:
                raise ValueError(f"the payload of {h['warc-record-id']} isn't what its digest says")
            size = len(body) if whole else int(http["content-length"]) if "content-length" in http else None
            yield (h["warc-record-id"], kind, h.get("warc-target-uri"), h["warc-date"], unquote(http["x-page-id"]) if "x-page-id" in http else None, size, digest, None if refers is None else unquote(refers), body if whole and payloads else None, h.get("warc-warcinfo-id"))

    return files(spark, path).mapInArrow(rows_of(parse, WARC_SCHEMA), "record_id string, record_type string, url string, date string, page_id string, payload_bytes long, payload_digest string, refers_to string, payload binary, warcinfo string")


def convert_pages(pages: DataFrame, payloads: bool = True, id_col: str = "page_id", **columns: str) -> DataFrame:
    """Pages to ARC files, these to WARC files, and the responses and revisits that read_warc finds in them, with page_id and
    refers_to of the id's type. The files are in the shared folder."""
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc, id_col, **columns)
    arc_to_warc(read_arc(spark, arc, packed=True), warc, kind)
    out = read_warc(spark, warc, payloads).where("record_type <> 'warcinfo'")
    return out.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def op3_warc(spark, sf_dir: str) -> DataFrame:
    out = convert_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
