"""WARC archives: a writer with revisit records, and a salvage reader.

Writing: every page becomes a record, gzip-compressed on its own. Of pages with equal payloads the one
with the largest page_id is a response, the others are revisits that name it; groups are found by
digest, and only groups of two or more pages are joined back. The bytes go through Spark's text writer,
so they land wherever Spark can write: a gzip member of less than 16 MiB ends in a zero byte, which is
left to the writer as its line separator (longer ones get an empty member behind them).

Reading: files come as whole bytes. A record counts if its member's CRC, its version line, its length,
its closing line breaks and its block digest hold (for the CRC see below). Where one of them fails, the reader looks for the
next place where a whole valid member or version line begins, logs the bytes between as a quarantined
gap, and goes on. Inside a member it looks for version lines the same way, and if the member itself is
damaged (CRC, cut off, bad codes) the records that it still holds count if they carry a block digest.

Results: a null html is an empty payload, written and read like any other (all empty payloads are equal);
a null page_id counts as smaller than any other and comes back null; among repeated rows each is a record
of its own, and all with the largest page_id are responses; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.llm.common import checkpointed

VERSION, MAGIC = b"WARC/1.", b"\x1f\x8b\x08"
#: A file holds at most so many bytes of payloads (or one record), and its records' heads; pages of up to SMALL_PAGE bytes are written apart from larger ones.
FILE_BYTES, SMALL_PAGE = 1 << 30, 1 << 18
#: A header of more bytes than this is none.
HEADER_BYTES = 1 << 16
#: Compressed bytes read at once.
PIECE = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record, uncompressed. A revisit keeps the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose last byte is zero (four bytes of length, the highest last)."""
    out = gzip.compress(data, 5, mtime=0)
    return out if not out[-1] else out + gzip.compress(b"", 5, mtime=0)


def with_references(pages: DataFrame) -> DataFrame:
    """page_id, url, html (never null) and refers_to: the response's page_id for revisits."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha1", F.sha1("html"))
    groups = rows.groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    copies = checkpointed(groups.filter("n > 1").select("sha1", "keeper"))
    refers = F.when(F.coalesce(F.col("page_id") < F.col("keeper"), F.col("keeper").isNotNull()), F.col("keeper"))
    return rows.join(copies, "sha1", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES, small_page: int = SMALL_PAGE) -> None:
    """Archives of all pages under path, one file or more for each task, none with more than file_bytes of payloads but for a single larger one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = zip(pdf.page_id, pdf.url, pdf.html, pdf.refers_to, strict=True)
            whole = (member(record(None if pd.isna(i) else int(i), url, html.encode(), None if pd.isna(r) else int(r), date)) for i, url, html, r in rows)
            yield pd.DataFrame({"member": [m[:-1] for m in whole]})

    # ids travel as text: a column with nulls would turn into floats
    rows = with_references(pages).select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"))
    small = F.octet_length("html") <= small_page
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    for mode, part, most in (("error", rows.filter(small), small_page), ("append", rows.filter(~small), largest)):
        if mode == "append" and largest <= small_page:
            break
        written = part.mapInPandas(run, "member binary").select(F.col("member").cast("string").alias("value"))
        written.write.mode(mode).option("lineSep", "\u0000").option("maxRecordsPerFile", max(1, file_bytes // max(1, most))).text(path)


class Finder:
    """The next place of a byte string at or behind a place; places asked for do not go back, so each is searched for once."""

    def __init__(self, data: bytes):
        self.data, self.known = data, {}

    def __call__(self, what: bytes, at: int) -> int:
        place = self.known.get(what, at - 1)
        if 0 <= place < at or what not in self.known:
            place = self.known[what] = self.data.find(what, at)
        return place


def parse_record(data: bytes, at: int = 0, signed: bool = False, find: Finder | None = None) -> tuple[dict, int] | str:
    """The record at a place in uncompressed bytes and where it ends, or why there is none; signed: only with a block digest."""
    if data[at : at + len(VERSION)] != VERSION:
        return "no version line"
    head = find(b"\r\n\r\n", at) if find else data.find(b"\r\n\r\n", at, at + HEADER_BYTES)
    if not at <= head < at + HEADER_BYTES:
        return "header without an end"
    fields = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header line"
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        return "no content length"
    begin, end = head + 4, head + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        return "wrong content length"
    block = data[begin:end]
    said = fields.get("warc-block-digest", "")
    if signed and not said.startswith("sha1:"):
        return "no block digest"
    if said.startswith("sha1:") and said[5:] != digest(block):
        return "block digest differs"
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((v for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"), b"").strip()
    kind = fields.get("warc-type", "")
    claimed = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and claimed and claimed != digest(payload):
        return "payload digest differs"
    return {
        "record_type": kind,
        "record_id": fields.get("warc-record-id", ""),
        "refers_to": fields.get("warc-refers-to"),
        "target_uri": fields.get("warc-target-uri", ""),
        "payload_digest": claimed,
        "payload_bytes": int(length) if kind == "revisit" and length.isdigit() else len(payload),
        "payload": payload,
    }, end + 4


def inflate(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the member at a place decompresses to, where it ends, and why it is damaged (with the bytes before the damage)."""
    unzip, parts, end = zlib.decompressobj(31), [], at
    try:
        while not unzip.eof and end < len(data):  # in pieces: what is left over behind a member is copied
            parts.append(unzip.decompress(data[end : end + PIECE]))
            end += PIECE
    except zlib.error as e:
        # once more, byte by byte where it failed: an error takes the whole call's bytes with it
        unzip = zlib.decompressobj(31)
        parts = [unzip.decompress(data[at:end])]
        try:
            for k in range(end, min(end + PIECE, len(data))):
                parts.append(unzip.decompress(data[k : k + 1]))
        except zlib.error:
            pass
        return b"".join(parts), end, f"gzip: {e}"
    return b"".join(parts), min(end, len(data)) - len(unzip.unused_data), None if unzip.eof else "gzip: cut off"


def records_inside(plain: bytes, signed: bool) -> tuple[list[dict], list[str]]:
    """The records in a member's bytes, and the reason of each gap before, between or behind them."""
    records, reasons, at, find = [], [], 0, Finder(plain)
    while at < len(plain):
        found = parse_record(plain, at, signed, find)
        if isinstance(found, str):
            reasons.append(found)
            while isinstance(found, str):
                at = find(VERSION, at + 1)
                if at < 0:
                    return records, reasons
                found = parse_record(plain, at, signed, find)
        records.append(found[0])
        at = found[1]
    return records, reasons


def parse_at(data: bytes, at: int, find: Finder | None = None) -> tuple[list[dict], int | None, list[str]]:
    """The records of the member or plain record at a place, where it ends (None if it is damaged), and the reasons of gaps."""
    if data[at : at + 3] != MAGIC:
        found = parse_record(data, at, find=find)
        return ([], None, [found]) if isinstance(found, str) else ([found[0]], found[1], [])
    plain, end, damage = inflate(data, at)
    records, reasons = records_inside(plain, damage is not None)
    if damage:
        return records, None, [damage]
    return records, end if records or not reasons else None, reasons


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(offset, length, record, None) for records and (offset, length, None, reason) for quarantined gaps, in file order.

    Records and gaps inside a member have the member's place; those of a damaged member have its gap's.
    """
    at, find = 0, Finder(data)
    while at < len(data):
        records, end, reasons = parse_at(data, at, find)
        if end is None:
            gap, reason, given, again = at, reasons[0], list(records), list(records)
            while end is None:
                nexts = [p for p in (find(MAGIC, at + 1), find(VERSION, at + 1)) if p >= 0]
                if not nexts:
                    at = len(data)
                    break
                at = min(nexts)
                records, end, reasons = parse_at(data, at, find)
                if end is None:
                    given, again = given + records, again + records
                elif len(records) == 1 and records[0] in again and data[at : at + 3] != MAGIC:
                    # a record that its damaged member holds uncompressed
                    again.remove(records[0])
                    end = None
            for one in given:
                yield gap, at - gap, one, None
            yield gap, at - gap, None, reason
            if end is None:
                return
        for one in records:
            yield at, end - at, one, None
        for reason in reasons:
            yield at, end - at, None, reason
        at = end


FIELDS = ("record_type", "record_id", "refers_to", "target_uri", "payload_digest", "payload_bytes", "payload")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records and quarantined gaps of all archives under path.

    file, offset and length say where; gaps have a reason and no record, records have no reason. Files
    of up to 2 GB are read whole by one task each; the writer above keeps them within FILE_BYTES of payloads.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file", "offset", "length", "reason", *FIELDS]
        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content, strict=True):
                rows, size = [], 0
                for offset, length, one, reason in salvage(content):
                    one = dict(one or {})
                    if not payload:
                        one.pop("payload", None)
                    size += len(one.get("payload", b""))
                    rows.append((name, offset, length, reason, *(one.get(f) for f in FIELDS)))
                    if size > 1 << 24 or len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=columns).astype({"payload_bytes": "Int64"})
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=columns).astype({"payload_bytes": "Int64"})

    kinds = "file string, offset long, length long, reason string, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, kinds)
