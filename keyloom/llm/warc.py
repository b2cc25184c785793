"""WARC 1.1 archives: writing, parsing, segment reassembly and chunked-transfer decoding.

An archive is a byte string of whole records, held in a table (archive, data) so that any store Spark can write holds
it; `read_archives` also takes `spark.read.format("binaryFile")` rows renamed to those columns.

* A response block over `segment_bytes` is cut: the first record carries WARC-Segment-Number 1, the rest are
  `continuation` records with WARC-Segment-Origin-ID and their number; the last has WARC-Segment-Total-Length.
* Reading groups the pieces by origin identifier, orders them by segment number, verifies that numbers run 1..n
  without a gap, that the total length is stated and met, and then decodes chunked framing.
* Pieces are sorted on disk-backed partitions and joined one record at a time; no task holds a group of records.

* Revisits are resolved against the responses read.

Defined results. Null payload: an empty one. Null ids: written without an id and read back as null. Ids are long
numbers; others are cast. Ties: if several rows share the smallest id of a payload, each of them is a response. Repeated
rows: one record each. A piece that occurs twice (same origin and number) counts once. Damaged records keep their row
with `status` other than ``ok`` (``missing_segment``, ``length_mismatch``, ``bad_chunk``, ``digest_mismatch``,
``truncated``, ``dangling``, ``bad_header`` with type ``damaged``) and a null payload digest; reading goes on with the
next record. Foreign archives: digests other than sha256 are not checked, referrals by other ids are resolved by record
id and have no refers_to. Very long payloads are cut into segments. Empty tables give empty results. Extra columns of
the input are not archived; names cannot clash, as only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm._shared import small_batches, written

CRLF = b"\r\n"
START = re.compile(rb"^WARC/[0-9]+\.[0-9]+\r?$", re.M)
NUMBER = re.compile("[0-9]{1,18}")
LONG = re.compile("-?[0-9]{1,18}")
OWN_ID = re.compile(r"^(<urn:page:[^:]*:[0-9a-f]{16})\.[0-9.]+>$")
REFERS = r"^<urn:page:(-?[0-9]+):[0-9a-f]{16}"
ARCHIVE_SCHEMA = "archive string, data binary"
PIECE_SCHEMA = "origin string, segment int, total long, id long, uri string, type string, refers string, digest string, complete boolean, block binary, payload_bytes long, payload_digest string, status string"
RECORD_SCHEMA = "id long, uri string, type string, refers string, payload_bytes long, payload_digest string, segments int, status string, record string"


# ---- bytes of one record -------------------------------------------------------------------------------------------


def chunked(payload: bytes, size: int = 8192) -> bytes:
    """Chunked transfer framing of a payload."""
    out = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out += [b"%x" % len(part), CRLF, part, CRLF]
    out.append(b"0\r\n\r\n")
    return b"".join(out)


def dechunked(data: bytes) -> bytes | None:
    """Inverse of `chunked` (chunk extensions and trailers are skipped); None if the framing is damaged."""
    out, at = [], 0
    while True:
        end = data.find(CRLF, at)
        if end < 0:
            return None
        try:
            n = int(data[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = end + 2
        if n == 0:
            return b"".join(out)
        if n < 0 or data[at + n : at + n + 2] != CRLF:
            return None
        out.append(data[at : at + n])
        at += n + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return CRLF.join([*lines, b"", block, b"", b""])


def one_line(s: str) -> str:
    """A header value without line breaks (they are percent-encoded)."""
    return s.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in s or "\n" in s else s


def record_id(page: int | None, digest: str, suffix: str = "") -> str:
    """The name of a page's record: its id and the first 64 bits of its payload's digest; rows that agree in both, and rows
    without an id, get a suffix, too."""
    return f"<urn:page:{page}:{digest[:16]}{'.' + suffix if suffix else ''}>"


def stem(rid: str | None) -> str | None:
    """A record id without the suffix of repeated rows: what a revisit of any of them refers to."""
    return OWN_ID.sub(r"\1>", rid) if rid else rid


def page_records(rid: str, page: int | None, uri: str | None, payload: bytes, refers_to: int | None, digest: str, segment_bytes: int, date: str) -> Iterator[bytes]:
    """The records of one page: a revisit, a response, or a response with its continuations."""
    common = [("WARC-Date", date)] + ([("WARC-Target-URI", one_line(uri))] if uri else []) + ([("X-Page-ID", str(page))] if page is not None else [])
    head = [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", rid), ("WARC-Profile", profile), ("WARC-Refers-To", record_id(refers_to, digest)), *common, *head], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", rid), *common, *head]
    if len(block) <= segment_bytes:
        yield record(first, block)
        return
    n = -(-len(block) // segment_bytes)
    for k in range(n):
        part = block[k * segment_bytes : (k + 1) * segment_bytes]
        if k == 0:
            yield record([*first, ("WARC-Segment-Number", "1")], part)
        else:
            last = [("WARC-Segment-Total-Length", str(len(block)))] if k == n - 1 else []
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{rid[:-1]}/{k + 1}>"), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", str(k + 1)), *last, *common], part)


def whole_number(text: str | None) -> int | None:
    """A header's number of at most 18 digits; None for anything else."""
    return int(text) if text is not None and NUMBER.fullmatch(text) else None


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(headers with lower-case names, block, whether it is whole) of each record.

    Bytes that are no record's beginning are passed over up to the next line that is one. A record whose length is not
    stated ends there too and counts as not whole, as one does whose stated length runs past the archive's end or to
    where no record ends; reading then goes on after its header.
    """
    at = 0
    while (found := START.search(data, at)) is not None:
        at = found.start()
        end, after = data.find(b"\r\n\r\n", at), START.search(data, found.end())
        following = after.start() if after else len(data)
        if end < 0 or end > following:
            yield {"warc-damaged": "header"}, b"", False
            at = following
            continue
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n, start = whole_number(head.get("content-length")), end + 4
        if n is None:
            yield head, data[start:following], False
            at = following
            continue
        stop = start + n
        after_it = data[stop : stop + 4]
        ends = not after_it.strip(CRLF) or START.match(data, stop + len(after_it) - len(after_it.lstrip(CRLF)))
        yield head, data[start:stop], stop <= len(data) and bool(ends)
        at = stop if stop <= len(data) and ends else start


def http_payload(block: bytes) -> tuple[bytes | None, dict[str, str]]:
    """Payload of an HTTP response block (chunks decoded; None if damaged) and its headers."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None, {}
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    return (dechunked(body) if headers.get("transfer-encoding", "").lower() == "chunked" else body), headers


# ---- writing --------------------------------------------------------------------------------------------------------


def with_referrals(pages: DataFrame, page_id: str, payload: str, uri: str, min_bytes: int) -> DataFrame:
    """(id, uri, body, refers_to, digest, again): equal payloads of min_bytes or more point to the smallest id; `again` marks
    rows whose id and payload another row has, too, and rows without an id.

    Only (digest, id) pairs are shuffled to find the groups; the payloads then meet their referral by id, a key that
    no group of copies makes hot. Only the named columns are read, so names cannot clash.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    wide = pages.select(F.col(page_id).cast("long").alias("id"), F.col(uri).alias("uri"), body.alias("body"), F.sha2(body, 256).alias("digest"))
    skinny = wide.filter("id IS NOT NULL").groupBy("digest", "id").agg(F.count("*").alias("rows"), F.first(F.length("body") >= min_bytes).alias("large"))
    firsts = skinny.filter("large").groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("digest", "first")
    marks = skinny.join(firsts, "digest", "left").select("id", "digest", F.when(F.col("large") & (F.col("id") > F.col("first")), F.col("first")).alias("refers_to"), (F.col("rows") > 1).alias("again"))
    marks = marks.filter("refers_to IS NOT NULL OR again")
    out = wide.join(marks, ["id", "digest"], "left")
    return out.select("id", "uri", "body", "refers_to", "digest", (F.col("id").isNull() | F.coalesce("again", F.lit(False))).alias("again"))


def write_archives(pages: DataFrame, page_id: str = "page_id", payload: str = "html", uri: str = "url", *, min_bytes: int = 100, segment_bytes: int = 16384, archive_bytes: int = 1 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives (archive, data) of about archive_bytes each, holding a record per row of pages."""
    small_batches(pages)
    rows = with_referrals(pages, page_id, payload, uri, min_bytes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[bytes] = []
        size = n = files = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"part-{task:06d}-{files:05d}.warc"], "data": [b"".join(held)]}, schema=pa.schema([("archive", pa.string()), ("data", pa.binary())]))

        for batch in batches:
            for k in range(batch.num_rows):
                pid, link, body, refers_to, digest, again = (batch.column(c)[k].as_py() for c in range(6))
                n += 1
                for r in page_records(record_id(pid, digest, f"{task}.{n}" if again or refers_to is not None else ""), pid, link, body, refers_to, digest, segment_bytes, date):
                    held.append(r)
                    size += len(r)
                    if size >= archive_bytes:
                        yield flush()
                        held, size, files = [], 0, files + 1
        if held:
            yield flush()

    return rows.mapInArrow(pack, ARCHIVE_SCHEMA)


# ---- reading --------------------------------------------------------------------------------------------------------


def read_pieces(archives: DataFrame) -> DataFrame:
    """One row per record of the archives. A whole record is decoded here; a piece keeps its block. Request, metadata
    and other types are skipped."""
    small_batches(archives)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("origin", "segment", "total", "id", "uri", "type", "refers", "digest", "complete", "block", "payload_bytes", "payload_digest", "status")
        schema = pa.schema(list(zip(names, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.binary(), pa.int64(), pa.string(), pa.string()), strict=True)))
        for batch in batches:
            for data in batch.column("data"):
                rows: list[tuple] = []
                for head, block, whole in parse(data.as_py() or b""):
                    kind = "damaged" if "warc-damaged" in head or not head.get("warc-type") else head["warc-type"]
                    if kind not in ("response", "revisit", "continuation", "damaged"):
                        continue
                    row = piece(head, kind, block, whole)
                    if row[1] is None:
                        *_, length, digest, _, status, _ = joined([row])
                        row = (*row[:9], None, length, digest, status)
                    else:
                        row = (*row, None, None, None)
                    rows.append(row)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return archives.select("data").mapInArrow(unpack, PIECE_SCHEMA)


def piece(head: dict[str, str], kind: str, block: bytes, whole: bool) -> tuple:
    """A record's header fields and block as PIECE_SCHEMA's first ten columns. Numbers that are none count as not stated;
    a continuation without a segment number has number 0, which no record's pieces have."""
    number, total, page = whole_number(head.get("warc-segment-number")), whole_number(head.get("warc-segment-total-length")), head.get("x-page-id", "")
    if number is not None and number >= 1 << 31 or number is None and kind == "continuation":
        number = 0
    origin = head.get("warc-segment-origin-id", head.get("warc-record-id"))
    return origin, number, total, int(page) if LONG.fullmatch(page) else None, head.get("warc-target-uri"), kind, stem(head.get("warc-refers-to")), head.get("warc-payload-digest"), whole, block


def joined(pieces: list[tuple]) -> tuple:
    """The record of one origin's pieces, in order of their numbers: a row of RECORD_SCHEMA."""
    if pieces[0][5] == "damaged":
        return None, None, "damaged", None, None, None, 1, "bad_header", None
    first = next((p for p in pieces if p[5] != "continuation"), None)
    numbers = [p[1] for p in pieces]
    status, block = "ok", b""
    if first is None or (len(pieces) > 1 or numbers[0] is not None) and numbers != list(range(1, len(pieces) + 1)):
        status = "missing_segment"
    else:
        block = b"".join(p[9] for p in pieces)
        if not all(p[8] for p in pieces):
            status = "truncated"
        elif numbers[0] is not None:
            total = pieces[-1][2]
            status = "missing_segment" if total is None else "ok" if total == len(block) else "length_mismatch"
    head = first or pieces[0]
    length = digest = None
    if status == "ok":
        payload, http = http_payload(block)
        stated = head[7].removeprefix("sha256:") if head[7] and head[7].startswith("sha256:") else None  # others are not checked
        if payload is None:
            status = "bad_chunk"
        elif head[5] == "revisit":
            length, digest = whole_number(http.get("content-length")), stated
        else:
            length, digest = len(payload), hashlib.sha256(payload).hexdigest()
            if stated not in (None, digest):
                status, digest = "digest_mismatch", None
    return head[3], head[4], head[5], head[6], length, digest, len(pieces), status, head[0]


def reassemble(pieces: DataFrame) -> DataFrame:
    """RECORD_SCHEMA rows: pieces dealt by origin, sorted by (origin, number) and joined as they stream by."""
    dealt = pieces.repartition(F.col("origin")).sortWithinPartitions("origin", "segment")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("uri", pa.string()), ("type", pa.string()), ("refers", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("segments", pa.int32()), ("status", pa.string()), ("record", pa.string())])
        group: list[tuple] = []
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and (row[0] != group[-1][0] or row[0] is None):
                    rows.append(joined(group))
                    group = []
                if row[12] is not None:
                    rows.append((*row[3:7], row[10], row[11], 1, row[12], row[0]))
                elif not group or row[1] != group[-1][1]:
                    group.append(row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows = []
        if group:
            rows.append(joined(group))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return dealt.mapInArrow(join, RECORD_SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """RECORD_SCHEMA rows with revisits checked against the responses read: refers_to is the id of the page referred to;
    a revisit whose response is not there, or has another length or digest, has status ``dangling``.

    What revisits claim is aggregated before it meets the responses, so that a payload with very many revisits is one row.
    """
    records = written(records, "records")
    stems = F.regexp_replace("record", OWN_ID.pattern, "$1>")
    claims = records.filter("type = 'revisit' AND status = 'ok'").groupBy("refers", "payload_bytes", "payload_digest").agg(F.count("*").alias("n"))
    there = records.filter("type = 'response' AND status = 'ok'").select(stems.alias("refers"), F.col("payload_bytes").alias("has_bytes"), F.col("payload_digest").alias("has_digest")).distinct()
    same = F.coalesce(F.col("payload_bytes") == F.col("has_bytes"), F.lit(True)) & F.coalesce(F.col("payload_digest") == F.col("has_digest"), F.lit(True))
    good = claims.join(there, "refers").filter(same).select("refers", "payload_bytes", "payload_digest").distinct()
    both = lambda c: F.col(f"c.{c}").eqNullSafe(F.col(f"g.{c}"))
    bad = claims.alias("c").join(good.alias("g"), both("refers") & both("payload_bytes") & both("payload_digest"), "left_anti")
    bad = written(bad.select(F.col("refers").alias("r"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d")), "dangling")
    claim = F.col("refers").eqNullSafe(F.col("r")) & F.col("payload_bytes").eqNullSafe(F.col("b")) & F.col("payload_digest").eqNullSafe(F.col("d"))
    out = records.withColumn("refers_to", F.regexp_extract("refers", REFERS, 1).try_cast("long"))
    if bad.isEmpty():
        return out
    dangling = F.col("marked") & (F.col("type") == "revisit") & (F.col("status") == "ok")
    out = out.join(bad.withColumn("marked", F.lit(True)), claim, "left")
    return out.withColumn("status", F.when(dangling, "dangling").otherwise(F.col("status"))).withColumn("payload_digest", F.when(dangling, None).otherwise(F.col("payload_digest"))).drop("r", "b", "d", "marked")


def read_archives(archives: DataFrame) -> DataFrame:
    """RECORD_SCHEMA rows and refers_to of archives. Whole records are decoded where they are read; of the shuffled bytes
    only pieces have blocks."""
    return resolved(reassemble(read_pieces(archives)))


def round_trip(pages: DataFrame, **options: object) -> DataFrame:
    """Write the archives to the shared folder, then read them back."""
    return read_archives(written(write_archives(pages, **options), "warc"))
