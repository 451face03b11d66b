"""WARC archives: writing captures with revisits and segments, reading them back and reassembling segments.

A payload is stored once, as the body of an HTTP response in chunked framing; later captures of the same payload are
revisit records. A block longer than a segment is cut: continuation records name the first record as their origin and
carry segment numbers, the last one the total length. Reading groups continuation records by origin, orders them by
number, checks the total length and undoes the chunked framing.

Records go through Spark's text writer (which writes bytes as they are), compressed, into files of a bounded number of
records of bounded size, so that a file fits a task when it is read as a whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textgrade.llm.common import broadcast_if_small
from textgrade.sources.settled import settle, shared_folder

#: Bytes of a block after which it is cut, records in a file, and bytes in an HTTP chunk.
SEGMENT, PER_FILE, CHUNK = 1 << 16, 2048, 1 << 13
CRLF = b"\r\n"
_STAMP = "2000-01-01T00:00:00Z"


def base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits."""
    fives = [F.lpad(F.conv(F.substring(sha1_hex, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """Without the two line ends that close a record: those the writer adds."""
    lines = [f"{k}: {v}" for k, v in (*headers, ("Content-Length", str(len(block))))]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block


def _chunked(payload: bytes, size: int) -> bytes:
    out = []
    for low in range(0, len(payload), size):
        part = payload[low : low + size]
        out += [f"{len(part):x}".encode(), CRLF, part, CRLF]
    return b"".join([*out, b"0", CRLF, CRLF])


def _uri(url) -> str:
    """The address as a header value: line ends would end the header."""
    return "".join(url.splitlines()) if isinstance(url, str) else ""


def records_of(row_id: str, url, payload: bytes, digest: str, refers_to: str | None, segment: int, chunk: int) -> list[bytes]:
    """The records of one capture."""
    common = [("WARC-Date", _STAMP), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        extra = [
            ("WARC-Refers-To", refers_to),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", row_id), *common, *extra, kind], head)]
    block = head + _chunked(payload, chunk)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", row_id), *common, kind]
    if len(block) <= segment:
        return [_record(first, block)]
    out = [_record([*first, ("WARC-Segment-Number", "1")], block[:segment])]
    for number, low in enumerate(range(segment, len(block), segment), 2):
        headers = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"{row_id[:-1]}#{number}>"),
            ("WARC-Date", _STAMP),
            ("WARC-Segment-Origin-ID", row_id),
            ("WARC-Segment-Number", str(number)),
        ]
        if low + segment >= len(block):
            headers.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(headers, block[low : low + segment]))
    return out


def _writer(segment: int, chunk: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            records: list[bytes] = []
            held = 0
            for row in frame.itertuples(index=False):
                payload = row.html.encode() if isinstance(row.html, str) else b""
                refers = row.refers if isinstance(row.refers, str) else None
                for record in records_of(row.record_id, row.url, payload, row.digest, refers, segment, chunk):
                    records.append(record)
                    held += len(record)
                    if held > 1 << 24:
                        yield pd.DataFrame({"record": records})
                        records, held = [], 0
            yield pd.DataFrame({"record": records})

    return run


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
    segment: int = SEGMENT,
    chunk: int = CHUNK,
) -> None:
    """One record (and its continuations) per row, into the folder ``path``.

    Of rows whose payloads are equal and at least ``least_bytes`` long, that with the smallest id is a response, the
    others revisits of it; shorter ones and rows without an id are responses. A record is named by its row's id, payload
    digest and address, so that rows which repeat an id, or have none, do not mix their segments. Only rows equal in all
    three share a name; each is written, and :func:`read_archive` returns each.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    source = pages.select(F.col(id_col).alias("row"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    mark = F.xxhash64("url")
    digests = settle(
        source.select("row", base32(F.sha1("html")).alias("digest"), F.octet_length("html").alias("bytes"), mark.alias("mark"))
    )
    firsts = (
        digests.where(F.col("row").isNotNull() & (F.col("bytes") >= least_bytes))
        .groupBy("digest")
        .agg(F.min(F.struct("row", "mark")).alias("first"), F.max("row").alias("last"))
        .where("first.row < last")
    )
    repeats = digests.alias("d").join(firsts.alias("f"), "digest").where("row != first.row").select("row", "digest", "first").distinct()
    repeats = settle(repeats).select(F.col("row").alias("r"), F.col("digest").alias("rd"), "first")
    rows = source.withColumn("digest", base32(F.sha1("html")))
    rows = rows.join(broadcast_if_small(repeats), (F.col("row") == F.col("r")) & (F.col("digest") == F.col("rd")), "left")

    def name(row: Column, mark: Column) -> Column:
        own = F.coalesce(F.hex(F.encode(row.cast("string"), "UTF-8")), F.lit("-"))
        return F.concat(F.lit("<urn:row:"), own, F.lit(":"), "digest", F.lit(":"), F.hex(mark), F.lit(">"))

    rows = rows.select(
        name(F.col("row"), mark).alias("record_id"),
        "url",
        F.when(F.col("first").isNull(), F.col("html")).alias("html"),
        "digest",
        F.when(F.col("first").isNotNull(), name(F.col("first.row"), F.col("first.mark"))).alias("refers"),
    )
    records = rows.mapInPandas(_writer(segment, chunk), "record binary")
    (
        records.select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", PER_FILE)
        .text(path)
    )


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = int(headers["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) < length or data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield headers, block
        at = end + 8 + length


def unpacked(content: bytes) -> bytes:
    """The bytes of a file of one or several gzip members, or of a plain one."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP response, its chunked framing undone if it has one."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("the chunked body is cut short")
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) < size:
            raise ValueError("the chunked body is cut short")
        at = end + 2 + size + 2


_PARTS = "record_id string, kind string, url string, digest string, refers string, origin string, segment int, total long, block binary"


def _reader(segmented: bool):
    """Records of archives that are, or are not, parts of segmented ones."""
    columns = [c.split()[0] for c in _PARTS.split(", ")]
    kinds = {"segment": "Int32", "total": "Int64"}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for content in (c for frame in frames for c in frame["content"]):
            rows, held = [], 0
            for h, block in parse_archive(unpacked(content)):
                number = h.get("warc-segment-number")
                if h["warc-type"] not in ("response", "revisit", "continuation") or segmented != (number is not None):
                    continue
                origin = h.get("warc-segment-origin-id") or h["warc-record-id"]
                digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                total = h.get("warc-segment-total-length")
                rows.append(
                    (h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"), digest, h.get("warc-refers-to"), origin,
                     int(number) if number else None, int(total) if total else None, block)
                )
                held += len(block)
                if held > 1 << 24:
                    yield pd.DataFrame(rows, columns=columns).astype(kinds)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns).astype(kinds)

    return run


def _joined(parts: list) -> bytes:
    """The block of a segmented record; its numbers must be 1, 2, ... and its length the one that the last one tells."""
    parts = sorted(parts, key=lambda p: p["segment"])
    block = b"".join(p["block"] for p in parts)
    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
        raise ValueError(f"segments are missing or of the wrong length: {len(parts)} with {len(block)} bytes")
    return block


def _payloads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        blocks = [b if p is None else _joined(p) for b, p in zip(frame["block"], frame["parts"], strict=True)]
        kinds = frame["kind"]
        frame["payload"] = [b"" if k == "revisit" else payload_of(b) for b, k in zip(blocks, kinds, strict=True)]
        frame["found"] = [base64.b32encode(hashlib.sha1(p).digest()).decode() for p in frame["payload"]]
        wrong = (frame["kind"] == "response") & frame["digest"].notna() & (frame["digest"] != frame["found"])
        if wrong.any():
            raise ValueError(f"the payload of {frame.loc[wrong, 'record_id'].iloc[0]} does not have the digest it tells")
        yield frame[["record_id", "kind", "url", "digest", "refers", "payload"]]


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, kind, url, digest, refers, payload`` of the responses and revisits in a folder of archives.

    Continuations are grouped by their origin and only they are shuffled. A missing segment, a wrong total length and
    a wrong digest are errors. A revisit has an empty payload and the digest of what it refers to. Of segmented
    records that share one id (equal rows) one is returned for each complete set.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    kind = "array<struct<segment:int,total:bigint,block:binary>>"
    whole = files.mapInPandas(_reader(False), _PARTS).select(
        "record_id", "kind", "url", "digest", "refers", "block", F.lit(None).cast(kind).alias("parts")
    )
    grouped = (
        files.mapInPandas(_reader(True), _PARTS)
        .groupBy(F.col("origin").alias("record_id"))
        .agg(
            F.max(F.when(F.col("kind") != "continuation", F.struct("kind", "url", "digest", "refers"))).alias("head"),
            F.count_if(F.col("segment") == 1).alias("times"),
            F.collect_set(F.struct("segment", "total", "block")).alias("parts"),
        )
    )
    each = F.explode(F.array_repeat(F.lit(0), F.greatest("times", F.lit(1)).cast("int")))
    segmented = grouped.select(
        "record_id", "head.*", F.lit(None).cast("binary").alias("block"), "parts", each.alias("nth")
    ).drop("nth")
    return whole.unionByName(segmented).mapInPandas(
        _payloads, "record_id string, kind string, url string, digest string, refers string, payload binary"
    )


def archive_digest(records: DataFrame, id_type: str = "long") -> DataFrame:
    """Per record its row, the bytes and digest of its full payload, its type and the row it refers to."""
    row = lambda c: F.decode(F.unhex(F.regexp_extract(c, "<urn:row:([0-9A-F]*)", 1)), "UTF-8").cast(id_type)
    named = ~F.col("record_id").startswith("<urn:row:-")
    facts = settle(
        records.select(
            F.when(named, row(F.col("record_id"))).alias("page_id"),
            F.octet_length("payload").cast("long").alias("own_bytes"),
            F.col("digest").alias("payload_digest"),
            F.col("kind").alias("record_type"),
            F.when(F.col("refers").isNotNull(), row(F.col("refers"))).alias("refers_to"),
        )
    )
    kept = facts.where("record_type = 'response' and page_id is not null")
    referred = facts.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    sizes = settle(kept.join(referred, ["page_id", "payload_digest"], "left_semi").select("page_id", "payload_digest", "own_bytes").distinct())
    sizes = sizes.select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), F.col("own_bytes").alias("full"))
    on = (F.col("refers_to") == F.col("p")) & (F.col("payload_digest") == F.col("d"))
    return facts.join(broadcast_if_small(sizes), on, "left").select(
        "page_id",
        F.when(F.col("record_type") == "revisit", F.col("full")).otherwise(F.col("own_bytes")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )


def new_archive(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/archive-{uuid.uuid4().hex}"
