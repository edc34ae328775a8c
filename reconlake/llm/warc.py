"""Zstandard WARC archives: writing, and reading with full validation.

An archive is a skippable frame that holds a dictionary, then one zstandard
frame for each record, so that any record can be read by itself. The reader
takes the dictionary from the leading frame, decodes frame by frame, and checks
the frame sizes, the WARC version and mandatory headers, the block length
against Content-Length, the record's end and, where a record states them, the
payload's digest and length. Archives of other writers are read too: payload
digests and lengths of the HTTP part are optional there, a resource's payload
is its block, and records of other kinds (warcinfo, request, metadata, …) are
checked and passed over.

Among records with equal payloads the one with the largest page id is written
as a response and the others as revisits that refer to it. Digests are
aggregated on each task before they are shuffled and joined back as a table of
one row per payload that occurs more than once, so a payload that a third of
all pages share costs one row there; Spark splits its partition in the join.

Archives are rows (archive, content) of a table in the folder that the cluster
shares, each of about ARCHIVE_BYTES before compression, so a task holds one
archive at a time, a lost executor repeats its own partitions only, and no file
of one machine is needed by another. `binary_files` reads archives that lie as
files in any store.

Nulls and odd rows: a null payload is an empty one. A null url leaves the
target header out. A null page id sorts before all others and reads back as
null; if a payload's pages have no id at all, all are responses. Rows that
repeat the largest id of a payload are all responses. Pages without rows give
no archives. Other columns of the pages are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.plans.lineage import written

ARCHIVE_BYTES = 8 << 20
SAMPLE_BYTES = 1 << 20  # of an archive's own first records, for its dictionary
DICTIONARY_BYTES = 64 << 10

#: Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
MANDATORY = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")
PAGES = ("response", "revisit", "resource")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URN = "<urn:x-page:{}>"

ARCHIVES = "archive string, content binary"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class BadArchive(ValueError):
    """What is wrong, and where."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def headers(first: str, fields: dict[str, object]) -> bytes:
    lines = [first, *(f"{k}: {v}" for k, v in fields.items() if v is not None)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, response: int | None, date: str) -> bytes:
    """A record; `response` is the page that a revisit refers to."""
    http = headers("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": len(payload)})
    block = http if response is not None else http + payload
    fields = {
        "WARC-Type": "response" if response is None else "revisit",
        "WARC-Record-ID": PAGE_URN.format(page_id),
        "WARC-Date": date,
        # Quoted so that a url can't end its line; unquoting gives back every character.
        "WARC-Target-URI": None if url is None else urllib.parse.quote(url, safe="/:?#[]@!$&'()*+,;="),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Profile": None if response is None else PROFILE,
        "WARC-Refers-To": None if response is None else PAGE_URN.format(response),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    return headers("WARC/1.1", fields) + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The archive of some records, with a dictionary from the first SAMPLE_BYTES of them."""
    samples, size = [], 0
    for r in records:
        samples.append(r[: 64 << 10])
        size += len(samples[-1])
        if size >= SAMPLE_BYTES:
            break
    try:
        trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 8)), samples)
        raw = trained.as_bytes()
    except zstandard.ZstdError:  # too few or too uniform samples: their bytes serve as they are
        raw = b"".join(samples)[-DICTIONARY_BYTES:]
    raw_dict = zstandard.ZstdCompressionDict(raw)
    held = zstandard.ZstdCompressor(level=9).compress(raw)
    compressor = zstandard.ZstdCompressor(level=3, dict_data=raw_dict, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE_MAGIC, len(held)), held, *map(compressor.compress, records)])


def frames(name: str, content: bytes) -> Iterator[bytes]:
    """The decoded records of an archive."""
    if len(content) < 8:
        raise BadArchive(f"{name}: shorter than a frame header")
    magic, size = struct.unpack_from("<II", content)
    if magic != SKIPPABLE_MAGIC:
        raise BadArchive(f"{name}: no leading dictionary frame")
    raw, at = content[8 : 8 + size], 8 + size
    if len(raw) != size:
        raise BadArchive(f"{name}: the dictionary frame is cut off")
    if raw[:4] == FRAME_MAGIC:
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    view = memoryview(content)
    while at < len(content):
        if bytes(view[at : at + 4]) != FRAME_MAGIC:
            raise BadArchive(f"{name}: no frame at byte {at}")
        frame, out, start = decompressor.decompressobj(), [], at
        try:
            while not frame.eof:
                if at >= len(content):
                    raise BadArchive(f"{name}: the frame at byte {start} is cut off")
                step = view[at : at + (16 << 10)]
                out.append(frame.decompress(step))
                at += len(step)
        except zstandard.ZstdError as e:
            raise BadArchive(f"{name}: the frame at byte {start}: {e}") from e
        at -= len(frame.unused_data)
        yield b"".join(out)


def parse_headers(raw: bytes, where: str) -> tuple[str, dict[str, str], int]:
    """First line, fields by lower-case name, and where the block starts."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise BadArchive(f"{where}: its headers don't end")
    first, *lines = raw[:end].decode("utf-8", "replace").split("\r\n")
    fields = {}
    for line in lines:
        k, colon, v = line.partition(":")
        if not colon:
            raise BadArchive(f"{where}: not a header: {line[:80]!r}")
        fields[k.strip().lower()] = v.strip()
    return first, fields, end + 4


def _number(text: str, where: str) -> int:
    if not text.isascii() or not text.isdigit():
        raise BadArchive(f"{where}: not a length: {text[:40]!r}")
    return int(text)


def _page(urn: str | None) -> int | None:
    inside = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(inside) if inside.lstrip("-").isdigit() else None


def parse(raw: bytes, where: str) -> tuple | None:
    """The fields of RECORDS of one record; None of one that holds no page."""
    first, fields, start = parse_headers(raw, where)
    if first not in ("WARC/1.0", "WARC/1.1"):
        raise BadArchive(f"{where}: unknown version {first[:20]!r}")
    for k in MANDATORY:
        if k.lower() not in fields:
            raise BadArchive(f"{where}: without {k}")
    n = _number(fields["content-length"], where)
    if len(raw) != start + n + 4 or raw[start + n :] != b"\r\n\r\n":
        raise BadArchive(f"{where}: its block has {len(raw) - start - 4} bytes, its header says {n}")
    kind = fields["warc-type"]
    if kind not in PAGES:
        return None
    http, body = {}, 0
    if kind != "resource" and fields.get("content-type", "application/http").startswith("application/http"):
        _, http, body = parse_headers(raw[start : start + n], where)
    payload = raw[start + body : start + n]
    length, stated = http.get("content-length"), fields.get("warc-payload-digest", "")
    size = len(payload) if length is None else _number(length, where)
    if kind == "revisit":
        if payload or "warc-refers-to" not in fields:
            raise BadArchive(f"{where}: a revisit with a payload or without what it revisits")
    elif len(payload) != size or (stated.startswith("sha1:") and digest(payload) != stated.removeprefix("sha1:")):
        raise BadArchive(f"{where}: its payload doesn't match its length or digest")
    stated = stated.removeprefix("sha1:") if stated.startswith("sha1:") else None if kind == "revisit" else digest(payload)
    url = fields.get("warc-target-uri")
    return (
        _page(fields["warc-record-id"]), None if url is None else urllib.parse.unquote(url), size, stated, kind,
        _page(fields.get("warc-refers-to")), None if kind == "revisit" else payload,
    )


def with_kind(pages: DataFrame, min_bytes: int) -> DataFrame:
    """`pages` (page_id, payload) with `response`: the page that it revisits, else null."""
    marked = pages.withColumn("sha", F.sha1("payload"))
    copies = marked.where(F.octet_length("payload") >= min_bytes)
    shared = copies.groupBy("sha").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = marked.join(shared, "sha", "left")
    other = F.col("largest").isNotNull() & ~F.col("largest").eqNullSafe(F.col("page_id"))
    return joined.withColumn("response", F.when(other, F.col("largest"))).drop("sha", "largest")


def _writer(archive_bytes: int, date: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        size = 0

        def full() -> pd.DataFrame:
            content = archive(held)
            return pd.DataFrame({"archive": [f"{hashlib.sha1(content).hexdigest()}.warc.zst"], "content": [content]})

        for b in batches:
            responses = [None if pd.isna(x) else int(x) for x in b["response"]]
            ids = [None if pd.isna(x) else int(x) for x in b["page_id"]]
            for page_id, url, payload, response in zip(ids, b["url"], b["payload"], responses):
                held.append(record(page_id, url, bytes(payload), response, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield full()
                    held, size = [], 0
        if held:
            yield full()

    return write


def write(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    payload: Column | None = None,
    min_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
    date: str = "2026-01-01T00:00:00Z",
) -> DataFrame:
    """Archives (archive, content) of the pages, written to the shared folder."""
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8") if payload is None else F.coalesce(payload, F.lit(b""))
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    # Ids pass through pandas as text, which keeps all 64 bits beside nulls.
    kinds = with_kind(rows, min_bytes).withColumns({c: F.col(c).cast("string") for c in ("page_id", "response")})
    return written(kinds.select("page_id", "url", "payload", "response").mapInPandas(_writer(archive_bytes, date), ARCHIVES), "warc")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    for b in batches:
        for name, content in zip(b["archive"], b["content"]):
            rows = [parse(r, f"{name}, record {i}") for i, r in enumerate(frames(name, bytes(content)))]
            out = pd.DataFrame([r for r in rows if r is not None], columns=names)
            yield out.astype({c: "Int64" for c in ("page_id", "payload_bytes", "refers_to")})


def read(archives: DataFrame) -> DataFrame:
    """The records (RECORDS) of archives (archive, content); a broken archive fails the job with its name and place."""
    return archives.select("archive", "content").mapInPandas(_read, RECORDS)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Archives that lie as files below `path`."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")
