"""WARC archives: a writer that replaces repeated payloads by revisit records, and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.lineage import settled, sliced

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
_MEMBER = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/(?:0\.1[78]|1\.[01])\r\n")
# The named fields of the format in their usual spelling, and the hash functions of digests.
FIELDS = (
    "WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "Content-Type", "WARC-Concurrent-To", "WARC-Block-Digest", "WARC-Payload-Digest",
    "WARC-IP-Address", "WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date", "WARC-Target-URI", "WARC-Truncated", "WARC-Warcinfo-ID",
    "WARC-Filename", "WARC-Profile", "WARC-Identified-Payload-Type", "WARC-Segment-Number", "WARC-Segment-Origin-ID", "WARC-Segment-Total-Length",
)
HASHES = ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")
_SPELLING = {f.lower(): f for f in FIELDS}


class Record(NamedTuple):
    """headers: names of FIELDS in their usual spelling, others as written; values of repeated headers joined by ', '."""

    offset: int
    headers: dict[str, str]
    payload: bytes


class Gap(NamedTuple):
    """Bytes of an archive that no record could be read from."""

    start: int
    end: int
    reason: str


def write_record(headers: list[tuple[str, str]], payload: bytes, compress: bool = True) -> bytes:
    """One record; compressed, it is a gzip member of its own, with the same bytes each time."""
    block = hashlib.sha256(payload).hexdigest()
    lines = [*headers, ("WARC-Block-Digest", f"sha256:{block}"), ("Content-Length", str(len(payload)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + payload + b"\r\n\r\n"
    return gzip.compress(raw, 6, mtime=0) if compress else raw


def digest_fits(digest: str, block: bytes) -> bool:
    """Whether a digest ('sha1:...', in hex, base32 or base64) is the block's; digests of other functions are not checked."""
    name, _, value = digest.partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    if name not in HASHES:
        return True
    found = hashlib.new(name, block).digest()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=") or value.rstrip("=") == base64.b64encode(found).decode().rstrip("=")


class _Marks:
    """Places of a mark in some bytes, asked for from rising places: what was searched once is not searched again."""

    def __init__(self, find):
        self.find, self.place = find, -1

    def after(self, at: int) -> int | None:
        """The first place at or after `at`."""
        if self.place is not None and self.place < at:
            self.place = self.find(at)
        return self.place


def _marks(raw: bytes) -> tuple[_Marks, _Marks, _Marks]:
    """Gzip members, version lines and ends of headers."""
    literal = lambda mark: lambda at: None if (place := raw.find(mark, at)) < 0 else place
    version = lambda at: m.start() if (m := _VERSION.search(raw, at)) else None
    return _Marks(literal(_MEMBER)), _Marks(version), _Marks(literal(b"\r\n\r\n"))


def _headers(raw: bytes, at: int, end: int) -> dict[str, str]:
    """Named fields of the lines in raw[at:end], in any case, folded or repeated; stops with ValueError at the first line that is none."""
    found: dict[str, list[str]] = {}
    last = None
    while at < end:
        stop = raw.find(b"\r\n", at, end)
        stop = end if stop < 0 else stop
        line = raw[at:stop].decode("utf-8")
        if line[:1] in (" ", "\t"):
            if last is None:
                raise ValueError("header begins with a folded line")
            found[last][-1] = f"{found[last][-1]} {line.strip()}".strip()
        else:
            name, colon, value = line.partition(":")
            if not colon or not name.strip():
                raise ValueError("header line without a name")
            last = _SPELLING.get(name.strip().lower(), name.strip())
            found.setdefault(last, []).append(value.strip())
        at = stop + 2
    return {name: ", ".join(values) for name, values in found.items()}


def _parse(raw: bytes, at: int, ends: _Marks) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the record at `at`; ValueError if a check fails."""
    version = _VERSION.match(raw, at)
    if not version:
        raise ValueError("no version line")
    head_end = ends.after(version.end() - 2)
    if head_end is None:
        raise ValueError("header does not end")
    try:
        headers = _headers(raw, version.end(), head_end)
        length = int(headers["Content-Length"])
    except (KeyError, UnicodeDecodeError) as e:
        raise ValueError(f"bad header: {e!r}") from e
    start, end = head_end + 4, head_end + 4 + length
    if length < 0 or raw[end : end + 4] != b"\r\n\r\n":
        raise ValueError("record is cut or its length is wrong")
    payload = raw[start:end]
    if not digest_fits(headers.get("WARC-Block-Digest", ""), payload):
        raise ValueError("digest differs")
    return headers, payload, end + 4


def read_archive(data: bytes) -> Iterator[Record | Gap]:
    """Records in order, and a Gap for each stretch of bytes that is skipped.

    After a failed check the next place is sought where a gzip member or a version line begins and a whole record passes its checks; all
    bytes up to there are one quarantined gap.  Marks are searched once from start to end, whatever the damage.  Compressed and plain records may be
    mixed.  A gzip member may hold several records: all have its offset, and from a damaged member those at its start that were decompressed
    whole are read before its bytes count as a gap.
    """
    at, bad, reason = 0, None, ""
    view, (members, versions, ends) = memoryview(data), _marks(data)

    def onward(at: int) -> int:
        return min((p for p in (members.after(at + 1), versions.after(at + 1)) if p is not None), default=len(data))

    while at < len(data):
        try:
            if data[at : at + 3] == _MEMBER:
                raw, end, error = _window_member(view, at)
                found, error = _member_records(raw, at, error)
            else:
                headers, payload, end = _parse(data, at, ends)
                found, error = [Record(at, headers, payload)], ""
            if error and not found:
                raise ValueError(error)
        except ValueError as e:
            if bad is None:
                bad, reason = at, str(e)
            at = onward(at)
            continue
        if bad is not None:
            yield Gap(bad, at, reason)
            bad = None
        yield from found
        if error:
            bad, reason = at, error
            at = onward(at)
        else:
            at = end
    if bad is not None:
        yield Gap(bad, len(data), reason)


def _member_records(raw: bytes, at: int, error: str) -> tuple[list[Record], str]:
    """The whole records of a decompressed member, in turn up to the first that fails, and what is wrong with the rest (empty: nothing)."""
    found, place, ends = [], 0, _marks(raw)[2]
    while place < len(raw) or not (found or error):
        try:
            headers, payload, place = _parse(raw, place, ends)
        except ValueError as e:
            return found, error or str(e)
        found.append(Record(at, headers, payload))
    return found, error


def _window_member(view: memoryview, at: int, step: int = 1 << 10) -> tuple[bytes, int, str]:
    """One gzip member as far as it can be read, its end, and the error that stopped it (or empty); fed piece by piece, so that a long archive
    is not copied for each record."""
    unpack, out, end = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof and end < len(view):
            out.append(unpack.decompress(view[end : end + step]))
            end += step
    except zlib.error as e:
        return b"".join(out), end, f"gzip: {e}"
    if not unpack.eof:
        return b"".join(out), end, "gzip member is cut"
    return b"".join(out), min(end, len(view)) - len(unpack.unused_data), ""


def _archiver(limit: int):
    """Archives of about `limit` bytes.  Ids are percent-encoded, so that any text goes through a header; a null id has no header."""

    def shown(id_: str) -> str:
        return quote(id_, safe="")

    def urn(id_: str | None) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{id_}')}>"

    def run(batches):
        names = ("id", "url", "payload", "digest", "first", "is_first")
        held, size = [], 0
        for batch in sliced(batches, "payload"):
            for id_, url, payload, digest, first, is_first in zip(*(batch.column(c).to_pylist() for c in names)):
                headers = [("WARC-Type", "response" if is_first else "revisit"), ("WARC-Record-ID", urn(id_)), ("WARC-Date", DATE), ("WARC-Target-URI", re.sub(r"\s+", " ", url or "")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
                if id_ is not None:
                    headers.append(("X-Page-Id", shown(id_)))
                if not is_first:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", urn(first)), ("X-Refers-To-Page", shown(first))]
                held.append(write_record(headers, payload if is_first else b""))
                size += len(held[-1])
                if size >= limit:
                    yield pa.RecordBatch.from_pydict({"content": [b"".join(held)]})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"content": [b"".join(held)]})

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """A table of archives (content: the bytes of one .warc.gz of about archive_bytes), one record per page.

    The payload is the page in UTF-8 (null: empty).  Of pages with equal payloads of at least min_bytes bytes, those of the smallest id are
    response records with the payload, the others revisit records that refer to it.  Smaller payloads are always response records.  A null id is
    never the smallest; if all ids of a payload are null, all are response records.  Rows that share the smallest id are all response records.
    Repeated rows have records of their own, null urls an empty target; other columns are ignored; an empty table gives no archive.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(first, "digest", "left")
    is_first = F.col("first").isNull() | F.coalesce(F.col("id") == F.col("first"), F.lit(False))
    rows = rows.select("id", "url", "payload", "digest", F.col("first").cast("string").alias("first"), is_first.alias("is_first"))
    return rows.withColumn("id", F.col("id").cast("string")).mapInArrow(_archiver(archive_bytes), "content binary")


def _reader(batches):
    for batch in sliced(batches, "content"):
        for name, content in zip(batch.column("archive").to_pylist(), batch.column("content").to_pylist()):
            rows = []
            for x in read_archive(content or b""):
                if isinstance(x, Gap):
                    rows.append({"archive": name, "offset": x.start, "headers": None, "payload": None, "gap_end": x.end, "reason": x.reason})
                else:
                    rows.append({"archive": name, "offset": x.offset, "headers": list(x.headers.items()), "payload": x.payload, "gap_end": None, "reason": None})
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_READ)


_READ = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("gap_end", pa.int64()), ("reason", pa.string())])


def read_archives(archives: DataFrame) -> DataFrame:
    """Rows (archive, offset, headers, payload) of all records, and (archive, offset, gap_end, reason) with null headers for each quarantined gap.

    archives: columns archive (a name) and content (bytes), such as Spark's binaryFile source gives with path renamed.  Null content is empty.
    """
    schema = T.StructType([T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("payload", T.BinaryType()), T.StructField("gap_end", T.LongType()), T.StructField("reason", T.StringType())])
    return archives.select("archive", "content").mapInArrow(_reader, schema)


def gap_log(read: DataFrame) -> DataFrame:
    """The quarantined byte ranges of archives that were read: archive, start, end, reason."""
    return read.where(F.col("headers").isNull()).select("archive", F.col("offset").alias("start"), F.col("gap_end").alias("end"), "reason")


def warc_report(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the pages to archives in the shared folder, reads them back and returns one row per page (see write_archives).

    payload_bytes and payload_digest of a revisit are those of the payload it stands for.  Quarantined gaps are logged to a table in the shared
    folder; ValueError if there are any, or if the archives do not hold a record for each page.  Null ids and repeated rows are pages of their own;
    an empty table gives an empty result; other columns are ignored.
    """
    kind = pages.schema[id_col].dataType
    archives = settled(write_archives(pages, id_col, url_col, html_col), "archives")
    h = F.col("headers")
    is_response = h["WARC-Type"] == "response"
    read = settled(
        read_archives(archives.select(F.sha2("content", 256).alias("archive"), "content")).select(
            "archive", "offset", "gap_end", "reason", "headers",
            F.when(is_response, F.octet_length("payload").cast("bigint")).otherwise(h["X-Payload-Length"].cast("bigint")).alias("payload_bytes"),
            F.when(is_response, F.sha2("payload", 256)).otherwise(F.regexp_replace(h["WARC-Payload-Digest"], "^sha256:", "")).alias("payload_digest"),
        ),
        "records",
    )
    gaps = settled(gap_log(read), "gaps")
    records = read.where(F.col("headers").isNotNull())
    lost, found, wanted = gaps.count(), records.count(), pages.count()
    if lost or found != wanted:
        raise ValueError(f"{found} records of {wanted} pages and {lost} gaps were read")
    id_ = lambda name: F.url_decode(h[name]).cast(kind)
    return records.select(id_("X-Page-Id").alias(id_col), "payload_bytes", "payload_digest", h["WARC-Type"].alias("record_type"), id_("X-Refers-To-Page").alias("refers_to"))
