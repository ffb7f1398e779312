"""WARC archives of Zstandard frames: writer, and a reader that trusts nothing.

An archive starts with a skippable frame that holds the dictionary; each record
follows as one frame of its own. The reader takes the dictionary from that leading
frame, decodes one frame per record, and checks the version line, the header lines,
the content length, the closing blank lines and the payload digest.

Payloads are equal when length and SHA-1 are; of equal payloads (of at least
``least_bytes`` bytes) the record with the smallest page_id is a response and the
others are revisits of it. The smallest id per digest is combined before the shuffle
and joined back on the digest, a join that Spark may split where a digest is hot.
Archives are rows (archive, content) of a table in the shared folder, each of about
``ARCHIVE_BYTES`` of records, ``ARCHIVE_RECORDS`` of them, or one; a frame's end follows from
its block headers, so that reading is linear. ``read_archives`` also takes the rows of
``spark.read.format("binaryFile")``. The dictionary is trained on the driver from at
most ``DICT_PAGES`` pages of at most ``DICT_PAGE_BYTES`` bytes each.

The reader also takes what others write: WARC/1.0, archives without a dictionary or with a
compressed one, further skippable frames, frames that don't tell their size, folded header lines, other
types of records and HTTP responses, whose payload is what follows the HTTP headers. There
``page_id`` and ``refers_to`` are null and ``record_id`` says what the record is; digests
are checked where they are SHA-1 and, of payloads, not transfer-encoded.

Cases: a null html is an empty payload; a null url is empty; page ids must be integers (an error otherwise); a null page_id is written
without a number and comes back null, after all others in the choice of a response; repeated rows
are records of their own, and one of equal id revisits the first; extra columns are
ignored; an empty table gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Fixed values of the format: the skippable frame for dictionaries, and frames in general.
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
DICT_PAGES, DICT_PAGE_BYTES, DICT_BYTES = 400, 16 << 10, 32 << 10
ARCHIVE_BYTES, ARCHIVE_RECORDS = 8 << 20, 20_000
#: A record may not claim more bytes than Spark's binary values can hold.
RECORD_BYTES = (1 << 31) - 1
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, record_id string, date string"
#: Pages have no date of their own; a writer may give another.
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _number(name: str) -> int | None:
    """The page id in a record's name; null where it has none."""
    digits = name.removeprefix("<urn:page:").removesuffix(">") if name.startswith("<urn:page:") else ""
    return int(digits) if digits else None


def record_bytes(page_id: int | None, url: str, payload: bytes, sha: str, refers_to: int | None, revisit: bool | None = None, date: str = DATE) -> bytes:
    """``revisit`` (default: whether there is a page to refer to) leaves the payload out."""
    revisit = refers_to is not None if revisit is None else revisit
    body = b"" if revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}".replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class ArchiveError(ValueError):
    """An archive that breaks the format."""


def _fields(head: bytes) -> dict[str, str]:
    try:
        lines = head.decode("utf-8").split("\r\n")
    except UnicodeDecodeError as e:
        raise ArchiveError(f"headers are not UTF-8: {e}") from e
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError("not a WARC/1.0 or WARC/1.1 record")
    fields, last = {}, ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] = f"{fields[last]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        last = name.strip().lower()
        if not colon or not last:
            raise ArchiveError(f"malformed header line {line[:60]!r}")
        fields[last] = value.strip()
    return fields


def _sha1(fields: dict[str, str], key: str) -> str | None:
    kind, _, value = fields.get(key, "").partition(":")
    return value if kind.lower() == "sha1" and len(value) == 32 else None


def parse_record(raw: bytes) -> dict:
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        raise ArchiveError("a record without an end of its headers")
    fields = _fields(head)
    try:
        kind, length, name = fields["warc-type"], int(fields["content-length"]), fields["warc-record-id"]
        page_id, full, refers = _number(name), int(fields.get("x-payload-length", -1)), _number(fields.get("warc-refers-to", ""))
    except (KeyError, ValueError) as e:
        raise ArchiveError(f"missing or malformed header: {e}") from e
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError(f"record {name}: content length {length} does not match {len(rest) - 4}")
    block, encoded = rest[:length], False
    payload = block
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, found, payload = block.partition(b"\r\n\r\n")
        payload, encoded = payload if found else b"", b"\r\ntransfer-encoding:" in http.lower()
    sha, whole = _sha1(fields, "warc-payload-digest"), _sha1(fields, "warc-block-digest")
    if whole and digest(block) != whole:
        raise ArchiveError(f"record {name}: the block's digest is wrong")
    if kind != "revisit" and ((sha and not encoded and digest(payload) != sha) or full not in (-1, len(payload))):
        raise ArchiveError(f"record {name}: the payload's digest or length is wrong")
    return {
        "page_id": page_id, "url": fields.get("warc-target-uri", "").strip("<>"), "record_type": kind, "refers_to": refers, "payload_bytes": full if full >= 0 else None if kind == "revisit" else len(payload),
        "payload_digest": sha or (None if kind == "revisit" else digest(payload)), "payload": payload, "record_id": name, "date": fields.get("warc-date"),
    }


def write_archive(records: list[bytes], dictionary: bytes, level: int = 3) -> bytes:
    import zstandard

    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
    return struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary + b"".join(packer.compress(r) for r in records)


def frame_end(content: bytes, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its header and the headers of its blocks."""
    import zstandard

    if len(content) - at < 6 or struct.unpack_from("<I", content, at)[0] != FRAME_MAGIC:
        raise ArchiveError(f"no frame at {at}")
    head = content[at : at + 18]
    try:
        here, checksum = at + zstandard.frame_header_size(head), zstandard.get_frame_parameters(head).has_checksum
    except zstandard.ZstdError as e:
        raise ArchiveError(f"frame at {at}: {e}") from e
    last = 0
    while not last:
        if here + 3 > len(content):
            raise ArchiveError(f"frame at {at} is cut off")
        block = int.from_bytes(content[here : here + 3], "little")
        last, kind = block & 1, block >> 1 & 3
        here += 3 + (1 if kind == 1 else block >> 3)  # kind 1 repeats one byte
    here += 4 if checksum else 0
    if here > len(content):
        raise ArchiveError(f"frame at {at} is cut off")
    return here


def read_archive(content: bytes) -> Iterator[dict]:
    import zstandard

    if len(content) < 8:
        raise ArchiveError("no frame at the start")
    at, dictionary = 0, b""
    if struct.unpack_from("<I", content)[0] == DICT_MAGIC:
        at = 8 + struct.unpack_from("<I", content, 4)[0]
        if at > len(content):
            raise ArchiveError("dictionary frame is cut off")
        dictionary = content[8:at]
    if dictionary[:4] == struct.pack("<I", FRAME_MAGIC):
        dictionary = _unpacked(zstandard.ZstdDecompressor(), dictionary, 8)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    while at < len(content):
        if len(content) - at >= 8 and struct.unpack_from("<I", content, at)[0] >> 4 == DICT_MAGIC >> 4:
            at += 8 + struct.unpack_from("<I", content, at + 4)[0]  # a skippable frame
            if at > len(content):
                raise ArchiveError("a skippable frame is cut off")
            continue
        end = frame_end(content, at)
        raw = _unpacked(unpacker, content[at:end], at)
        at = end
        yield parse_record(raw)


def _unpacked(unpacker, frame: bytes, at: int) -> bytes:
    """What a frame holds, with the length that it tells if it tells one."""
    import zstandard

    try:
        size = zstandard.frame_content_size(frame)
        if size > RECORD_BYTES:
            raise ArchiveError(f"frame at {at} claims {size} bytes")
        if size >= 0:
            raw = unpacker.decompress(frame)
        else:
            parts, n, one = [], 0, unpacker.decompressobj()
            for i in range(0, len(frame), 1 << 16):  # a little at a time: the frame may claim any size
                parts.append(one.decompress(frame[i : i + (1 << 16)]))
                n += len(parts[-1])
                if n > RECORD_BYTES:
                    raise ArchiveError(f"frame at {at} holds more than {RECORD_BYTES} bytes")
            raw = b"".join(parts)
    except zstandard.ZstdError as e:
        raise ArchiveError(f"frame at {at}: {e}") from e
    if size >= 0 and len(raw) != size:
        raise ArchiveError(f"frame at {at}: {len(raw)} bytes, not {size}")
    return raw


def _train(pages: DataFrame) -> bytes:
    import zstandard

    # ids first: else every task would send that many pages to the driver for the choice
    usable = pages.where("octet_length(html) > 64 AND page_id IS NOT NULL")
    ids = [r[0] for r in usable.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(DICT_PAGES).collect()]
    sample = usable.where(F.col("page_id").isin(ids)).select("page_id", F.expr(f"substring(CAST(html AS BINARY), 1, {DICT_PAGE_BYTES})").alias("b"))
    rows = sorted(sample.limit(DICT_PAGES).collect(), key=lambda r: (r.page_id, bytes(r.b))) if ids else []  # bounded by both limits
    try:
        return zstandard.train_dictionary(DICT_BYTES, [bytes(r.b) for r in rows]).as_bytes() if len(rows) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, least_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Archives (archive, content) of a pages table, ready to be written."""
    if pages.schema["page_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("page_id must be an integer")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "n": F.octet_length("payload")})
    # a null id comes after all others
    firsts = rows.groupBy("sha", "n").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id")).alias("f"), F.count("*").alias("m"))
    shared = firsts.where(F.col("m") > 1).where(F.col("n") >= least_bytes).select("sha", "n", F.col("f.page_id").alias("low"), F.lit(True).alias("several"))
    joined = rows.join(shared, ["sha", "n"], "left").withColumn("first", F.col("page_id").eqNullSafe(F.col("low")))
    # several rows may have the smallest id itself: the first of them is the response
    same = joined.where(F.col("several") & F.col("first")).groupBy("sha", "n").agg(F.count("*").alias("k")).where("k > 1")
    revisit = F.coalesce(F.col("several"), F.lit(False)) & ~F.col("first")
    if not same.isEmpty():
        order = F.row_number().over(Window.partitionBy("sha", "n", "page_id").orderBy("url"))
        revisit = F.coalesce(F.col("several"), F.lit(False)) & (~F.col("first") | (order > 1))
    joined = joined.withColumn("revisit", revisit)
    dictionary = _train(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            content = write_archive(records, dictionary)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(content).hexdigest() + ".warc.zst"]), pa.array([content], pa.binary())], names=["archive", "content"])

        records, size = [], 0
        for batch in batches:
            for page_id, url, body, refers, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                records.append(record_bytes(page_id, url, body, digest(body), refers, revisit, date))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES or len(records) >= ARCHIVE_RECORDS:
                    yield out()
                    records, size = [], 0
        if records:
            yield out()

    return joined.select("page_id", "url", "payload", F.when(F.col("revisit"), F.col("low")).alias("refers"), "revisit").mapInArrow(run, "archive string, content binary")


def read_archives(archives: DataFrame, content: str = "content") -> DataFrame:
    """The records of all archives, one row each."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("record_id", pa.string()), ("date", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column(0):
                found = list(read_archive(one.as_py()))
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    return archives.select(content).mapInArrow(run, RECORD)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives to the shared folder and reads their records back."""
    return read_archives(Scratch(pages.sparkSession).table(write_archives(pages)))
