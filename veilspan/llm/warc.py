"""WARC archives of Zstandard frames: writer with duplicate payloads revisited, and reader.

An archive is one file: a skippable frame (magic ``0x184D2A5D``) whose content is the dictionary,
then one Zstandard frame per record, compressed with that dictionary.  A last, one-byte skippable
frame closes every stretch that the writer puts out: Spark's text writer adds a line feed to each
row, and that byte is this frame's content, so the file is valid Zstandard throughout.

The reader takes the dictionary from the leading skippable frame (plain, or compressed itself),
decodes frame by frame and checks each record: version line, required fields, block length, end
mark, block and payload digests, HTTP length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import scratch_path

DICTIONARY_FRAME = 0x184D2A5D
_SKIPPABLE = range(0x184D2A50, 0x184D2A60)
_ZSTD = b"\x28\xb5\x2f\xfd"
_CLOSING = struct.pack("<II", 0x184D2A50, 1)
#: The dictionary is trained on so many bytes of payload at a file's start, to so many bytes.
DICTIONARY_SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 64 << 10
STRETCH_BYTES = 1 << 20
#: Stretches of an archive: about 128 MB of compressed records, then the task starts another file.
ARCHIVE_STRETCHES = 128
LEVEL = 3
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    if urn is None:
        return None
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise WarcError(f"not a page's name: {urn[:80]!r}")
    return int(urn[10:-1]) if urn[10:-1] else None


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record, or a revisit record that holds the HTTP header alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", date),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Block-Digest", "sha1:" + digest(block)),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]-._~")))
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    page_id: int | None
    record_type: str
    refers_to: int | None
    payload_bytes: int
    payload_digest: str
    #: None in a revisit.
    payload: bytes | None
    fields: dict[str, str]


def parse_record(data: bytes) -> Record:
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip():
            raise WarcError(f"a header line without a name: {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise WarcError(f"missing fields: {sorted(missing)}")
    if not fields["content-length"].isdigit():
        raise WarcError("a length that is no number")
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"the block has {len(rest) - 4} bytes and should have {n}")
    if fields.get("warc-block-digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
        raise WarcError("the block doesn't match its digest")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return Record(None, kind, None, n, digest(block), block, fields)
    http, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not http.startswith(b"HTTP/"):
        raise WarcError("no HTTP header")
    sizes = [v for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length"]
    if len(sizes) != 1 or not sizes[0].strip().isdigit():
        raise WarcError("no HTTP length")
    size, said = int(sizes[0]), fields.get("warc-payload-digest", "")
    if kind == "revisit":
        if "warc-refers-to" not in fields or payload or not said.startswith("sha1:"):
            raise WarcError("a revisit without its response, or with a payload")
        return Record(_page(fields["warc-record-id"]), kind, _page(fields["warc-refers-to"]), size, said[5:], None, fields)
    if size != len(payload) or said != "sha1:" + digest(payload):
        raise WarcError("the payload doesn't match its length or digest")
    return Record(_page(fields["warc-record-id"]), kind, None, size, said[5:], payload, fields)


def train_dictionary(payloads: list[bytes]) -> bytes:
    """A trained dictionary, or none where the samples are too few or too alike to train one."""
    if len(payloads) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, payloads).as_bytes()
    except zstandard.ZstdError:
        return b""


def read_frames(data: bytes) -> Iterator[bytes]:
    """Content of each Zstandard frame of an archive."""
    view, at, known = memoryview(data), 0, None
    while at < len(view):
        if len(view) - at < 8:
            raise WarcError("the archive is cut short")
        magic, n = struct.unpack_from("<II", view, at)
        if magic in _SKIPPABLE:
            if at + 8 + n > len(view):
                raise WarcError("a skippable frame is cut short")
            if magic == DICTIONARY_FRAME and at == 0:
                raw = bytes(view[8 : 8 + n])
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw) if raw[:4] == _ZSTD else raw
                known = zstandard.ZstdCompressionDict(raw)
            at += 8 + n
            continue
        if bytes(view[at : at + 4]) != _ZSTD:
            raise WarcError(f"no frame at byte {at}")
        frame = zstandard.ZstdDecompressor(dict_data=known).decompressobj() if known else zstandard.ZstdDecompressor().decompressobj()
        parts = []
        while not frame.eof:
            piece = view[at : at + (64 << 10)]
            if not len(piece):
                raise WarcError("a frame is cut short")
            parts.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
        yield b"".join(parts)


def read_records(data: bytes) -> Iterator[Record]:
    for frame in read_frames(data):
        yield parse_record(frame)


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to, revisit for each row.

    Of rows with equal payloads of ``min_bytes`` or more, those with the largest id are responses and
    the others revisit that id.  The largest id of each payload is found by a partial aggregate over
    32-byte hashes; the join back has one row per repeated payload on its small side and is one that
    adaptive execution splits where a payload is common.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload")
    ).withColumn("h", F.unhex(F.sha2("payload", 256)))
    repeated = (
        rows.where(F.octet_length("payload") >= min_bytes).groupBy("h").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1").select("h", "latest")
    )
    joined = rows.join(repeated, "h", "left")
    revisit = F.coalesce(F.col("latest") > F.col("page_id"), F.col("latest").isNotNull() & F.col("page_id").isNull())
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("latest")).alias("refers_to"), F.coalesce(revisit, F.lit(False)).alias("revisit"))


def write_archives(marked: DataFrame, path: str, stretches: int = ARCHIVE_STRETCHES, stretch_bytes: int = STRETCH_BYTES) -> None:
    """Archives of ``mark_revisits``' rows: a partition's records in files of up to ``stretches`` stretches
    of ``stretch_bytes`` (or one record more), each file with the partition's dictionary in front."""

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)

        source, first, size = rows(), [], 0
        for r in source:
            first.append(r)
            size += len(r[2].as_buffer())
            if size >= DICTIONARY_SAMPLE_BYTES:
                break
        raw = train_dictionary([r[2].as_py() for r in first if not r[4]])
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdCompressor(level=LEVEL)
        if raw:
            raw = zstandard.ZstdCompressor(level=LEVEL).compress(raw)
            lead = [struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw]
        else:
            lead = []
        out, held, given = lead.copy(), 0, 0
        for part in (first, source):
            for page_id, url, payload, refers_to, revisit in part:
                out.append(packer.compress(encode_record(page_id, url, payload.as_py(), refers_to, revisit)))
                held += len(out[-1])
                if held >= stretch_bytes:
                    yield pa.record_batch({"frames": [b"".join(out) + _CLOSING]})
                    given += 1
                    out, held = ([] if given % stretches else lead.copy()), 0
        if held:
            yield pa.record_batch({"frames": [b"".join(out) + _CLOSING]})

    marked.mapInArrow(archive, "frames binary").select(F.col("frames").cast("string")).write.option("maxRecordsPerFile", stretches).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """Every record of the archives under ``path``: page_id, record_type, refers_to, payload_bytes,
    payload_digest, payload (null in revisits), target_uri.  A broken record fails the read."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for r in read_records(content.as_py()):
                    rows.append((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload, r.fields.get("warc-target-uri")))
                    size += len(r.payload or b"") + 200
                    if size > 8 << 20:
                        yield _records(rows)
                        rows, size = [], 0
                if rows:
                    yield _records(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(records, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, target_uri string")


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "target_uri"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, stretches: int = ARCHIVE_STRETCHES, stretch_bytes: int = STRETCH_BYTES, **columns: str) -> DataFrame:
    """Archives of all pages, written to the shared folder and read back.

    Null payloads are empty, null urls leave the field out, repeated rows give a record each; an
    empty table gives no record.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(mark_revisits(pages, min_bytes=min_bytes, **columns), path, stretches, stretch_bytes)
    return read_archives(pages.sparkSession, path)
