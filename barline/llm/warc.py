"""WARC archives of Zstandard frames: writer, reader and payload deduplication.

An archive starts with a skippable frame (0x184D2A5D) that holds the dictionary; every record
is one frame, compressed with it. Archives are written by Spark's text writer, which puts the
bytes of a row into a file as they are; an empty skippable frame serves as line separator, so
that a file is a valid Zstandard stream. Each row is one whole archive of about
``ARCHIVE_BYTES`` before compression and becomes one file. Writing and reading go through
Spark's file systems and commit protocol only.

Defined cases: a null payload is empty; records with payloads below ``LEAST_BYTES`` are never
revisits; rows that repeat the smallest page id of a payload are responses; a null page id
revisits the smallest other id and is a response where there is none; an empty table gives no
archive and reads back as no rows. A damaged record is reported in ``problem``, the rest of its
archive is still read; a damaged frame ends its archive with one row that says so.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm.textops import slices, tidy
from barline.session import shared_dir

DICTIONARY_MAGIC, SKIPPABLE, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
#: An empty skippable frame; all of its bytes are ASCII.
SEPARATOR = struct.pack("<II", SKIPPABLE, 0).decode("ascii")
ARCHIVE_BYTES = 8 << 20
LEAST_BYTES = 100
#: Pages, and bytes of each, that the compression dictionary is trained on.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 32 << 10, 32 << 10
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, record_type string, target_uri string, refers_to long, payload_bytes long, payload_digest string, payload binary, problem string"
FIELDS = ["page_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload", "problem"]
ARROW = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("problem", pa.string())])


def train_dictionary(pages: DataFrame) -> bytes | None:
    """A dictionary from a bounded sample of pages; None if it is too small to train on."""
    rows = pages.where("html IS NOT NULL").select(F.col("html").cast("binary").substr(1, SAMPLE_BYTES).alias("b")).limit(SAMPLE_PAGES).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r.b) for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return None


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _archives(dictionary: bytes | None, archive_bytes: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        start = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""
        frames, size = [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([start + b"".join(frames)], pa.binary())], ["value"])

        for part in slices(batches, "html", ARCHIVE_BYTES):
            for r in part.to_pylist():
                raw = record(r["page_id"], r["url"], r["html"] or b"", r["digest"], r["refers_to"])
                frames.append(packer.compress(raw))
                size += len(raw)
                if size >= archive_bytes:
                    yield done()
                    frames, size = [], 0
        if frames:
            yield done()

    return task


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, html (bytes), digest, refers_to: the smallest page id with an equal payload, if another row's."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    first = rows.where(F.octet_length("html") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
    first = first.where("n > 1 AND original IS NOT NULL").select("digest", "original")
    other = F.coalesce(F.col("page_id") != F.col("original"), F.col("original").isNotNull())
    return rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", F.when(other, F.col("original")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write all pages as archives into the folder ``path``."""
    rows = with_originals(pages).mapInArrow(tidy(_archives(train_dictionary(pages), archive_bytes)), "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).text(path)


def frame_length(data: memoryview, at: int) -> int:
    """Bytes of the Zstandard frame at ``at``, from its header and block headers."""
    end = at + zstandard.frame_header_size(data[at : at + 18])
    checksum = 4 if data[at + 4] & 4 else 0
    while True:
        if end + 3 > len(data):
            raise ValueError("the frame is cut off")
        head = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            if end + checksum > len(data):
                raise ValueError("the frame is cut off")
            return end + checksum - at


def frames(data: bytes) -> Iterator[bytes]:
    """Decoded frames of an archive. The leading skippable frame gives the dictionary, itself perhaps compressed."""
    view, at, unpack = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        if at + 8 > len(view):
            raise ValueError("bytes after the last frame")
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            if at + 8 + size > len(view):
                raise ValueError("the skippable frame is cut off")
            if at == 0 and magic == DICTIONARY_MAGIC:
                body = bytes(view[8 : 8 + size])
                if body[:4] == struct.pack("<I", FRAME_MAGIC):
                    body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            at += 8 + size
        elif magic == FRAME_MAGIC:
            size = frame_length(view, at)
            yield unpack.decompressobj().decompress(view[at : at + size])
            at += size
        else:
            raise ValueError(f"no frame at byte {at}")


def parse(raw: bytes) -> dict:
    """Fields of one record; ``problem`` tells what is wrong with it, if anything."""
    out = dict.fromkeys(FIELDS)
    head, sep, block = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    missing = [f for f in ("warc-type", "warc-record-id", "warc-date", "content-length") if f not in fields]
    if not sep or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        return out | {"problem": "no WARC header"}
    if missing:
        return out | {"problem": f"missing {', '.join(missing)}"}
    if not fields["content-length"].isdigit():
        return out | {"problem": "bad Content-Length"}
    size = int(fields["content-length"])
    if len(block) != size + 4 or block[size:] != b"\r\n\r\n":
        return out | {"problem": f"block of {max(0, len(block) - 4)} bytes, {size} announced"}
    block = block[:size]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        return out | {"problem": "wrong block digest"}

    def page(name: str) -> int | None:
        last = fields.get(name, "").strip("<>").rpartition(":")[2]
        return int(last) if last.lstrip("-").isdigit() else None

    http, _, payload = block.partition(b"\r\n\r\n")
    announced = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length" and v.strip().isdigit()), None)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    out |= {"page_id": page("warc-record-id"), "record_type": fields["warc-type"], "target_uri": fields.get("warc-target-uri"), "refers_to": page("warc-refers-to"), "payload_bytes": announced, "payload_digest": digest}
    if fields["warc-type"] == "response":
        real = hashlib.sha256(payload).hexdigest()
        if announced != len(payload):
            return out | {"problem": f"payload of {len(payload)} bytes, {announced} announced"}
        if digest is not None and digest != real:
            return out | {"problem": "wrong payload digest"}
        out |= {"payload": payload, "payload_digest": real}
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for batch in batches:
        for content in batch.column("content"):
            try:
                for raw in frames(content.as_buffer().to_pybytes()):
                    rows.append(parse(raw))
                    size += len(raw)
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows, size = [], 0
            except (ValueError, zstandard.ZstdError) as e:
                rows.append(dict.fromkeys(FIELDS) | {"problem": f"archive: {e}"})
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in ``path``; revisits have no payload of their own."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(tidy(_read), RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)
