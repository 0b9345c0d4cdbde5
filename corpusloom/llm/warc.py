"""WARC archives in Zstandard: writer, reader and the query op7.

An archive is one leading skippable frame that holds a dictionary, then one Zstandard frame for each
record. The reader loads the dictionary, walks the frames by their block headers, decodes one frame
to one record and validates version line, header fields, lengths and digests.

Cases: null html is an empty payload; null url leaves WARC-Target-URI out; a null page_id is never the
response that others refer to when some other page has the payload; rows that repeat a page_id with an
equal payload are the same page and are written alike; an empty table makes no archive; a URL is written and
read as it stands, but for line breaks and white space at its ends, which become %XX. Other columns
of the pages are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, materialize, salted_left_join, table

#: Magic number of the skippable frame that carries the dictionary, and of a Zstandard frame.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: Payloads of fewer bytes are always stored whole.
LEAST_REVISIT_BYTES = 1000
#: The dictionary is trained on so many pages of at most so many bytes.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 65536, 16384
#: An archive is closed once its frames take so many bytes.
ARCHIVE_BYTES = 2 << 20
CRLF = b"\r\n"
#: What would break a header line, or be stripped from its ends: written as %XX. All other characters of a URL stay as they are.
LINE_BREAK = re.compile(r"[\r\n]|^\s|\s$")
ARCHIVES = "name string, content binary"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"


class ArchiveError(ValueError):
    """An archive or a record that breaks the format."""


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or none where the samples are too few or too short to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def frame_length(buf: memoryview, pos: int) -> int:
    """Bytes of the frame at `pos`, from its header and block headers."""
    if len(buf) - pos < 8:
        raise ArchiveError("truncated frame")
    magic, size = struct.unpack_from("<II", buf, pos)
    if 0x184D2A50 <= magic <= 0x184D2A5F:
        end = pos + 8 + size
    elif magic == FRAME_MAGIC:
        flags = buf[pos + 4]
        single, ids, sizes = flags >> 5 & 1, (0, 1, 2, 4)[flags & 3], flags >> 6
        end = pos + 5 + (not single) + ids + ((0, 2, 4, 8)[sizes] or single)
        last = False
        while not last:
            if end + 3 > len(buf):
                raise ArchiveError("truncated block")
            head = buf[end] | buf[end + 1] << 8 | buf[end + 2] << 16
            last, kind, n = head & 1, head >> 1 & 3, head >> 3
            if kind == 3:
                raise ArchiveError("reserved block type")
            end += 3 + (1 if kind == 1 else n)
        end += 4 * (flags >> 2 & 1)
    else:
        raise ArchiveError(f"no frame at byte {pos}")
    if end > len(buf):
        raise ArchiveError("truncated frame")
    return end - pos


def make_record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One response or revisit record. A revisit carries the HTTP header only."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + LINE_BREAK.sub(lambda m: urllib.parse.quote(m[0]), url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF


def parse_record(raw: bytes) -> dict:
    """Header fields and payload of one decoded record, validated."""
    cut = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/1.") or cut < 0:
        raise ArchiveError("no WARC header")
    fields = {}
    for line in raw[:cut].split(CRLF)[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise ArchiveError("header line without a colon")
        fields[key.decode().lower()] = value.strip().decode()
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if key not in fields:
            raise ArchiveError(f"no {key}")
    block = raw[cut + 4 : -4]
    if raw[-4:] != CRLF + CRLF or len(block) != int(fields["content-length"]):
        raise ArchiveError("Content-Length differs from the block")
    if fields.get("warc-block-digest", "sha1:" + hashlib.sha1(block).hexdigest()) != "sha1:" + hashlib.sha1(block).hexdigest():
        raise ArchiveError("block digest differs")
    at = block.find(b"\r\n\r\n")
    if at < 0:
        raise ArchiveError("no HTTP header")
    length = next((int(x.partition(b":")[2]) for x in block[:at].lower().split(CRLF) if x.startswith(b"content-length:")), None)
    payload, digest = block[at + 4 :], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    number = lambda x: None if x is None or x == "<urn:page:null>" else int(x[10:-1])
    if fields["warc-type"] == "response":
        if len(payload) != length or hashlib.sha1(payload).hexdigest() != digest:
            raise ArchiveError("payload differs from its length or digest")
    elif fields["warc-type"] != "revisit" or payload or "warc-refers-to" not in fields or length is None:
        raise ArchiveError("not a response or a revisit")
    return {"page_id": number(fields["warc-record-id"]), "payload_bytes": length, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": number(fields.get("warc-refers-to")), "url": fields.get("warc-target-uri"), "payload": payload if fields["warc-type"] == "response" else None}


def dictionary_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=9).compress(dictionary) if dictionary else b""
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    extra = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=3, write_checksum=True, **extra)


def read_archive(content: bytes) -> Iterator[dict]:
    """Records of an archive, one for each frame."""
    buf, pos, extra = memoryview(content), 0, {}
    while pos < len(buf):
        n = frame_length(buf, pos)
        magic = struct.unpack_from("<I", buf, pos)[0]
        if magic == DICTIONARY_MAGIC and pos == 0:
            body = bytes(buf[8:n])
            if body[:4] == struct.pack("<I", FRAME_MAGIC):
                body = zstandard.ZstdDecompressor().decompress(body)
            extra = {"dict_data": zstandard.ZstdCompressionDict(body)} if body else {}
        elif magic == FRAME_MAGIC:
            if pos == 0 or "reader" not in extra:
                extra["reader"] = zstandard.ZstdDecompressor(**{k: v for k, v in extra.items() if k == "dict_data"})
            size = zstandard.frame_content_size(buf[pos : pos + n])
            raw = extra["reader"].decompress(bytes(buf[pos : pos + n]))
            if size >= 0 and size != len(raw):
                raise ArchiveError("frame content size differs")
            yield parse_record(raw)
        pos += n


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives (name, content) of pages(page_id, url, html), one record a row.

    Of equal payloads of 1000 bytes or more, the one with the largest page_id is stored; the others revisit it.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    # the sample is drawn by number first, so that only its own payloads travel
    drawn = rows.filter(F.octet_length("payload").between(1, SAMPLE_BYTES)).select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES)
    small = rows.join(F.broadcast(drawn), "page_id").filter(F.octet_length("payload").between(1, SAMPLE_BYTES)).groupBy("page_id").agg(F.min("payload").alias("payload"))
    dictionary = spark.sparkContext.broadcast(train_dictionary([bytes(r[1]) for r in sorted(small.collect())]))
    rows = rows.withColumn("digest", F.sha1("payload"))
    stored = F.when(F.octet_length("payload") >= LEAST_REVISIT_BYTES, F.col("digest"))
    keys = rows.select("page_id", stored.alias("stored"))
    groups = keys.filter(F.col("stored").isNotNull()).groupBy("stored").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("stored", "kept")
    hot = hot_keys(keys, "stored")
    rows = salted_left_join(rows.withColumn("stored", stored), groups, "stored", hot, spread=F.xxhash64("page_id"))
    refers = F.when(F.col("kept").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("kept"))), F.col("kept"))
    rows = rows.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))

    def pack(batches):
        from pyspark import TaskContext

        lead, press = dictionary_frame(dictionary.value), compressor(dictionary.value)
        part, n, frames, size = TaskContext.get().partitionId(), 0, [], 0
        archive = lambda: pa.RecordBatch.from_pydict({"name": [f"pages-{part:06d}-{n:06d}.warc.zst"], "content": pa.array([lead + b"".join(frames)], pa.binary())})
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                frames.append(press.compress(make_record(page_id, url, payload, digest, refers_to, date)))
                size += len(frames[-1])
                if size >= archive_bytes:
                    yield archive()
                    n, frames, size = n + 1, [], 0
        if frames:
            yield archive()

    return rows.mapInArrow(pack, ARCHIVES)


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of archives given as (content binary): a table of them, or the binaryFile source."""

    def unpack(batches):
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for row in read_archive(content.as_py()):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("content").mapInArrow(unpack, RECORDS)


def save_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Write archives as files of a folder that every executor reaches (any URI that pyarrow knows)."""

    def save(batches):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{top}/{name}.part") as out:
                    out.write(content)
                store.move(f"{top}/{name}.part", f"{top}/{name}")
                yield pa.RecordBatch.from_pydict({"name": [name]})

    return archives.mapInArrow(save, "name string")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for each page, written and read back."""
    archives = materialize(write_archives(table(spark, sf_dir, "pages")), "warc")
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), w AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS kept FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN kept > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept > page_id THEN kept END AS refers_to
FROM w
"""
