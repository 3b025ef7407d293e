"""WARC archives in Zstandard: one frame for each record, a dictionary in the leading skippable frame.

Writing: which records revisit another is found by payload hash. A bitmap of the repeated hashes picks the rows that have to be looked up; only these are shuffled with
their payloads, for a join with a written table that Spark splits where very many pages have one payload. All others are written where they are read. Each task packs its records into archives of about ARCHIVE bytes of content, each with a dictionary
trained on a bounded sample of its own records. An archive is one binary value, so Spark's writers and readers carry
it to and from any store (spark.read.format("binaryFile") gives the same columns for archives in files).

Reading: the dictionary is taken from the leading skippable frame, plain or itself compressed; archives without one, and further skippable frames, are read too.
Frames are found by their block headers and decoded one by one, with or without a content size, and each
record's version line, mandatory headers, lengths, line ends and digests are checked. What fails a check comes out with a text in `error`; what follows a
broken frame can't be found, and the archive ends with an error row there. An empty archive is one error row.

Null html counts as empty. Null or repeated page_ids and null urls are records of their own; rows with the same page_id and payload are all responses
if that page_id is the smallest. An empty table gives no archives. A very long html is one record, and an archive of its own if it exceeds ARCHIVE. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared

#: Magic number of the skippable frame that holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
#: Magic numbers of other skippable frames differ in their last four bits; that of data frames.
SKIPPABLE = 0x184D2A5
FRAME = 0xFD2FB528
ARCHIVE = 8 << 20
DICTIONARY, SAMPLED = 16 << 10, 128
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}|{url}')}>"


def record(page: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """One response or revisit record. The HTTP header of a revisit keeps the length of the payload that it leaves out."""
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page, url)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Page-ID: {'' if page is None else page}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {'' if first is None else first}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


def archive(records: list[bytes]) -> bytes:
    """The records as frames behind their dictionary."""
    step = max(1, len(records) // SAMPLED)
    sample = [r[:16384] for r in records[::step][:SAMPLED]]
    try:
        trained = zstd.train_dictionary(DICTIONARY, sample).as_bytes()
    except (zstd.ZstdError, ValueError):  # too few or too small records: their bytes serve as they are
        trained = b"".join(sample)[-DICTIONARY:] or b"WARC/1.1"
    known = zstd.ZstdCompressionDict(trained)
    pack = zstd.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(trained)), trained, *(pack.compress(r) for r in records)])


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at `at` ends, by its header and the headers of its blocks."""
    if struct.unpack_from("<I", data, at)[0] != FRAME:
        raise ValueError("not a frame")
    flags = data[at + 4]
    single = flags >> 5 & 1
    size = (1 if single else 0, 2, 4, 8)[flags >> 6]
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + size
    last = False
    while not last:
        block = int.from_bytes(data[at : at + 3], "little")
        if at + 3 > len(data):
            raise ValueError("frame is cut off")
        last, kind = bool(block & 1), block >> 1 & 3
        if kind == 3:
            raise ValueError("reserved block")
        at += 3 + (1 if kind == 1 else block >> 3)
    at += 4 if flags >> 2 & 1 else 0
    if at > len(data):
        raise ValueError("frame is cut off")
    return at


def parse(raw: bytes) -> dict:
    """The fields of one record, all checks made."""
    head, _, rest = raw.partition(CRLF * 2)
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError("header line without a name")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not fields.get(name):
            raise ValueError(f"no {name}")
    length = fields["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4:
        raise ValueError("content-length differs from the block")
    if rest[-4:] != CRLF * 2:
        raise ValueError("no line ends behind the block")
    block = rest[:-4]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("block digest differs")
    http, _, payload = block.partition(CRLF * 2)
    inner = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    held = int(inner.get("content-length", len(payload)))
    kind = fields["warc-type"]
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        if payload:
            raise ValueError("revisit with a payload")
    elif held != len(payload):
        raise ValueError("payload differs from its length")
    elif said and said != digest(payload):
        raise ValueError("payload digest differs")
    number = lambda x: int(x) if x else None
    return {
        "page_id": number(fields.get("x-page-id")), "url": fields.get("warc-target-uri"), "payload_bytes": held, "payload_digest": said or digest(payload), "record_type": kind,
        "refers_to": number(fields.get("x-refers-to-page-id")), "payload": None if kind == "revisit" else payload,
    }


def dictionary(raw: bytes) -> zstd.ZstdCompressionDict:
    """The dictionary that a skippable frame holds, plain or as a Zstandard frame."""
    if raw[:4] == struct.pack("<I", FRAME):
        raw = zstd.ZstdDecompressor().decompressobj().decompress(raw)
    return zstd.ZstdCompressionDict(raw)


def records_of(content: bytes):
    """(record, None) or (None, error) for each frame."""
    data, at = memoryview(content), 0
    unpack = zstd.ZstdDecompressor()
    if not len(data):
        yield None, "empty archive"
    while at < len(data):
        try:
            magic = struct.unpack_from("<I", data, at)[0]
            if magic >> 4 == SKIPPABLE:
                end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
                if end > len(data):
                    raise ValueError("frame is cut off")
                if not at and magic == DICTIONARY_FRAME:
                    unpack = zstd.ZstdDecompressor(dict_data=dictionary(bytes(data[8:end])))
                at = end
                continue
            end = frame_end(data, at)
        except (ValueError, struct.error, IndexError, zstd.ZstdError) as e:
            yield None, str(e)
            return
        try:
            frame = unpack.decompressobj()  # reads frames without a content size too
            raw = frame.decompress(data[at:end])
            if not frame.eof:
                raise ValueError("frame ends early")
            yield parse(raw), None
        except (ValueError, zstd.ZstdError) as e:
            yield None, str(e)
        at = end


def _write(batches):
    held, size = [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary()), pa.array([len(held)], pa.int64())], ["content", "records"])

    for batch in batches:
        for page, url, html, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(record(page, url, (html or "").encode(), first, revisit))
            size += len(held[-1])
            if size >= ARCHIVE:
                yield out()
                held, size = [], 0
    if held:
        yield out()


KINDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string, error string"


def _read(batches):
    names = [k.split()[0] for k in KINDS.split(", ")]
    types = {"long": pa.int64(), "string": pa.string()}
    kinds = [types[k.split()[1]] for k in KINDS.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, kinds, strict=True)], names)

    for batch in batches:
        for content in batch.column(0):
            rows = []
            for got, error in records_of(content.as_py() or b""):
                if got:
                    got["payload"] = got["payload"].decode("utf-8", "replace") if got["payload"] is not None else None
                rows.append(got or {"error": error})
                if len(rows) == 500:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)


def write_archives(pages: DataFrame, least: int = 0) -> DataFrame:
    """(content, records): archives of all pages; of equal payloads of `least` bytes or more, all but the first are revisits."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    page = page.select("*", F.octet_length(html).alias("length"), F.sha2(html, 256).alias("key"))
    again = page.where(F.col("length") >= least).groupBy("key").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1")
    again = _shared.written(again.select(F.xxhash64("key").alias("hash"), F.col("key").alias("k"), "first"), "again")
    row = _shared.marked(page, F.xxhash64("key"), again)
    single = row.where("not may_").select("page_id", "url", "html", F.lit(None).cast("long").alias("first"), F.lit(False).alias("revisit"))
    later = F.col("k").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    told = row.where("may_").join(again, F.col("key") == F.col("k"), "left").select("page_id", "url", "html", "first", later.alias("revisit"))
    return single.union(told).mapInArrow(_write, "content binary, records long")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives (content): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits) and error."""
    return archives.select("content").mapInArrow(_read, KINDS)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """All pages, written to archives and read back."""
    archives = _shared.written(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")), "warc")
    found = read_archives(archives)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
