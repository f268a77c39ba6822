"""WARC archives, Zstandard-compressed record by record with a shared dictionary.

An archive is a leading skippable frame (magic 0x184D2A5D) that holds the dictionary, then one frame for each record. The
writer trains the dictionary on samples of the archive's own payloads and writes a record for each page: the largest page_id of
equal payloads of at least ``LEAST_REVISIT`` bytes is a response, the others are revisits that name it and carry no payload.
The reader loads the dictionary from the leading frame, decodes one frame for each record, and validates version, required
headers, type, content length, the record's end, payload length and payload digest; a damaged record is returned with
its error, and reading goes on with the next frame.

Archives are rows (archive, content), as Spark's binaryFile reader yields files (path, content); ``read`` takes either.

Defined cases: a null payload is empty; a null url is written as an empty target; a null page_id is written empty and read as null, and
is a response only if its group has no other id; rows that repeat the largest page_id are responses all; an empty table gives no
archives and no rows; other columns are not read. An archive is one value of a row: its size is bound by ``archive_bytes`` when written here, and by
Spark's limit of 2 GB for a binary value when read.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_REVISIT = 1000
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_BYTES = 16_384
SAMPLES = 64
SAMPLE_BYTES = 4096
#: payload bytes of an archive, about
ARCHIVE_BYTES = 8_000_000
LEVEL = 3
#: bytes of an archive first given to the decoder of a frame
SLICE = 4096
DATE = "1970-01-01T00:00:00Z"
RECORD_SCHEMA = "archive string, record_offset long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"


def marked(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url, payload, digest, and refers_to: the response's page_id for a revisit, else null."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= LEAST_REVISIT
    # only digests that occur more than once need a join; small payloads never do
    named = rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("k")).filter("k > 1").select("digest", "last")
    revisit = large & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    # those have a key of their own each, which meets nothing and lies anywhere
    key = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id()))
    rows = rows.withColumn("key", key).join(named.withColumnRenamed("digest", "key"), "key", "left")
    return rows.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("last")).alias("refers_to"))


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    name = lambda n: f"<urn:page:{'' if n is None else n}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join((url or '').splitlines())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _archive(records: list[bytes]) -> bytes:
    import zstandard

    step = max(1, len(records) // SAMPLES)
    samples = [r[:SAMPLE_BYTES] for r in records[::step]]
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:  # too few or too small samples: the first record's bytes serve as they are
        dictionary = zstandard.ZstdCompressionDict(samples[0], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = dictionary.as_bytes()
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True).compress
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw, *map(pack, records)])


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """archive and content: the archives that hold a record for each page."""

    def run(batches):
        from pyspark import TaskContext

        part, held, size, number = TaskContext.get().partitionId(), [], 0, 0
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                held.append(_record(*row))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"archive": [f"part-{part:05d}-{number:05d}.warc.zst"], "content": [_archive(held)]})
                    held, size, number = [], 0, number + 1
        if held:
            yield pa.RecordBatch.from_pydict({"archive": [f"part-{part:05d}-{number:05d}.warc.zst"], "content": [_archive(held)]})

    return marked(pages, page_id, url, payload).mapInArrow(run, "archive string, content binary")


def _parse(data: bytes) -> dict:
    """The fields of a decoded record; raises ValueError with what is wrong."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("no end of headers")
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC version line")
    head = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            raise ValueError("header without a colon")
        head[key.strip().lower()] = value.strip()
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if key not in head:
            raise ValueError(f"no {key}")
    if head["warc-type"] not in ("response", "revisit"):
        raise ValueError(f"type {head['warc-type']}")
    if not head["content-length"].isdigit():
        raise ValueError("content-length is no number")
    block = data[end + 4 : end + 4 + int(head["content-length"])]
    if len(block) != int(head["content-length"]) or data[end + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("content-length does not meet the record's end")
    _, blank, payload = block.partition(b"\r\n\r\n")
    if not blank:
        raise ValueError("no end of HTTP headers")
    number = lambda v: int(v[10:-1]) if v.startswith("<urn:page:") and len(v) > 11 else None
    out = {"page_id": number(head["warc-record-id"]), "url": head.get("warc-target-uri"), "record_type": head["warc-type"], "refers_to": None, "payload": None}
    stated = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if out["record_type"] == "response":
        out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
        if stated and stated != out["payload_digest"]:
            raise ValueError("payload digest differs")
        if "x-payload-length" in head and head["x-payload-length"] != str(len(payload)):
            raise ValueError("payload length differs")
    else:
        if "warc-refers-to" not in head:
            raise ValueError("revisit without warc-refers-to")
        length = head.get("x-payload-length", "")
        out |= {"refers_to": number(head["warc-refers-to"]), "payload_bytes": int(length) if length.isdigit() else None, "payload_digest": stated or None}
    return out


def records(content: bytes):
    """(offset of the frame, fields or None, error or None) of each record of an archive."""
    import zstandard

    if len(content) < 8 or struct.unpack_from("<I", content)[0] != DICTIONARY_MAGIC:
        yield 0, None, "no leading dictionary frame"
        return
    at = 8 + struct.unpack_from("<I", content, 4)[0]
    if at > len(content):
        yield 0, None, "dictionary frame is cut off"
        return
    raw = content[8:at]
    if raw[:4] == FRAME_MAGIC:  # the format allows the dictionary itself to be compressed
        try:
            raw, _ = _frame(zstandard.ZstdDecompressor().decompressobj(), memoryview(raw), 0)
        except (zstandard.ZstdError, ValueError) as e:
            yield 0, None, f"dictionary frame: {e}"
            return
    view = memoryview(content)
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    while at < len(content):
        after = -1
        try:
            data, after = _frame(unpack.decompressobj(), view, at)
            yield at, _parse(data), None
        except (zstandard.ZstdError, ValueError) as e:
            yield at, None, str(e)
            if after < 0:
                after = content.find(FRAME_MAGIC, at + 4)
            if after < 0:
                return
        at = after


def _frame(decoder, view: memoryview, at: int) -> tuple[bytes, int]:
    """What the frame at ``at`` holds, and where it ends. Fed in slices, so that no frame copies the rest of its archive."""
    out, size = [], SLICE
    while at < len(view):
        part = view[at : at + size]
        out.append(decoder.decompress(part))
        at += len(part)
        if decoder.eof:
            return b"".join(out), at - len(decoder.unused_data)
        size *= 2
    raise ValueError("frame is cut off")


def read(archives: DataFrame, with_payload: bool = True, batch_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """RECORD_SCHEMA: a row for each record of the archives (archive or path, content); payload is left null if not asked for."""
    name = "archive" if "archive" in archives.columns else "path"
    schema = pa.schema(
        [("archive", pa.string()), ("record_offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string())]
        + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string())]
    )

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                for offset, fields, error in records(content or b""):
                    row = {"archive": archive, "record_offset": offset, "error": error} | (fields or {})
                    size += len(row.get("payload") or b"") + 200
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                    if size > batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select(F.col(name).alias("archive"), "content").mapInArrow(run, RECORD_SCHEMA)
