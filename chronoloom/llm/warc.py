"""WARC archives compressed with Zstandard: a dictionary in a leading skippable frame, then one frame for each record.

Archives are plain files in any store that Spark writes to and reads from. Between records stands an empty skippable frame, which
every Zstandard reader passes over: it is the line separator with which Spark's text writer writes the frames as they are.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import may_be_among, scratch_folder, small_batches, written

# Fixed values of the formats.
ZSTD_MAGIC = (0xFD2FB528).to_bytes(4, "little")
DICTIONARY_MAGIC = (0x184D2A5D).to_bytes(4, "little")
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"  # pages have none
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 1 << 13, 1 << 15
RECORDS = 4096  # of one archive, which a task reads whole
HOT_GROUPS = 4096  # groups of equal payloads whose first rows are broadcast
URN = "urn:page:"

READ = "path string, at long, record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, error string"


# Writing.


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, body, digest (hexadecimal SHA-1), size, first: the page_id that a revisit refers to, else null.

    Of rows with equal bodies of at least `least_bytes`, the one of least page_id keeps its body; the others are revisits and lose
    it. The groups with most rows are broadcast (at most HOT_GROUPS); a bitmap finds the rows that may be in one of the others, and
    only these are shuffled, each group with at most 1 / HOT_GROUPS of all rows. A null html is an empty body. A row without an id
    is never a first one but where its whole group has none; then all its rows keep their bodies, as do rows that share the least id.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("body"))
    rows = rows.withColumns({"digest": F.sha1("body"), "size": F.octet_length("body").cast("long")})
    groups = rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared, _ = written(groups.where("n > 1 and first is not null"))
    hot, _ = written(shared.orderBy(F.desc("n"), "digest").limit(HOT_GROUPS).drop("n"))
    rest = shared.drop("n").join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    told = may_be_among(rows.join(F.broadcast(hot), "digest", "left"), F.col("digest"), rest.select("digest"), "_maybe")
    open_ = F.col("first").isNull() & F.col("_maybe")
    found = told.where(~open_).unionByName(told.where(open_).drop("first").join(rest, "digest", "left"))
    first = F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first"))
    return found.select("page_id", "url", "digest", "size", first.alias("first"), F.when(first.isNull(), F.col("body")).alias("body"))


def trained_dictionary(pages: DataFrame) -> bytes:
    """A Zstandard dictionary from the first SAMPLE_BYTES of SAMPLE_ROWS pages, those of least hash; empty if there are too few."""
    rows = pages.where("html <> ''").select(F.xxhash64("page_id", "url").alias("_h"), F.substring("html", 1, SAMPLE_BYTES).alias("text"))
    least = rows.select("_h").orderBy("_h").limit(SAMPLE_ROWS).agg(F.max("_h")).first()[0]  # only hashes are compared on the driver
    texts = [r.text.encode() for r in rows.where(F.col("_h") <= least).limit(SAMPLE_ROWS).collect()] if least is not None else []
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b""


def record_bytes(page_id: str, url: str | None, body: bytes | None, digest: str, size: int, first: str | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit without one that refers to `first`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if first is not None else http + body
    lines = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", f"<{URN}{quote(page_id, safe='')}>"),
        ("WARC-Date", NO_DATE),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url:  # white space and control characters can't stand in a header
        lines.append(("WARC-Target-URI", "".join(quote(c) if c <= "\x20" or "\x7f" <= c <= "\xa0" or c in "  " else c for c in url)))
    if first is not None:
        lines += [("WARC-Refers-To", f"<{URN}{quote(first, safe='')}>"), ("WARC-Profile", REVISIT_PROFILE)]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def skippable_frame(data: bytes, magic: bytes = DICTIONARY_MAGIC) -> bytes:
    return magic + len(data).to_bytes(4, "little") + data


def write_archives(pages: DataFrame, folder: str, records: int = RECORDS) -> None:
    """Writes a record for each row of pages (page_id, url, html) to archives in `folder`, of at most `records` records each.

    Other columns are left out. Nulls, empty pages and equal rows: see with_revisits. An empty table gives no archive with records.
    A null page_id is an empty record id. The dictionary is trained on a bounded sample (trained_dictionary); it is itself
    compressed, at the head of every archive.
    """
    dictionary = trained_dictionary(pages)
    head = skippable_frame(zstandard.compress(dictionary)) if dictionary else skippable_frame(b"", EMPTY_FRAME[:4].encode())
    rows = with_revisits(pages).select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page_id"), "url", "body", "digest", "size", F.col("first").cast("string").alias("first")
    )

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True, write_content_size=True)
        n = 0
        for batch in batches:
            out = []
            for page_id, url, body, digest, size, first in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if n % records == 0:  # the writer begins a new file after records + 1 rows, which the dictionary heads
                    out.append(head)
                n += 1
                out.append(packer.compress(record_bytes(page_id, url, None if body is None else body.encode(), digest, size, first)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    with small_batches(pages.sparkSession):
        packed = rows.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
        packed.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", records + 1).text(folder)


# Reading.


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at `at` ends, from the lengths of its blocks; ValueError if it goes beyond the data."""
    head = bytes(data[at : at + 18])
    try:
        place = at + zstandard.frame_header_size(head)
    except zstandard.ZstdError as e:
        raise ValueError(f"broken frame header: {e}") from e
    last = False
    while not last:
        if place + 3 > len(data):
            raise ValueError("archive ends inside a frame")
        block = int.from_bytes(data[place : place + 3], "little")
        last = bool(block & 1)
        place += 3 + (1 if (block >> 1) & 3 == 1 else block >> 3)  # a run has one byte
    place += 4 if head[4] & 4 else 0  # checksum
    if place > len(data):
        raise ValueError("archive ends inside a frame")
    return place


def archive_frames(data: memoryview) -> Iterator[tuple[int, bytes | ValueError]]:
    """Offset and content of each frame, decoded with the dictionary that the leading skippable frame holds, if it does.

    A frame that can't be decoded gives the error and the next ones go on; one whose end isn't known ends the archive.
    """
    at, known = 0, None
    if bytes(data[:4]) == DICTIONARY_MAGIC:
        held = bytes(data[8 : 8 + int.from_bytes(data[4:8], "little")])
        if held[:4] == ZSTD_MAGIC:
            held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
        known = zstandard.ZstdCompressionDict(held)
    reader = zstandard.ZstdDecompressor(dict_data=known)
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic in SKIPPABLE and at + 8 <= len(data):
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            if end > len(data):
                yield at, ValueError("archive ends inside a frame")
            at = end
            continue
        if bytes(data[at : at + 4]) != ZSTD_MAGIC:
            yield at, ValueError("not a Zstandard frame")
            return
        try:
            end = frame_end(data, at)
        except ValueError as e:
            yield at, e
            return
        try:
            yield at, reader.decompressobj().decompress(data[at:end])
        except zstandard.ZstdError as e:
            yield at, ValueError(f"frame can't be decoded: {e}")
        at = end


def parsed_record(record: bytes) -> dict:
    """The fields of READ that a record has; ValueError if its headers, lengths or digest don't hold."""
    head, found, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not found or not first.startswith(b"WARC/"):
        raise ValueError("no WARC header")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError("header without a name")
        headers[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    missing = [h for h in REQUIRED if not headers.get(h)]
    if missing:
        raise ValueError(f"no {missing[0]} header")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("content-length does not hold")
    kind, block, payload, told = headers["warc-type"], rest[:-4], rest[:-4], None
    if headers.get("content-type", "").startswith("application/http"):
        http, found, payload = block.partition(b"\r\n\r\n")
        if not found:
            raise ValueError("no HTTP header")
        fields = [line.partition(b":") for line in http.split(b"\r\n")[1:]]
        told = next((int(v) for k, _, v in fields if k.strip().lower() == b"content-length" and v.strip().isdigit()), None)
    digest = headers.get("warc-payload-digest", "").partition("sha1:")[2]
    if kind == "revisit":
        if not digest or not headers.get("warc-refers-to"):
            raise ValueError("a revisit without digest or reference")
        size, payload = told, None
    else:
        size = len(payload)
        if told is not None and told != size:
            raise ValueError("length of the payload does not hold")
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest not in ("", own):
            raise ValueError("payload digest does not hold")
        digest = own
    bare = lambda v: unquote(v.strip("<>").removeprefix(URN)) if v is not None else None
    return {
        "record_id": bare(headers["warc-record-id"]), "record_type": kind, "target_uri": headers.get("warc-target-uri"), "refers_to": bare(headers.get("warc-refers-to")),
        "payload_bytes": size, "payload_digest": digest, "payload": payload,
    }


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The columns of READ, a row for each record of the archives in `folder`; `at` is the offset of its frame.

    Headers, lengths, checksums and digests are checked; what doesn't hold is a row with `error` and nulls. Revisits have no
    payload; their payload_bytes and payload_digest are those of the page they repeat, as their headers say. Archives without a
    dictionary, and skippable frames anywhere, are fine. An archive is decoded by one task, a frame at a time.
    """
    schema = READ if payloads else READ.replace(", payload binary", "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                out, held = [], 0
                for at, frame in archive_frames(memoryview(content.as_buffer())):
                    row = {"path": path.as_py(), "at": at}
                    try:
                        if isinstance(frame, ValueError):
                            raise frame
                        row |= parsed_record(frame)
                        held += len(frame)
                    except ValueError as e:
                        row["error"] = str(e)
                    out.append(row)
                    if held > 1 << 24 or len(out) >= 1 << 12:
                        yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in names} for r in out], fields)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in names} for r in out], fields)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("path", "content").mapInArrow(records, schema)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes archives of pages to a folder of this application and reads them back; a record that doesn't hold is an error."""
    folder = f"{scratch_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    read = read_archives(pages.sparkSession, folder, payloads=False)
    kind = pages.schema["page_id"].dataType
    id_of = lambda c: F.when(c != "", c).cast(kind)
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "path", "error")).cast("string")).otherwise(F.col("record_id"))
    return read.select(id_of(sound).alias("page_id"), "payload_bytes", "payload_digest", "record_type", id_of(F.col("refers_to")).alias("refers_to"))
