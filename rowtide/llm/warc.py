"""WARC archives whose records are compressed one by one against a Zstandard dictionary.

An archive is a file of a bounded size: a skippable frame that holds a dictionary built from the archive's own
records, then a frame per record, so that any record can be read alone with the dictionary. Of equal
payloads of at least ``MIN_REVISIT`` bytes one is written as a response, the others as revisits of it.

Spark writes and reads the files, so they can be on any store it reaches, and a lost task leaves nothing
behind. Spark's text writer ends each row with a separator; the separator used is an empty skippable frame,
which every Zstandard reader passes over.

Defined results: a null payload is empty, a null URL becomes ``urn:page:<id>``; of equal payloads that with the
largest page id is the response (null ids are the smallest; rows that share the largest id are responses all);
extra columns are left out; an empty table gives no archive and reads as an empty table.
"""

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtide.llm.stage import bounded_batches

MIN_REVISIT = 1000
ARCHIVE_BYTES = 8 * 1024 * 1024  # of records, before compression; one larger record is an archive of its own
DICTIONARY_BYTES = 112_640
LEVEL = 6

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

_READ = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
         "payload binary, archive string, frame_offset long, frame_bytes long")


def planned(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``page_id, url, payload, sha1, size, refers_to`` per page; the payload is null where the record is a
    revisit of the page ``refers_to``."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url",
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({
        "sha1": F.sha1("payload"), "digest": F.unhex(F.sha2("payload", 256)),
        "size": F.octet_length("payload").cast("long")})
    equal = rows.where(F.col("size") >= min_revisit).groupBy("digest").agg(
        F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    joined = rows.join(equal.drop("copies"), "digest", "left")
    again = F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("page_id"))
    return joined.select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "sha1", "size",
        F.when(again, F.col("keeper")).alias("refers_to"))


def record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {sha1}'.encode()).digest(), version=4)}>"


def _header(fields: list[tuple[str, object]], length: int) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in fields if v is not None], f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode()


def record(page_id: int | None, url: str | None, payload: bytes | None, sha1: str, size: int, refers_to: int | None) -> bytes:
    """The bytes of a record. A revisit keeps the HTTP header only."""
    target = f"urn:page:{page_id}" if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, sha1)),
        ("WARC-Target-URI", target),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(refers_to, sha1) if revisit else None),
        ("Page-Id", page_id),
        ("Has-Target-URI", None if url is None else 1),
        ("Refers-To-Page-Id", refers_to),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return _header(fields, len(block)) + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES):
    """A dictionary from the records, or None where they are too few or too small for one."""
    import zstandard

    total = sum(map(len, records))
    size = min(size, total // 8)
    if len(records) < 8 or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, records, k=200, d=8)
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes], level: int = LEVEL) -> bytes:
    """One archive: the dictionary in a leading skippable frame, and a frame for each record."""
    import zstandard

    dictionary = build_dictionary(records)
    body = dictionary.as_bytes() if dictionary else b""
    info = _header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, str(len(records)))), ("WARC-Date", DATE),
                    ("Content-Type", "application/warc-fields")], 0) + b"\r\n\r\n"
    packer = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True, write_content_size=True)
    frames = [struct.pack("<II", DICTIONARY_MAGIC, len(body)), body]
    frames.extend(packer.compress(r) for r in [info, *records])
    return b"".join(frames)


def write(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the pages as archives below ``path``, one file each."""
    bounded_batches(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], ["archive"])
        for batch in batches:
            for row in zip(*batch.columns):
                made = record(*[v.as_py() for v in row])
                if held and size + len(made) > archive_bytes:
                    yield pack()
                    held, size = [], 0
                held.append(made)
                size += len(made)
        if held:
            yield pack()

    archives = planned(pages, min_revisit).mapInArrow(work, "archive binary")
    whole = archives.select(F.col("archive").cast("string").alias("value"))
    whole.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


def frames(data: bytes) -> Iterator[tuple[int, int, int]]:
    """Magic number, begin and end of every frame, from the frame and block headers alone."""
    import zstandard

    at, view = 0, memoryview(data)
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            end = at + 8 + size
        elif magic == FRAME_MAGIC:
            head = view[at: at + 18]
            end, last = at + zstandard.frame_header_size(head), False
            while not last:
                block = int.from_bytes(view[end: end + 3], "little")
                last, kind = block & 1, block >> 1 & 3
                end += 3 + (1 if kind == 1 else block >> 3)
            end += 4 * zstandard.get_frame_parameters(head).has_checksum
        else:
            raise ValueError(f"no frame at {at}")
        yield magic, at, end
        at = end


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Header fields, block, place and length of every record of an archive."""
    import zstandard

    reader = zstandard.ZstdDecompressor()
    for magic, begin, end in frames(data):
        if magic == DICTIONARY_MAGIC and begin == 0:
            if end > begin + 8:
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[begin + 8: end]))
        elif magic == FRAME_MAGIC:
            text = reader.decompress(data[begin:end])
            head, _, rest = text.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])], begin, end - begin


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per page record of the archives below ``path``; ``payload`` is null for revisits.

    The payload of a response is hashed again: a digest that differs from the header's fails the job."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                out, size = [], 0
                for fields, block, begin, length in records(content.as_py()):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    sha1 = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    http, _, payload = block.partition(b"\r\n\r\n")
                    stated = int(http.rpartition(b"Content-Length: ")[2])
                    response = fields["WARC-Type"] == "response"
                    if response and (hashlib.sha1(payload).hexdigest() != sha1 or len(payload) != stated):
                        raise ValueError(f"{path}: the record at {begin} is damaged")
                    number = lambda name: int(fields[name]) if name in fields else None
                    out.append({
                        "page_id": number("Page-Id"), "url": fields["WARC-Target-URI"] if "Has-Target-URI" in fields else None,
                        "payload_bytes": stated, "payload_digest": sha1, "record_type": fields["WARC-Type"],
                        "refers_to": number("Refers-To-Page-Id"), "payload": payload if response else None,
                        "archive": path.as_py(), "frame_offset": begin, "frame_bytes": length})
                    size += len(payload)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(out, shape)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, shape)

    long, string = pa.int64(), pa.string()
    shape = pa.schema([
        ("page_id", long), ("url", string), ("payload_bytes", long), ("payload_digest", string), ("record_type", string),
        ("refers_to", long), ("payload", pa.binary()), ("archive", string), ("frame_offset", long), ("frame_bytes", long)])
    return files.mapInArrow(work, _READ)
