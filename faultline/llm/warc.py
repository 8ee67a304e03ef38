"""WARC archives: written by tasks, and read by byte ranges of any size.

Every record is one gzip member. A reading task gets a byte range of a file. It looks for the gzip magic number from the
range's start, takes a place for a member where its first bytes decode to a WARC version line, and owns the records
that start inside its range; the last of them may end in the next one. Compressed bytes that look like a member don't decode to a
version line, so a range may start anywhere. Bytes between members that fit nothing are skipped.

Equal payloads are stored once: of the pages whose payloads are equal and have REVISIT_BYTES or more, the one of largest id is a response,
the others are revisit records that refer to it. The digest decides, so pages move by digest only where they have to;
a digest that a third of all pages share is split by Spark's skew handling, since its winner is one row.

Tasks name their files by attempt, and only files in the returned manifest belong to the archive.

Defined results: a null payload is written as an empty one. Pages without an id are written too; they are never referred to while
another page of that payload has an id, and their record has no page id. Rows that repeat the winning id are responses
as it is. A null url leaves out the target. An empty table gives no archive and an empty result. Only page_id, url and html are
read, so names of other columns cannot clash. A payload of any length is one record, which its task holds whole.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.support import file_system, materialise, new_folder, table

REVISIT_BYTES = 1000
#: Bytes of a file that one row of work covers, and bytes read at a time.
RANGE_BYTES, READ_BYTES = 8 * 2**20, 2**17
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
#: A capture date, as the table has none.
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit with the payload's digest alone."""
    head = HTTP_HEAD.format(len(payload)).encode()
    block = head if refers_to is not None else head + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-Id", str(refers_to))]
    text = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a decoded record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    return fields, rest[: int(fields.get("content-length", 0))]


class Window:
    """Bytes of a file from `start` on, read piece by piece as they are asked for."""

    def __init__(self, file: pa.NativeFile, start: int):
        self.file, self.start, self.size, self.held = file, start, file.size(), b""

    def more(self) -> bool:
        piece = self.file.read_at(READ_BYTES, self.start + len(self.held)) if self.start + len(self.held) < self.size else b""
        self.held += piece
        return bool(piece)

    def drop(self, n: int) -> None:
        self.start, self.held = self.start + n, self.held[n:]


def member_at(window: Window, at: int) -> tuple[bytes, int] | None:
    """The decoded record at place `at` of the window and the place behind it; None where no whole record is."""
    unpacker, out, used = zlib.decompressobj(31), io.BytesIO(), at
    try:
        while not unpacker.eof:
            if used == len(window.held) and not window.more():
                return None
            piece = window.held[used : used + READ_BYTES]
            # A few bytes first: what isn't a record is found out before much is decoded.
            piece = piece[:512] if used == at else piece
            used += len(piece)
            out.write(unpacker.decompress(piece))
            start = out.getbuffer()[: len(VERSION)]
            wrong = bytes(start) != VERSION[: len(start)]
            start.release()
            if wrong:
                return None
    except zlib.error:
        return None
    return (out.getvalue(), used - len(unpacker.unused_data)) if out.tell() >= len(VERSION) else None


def records_in(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, fields and block of every record that starts in bytes start to end - 1."""
    window = Window(file, start)
    while window.start < end:
        at = window.held.find(MAGIC)
        if at < 0:
            keep = min(len(window.held), len(MAGIC) - 1)  # the magic number may go on in the next piece
            window.drop(len(window.held) - keep)
            if not window.more():
                return
            continue
        window.drop(at)
        if window.start >= end:
            return
        found = member_at(window, 0)
        if found is None:
            window.drop(1)
            continue
        yield window.start, *parsed(found[0])
        window.drop(found[1])


def with_roles(pages: DataFrame) -> DataFrame:
    """page_id, url, html and refers_to: the largest id of an equal payload for pages that revisit it, else null."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("n_bytes"))
    large = keyed.where(F.col("n_bytes") >= REVISIT_BYTES)
    winners = large.groupBy("digest").agg(F.count("*").alias("pages"), F.max("page_id").alias("winner")).where("pages > 1 and winner is not null").select("digest", "winner")
    joined = keyed.join(winners, "digest", "left")
    revisits = F.col("winner").isNotNull() & ~F.col("winner").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "html", F.when(revisits, F.col("winner")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of `pages` (page_id, url, html) and return the manifest: path, n_bytes, n_records."""
    if file_system(folder)[0].type_name == "local":
        file_system(folder)[0].create_dir(file_system(folder)[1])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out, n_bytes, n_records = TaskContext.get(), None, 0, 0
        path = f"{folder}/pages-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    system, place = file_system(path)
                    out = system.open_output_stream(place, compression=None)
                data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to)
                out.write(data)
                n_bytes, n_records = n_bytes + len(data), n_records + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n_bytes]), pa.array([n_records])], ["path", "n_bytes", "n_records"])

    written = with_roles(pages).mapInArrow(write, "path string, n_bytes long, n_records long")
    return materialise(written, "archive-manifest")


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every record of `files` (path, n_bytes): path, place, record_type, page_id, url, refers_to, payload_digest (hex), payload.

    The payload of a revisit is null. Any gzipped WARC file will do; records of others have no page_id.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("place", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for piece in batch.to_pylist():
                system, place = file_system(piece["path"])
                with system.open_input_file(place) as file:
                    rows, held = [], 0
                    for at, fields, block in records_in(file, piece["start"], piece["start"] + range_bytes):
                        revisit = fields.get("warc-type") == "revisit"
                        payload = None if revisit else block.partition(b"\r\n\r\n")[2] if "http" in fields.get("content-type", "") else block
                        stored = fields.get("warc-payload-digest", "")
                        digest = base64.b32decode(stored[5:]).hex() if stored.startswith("sha1:") else None
                        number = lambda name: int(fields[name]) if name in fields else None  # noqa: B023, E731
                        rows.append((piece["path"], at, fields.get("warc-type"), number("x-page-id"), fields.get("warc-target-uri"), number("x-refers-to-page-id"), digest, payload))
                        held += len(block)
                        if held > 128 * READ_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = files.select("path", starts.alias("start"))
    total = files.agg(F.sum(F.ceil(F.col("n_bytes") / range_bytes))).first()[0] or 1
    dealt = ranges.repartition(int(total), "path", "start")
    return dealt.mapInArrow(read, "path string, place long, record_type string, page_id long, url string, refers_to long, payload_digest string, payload binary")


def record_facts(records: DataFrame) -> DataFrame:
    """Per record: page_id, and size and digest of the full payload, which a revisit takes from the response it refers to."""
    measured = records.select(
        "page_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")
    )
    read = materialise(measured, "records")
    responses = read.where("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("their_bytes"), F.col("payload_digest").alias("their_digest"))
    referred = read.where("refers_to is not null").select("refers_to").distinct()
    targets = responses.join(referred, "refers_to", "left_semi").dropDuplicates(["refers_to"])
    joined = read.join(targets, "refers_to", "left")
    return joined.select(
        "page_id",
        F.coalesce("payload_bytes", "their_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "their_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), new_folder(spark, "archives"))
    return record_facts(read_archives(manifest))
