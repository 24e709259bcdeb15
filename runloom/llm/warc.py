"""WARC archives: records as rows of chunks with running digests, written and read as streams."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.common import ship_package, stored
from runloom.session import shared_folder

#: Bytes of a chunk: a longer payload is written as a response record and continuation records of at most this size.
CHUNK_BYTES = 1 << 20
_END = "\r\n\r\n"
_LABELS = "page_id long, twin long, payload_bytes long, payload_digest string"
_CHUNKS = "record_id string, chunk int, chunk_bytes long, running_bytes long, running_digest string, last boolean, " \
    "page_id long, record_type string, refers_to long, stated_bytes long, stated_digest string, has_payload boolean"


def _base32(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def _payload(html: pa.Scalar) -> memoryview:
    """The bytes of an Arrow string where they lie, without a copy."""
    return memoryview(html.as_buffer()) if html.is_valid else memoryview(b"")


def _chunks(data, size: int):
    """Pieces of UTF-8 ``data`` of at most ``size`` bytes, cut between characters."""
    view, at = memoryview(data), 0
    while True:
        end = min(len(view), at + size)
        while end < len(view) and end > at + 4 and view[end] & 0xC0 == 0x80:
            end -= 1
        yield view[at:end]
        at = end
        if at >= len(view):
            return


def _digests(chunk_bytes: int):
    def run(batches):
        for batch in batches:
            size, digest = [], []
            for html in batch.column("html").cast(pa.large_binary()):
                running, n = hashlib.sha1(), 0
                for chunk in _chunks(_payload(html), chunk_bytes):
                    running.update(chunk)
                    n += len(chunk)
                size.append(n)
                digest.append(_base32(running))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("twin"), pa.array(size, pa.int64()), pa.array(digest, pa.string())],
                ["page_id", "twin", "payload_bytes", "payload_digest"],
            )

    return run


def payload_labels(pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per page: (page_id, twin, payload_bytes, payload_digest, record_type, refers_to).

    The smallest page_id of equal payloads is found by an aggregate with map-side combine; the written table of digests is
    joined back on the digest, where Spark can split a payload that very many pages share.
    """
    ship_package(pages.sparkSession)
    digests = pages.select("page_id", F.xxhash64("html").alias("twin"), "html").mapInArrow(_digests(chunk_bytes), _LABELS)
    own = stored(digests, "warc-digests")
    first = own.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
    several = stored(first.where("rows > 1").select("payload_digest", "payload_bytes", "first"), "warc-first")
    joined = own.join(several, ["payload_digest", "payload_bytes"], "left")
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "twin", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"),
    )


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _records(chunk_bytes: int):
    """Records without the line ends that close them: headers, an empty line, the block.

    Short records go on together, up to 32 chunks of them; each segment of a long one goes on as soon as it is made.
    """

    def batch_of(lines):
        return pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["record"])

    def run(batches):
        for batch in batches:
            lines: list[str] = []
            held = 0
            names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
            heads = zip(*(batch.column(n).to_pylist() for n in names))
            for (page, url, size, digest, kind, refers), text in zip(heads, batch.column("html")):
                name = f"urn:page:{page}"
                head = [f"WARC-Record-ID: <{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
                        f"X-Page-ID: {page}", f"X-Payload-Length: {size}"]
                if url is not None:
                    head.append(f"WARC-Target-URI: {_clean(url)}")
                if kind == "revisit":
                    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                             f"WARC-Refers-To: <urn:page:{refers}>"]
                    lines.append(_record("revisit", head, b""))
                    continue
                data = _payload(text)
                if len(data) <= chunk_bytes:
                    lines.append(_record("response", head, bytes(data)))
                    held += len(data)
                    if held > 32 * chunk_bytes:
                        yield batch_of(lines)
                        lines, held = [], 0
                    continue
                if lines:
                    yield batch_of(lines)
                    lines, held = [], 0
                for number, chunk in enumerate(_chunks(data, chunk_bytes), 1):
                    extra = [f"WARC-Segment-Number: {number}"]
                    if number == 1:
                        yield batch_of([_record("response", head + extra, bytes(chunk))])
                    else:
                        parts = [f"WARC-Record-ID: <{name}:{number}>", "WARC-Date: 1970-01-01T00:00:00Z",
                                 f"WARC-Segment-Origin-ID: <{name}>", *extra]
                        yield batch_of([_record("continuation", parts, bytes(chunk))])
            yield batch_of(lines)

    return run


def _record(kind: str, head: list[str], block: bytes) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *head, "Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines) + _END + block.decode()


def write_archives(pages: DataFrame, labels: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write one record per page to gzip-compressed WARC files under ``path``, through Spark's own text sink.

    The sink's line separator is the pair of empty lines that ends every record, so that the files are plain WARC and land
    in any store that Spark writes to. A payload of more than ``chunk_bytes`` becomes a segmented record.
    """
    html = F.when(F.col("record_type") == "response", F.col("html")).alias("html")
    own = pages.select(F.col("page_id").alias("p"), F.xxhash64("html").alias("t"), "url", "html")
    # repeated rows of a page have one label each, all equal
    one = labels.dropDuplicates(["page_id", "twin"])
    joined = own.join(one, own["p"].eqNullSafe(one["page_id"]) & (own["t"] == one["twin"]))
    rows = joined.select("page_id", "url", html, "payload_bytes", "payload_digest", "record_type", "refers_to")
    records = rows.mapInArrow(_records(chunk_bytes), "record string")
    records.write.option("lineSep", _END).option("compression", "gzip").text(path)


class _Parser:
    """Reads a byte stream of records piece by piece; holds a header or a piece, never a record."""

    def __init__(self):
        self.buffer, self.need, self.head, self.origin = b"", None, None, None

    def feed(self, data: bytes):
        self.buffer += data
        while True:
            if self.need is None:
                self.buffer = self.buffer.lstrip(b"\r\n")
                end = self.buffer.find(b"\r\n\r\n")
                if end < 0:
                    return
                lines = self.buffer[:end].decode().split("\r\n")
                self.head = dict(line.split(": ", 1) for line in lines[1:])
                self.need = int(self.head["Content-Length"])
                self.buffer = self.buffer[end + 4 :]
                yield "head", self.head
            take = self.buffer[: self.need]
            if take:
                yield "data", take
            self.need -= len(take)
            self.buffer = self.buffer[len(take) :]
            if self.need:
                return
            self.need = None
            yield "end", None


def _chunk_rows(batches):
    """The chunk table of archives: a running digest goes from segment to segment of a record."""
    parser, row, digest, total, size, number = _Parser(), None, None, 0, 0, 0
    names = [f.split()[0] for f in _CHUNKS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names)

    def page(name):
        found = re.search(r"urn:page:(-?\d+)", name or "")
        return int(found[1]) if found else None

    for batch in batches:
        out = []
        for value in batch.column(0).cast(pa.large_binary()):
            for what, got in parser.feed(value.as_py() + _END.encode()):
                if what == "head":
                    size = 0
                    if got["WARC-Type"] == "continuation":
                        number += 1
                        continue
                    row, digest, total, number = got, hashlib.sha1(), 0, 0
                elif what == "data":
                    digest.update(got)
                    total, size = total + len(got), size + len(got)
                else:
                    stated = int(row["X-Payload-Length"])
                    last = row["WARC-Type"] == "revisit" or total >= stated
                    out.append((row["WARC-Record-ID"], number, size, total, _base32(digest), last, page(row["WARC-Record-ID"]), row["WARC-Type"],
                                page(row.get("WARC-Refers-To")), stated, row["WARC-Payload-Digest"].removeprefix("sha1:"), row["WARC-Type"] != "revisit"))
        yield table(out)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives under ``path``: a row per record and chunk with the digest of all bytes so far."""
    ship_package(spark)
    return spark.read.option("lineSep", _END).text(path).mapInArrow(_chunk_rows, _CHUNKS)


def verified_records(chunks: DataFrame) -> DataFrame:
    """A row per record from its last chunk; a payload whose bytes or digest differ from its header raises an error.

    A revisit has no payload of its own: its length and digest are those its header states.
    """
    whole = chunks.where("last")
    fine = ~F.col("has_payload") | ((F.col("running_bytes") == F.col("stated_bytes")) & (F.col("running_digest") == F.col("stated_digest")))
    checked = F.when(fine, F.col("stated_digest")).otherwise(F.raise_error(F.concat(F.lit("payload differs: "), "record_id")).cast("string"))
    return whole.select("page_id", F.col("stated_bytes").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")


def warc_round_trip(pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write all pages (page_id, url, html) as WARC records and read them back.

    * null html: an empty payload; * equal payloads of at least ``min_bytes`` bytes: the smallest page_id is the response, the
    others revisit it; * repeated rows of that page are responses as well; * a null page_id is larger than any other, and
    null page_ids alone with a payload are all responses; * null url: no target header; white space and control
    characters of a url are percent-encoded in the header; * extra columns are ignored.
    """
    path = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, payload_labels(pages, min_bytes, chunk_bytes), path, chunk_bytes)
    return verified_records(read_archives(pages.sparkSession, path))
