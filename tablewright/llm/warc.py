"""WARC archives with an index written first.

A task writes its records as gzip members to archives of its own and returns one
index row per record: archive, offset, length, URL and digest.  Reading starts
from the index: the wanted rows are sorted by place, neighbouring byte ranges are
joined into one read, and each record is cut out of it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.text import raw_texts, slices
from tablewright.session import materialise, scratch_path

#: An archive is closed and the next one begun at this size.
ARCHIVE_BYTES = 256 << 20
#: Ranges at most this far apart are read together, up to READ_BYTES at once.
GAP_BYTES, READ_BYTES = 64 << 10, 4 << 20
#: Index rows of so many bytes of records go to one reading task.
TASK_BYTES = 16 << 20

INDEX = (
    "page_id bigint, url string, archive string, offset bigint, length bigint, "
    "payload_digest string, record_type string, refers_to bigint"
)
_INDEX = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
     ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _header(text: str) -> str:
    """No control character may end a header line; those are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record; a revisit has no block, only the digest and size of what it repeats."""
    block = payload if kind == "response" else b""
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if kind == "revisit":
        lines.append(f"WARC-Refers-To: {_urn(refers_to)}")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")
    lines += [
        "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, record_type, refers_to``, one row per page.

    Among pages with one payload of at least ``least_bytes`` the one with the largest
    page_id is the response and the others revisit it; smaller ones are all responses.  Null html is
    an empty payload.  Pages without a page_id revisit a page that has one, if there is one.  Rows
    that repeat the winning page_id with its payload are that same record, written again.
    """
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns(
        {"_sha": F.sha1("html"), "_n": F.octet_length("html")}
    )
    repeated = (
        keyed.filter(F.col("_n") >= least_bytes)
        .groupBy("_sha", "_n")
        .agg(F.max("page_id").alias("_best"), F.count("*").alias("_rows"))
        .filter("_rows > 1 AND _best IS NOT NULL")
        .drop("_rows")
    )
    # written first: if it is small Catalyst broadcasts it and the pages stay where they are, else both are shuffled
    repeated = materialise(repeated, "repeated-payloads")
    revisit = F.expr("_best IS NOT NULL AND NOT (page_id <=> _best)")
    return keyed.join(repeated, ["_sha", "_n"], "left").select(
        "page_id", "url", "html",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_best")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write every page to archives below ``folder`` and return the index (see ``INDEX``), itself written as a table.

    Each attempt of a task writes archives under new names, and the index names
    those of the attempts that counted; archives of lost attempts are never read.
    """
    spark = pages.sparkSession
    folder = (folder or scratch_path(spark, "warc")).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _place(folder)
        files.create_dir(base, recursive=True)
        out, archive, at = None, None, 0
        try:
            for batch in slices(batches):
                rows = []
                pages_in, urls, _, kinds, answers = (c.to_pylist() for c in batch.columns)
                for page_id, url, payload, kind, refers_to in zip(pages_in, urls, raw_texts(batch.column(2)), kinds, answers):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        archive, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{base}/{archive}", compression=None)
                    digest = base32_sha1(payload)
                    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                    data = packer.compress(record(page_id, url, payload, digest, kind, refers_to)) + packer.flush()
                    out.write(data)
                    rows.append((page_id, url, f"{folder}/{archive}", at, len(data), digest, kind, refers_to))
                    at += len(data)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX)], schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    return materialise(roles(pages, least_bytes).mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """The records that ``index`` names: ``page_id, payload_bytes, payload_digest, record_type, refers_to, html``.

    Everything is taken from the archives.  ``html`` is null for revisits; a response whose
    payload does not have its digest fails.
    """
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    placed = (
        index.select("archive", "offset", "length")
        .repartitionByRange(tasks, "archive", "offset")
        .sortWithinPartitions("archive", "offset")
    )
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = None
        for batch in slices(batches):
            archives, offsets, lengths = (c.to_pylist() for c in batch.columns)
            rows = []
            for first, end in spans(archives, offsets, lengths):
                if opened is None or opened[0] != archives[first]:
                    files, path = _place(archives[first])
                    opened = archives[first], files.open_input_file(path)
                start = offsets[first]
                data = opened[1].read_at(offsets[end - 1] + lengths[end - 1] - start, start)
                for i in range(first, end):
                    at = offsets[i] - start
                    fields, block = parse(zlib.decompress(data[at : at + lengths[i]], 31))
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and base32_sha1(block) != digest:
                        raise ValueError(f"record at {offsets[i]} of {archives[i]} does not have its digest")
                    refers_to = _page(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    html = block.decode() if kind == "response" else None
                    rows.append((_page(fields["WARC-Record-ID"]), int(fields["X-Payload-Length"]), digest, kind, refers_to, html))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return placed.mapInArrow(
        run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, html string"
    )


def spans(archives: list[str], offsets: list[int], lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Row ranges that are read at once: one archive, small gaps, a bounded size.  A long record is read alone."""
    first = 0
    for i in range(1, len(offsets) + 1):
        if (
            i == len(offsets)
            or archives[i] != archives[first]
            or offsets[i] > offsets[i - 1] + lengths[i - 1] + GAP_BYTES
            or offsets[i] + lengths[i] - offsets[first] > READ_BYTES
        ):
            yield first, i
            first = i
