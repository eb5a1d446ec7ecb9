"""WARC archives with an index: write, then read selected records back by byte ranges.

Writing goes index first: each task writes its records, one gzip member each,
to an archive of its own in the shared folder, and returns offset, length, URL
and digest per record. Those rows are the index, a table committed by Spark, so
an archive of a task that failed or ran twice is never looked at. Of records
with equal payloads of at least ``LEAST_BYTES`` one is a response and the
others revisit it, without a payload of their own.

Reading sorts the index rows of the selected records by archive and offset and
coalesces neighbours into ranges of at most ``RANGE_BYTES``, skipping gaps of
over ``GAP_BYTES``; each range is one read. Index rows are small while each
stands for a read, so tasks are dealt by the summed lengths: as many ranges of
(archive, offset) as ``TASK_BYTES`` need, which also split an archive.

Archives go through pyarrow's file systems, so the shared folder can be local,
HDFS or an object store.

Edge cases: a null or empty html has an empty payload; a null url is written
as an empty target; a null page_id sorts before all others and is written as
"-"; rows that repeat page_id and html are written as often as they occur, under
one record id; a very long page is one record and one read; an empty table
gives no archives and no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconweave.llm.common import durable, map_batches, shared_dir, small

LEAST_BYTES = 1000
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES, GAP_BYTES = 4 << 20, 64 << 10
#: Bytes of archives that a task reads, about.
TASK_BYTES = 8 << 20
#: The date of all records: results do not depend on when they are written.
DATE = "2024-01-01T00:00:00Z"

INDEX = "record_id string, page_id long, url string, record_type string, payload_digest string, archive string, offset long, length long"
RECORDS = "record_id string, page_id long, url string, record_type string, refers_to_record string, payload_digest string, payload_bytes long, payload binary"


def _record(row: dict) -> bytes:
    """One WARC/1.1 record of a page: an HTTP response with its payload, or a revisit with the headers alone."""
    html = row["payload"]
    sha1 = "sha1:" + base64.b32encode(bytes(row["sha1"])).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + html
    page = "-" if row["page_id"] is None else row["page_id"]
    url = (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:uuid:{row['record_id']}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: {sha1}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {page}",
    ]
    if revisit:
        head[4:4] = [f"WARC-Refers-To: <urn:uuid:{row['refers_to_record']}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one record; raises if the digests do not fit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record: {first[:20]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (hashlib.sha1(payload).digest() != digest or len(payload) != int(said["Content-Length"])):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    urn = lambda name: fields[name].removeprefix("<urn:uuid:").removesuffix(">") if name in fields else None
    return {
        "record_id": urn("WARC-Record-ID"),
        "page_id": None if fields["X-Page-Id"] == "-" else int(fields["X-Page-Id"]),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "refers_to_record": urn("WARC-Refers-To"),
        "payload_digest": digest.hex(),
        "payload_bytes": int(said["Content-Length"]),
        "payload": None if revisit else payload,
    }


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write (page_id, url, html) rows to archives under ``folder``; returns the index, a written table."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
            F.unhex(F.sha1(payload)).alias("sha1"), F.sha2(payload, 256).alias("sha256")
    ).withColumn("bytes", F.octet_length("payload"))
    # equal means equal in both digests and in length
    groups = base.where(F.col("bytes") >= least_bytes).groupBy("sha1", "sha256", "bytes").agg(F.max("page_id").alias("first_id"),
        F.count("*").alias("n"))
    groups = durable(groups.where("n > 1").select("sha1", "sha256", "bytes", "first_id", F.expr("uuid()").alias("response_id")), "groups")
    rows = base.join(small(groups, 160), ["sha1", "sha256", "bytes"], "left")

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        names = ["record_id", "page_id", "url", "record_type", "payload_digest", "archive", "offset", "length", "response_id"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        store, where = fs.FileSystem.from_uri(folder)
        store.create_dir(where, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    index = []
                    for row in batch.slice(lo, 256).to_pylist():
                        if out is None or at >= ARCHIVE_BYTES:
                            if out is not None:
                                out.close()
                            name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                            out = store.open_output_stream(f"{where}/{name}", compression=None)
                        # the row with the largest page_id is the response
                        grouped = row["response_id"] is not None
                        lead = not grouped or row["page_id"] == row["first_id"]
                        record_id = row["response_id"] if grouped and lead else str(uuid.uuid4())
                        row |= {"record_type": "response" if lead else "revisit", "record_id": record_id, "refers_to_record": row["response_id"]}
                        member = gzip.compress(_record(row), 1, mtime=0)
                        out.write(member)
                        index.append((record_id, row["page_id"], row["url"], row["record_type"], bytes(row["sha1"]).hex(), name, at, len(member),
                            row["response_id"]))
                        at += len(member)
                    if index:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)], names)
        finally:
            if out is not None:
                out.close()

    index = durable(map_batches(rows.select("page_id", "url", "payload", "sha1", "first_id", "response_id"), write,
        INDEX + ", response_id string"), "index")
    return index.withColumn("archive", F.concat(F.lit(folder + "/"), "archive"))


def read_records(selected: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of index rows (archive, offset, length), read in coalesced byte ranges."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        opened: tuple[str, object] | None = None

        def fetch(archive: str, run: list[tuple[int, int]]):
            nonlocal opened
            if opened is None or opened[0] != archive:
                if opened is not None:
                    opened[1].close()
                store, where = fs.FileSystem.from_uri(archive)
                opened = (archive, store.open_input_file(where))
            start = run[0][0]
            raw = memoryview(opened[1].read_at(run[-1][0] + run[-1][1] - start, start))
            rows = []
            for offset, length in run:
                member = zlib.decompress(raw[offset - start : offset - start + length], wbits=31)
                row = parse_record(member)
                if not with_payload:
                    row["payload"] = None
                rows.append(tuple(row.values()))
            names = [f.split()[0] for f in RECORDS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        run: list[tuple[int, int]] = []
        last = ""
        for batch in batches:
            for archive, offset, length in zip(*(batch[c].to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if run and (archive != last or offset - sum(run[-1]) > GAP_BYTES or offset + length - run[0][0] > RANGE_BYTES):
                    yield fetch(last, run)
                    run = []
                last = archive
                run.append((offset, length))
        if run:
            yield fetch(last, run)
        if opened is not None:
            opened[1].close()

    wanted = selected.select("archive", "offset", "length")
    total = wanted.agg(F.sum("length")).first()[0] or 0
    # a stated number of partitions is one that adaptive execution leaves alone
    ordered = wanted.repartitionByRange(-(-total // TASK_BYTES) or 1, "archive", "offset").sortWithinPartitions("archive", "offset")
    return map_batches(ordered, read, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives, read them back, and report each record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    index = write_archives(pages)
    records = read_records(index, with_payload=False)
    # revisits name a record; its page is the index row of that id. Only groups of equal payloads have such rows
    named = index.where("record_id = response_id").select(F.col("record_id").alias("refers_to_record"),
        F.col("page_id").alias("refers_to")).distinct()
    out = records.join(small(durable(named, "responses"), 64), "refers_to_record", "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
