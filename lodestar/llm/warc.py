"""Operator 10: WARC archives, written and read back with a verified chain of records.

Writing gives one record per page: a response with the page's html as payload,
or, for payloads that another page has too, a revisit that refers to the
response with the smallest id. Reading splits each archive into ranges. Each
range reports, for every place that looks like a record's start, the place
where that record would end (its successor). A place is believed only if it is
reachable from the file's start by such steps, so a record's magic inside a
payload is rejected. Within a range the steps are followed at once; between
ranges, pointer jumping doubles the length of the jumps in each round.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, make_folder, materialize, packed, shared_path, table, unpack

MAGIC = b"WARC/1.1\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RANGE_BYTES = 4 << 20
#: Bytes read beyond a range at first; a header that is longer is read on, by as much again as there is of it.
HEADER_STEP = 1 << 16
INCOMPLETE: tuple[dict[str, str], int] = ({}, -1)


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    block = b"" if refers_to is not None else HTTP + payload
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(block)}")
    return MAGIC + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 0) -> DataFrame:
    """The manifest (path, size, n_records) of the archives that hold a record per row of `pages`.

    A null html is an empty payload, a null url an empty one. Of rows with
    equal payloads of at least `min_revisit` bytes the smallest id is the
    response; a repeated row with that id, like one whose id is null in a group
    without ids, is written as a response too. No pages, no archives.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    keyed = rows.select("page_id", F.sha2("payload", 256).alias("key"), F.length("payload").alias("n"))
    # narrow rows find their group; a payload that many pages share is combined before the shuffle
    first = keyed.filter(F.col("n") >= min_revisit).groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    refers = keyed.join(first, "key").filter((F.col("page_id") != F.col("first")) | F.col("page_id").isNull()).filter(F.col("first").isNotNull())
    refers = refers.select(F.col("page_id").alias("id"), F.col("first").alias("refers_to"), F.col("key").alias("of")).distinct()
    joined = packed(rows.withColumn("of_key", F.sha2("payload", 256)), "payload", level=6).join(refers, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("of_key") == F.col("of")), "left")
    folder = make_folder(shared_path(spark, "warc"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, size, n = f"{folder}/{uuid.uuid4().hex}.warc", None, 0, 0
        try:
            for b in batches:
                for page, url, raw, ref in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), unpack(b.column(2)), b.column(3).to_pylist(), strict=True):
                    if out is None:
                        system, name = file_system(path)
                        out = system.open_output_stream(name)
                    rec = record(page, url, raw, ref, digest_of(raw))
                    out.write(rec)
                    size, n = size + len(rec), n + 1
        finally:
            if out is not None:
                out.close()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "size", "n_records"])

    return materialize(joined.select("page_id", "url", "packed", "refers_to").mapInArrow(write, "path string, size long, n_records long"), "warc-manifest")


def _header(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """The fields of the header at `at` and where its block begins; None if it isn't one, INCOMPLETE if `data` ends inside it."""
    if not data.startswith(MAGIC, at):
        return INCOMPLETE if MAGIC.startswith(data[at : at + len(MAGIC)]) else None
    fields: dict[str, str] = {}
    at += len(MAGIC)
    while (end := data.find(b"\r\n", at)) != at:
        if end < 0:
            return INCOMPLETE
        name, colon, value = data[at:end].partition(b": ")
        if not colon:
            return None
        fields[name.decode("latin-1").lower()] = value.decode("utf-8", "replace")
        at = end + 2
    n = fields.get("content-length", "")
    return (fields, at + 2) if n.isascii() and n.isdigit() and len(n) < 19 else None


def _load(path: str, start: int, end: int) -> bytes:
    system, name = file_system(path)
    with system.open_input_file(name) as f:
        f.seek(start)
        return f.read(end - start)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every possible record start of a range: where the steps from it leave the range."""
    for b in batches:
        for path, size, start, end in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            data = _load(path, start, min(size, end + len(MAGIC) + HEADER_STEP))
            step: dict[int, int] = {}
            at = data.find(MAGIC)
            while 0 <= at < end - start:
                found = _header(data, at)
                if found is INCOMPLETE and start + len(data) < size:
                    data += _load(path, start + len(data), min(size, start + len(data) + max(HEADER_STEP, len(data) - at)))
                    continue
                if found and found is not INCOMPLETE:
                    after = start + found[1] + int(found[0]["content-length"]) + 4
                    if after <= size:
                        step[start + at] = after
                at = data.find(MAGIC, at + 1)
            leave: dict[int, int] = {}
            for o in sorted(step, reverse=True):
                leave[o] = leave.get(step[o], step[o])
            if leave:
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(leave)), pa.array(list(leave), pa.int64()), pa.array(list(leave.values()), pa.int64())], ["path", "place", "leave"])


def chain_entries(ranges: DataFrame, manifest: DataFrame, range_bytes: int) -> DataFrame:
    """(path, place): the start of the file and the first reachable record of each later range, by pointer jumping."""
    jumps = materialize(ranges.mapInArrow(_candidates, "path string, place long, leave long"), "warc-candidates")
    reached = manifest.select("path", F.lit(0).cast("long").alias("place"))
    turns = int(manifest.agg(F.max(F.ceil(F.col("size") / range_bytes))).first()[0] or 0).bit_length()
    for k in range(turns):
        further = reached.join(jumps, ["path", "place"]).select("path", F.col("leave").alias("place"))
        reached = materialize(reached.unionByName(further).distinct(), f"warc-reached-{k}")
        if k < turns - 1:
            after = jumps.select("path", F.col("place").alias("leave"), F.col("leave").alias("far"))
            jumps = materialize(jumps.join(after, ["path", "leave"], "left").select("path", "place", F.coalesce("far", "leave").alias("leave")), f"warc-jumps-{k}")
    return reached


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, size, start, end, at in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            data, base, rows = _load(path, at, end), at, []
            while at < end:
                found = _header(data, at - base)
                if found is None:
                    raise ValueError(f"broken record at {at} in {path}")
                # the last record of the range may go on beyond it
                have = base + len(data)
                want = have + max(HEADER_STEP, have - at) if found is INCOMPLETE else base + found[1] + int(found[0]["content-length"]) + 4
                if want > have:
                    if want > size and found is not INCOMPLETE or have >= size:
                        raise ValueError(f"broken record at {at} in {path}")
                    data += _load(path, have, min(size, want))
                    continue
                fields, block = found
                n = int(fields["content-length"])
                body = data[block : block + n]
                kind = fields["warc-type"]
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                length = int(fields["x-payload-length"])
                if kind == "response":
                    payload = body.partition(b"\r\n\r\n")[2]
                    if digest_of(payload) != digest or len(payload) != length:
                        raise ValueError(f"the payload at {at} in {path} does not match its digest")
                page = fields["warc-record-id"][len("<urn:page:") : -1]
                ref = fields.get("warc-refers-to", "")[len("<urn:page:") : -1]
                rows.append((int(page) if page else None, length, digest, kind, int(ref) if ref else None))
                at = base + block + n + 4
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record on a file's chain."""
    ranges = manifest.select("path", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / range_bytes))).alias("i"))
    ranges = ranges.select("path", "size", (F.col("i") * range_bytes).alias("start"), F.least("size", (F.col("i") + 1) * range_bytes).alias("end"))
    ranges = materialize(ranges.repartition("path", "start"), "warc-ranges")
    entries = chain_entries(ranges.repartition("path", "start"), manifest, range_bytes)
    entries = entries.withColumn("start", F.floor(F.col("place") / range_bytes) * range_bytes)
    # the first place reached in a range: a longer jump never lands before a shorter one
    entries = entries.groupBy("path", "start").agg(F.min("place").alias("place"))
    work = ranges.join(entries, ["path", "start"]).select("path", "size", "start", "end", "place")
    return work.repartition("path", "start").mapInArrow(_records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages")))


QUERIES = {"op10_warc": op10_warc}
SQL: dict[str, str] = {}
