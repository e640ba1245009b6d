"""WARC archives: writing with revisits and segments, and segment reassembly.

Writing: pages with equal payloads of ``least_revisit`` bytes or more keep one
response, that with the largest page_id; the others become revisit records
that refer to it. Long blocks are cut into continuation records. Bodies are in
chunked transfer framing, and each record is a gzip member of its own.

Reading: records are parsed file by file. Continuation records are grouped by
their origin's identifier, ordered by segment number, and joined; the total
length of the last segment is verified and the chunked framing decoded.

Defined results: a null or empty payload is an empty response; a null page_id
never wins over another and stays null; rows that repeat the largest page_id
with the same payload are all responses; a page without a url gets an empty
one; missing or repeated segments, a wrong total or digest, and broken chunk
framing give the row an ``error`` text instead of a payload; an empty table
writes no record and reads as no row.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltide.llm.common import broadcast_if_small, c, map_frames, utf8
from voltide.session import Scratch, scratch_path

DATE = "2000-01-01T00:00:00Z"
FILES = "path string, n_records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, origin string, segment long, total long, block binary, error string"
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, error string"
_RECORD_COLS = [x.split()[0] for x in RECORDS.split(", ")]


def chunked(body: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunk(raw: bytes) -> bytes:
    """The body of chunked framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = raw.index(b"\r\n", at)
        size = int(raw[at:end].split(b";")[0].strip() or b"x", 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if len(raw) < at + size + 2 or raw[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(raw[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP response block, transfer framing removed."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of HTTP headers")
    headers = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return unchunk(body) if b"chunked" in headers.get(b"transfer-encoding", b"") else body


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))] if v is not None)
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def page_records(page_id, url: str, payload: bytes, digest: str, refers_to, record_id: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page."""
    url = "".join(x for x in url if x.isprintable())
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page_id)]
    kind = "application/http; msgtype=response"
    if refers_to is not None:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id), *common, ("WARC-Profile", profile), ("X-Refers-To-Page", refers_to), ("Content-Type", kind)], http)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", record_id), *common, ("Content-Type", kind)], block)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", record_id), *common, ("WARC-Segment-Number", 1), ("Content-Type", kind)], parts[0])
    for n, part in enumerate(parts[1:], 2):
        last = len(block) if n == len(parts) else None
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, record_id + str(n))}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", last)], part)


def write_warc(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = 1000, segment_bytes: int = 16 << 10, chunk_bytes: int = 4 << 10) -> DataFrame:
    """Write one file for each input partition; returns their paths.

    Only groups of two or more equal payloads are looked up. Their table is
    counted first: a small one is broadcast, so that no page moves; a larger
    one is joined by a shuffle whose skewed partitions are split.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession)
    html = F.coalesce(c(html_col).cast("string"), F.lit(""))
    rows = pages.select(c(id_col).cast("long").alias("page_id"), F.coalesce(c(url_col).cast("string"), F.lit("")).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("size"), F.sha1(html.cast("binary")).alias("digest"))
    groups = rows.where(F.col("size") >= least_revisit).groupBy("digest", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("keep")).where("n > 1 and keep is not null").select("digest", "size", "keep")
    groups = scratch.table(groups, "groups")
    planned = rows.join(broadcast_if_small(groups), ["digest", "size"], "left")
    planned = planned.withColumn("refers_to", F.when(~F.col("keep").eqNullSafe(F.col("page_id")), F.col("keep")))
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, attempt, n = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0
        fs, at = pafs.FileSystem.from_uri(folder)
        name = f"part-{part:06d}-{attempt}.warc.gz"
        with fs.open_output_stream(f"{at}/{name}") as out:
            for b in batches:
                for page_id, url, html, digest, refers in zip(b["page_id"], b["url"], b["html"], b["digest"], b["refers_to"], strict=True):
                    record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{folder}/{part}/{n}')}>"
                    for r in page_records(None if pd.isna(page_id) else int(page_id), url, utf8(html), digest, None if pd.isna(refers) else int(refers), record_id, segment_bytes, chunk_bytes):
                        out.write(r)
                    n += 1
        if n:
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "n_records": [n]})
        else:
            fs.delete_file(f"{at}/{name}")

    return Scratch(spark).table(map_frames(planned.select("page_id", "url", "html", "digest", "refers_to"), run, FILES), "files")


def parse_records(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a decompressed stream."""
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError("not a WARC record")
            continue
        headers = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        size = int(headers["content-length"])
        block = f.read(size)
        if len(block) != size:
            raise ValueError("record is cut short")
        yield headers, block


def decode(block: bytes, claimed: str | None) -> tuple[int | None, str | None, str | None]:
    """(bytes, SHA-1, error) of a block's payload."""
    try:
        body = payload_of(block)
    except ValueError as e:
        return None, None, f"framing: {e}"
    digest = hashlib.sha1(body).hexdigest()
    if claimed and digest != claimed:
        return None, None, "digest differs"
    return len(body), digest, None


def read_records(files: DataFrame, batch: int = 500) -> DataFrame:
    """Every record of the archives; whole responses come decoded, segments
    with their blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for b in batches:
            for path in b["path"]:
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(at) as raw, gzip.GzipFile(fileobj=raw) as f:
                    for h, block in parse_records(f):
                        page = int(h["x-page-id"]) if "x-page-id" in h else None
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        segment = int(h["warc-segment-number"]) if "warc-segment-number" in h else None
                        total = int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None
                        kind = h["warc-type"]
                        if kind == "revisit":
                            head = dict(x.lower().split(b": ", 1) for x in block.strip().split(b"\r\n")[1:])
                            out.append((page, int(head[b"content-length"]), digest, kind, int(h["x-refers-to-page"]), None, None, None, None, None))
                        elif segment is not None:
                            origin = h.get("warc-segment-origin-id") or h["warc-record-id"]
                            out.append((page, None, digest, kind, None, origin, segment, total, block, None))
                        elif kind == "response":
                            n, sha, error = decode(block, digest)
                            out.append((page, n, sha, kind, None, None, None, None, None, error))
                        size += len(block)
                        if len(out) >= batch or size > 8 << 20:
                            yield _frame(out)
                            out, size = [], 0
        if out:
            yield _frame(out)

    return map_frames(files, run, RECORDS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_RECORD_COLS, dtype=object)
    for k in ("page_id", "payload_bytes", "refers_to", "segment", "total"):
        out[k] = out[k].astype("Int64")
    return out


def join_segments(segments: list[tuple[int, bytes, int | None]]) -> tuple[bytes | None, str | None]:
    """(block, error) of the segments of one origin, in any order."""
    segments = sorted(segments, key=lambda s: s[0])
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        return None, "segments are missing or repeated"
    block, total = b"".join(s[1] for s in segments), segments[-1][2]
    if total is None:
        return None, "no last segment"
    if total != len(block):
        return None, f"total length {total}, found {len(block)}"
    return block, None


def reassemble(segments: DataFrame) -> DataFrame:
    """One row per origin record; a record's own segments meet in one task."""
    # The origin's columns ride on segment 1 alone.
    grouped = segments.groupBy("origin").agg(F.max("page_id").alias("page_id"), F.max("payload_digest").alias("payload_digest"), F.collect_list(F.struct("segment", "block", "total")).alias("segments"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page_id, claimed, parts in zip(b["page_id"], b["payload_digest"], b["segments"], strict=True):
                block, error = join_segments([(int(p["segment"]), bytes(p["block"]), None if pd.isna(p["total"]) else int(p["total"])) for p in parts])
                n, sha = None, None
                if error is None:
                    n, sha, error = decode(block, claimed)
                rows.append((None if pd.isna(page_id) else int(page_id), n, sha, "response", None, error))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in PAGES.split(", ")], dtype=object)
            for k in ("page_id", "payload_bytes", "refers_to"):
                out[k] = out[k].astype("Int64")
            yield out

    return map_frames(grouped.select("page_id", "payload_digest", "segments"), run, PAGES)


def read_warc(spark: SparkSession, files: DataFrame) -> DataFrame:
    """One row per page of the archives."""
    paths = [(r.path,) for r in files.select("path").collect()]  # one for each file
    table = spark.createDataFrame(paths, "path string")
    table = table.repartition(len(paths)) if len(paths) > 1 else table
    records = Scratch(spark).table(read_records(table), "records")
    cols = [x.split()[0] for x in PAGES.split(", ")]
    return records.where("origin is null").select(*cols).unionByName(reassemble(records.where("origin is not null")).select(*cols))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages, then read the archives back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_warc(pages.sparkSession, write_warc(pages, folder, **options))
