"""WARC: pages are written as archives, archives are read back, and the records of each transaction are joined through their concurrent-to identifiers into one nested row for each capture.

Writing. Every page becomes a request, a response or revisit, and a metadata record, each a gzip member of its own. Of pages with equal payloads of at least `least` bytes (by length and SHA-256), the one with the smallest id has the response, and the others revisit it: their records hold the HTTP headers alone and name the response's record. Which page that is follows from digests alone, counted before they are shuffled; texts are joined with the list of revisits by a row's place in its file, so neither a payload that a third of the pages share nor an id that repeats meets in one task. A task writes files of its own of about FILE bytes; their names are committed as rows with the starts of segments, so files of an attempt that was lost are never read.

Reading. A segment is a byte range of a file that starts at a record; a file of others is one segment. Compressed files hold one record a member, plain ones are read by their lengths. A record is parsed in one piece, and its block is kept only if it is a request or metadata; a response is named by its place. A payload with a SHA-256 in its header is verified.

Assembly. A request or metadata record belongs to the response, revisit or resource that it names in WARC-Concurrent-To, that names it, or that is reached over other records so. What reaches none becomes a row of its own without a response. Payloads are read last, at their places, in ranges of files that are split within a record that many revisit; a revisit's payload is the one of the response that it refers to.

Nulls: a null html has an empty payload; a null url leaves out WARC-Target-URI; a null id is the largest and stays null. Empty payloads are responses. Of rows that repeat an id and a payload, one is the response and the others revisit it. Very long pages are one record, in memory one at a time. Of records that repeat an identifier one counts. An empty table has files without pages or none. Only the three columns are read, whatever others are called. In WARC-Target-URI, control characters and spaces are percent-encoded.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_pieces, placed_rows, saved, size_of
from .files import create, folder, located, spread, tasks_for

#: Bytes of a payload that may be revisited, of a file, and of a segment; a list of revisits of at most so many bytes is sent to all tasks.
LEAST, FILE, SEGMENT, SENT = 100, 256 << 20, 8 << 20, 16 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAIN = ("response", "revisit", "resource", "conversion")
SEGMENTS = "file string, start long, stop long, n_records long"
RECORDS = "file string, offset long, size long, record_id string, kind string, date string, target string, concurrent array<string>, refers_to string, content_type string, http string, block binary, fields map<string,string>, payload_bytes long, payload_digest string, intact boolean"


def member(kind: str, record: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record}>", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(["WARC/1.1", *head, "", ""]).encode() + block + b"\r\n\r\n") + z.flush()


def target_uri(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def page_records(row: str, page_id: int | str | None, url: str | None, payload: bytes, refers: str | None, date: str) -> bytes:
    """The three records of a page; row is the 32 digits of its identifier, refers that of the response it revisits."""
    own = uuid.UUID(row)
    uri, digest = target_uri(url), f"sha256:{hashlib.sha256(payload).hexdigest()}"
    host, path = re.fullmatch(r"(?s)(?:.*?://([^/?#]*))?(.*)", uri or "").groups()
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    http = "\r\n".join(lines).encode()
    common = [("WARC-Target-URI", uri), ("WARC-Date", date)]
    with_main = [*common, ("WARC-Concurrent-To", f"<urn:uuid:{own}>")]
    request = f"GET /{path.partition('#')[0].removeprefix('/')} HTTP/1.1\r\nHost: {host or ''}\r\n\r\n".encode()
    out = member("request", str(uuid.uuid5(own, "request")), [*with_main, ("Content-Type", "application/http; msgtype=request")], request)
    main = [*common, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if refers is None:
        out += member("response", str(own), main, http + payload)
    else:
        out += member("revisit", str(own), [*main, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.UUID(refers)}>")], http)
    fields = "".join(f"{k}: {v}\r\n" for k, v in (("page-id", page_id), ("payload-bytes", len(payload))) if v is not None)
    return out + member("metadata", str(uuid.uuid5(own, "metadata")), [*with_main, ("Content-Type", "application/warc-fields")], fields.encode())


def write_archives(pages: DataFrame, least: int = LEAST, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(file, start, stop, n_records): segments of the archives, written to the shared folder."""
    spark = pages.sparkSession
    row = F.md5(F.concat_ws(":", "_file", F.col("_row").cast("string")).cast("binary")).alias("row")
    src = placed_rows(pages, {"page_id": id_col, "url": url_col, "html": html_col}).select(row, "page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"))
    payloads = saved(src.select("row", "page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("n")).where(F.col("n") >= least), "payloads")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("first")
    firsts = payloads.groupBy("digest", "n").agg(first, F.count("*").alias("m")).where("m > 1")
    revisits = saved(payloads.join(firsts, ["digest", "n"]).where("row <> first.row").select("row", F.col("first.row").alias("refers")), "revisits")
    where = folder(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream, at, segments, start, n = "", None, 0, [], 0, 0

        def cut() -> None:
            nonlocal start, n
            segments.append((name, start, at, n))
            start, n = at, 0

        for b in in_pieces(batches, "html", 4 << 20):
            for r, i, u, h, refers in zip(*(b.column(c).to_pylist() for c in ("row", "page_id", "url", "html", "refers")), strict=True):
                if stream is None:
                    name, stream = create(where, "pages", ".warc.gz")
                    head = member("warcinfo", str(uuid.uuid4()), [("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    stream.write(head)
                    start, n = 0, 1
                    at = len(head)
                records = page_records(r, i, u, h, refers, date)
                stream.write(records)
                at, n = at + len(records), n + 3
                if at - start >= SEGMENT:
                    cut()
                if at >= FILE:
                    stream.close()
                    if n:
                        cut()
                    stream = None
        if stream is not None:
            stream.close()
            if n:
                cut()
        yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in segments], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["file", "start", "stop", "n_records"])

    few = F.broadcast(revisits) if size_of(revisits) <= SENT else revisits
    return saved(src.join(few, "row", "left").mapInArrow(write, SEGMENTS), "segments")


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, stop): whole files of others, as segments; the files are listed, not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.lit(0).cast("long").alias("start"), F.col("length").alias("stop"))


def raw_records(fs: pa.fs.FileSystem, path: str, start: int, stop: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, size, bytes) of the records that start in a byte range."""
    with fs.open_input_file(path) as f:
        f.seek(start)
        packed = f.read(2) == b"\x1f\x8b"
        f.seek(start)
        at, buffer, used = start, b"", 0
        while at < stop:
            if packed:
                z, out, begin = zlib.decompressobj(31), [], at
                while not z.eof:
                    if used == len(buffer):
                        buffer, used = f.read(1 << 20), 0
                        if not buffer:
                            raise EOFError(f"{path} ends within a record")
                    piece = buffer[used : used + (1 << 14)]
                    out.append(z.decompress(piece))
                    step = len(piece) - len(z.unused_data)
                    used, at = used + step, at + step
                yield begin, at - begin, b"".join(out)
            else:
                f.seek(at)
                head = b""
                while b"\r\n\r\n" not in head:
                    more = f.read(1 << 12)
                    if not more:
                        raise EOFError(f"{path} ends within a record")
                    head += more
                top = head.index(b"\r\n\r\n") + 4
                size = top + int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head[:top])[1]) + 4
                yield at, size, f.read_at(size, at)
                at += size


def header_lines(raw: bytes) -> list[tuple[str, str]]:
    """Names in lower case and values; a line that starts with white space goes on with the one before."""
    lines = re.sub(r"\r?\n[ \t]+", " ", raw.decode("utf-8", "replace")).splitlines()
    return [(k.strip().lower(), v.strip()) for k, colon, v in (x.partition(":") for x in lines) if colon]


def parsed(raw: bytes) -> tuple[dict[str, list[str]], bytes]:
    """The headers and the block of a record."""
    top = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/") or top < 0:
        raise ValueError("no WARC record starts here")
    found: dict[str, list[str]] = {}
    for k, v in header_lines(raw[: top + 2].split(b"\r\n", 1)[1]):
        found.setdefault(k, []).append(v)
    size = int(found["content-length"][0])
    if len(raw) > top + 4 + size + 4:
        raise ValueError("a member holds more than one record")
    return found, raw[top + 4 : top + 4 + size]


def payload_of(block: bytes, content_type: str | None) -> tuple[str | None, bytes]:
    """HTTP headers, if it is an HTTP message, and what follows them."""
    if not (content_type or "").startswith("application/http"):
        return None, block
    head, gap, body = block.partition(b"\r\n\r\n")
    return (head + gap).decode("utf-8", "replace"), body


def named(value: str | None) -> str | None:
    return value and value.strip("<>")


def read_records(segments: DataFrame) -> DataFrame:
    """One row for each record of segments (file, start, stop). Responses are named by file, offset and size; requests and metadata have their block."""
    names = [c.strip().split(" ")[0] for c in re.sub(r"<[^>]*>", "", RECORDS).split(",")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.binary(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.bool_()]
    total = segments.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] or 0

    def row(file: str, at: int, size: int, raw: bytes) -> tuple:
        h, block = parsed(raw)
        one = lambda k: h.get(k, [None])[0]
        kind, content = one("warc-type"), one("content-type")
        http, payload = payload_of(block, content)
        sha, digest = hashlib.sha256(payload).hexdigest() if kind in MAIN else None, one("warc-payload-digest")
        told = digest[7:].lower() if digest and digest.lower().startswith("sha256:") else None
        fields = dict(header_lines(block)) if content == "application/warc-fields" else None
        intact = None if kind not in MAIN or kind == "revisit" or told is None else told == sha
        record = named(one("warc-record-id")) or f"{file}:{at}"
        return (file, at, size, record, kind, one("warc-date"), one("warc-target-uri"), [named(c) for c in h.get("warc-concurrent-to", [])], named(one("warc-refers-to")), content, http, None if kind in MAIN else block, fields and [*fields.items()], None if kind == "revisit" else len(payload), told if kind == "revisit" else sha, intact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start, stop in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                rows: list[tuple] = []
                for at, size, raw in raw_records(*located(file), start, stop):
                    rows.append(row(file, at, size, raw))
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return spread(segments.select("file", "start", "stop"), total, "file", "start").mapInArrow(run, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, kind, target, date, response, request, metadata, original.

    response has the main record's place, HTTP headers, payload_bytes and payload_digest; request the record's id and block; metadata an array of (record_id, fields, block); original, of a revisit, the place, payload_bytes and metadata of the response that it refers to, if it is among the records.
    """
    recs = saved(records.where("kind <> 'warcinfo'").dropDuplicates(["record_id"]), "records")
    main = F.col("kind").isin(*MAIN)
    mains, others = recs.where(main), recs.where(~main)
    edges = recs.select(F.col("record_id").alias("a"), F.explode("concurrent").alias("b"))
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    reached = mains.select(F.col("record_id").alias("node"), F.col("record_id").alias("capture"))
    left, known = others.select(F.col("record_id").alias("node")), []
    while True:
        met = edges.join(reached, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("capture").alias("capture"))
        reached = saved(left.join(met, "node"), "reached")  # others alone: mains keep their own
        known.append(reached)
        left = saved(left.join(reached, "node", "left_anti"), "unreached")
        if not left.limit(1).count() or not reached.limit(1).count():
            break
    belongs = left.withColumn("capture", F.lit(None).cast("string"))
    for part in known:
        belongs = belongs.unionByName(part)
    own = others.join(belongs.withColumnRenamed("node", "record_id"), "record_id")
    request = F.struct("record_id", F.decode("block", "UTF-8").alias("block"))
    meta = F.struct("record_id", "fields", "block")
    whole = own.where("capture IS NOT NULL").groupBy("capture").agg(
        F.min(F.when(F.col("kind") == "request", request)).alias("request"), F.array_sort(F.collect_list(F.when(F.col("kind") != "request", meta)), lambda x, y: F.when(x["record_id"] < y["record_id"], -1).when(x["record_id"] > y["record_id"], 1).otherwise(0)).alias("metadata")
    )
    response = F.struct("file", "offset", "size", "content_type", "http", "payload_bytes", "payload_digest", "intact").alias("response")
    rows = mains.select(F.col("record_id").alias("capture"), "kind", "target", "date", "refers_to", response).join(whole, "capture", "left")
    rows = saved(rows, "captures")
    said = F.struct("capture", "response", "metadata").alias("original")
    seconds = rows.where("kind = 'revisit'").join(rows.where("kind <> 'revisit'").select(F.col("capture").alias("refers_to"), said), "refers_to", "left")
    out = rows.where("kind <> 'revisit'").withColumn("original", F.lit(None).cast(seconds.schema["original"].dataType)).unionByName(seconds)
    alone = own.where("capture IS NULL").select(F.col("record_id").alias("capture"), F.lit(None).cast("string").alias("kind"), "target", "date", F.when(F.col("kind") == "request", request).alias("request"), F.when(F.col("kind") != "request", F.array(meta)).alias("metadata"))
    return out.unionByName(alone, allowMissingColumns=True).withColumnRenamed("capture", "capture_id")


def with_payloads(rows: DataFrame) -> DataFrame:
    """Adds `payload`, the whole payload of each capture, read at its place; a revisit has its original's, and null where that is not among the records."""
    at = F.when(F.col("kind") == "revisit", F.col("original.response")).otherwise(F.col("response"))
    rows = rows.withColumn("_at", at).withColumn("_f", F.col("_at.file")).withColumn("_o", F.col("_at.offset")).withColumn("_s", F.col("_at.size")).withColumn("_c", F.col("_at.content_type")).drop("_at")
    rows = saved(rows, "places")
    total = rows.agg(F.sum(F.coalesce("_s", F.lit(0)))).first()[0] or 0
    rows = rows.repartitionByRange(tasks_for(rows.sparkSession, total), "_f", "_o", "capture_id").sortWithinPartitions("_f", "_o")
    kept = [c for c in rows.columns if c not in ("_f", "_o", "_s", "_c")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, payload, file, name = None, None, None, ""
        for b in batches:
            own, held, size, since = b.select(kept), [], 0, 0

            def filled(end: int) -> pa.RecordBatch:
                part = own.slice(since, end - since)  # noqa: B023
                return pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], [*kept, "payload"])  # noqa: B023

            for k, (f, o, s, c) in enumerate(zip(*(b.column(x).to_pylist() for x in ("_f", "_o", "_s", "_c")), strict=True)):
                if (f, o) != last:
                    if f is not None and f != name:
                        fs, path = located(f)
                        name, file = f, fs.open_input_file(path)
                    last, payload = (f, o), None
                    if f is not None:
                        _, _, raw = next(raw_records_of(file, o, s))
                        payload = payload_of(parsed(raw)[1], c)[1]
                held.append(payload)
                size += len(payload or b"")
                if size >= 4 << 20:
                    yield filled(k + 1)
                    held, size, since = [], 0, k + 1
            if held:
                yield filled(b.num_rows)

    schema = rows.select(*kept).schema
    return rows.mapInArrow(run, schema.add("payload", "binary"))


def raw_records_of(file: pa.NativeFile, offset: int, size: int) -> Iterator[tuple[int, int, bytes]]:
    """The record at a place of an open file."""
    raw = file.read_at(size, offset)
    yield offset, size, zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw


def field(metadata: str, name: str) -> Column:
    """The first value of a field in an array of metadata records."""
    return F.try_element_at(F.filter(F.transform(F.col(metadata), lambda m: m["fields"][name]), lambda v: v.isNotNull()), F.lit(1))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = with_payloads(captures(read_records(write_archives(pages))))
    kind = pages.schema["page_id"].dataType
    return rows.select(
        field("metadata", "page-id").cast(kind).alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        field("original.metadata", "page-id").cast(kind).alias("refers_to"),
    )


OP13_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS one FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest, CASE WHEN one <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN one <> page_id THEN one END AS refers_to
FROM p LEFT JOIN firsts f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""
