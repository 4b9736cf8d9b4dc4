"""WARC archives: writing captures and assembling them again.

A capture is three records: a request and a metadata record that name the response (or
revisit) in WARC-Concurrent-To. Equal payloads are stored once; the others are revisits
that refer to it. Records are text, and their separator (two CRLF) is the line separator
of Spark's text writer, so archives go to any store that Spark writes, and are read back
as binary files of bounded size. Reading parses records by their Content-Length and joins
the transaction's records by identifier into one nested row per capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegap.llm.common import discard, durable, shared_dir, small_batches, trimmed

SEPARATOR = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of a file at most, but for a single longer payload. Payloads above LARGE go
#: to files of their own, so that a few of them don't make all files short.
FILE_BYTES, LARGE = 256 << 20, 256 << 10
SALTS = 16


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, page_id: object, payload_digest: str) -> str:
    h = hashlib.md5(f"{kind}\n{page_id}\n{payload_digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _record(kind: str, ident: str, uri: str, content: str, block: str, *more: tuple[str, str]) -> str:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", DATE), ("WARC-Target-URI", uri), *more, ("Content-Type", content), ("Content-Length", str(len(block.encode("utf-8"))))]
    return "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n" + block


def request_of(uri: str) -> tuple[str, str]:
    """Host and path of a request; no host and the root for what isn't an ASCII URL."""
    try:
        parts = urlsplit(uri if uri.isascii() else "")
    except ValueError:  # such as an open bracket
        return "", "/"
    return parts.netloc, (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def capture_records(page_id: int | None, url: str | None, html: str | None, original: int | None) -> list[str]:
    """request, response or revisit (of the page ``original``) and metadata records."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    sha, uri = digest(payload), "".join((url or "about:blank").split())
    ident = record_id("capture", page_id, sha)
    host, path = request_of(uri)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    linked = ("WARC-Concurrent-To", ident)
    proof = ("WARC-Payload-Digest", f"sha1:{sha}")
    if original is None:
        main = _record("response", ident, uri, "application/http; msgtype=response", http + (html or ""), proof)
    else:
        refers = ("WARC-Refers-To", record_id("capture", original, sha))
        main = _record("revisit", ident, uri, "application/http; msgtype=response", http, proof, ("WARC-Profile", PROFILE), refers)
    known = "" if page_id is None else f"page-id: {page_id}\r\n"
    known += "" if url is None else f"url: {base64.b64encode(url.encode('utf-8', 'surrogatepass')).decode()}\r\n"
    return [
        _record("request", record_id("request", page_id, sha), uri, "application/http; msgtype=request", f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n", linked),
        main,
        _record("metadata", record_id("metadata", page_id, sha), uri, "application/warc-fields", known, linked),
    ]


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write pages (page_id, url, html) as gzip-compressed WARC files below ``path``.

    Of equal payloads of at least ``least`` bytes the one with the largest page_id is the
    response. Payloads move once at most, in the join with the repeated digests, which is
    salted so that a very common payload is spread.
    """
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.sha1(body.cast("binary")).alias("sha"), F.octet_length(body).alias("size"))
    keys = rows.where(F.col("size") >= least).groupBy("sha").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    keys = keys.where("n > 1").select("sha", "original", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    keys = durable(keys, "payloads")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(keys, ["sha", "salt"], "left")
    original = F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pydict()
                yield pa.RecordBatch.from_arrays([pa.array([r for row in zip(*part.values(), strict=True) for r in capture_records(*row)], pa.string())], ["value"])

    longest = rows.agg(F.max("size")).head()[0] or 1
    for part, size in ((F.col("size") <= LARGE, min(longest, LARGE)), (F.col("size") > LARGE, longest))[: 1 + (longest > LARGE)]:
        text = joined.where(part).select("page_id", "url", "html", original.alias("original")).mapInArrow(trimmed(run), "value string")
        text.write.mode("append").option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", 3 * max(1, FILE_BYTES // size)).text(path)
    discard(keys)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not at the start of a WARC record")
        head: dict[str, str] = {}
        while (line := stream.readline()) and line.strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        yield head, stream.read(int(head["content-length"]))


_FIELDS = [
    ("capture", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()), ("http", pa.string()), ("page_id", pa.int64()), ("payload", pa.binary()),
]


def _fields(head: dict[str, str], block: bytes, keep: bool) -> tuple:
    kind, ident = head["warc-type"], head["warc-record-id"]
    size = sha = intact = http = page = payload = None
    if kind in ("response", "revisit", "request"):
        lead, _, body = block.partition(b"\r\n\r\n")
        http = lead.decode("utf-8", "replace")
        if kind != "request":
            lines = (x.partition(":") for x in http.split("\r\n"))
            size = next((int(v) for k, _, v in lines if k.lower() == "content-length"), None)
            sha = head.get("warc-payload-digest", "").removeprefix("sha1:")
            if kind == "response":
                own = digest(body)
                intact = own == sha and len(body) == size
                size, sha, payload = len(body), own, body if keep else None
    elif kind == "metadata":
        for x in block.decode("utf-8").split("\r\n"):
            if x.startswith("page-id: "):
                page = int(x[9:])
    return head.get("warc-concurrent-to", ident), kind, ident, head.get("warc-target-uri"), head.get("warc-refers-to"), size, sha, intact, http, page, payload


def read_records(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row per record of the archives below ``path``; payload bytes only on demand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = pa.BufferReader(content.as_buffer())
                packed = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                rows, room = [], 0
                for head, block in parse(gzip.GzipFile(fileobj=raw) if packed else io.BufferedReader(raw)):
                    rows.append(_fields(head, block, payload))
                    room += len(block)
                    if room > 4 << 20 or len(rows) == 4096:
                        yield _batch(rows)
                        rows, room = [], 0
                yield _batch(rows)

    kinds = ", ".join(f"{n} {({pa.string(): 'string', pa.int64(): 'long', pa.bool_(): 'boolean', pa.binary(): 'binary'})[t]}" for n, t in _FIELDS)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(trimmed(run), kinds)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FIELDS)], [n for n, _ in _FIELDS])


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture, main (response or revisit), request, metadata.

    Records meet by the identifier in WARC-Concurrent-To (a main record's own). A capture
    without a request or metadata record has NULL there. Repeated identical captures,
    which share identifiers, are as many rows as there are main records.
    """

    def of(*kinds: str):
        cols = [n for n, _ in _FIELDS if n != "capture"]
        return F.first(F.when(F.col("record_type").isin(*kinds), F.struct(*cols)), ignorenulls=True)

    n = F.count_if(F.col("record_type").isin("response", "revisit")).cast("int")
    groups = records.groupBy("capture").agg(of("response", "revisit").alias("main"), of("request").alias("request"), of("metadata").alias("metadata"), n.alias("n"))
    return groups.where("n > 0").select("capture", "main", "request", "metadata", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).drop("copy")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archive ``pages``, read the archives and return a digest row per page.

    page_id, payload_bytes, payload_digest, record_type, refers_to (the response's
    page_id for revisits), intact (a response's bytes have their digest; null for a
    revisit). A null html is an empty payload; a null or malformed url makes a request
    without a host; a page with a null id is the response of its payload only if all of
    them are null; equal rows are repeated captures; other columns are ignored; an empty
    table gives no rows. Payloads are held one at a time.
    """
    import uuid

    spark = pages.sparkSession
    small_batches(spark)

    path = f"{shared_dir(spark)}/tidegap/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least)
    captures = durable(assemble(read_records(spark, path)).select(
        F.col("metadata.page_id").alias("page_id"), F.col("main.payload_bytes").alias("payload_bytes"), F.col("main.payload_digest").alias("payload_digest"),
        F.col("main.record_type").alias("record_type"), F.col("main.record_id").alias("record_id"), F.col("main.refers_to").alias("_to"), F.col("main.intact").alias("intact"),
    ), "captures")
    used = captures.where("record_type = 'revisit'").select(F.col("_to").alias("record_id")).distinct()
    originals = captures.where("record_type = 'response'").join(used, "record_id", "left_semi").select(F.col("record_id").alias("_to"), F.col("page_id").alias("refers_to"))
    originals = durable(originals.dropDuplicates(["_to"]), "originals")
    out = captures.join(originals, "_to", "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


# SQL: base32 digits are taken from the hexadecimal digest, eight of each ten hex digits.
ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
k as (select body, sha1(body) as hex, max(page_id) as original from p group by body),
d as (select *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (((('0x' || substr(hex, (i // 8) * 10 + 1, 10))::bigint >> (35 - 5 * (i % 8))::bigint) & 31) + 1)::int, 1)), 'string_agg', '') as digest from k)
select p.page_id, strlen(p.body)::bigint as payload_bytes, digest as payload_digest,
  case when p.page_id is not distinct from original then 'response' else 'revisit' end as record_type,
  case when p.page_id is distinct from original then original end as refers_to,
  case when p.page_id is not distinct from original then true end as intact from p join d using (body)
"""
