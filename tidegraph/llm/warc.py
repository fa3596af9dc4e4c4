"""WARC archives: writing, normalising whole-file gzip streams, and indexed reading.

``write_monolithic`` makes archives the way some crawlers do, as one gzip stream per file.
``normalise`` inflates each stream once, cuts it at the records, writes every record as a gzip
member of its own, and a sidecar with offset and length of each. ``read_indexed`` seeks by the sidecar.

Of payloads of at least ``least`` bytes that are equal, the one with the smallest page_id is stored
as response, the others as revisits that name it. Defined cases: null html is an empty payload; null
page_ids are never named while another id is there; rows that share the smallest page_id are all
responses; control characters in a url are percent-encoded; an empty table gives no archives and an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import files
from tidegraph.session import Scratch

#: Fixed values of the format.
VERSION, PROFILE, EOL = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"\r\n"
DATE = "1970-01-01T00:00:00Z"
READ = 1 << 18
#: Groups of equal payloads up to so many are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 200_000


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'null' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(body)),
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    return VERSION + EOL + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + EOL + body + EOL + EOL


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.split(EOL)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines[1:] if x)}


def split_records(chunks):
    """Whole records from an iterator of inflated chunks; holds one record at a time."""
    held = bytearray()
    for c in chunks:
        held += c
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            size = re.search(rb"(?im)^content-length:\s*(\d+)", bytes(held[at:end]))
            stop = end + 4 + int(size[1]) + 4
            if len(held) < stop:
                break
            yield bytes(held[at:stop])
            at = stop
        del held[:at]
    if held:
        raise ValueError(f"{len(held)} bytes after the last whole record")


def inflate(f):
    """Inflated chunks of a gzip file of one or many members."""
    z = zlib.decompressobj(31)
    while raw := f.read(READ):
        while raw:
            if out := z.decompress(raw):
                yield out
            raw = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
    if out := z.flush():
        yield out


def member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def plan(pages: DataFrame, scratch: Scratch, least: int = 100) -> DataFrame:
    """page_id, url, html, digest, first_id (the page to refer to, null for responses), revisit."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html"), 256)).withColumn("big", F.octet_length("html") >= least)
    groups = rows.where("big").groupBy(F.col("digest").alias("_d")).agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null")
    groups = scratch.cut(groups.drop("_n"), "groups")
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    joined = rows.join(groups, (F.col("digest") == F.col("_d")) & F.col("big"), "left")
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("_first")) & F.col("_first").isNotNull(), F.lit(False))
    return joined.select("page_id", "url", "html", "digest", F.when(again, F.col("_first")).alias("first_id"), again.alias("revisit"))


def write_monolithic(planned: DataFrame, scratch: Scratch, level: int = 1) -> list[str]:
    """One gzip stream per partition; the URIs of the files of committed tasks."""
    root = scratch.path("whole")

    def put(batches):
        import pyarrow as pa

        uri, out, z = f"{root}/{files.attempt_name('pages')}.warc.gz", None, None
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    out, z = files.create(uri), zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(z.compress(record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["first_id"], r["revisit"])))
        if out:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"uri": [uri]})

    return [r.uri for r in scratch.cut(planned.mapInArrow(put, "uri string"), "written").collect()]  # a row per file


def normalise(spark: SparkSession, uris: list[str], scratch: Scratch, level: int = 6) -> list[str]:
    """Record-per-member copies with ``.idx`` sidecars (int64 offset, int64 length per record)."""
    root = scratch.path("members")

    def put(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for k in b.column(0).to_pylist():
                uri, at, index = f"{root}/{files.attempt_name('pages')}.warc.gz", 0, []
                with files.open_input(uris[k]) as src, files.create(uri) as out:
                    for rec in split_records(inflate(src)):
                        data = member(rec, level)
                        out.write(data)
                        index.append((at, len(data)))
                        at += len(data)
                with files.create(uri.removesuffix(".warc.gz") + ".idx") as out:
                    out.write(np.array(index, "<i8").tobytes())
                yield pa.RecordBatch.from_pydict({"uri": [uri]})

    return [r.uri for r in scratch.cut(files.one_per_task(spark, len(uris)).mapInArrow(put, "uri string"), "normalised").collect()]


KIND = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, length long"


def _page(field: str | None) -> int | None:
    inner = (field or "").removeprefix("<urn:page:").removesuffix(">")
    return None if inner in ("", "null") else int(inner)


def read_indexed(spark: SparkSession, uris: list[str]) -> DataFrame:
    """Every record through its index entry; response payloads are checked against their digest."""

    def get(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
        for b in batches:
            for k in b.column(0).to_pylist():
                index = np.frombuffer(files.read_bytes(uris[k].removesuffix(".warc.gz") + ".idx"), "<i8").reshape(-1, 2)
                rows = []
                with files.open_input(uris[k]) as f:
                    for at, n in index.tolist():
                        f.seek(at)
                        rec = zlib.decompress(f.read(n), 31)
                        end = rec.index(b"\r\n\r\n")
                        head = parse_head(rec[:end])
                        http, _, payload = rec[end + 4 : -4].partition(b"\r\n\r\n")
                        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
                        digest = head["warc-payload-digest"].removeprefix("sha256:")
                        if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{uris[k]} at {at}: payload and digest disagree")
                        rows.append({"page_id": _page(head["warc-record-id"]), "url": head["warc-target-uri"], "payload_bytes": size, "payload_digest": digest, "record_type": head["warc-type"], "refers_to": _page(head.get("warc-refers-to")), "offset": at, "length": n})
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.one_per_task(spark, len(uris)).mapInArrow(get, KIND)


ORACLE_SQL = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to FROM p LEFT JOIN g ON payload_digest = d AND payload_bytes >= 100"""
