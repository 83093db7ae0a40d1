"""WARC archives: one gzip member per record, written from pages and read back in sequence.

The reader inflates members one after another with an incremental zlib object, frames
each record by its Content-Length, and verifies block and payload digests.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import new_path, partitions, small_batches, staged, store_of, task_number

LEAST_REVISIT = 100
FILE_BYTES = 64_000_000
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = 4) -> bytes:
    """One record as one gzip member. A revisit carries the HTTP head but not the payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{refers_to}')}>"),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))] if url is not None else []),
        *([("WARC-Page-ID", str(page_id))] if page_id is not None else []),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To-Page-ID", str(refers_to))] if revisit else []),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def members(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """The inflated gzip members of a stream, in order; a torn last member is an error."""
    z, parts, rest = zlib.decompressobj(31), [], b""
    begun = False
    while True:
        data = rest or stream.read(chunk)
        rest = b""
        if not data:
            break
        begun = True
        parts.append(z.decompress(data))
        if z.eof:
            yield b"".join(parts)
            rest, parts, begun = z.unused_data, [], False
            z = zlib.decompressobj(31)
    if begun:
        raise ValueError("archive ends inside a member")


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record, framed and verified."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's Content-Length doesn't frame its block")
    if fields.get("warc-block-digest", f"sha256:{hashlib.sha256(block).hexdigest()}") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("block digest differs")
    return fields, block


def page_of(fields: dict[str, str], block: bytes) -> tuple[int | None, str | None, int, str, str, int | None, bytes | None]:
    """page_id, url, payload length, payload digest, type, refers_to and payload (null in a revisit)."""
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload digest or length differs")
    page, refers = fields.get("warc-page-id"), fields.get("warc-refers-to-page-id")
    return (int(page) if page else None), fields.get("warc-target-uri"), length, digest, kind, (int(refers) if refers else None), payload if kind == "response" else None


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, payload, digest, refers_to`` of each row.

    Equal payloads of at least ``least`` bytes refer to the smallest page_id among them.
    Digests that hold over a thousandth of all rows (so a thousand at most) are looked up
    in a broadcast table; all others are joined, and rows that need no join are dealt at
    random, so no group of copies lands in one task.
    """
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    groups = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    groups = staged(groups.filter("n > 1 AND first IS NOT NULL"), "equal-payloads")
    hot = max(2, pages.count() // 1000)
    large = groups.filter(F.col("n") > hot).select("digest", F.col("first").alias("_hot"))
    small = groups.filter(F.col("n") <= hot).select(F.col("digest").alias("_key"), F.col("first").alias("_cold"))
    rows = rows.join(F.broadcast(large), "digest", "left")
    alone = F.col("_hot").isNotNull() | (F.octet_length("payload") < least)
    rows = rows.withColumn("_key", F.when(alone, F.concat(F.lit("-"), F.xxhash64("page_id", "url", "digest").cast("string"))).otherwise(F.col("digest")))
    first = F.coalesce("_hot", "_cold")
    return rows.join(small, "_key", "left").select(
        "page_id", "url", "payload", "digest", F.when(first != F.coalesce("page_id", F.lit(-1) - first), first).alias("refers_to")
    )


def write_archives(pages: DataFrame, out: str | None = None, least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record per row of ``pages(page_id, url, html)`` below ``out`` (by default in the
    shared folder); returns the staged manifest ``path, n_records, n_bytes``.

    Null html is an empty payload; a null url has no target field; repeated rows each
    have a record, and copies under the smallest page_id itself are responses; a null
    page_id is never the smallest. An empty table writes nothing.
    """
    spark = pages.sparkSession
    small_batches(spark)
    out = out or new_path(spark, "warc")
    if "://" not in out or out.startswith("file:"):
        store, path = store_of(out)
        store.create_dir(path, recursive=True)

    def run(batches):
        store, base = store_of(out)
        part, f, name, size, count = task_number(), None, "", 0, 0

        def closed():
            nonlocal f
            f.close()
            f = None
            return pa.RecordBatch.from_pydict({"path": [f"{out}/{name}"], "n_records": pa.array([count], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if f is None:
                    name, size, count = f"{part:06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    f = store.open_output_stream(f"{base}/{name}")
                data = record(*row)
                f.write(data)
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    yield closed()
        if f is not None:
            yield closed()

    return staged(with_revisits(pages, least).mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` of every record,
    and with ``payload`` its bytes; a record that isn't framed or doesn't match its digests raises."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + payload]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = store_of(path)
                rows, seen = [], 0
                with store.open_input_stream(name) as f:
                    for data in members(f):
                        rows.append(page_of(*parsed(data))[: 6 + payload])
                        seen += 1
                        if len(rows) == 500:
                            yield batch_of(rows)
                            rows = []
                if seen != expected:
                    raise ValueError(f"{path}: {seen} records of {expected}")
                if rows:
                    yield batch_of(rows)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return manifest.select("path", "n_records").repartition(partitions(manifest.sparkSession)).mapInArrow(run, schema)
