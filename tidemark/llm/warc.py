"""WARC archives: a writer and the normaliser of monolithic gzip files.

``write`` turns pages into WARC records inside whole-file gzip streams, as crawlers
often leave them: nothing can be read without inflating all before it.
``normalise`` inflates each stream once, rewrites every record as a gzip member of
its own and puts an index of offsets beside it (one JSON line per record), so that
``read`` fetches records by offset. On the way, records whose payload another
record has already become revisits without a body.

Archives close at ``ARCHIVE_BYTES`` of raw records, so a task holds a bounded file
and its list of records. Only digests are shuffled, never pages. Files get new
names in every attempt, and only those that a finished task names in its result
count: a lost executor leaves an unnamed file behind, no half one in use. They are
written below the given root by pyarrow's file systems (local, HDFS, S3, GCS).

Edge cases: null html is an empty payload; payloads below ``LEAST`` bytes are all
responses; of equal payloads the smallest page_id is the response, rows repeated
under that id are responses too, and a null page_id is one only if all are null; a
null url leaves out the target; an empty table writes no archive and gives no rows.
Only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import attach, durable

ARCHIVE_BYTES = 16 << 20
LEAST = 100
CHUNK = 1 << 20
GZIP = 16 + zlib.MAX_WBITS
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", root))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(value: str | None) -> int | None:
    name = (value or "<urn:page:none>")[10:-1]
    return None if name == "none" else int(name)


def head(fields: dict[str, str | int | None]) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode()


def parse_head(raw: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:])


def response(page_id: int | None, url: str | None, payload: bytes, digest: str) -> bytes:
    block = (HTTP % len(payload)).encode() + payload
    return head({"WARC-Type": "response", "WARC-Record-ID": record_id(page_id), "WARC-Date": DATE,
                 "WARC-Target-URI": None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~"),
                 "WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Bytes": len(payload),
                 "Content-Type": "application/http; msgtype=response",
                 "Content-Length": len(block)}) + block + b"\r\n\r\n"


def revisit(fields: dict[str, str], refers_to: int) -> bytes:
    return head(fields | {"WARC-Type": "revisit", "WARC-Refers-To": record_id(refers_to),
                          "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                          "Content-Length": 0}) + b"\r\n\r\n"


def write(pages: DataFrame, root: str) -> DataFrame:
    """Write every row into monolithic archives under ``root``; a durable manifest
    (archive, ordinal, page_id, payload_bytes, digest) names them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        store.create_dir(base, recursive=True)
        out = name = squeeze = None
        raw = ordinal = 0

        def close() -> None:
            if out is not None:
                out.write(squeeze.flush())
                out.close()
        for b in batches:
            rows = []
            for page, url, text in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "html")]):
                if out is None or raw > ARCHIVE_BYTES:
                    close()
                    name = f"crawl-{uuid.uuid4().hex}.warc.gz"
                    out, squeeze = store.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, GZIP)
                    raw = ordinal = 0
                payload = (text or "").encode("utf-8", "replace")
                digest = hashlib.sha256(payload).hexdigest()
                record = response(page, url, payload, digest)
                out.write(squeeze.compress(record))
                rows.append((name, ordinal, page, len(payload), digest))
                raw, ordinal = raw + len(record), ordinal + 1
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(),
                                                                pa.int64(), pa.string()))],
                    ["archive", "ordinal", "page_id", "payload_bytes", "digest"])
        close()
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return durable(pages.mapInArrow(run, "archive string, ordinal int, page_id long, payload_bytes long, "
                                         "digest string"))


class Inflated:
    """A gzip stream read once, front to back, in bounded pieces. Members follow one
    another; zeros after a member are padding. A member without its end is an error."""

    def __init__(self, stream) -> None:
        self.stream, self.inflate, self.have = stream, None, b""

    def _more(self) -> bool:
        if self.inflate is None or self.inflate.eof:
            data = (self.inflate.unused_data if self.inflate else b"").lstrip(b"\0")
            while not data and (read := self.stream.read(CHUNK)):
                data = read.lstrip(b"\0")
            if not data:
                return False
            self.inflate = zlib.decompressobj(GZIP)
        else:
            data = self.inflate.unconsumed_tail or self.stream.read(CHUNK)
            if not data:
                raise EOFError("archive ends inside a member")
        self.have += self.inflate.decompress(data, CHUNK)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before ``mark``; None at the end of the stream."""
        while (at := self.have.find(mark)) < 0:
            if not self._more():
                return None
        found, self.have = self.have[:at], self.have[at + len(mark):]
        return found

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.have and not self._more():
                raise EOFError("archive ends inside a record")
            piece, self.have = self.have[:n], self.have[n:]
            n -= len(piece)
            if piece:
                yield piece


def rewrite(store: fs.FileSystem, source: str, target: str, index: str,
            revisits: dict[int, int]) -> int:
    """One member per record and the offset index; gives the number of records."""
    count = offset = 0
    with store.open_input_stream(source, compression=None) as raw, \
            store.open_output_stream(target, compression=None) as out, \
            store.open_output_stream(index, compression=None) as idx:
        stream = Inflated(raw)
        while (top := stream.until(b"\r\n\r\n")) is not None:
            fields = parse_head(top)
            member, size = zlib.compressobj(4, zlib.DEFLATED, GZIP), 0
            body = stream.pieces(int(fields["Content-Length"]) + 4)
            refers_to = revisits.get(count)
            if refers_to is None:
                size += out.write(member.compress(top + b"\r\n\r\n"))
                for piece in body:
                    size += out.write(member.compress(piece))
            else:
                for _ in body:
                    pass
                size += out.write(member.compress(revisit(fields, refers_to)))
            size += out.write(member.flush())
            idx.write((json.dumps({"record": fields["WARC-Record-ID"], "offset": offset, "length": size,
                                   "type": "response" if refers_to is None else "revisit"}) + "\n").encode())
            offset, count = offset + size, count + 1
    return count


def normalise(manifest: DataFrame, root: str) -> DataFrame:
    """Rewrite the archives of a manifest; a durable listing (warc, index, records)
    names the new files. Equal digests meet by partial aggregates, and archives get
    their revisits as a list no longer than the archive."""
    first = durable(manifest.where(F.col("payload_bytes") >= LEAST).groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.min("page_id").alias("refers_to")).where("n > 1").drop("n"))
    rows = attach(manifest, first, ["digest"]).select(
        "archive", "ordinal", F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")),
                                     F.col("refers_to")).alias("refers_to"))
    archives = manifest.select("archive").distinct().count()

    def run(t: pa.Table) -> pa.Table:
        name = t.column("archive")[0].as_py()
        store, base = opened(root)
        stem = f"member-{uuid.uuid4().hex}"
        revisits = {o: r for o, r in zip(t.column("ordinal").to_pylist(), t.column("refers_to").to_pylist())
                    if r is not None}
        n = rewrite(store, f"{base}/{name}", f"{base}/{stem}.warc.gz", f"{base}/{stem}.idx", revisits)
        return pa.table({"warc": [f"{stem}.warc.gz"], "index": [f"{stem}.idx"], "records": pa.array([n], pa.int64())})

    # A partition per archive: few bytes are shuffled, but much is read and written.
    return durable(rows.repartition(max(1, 2 * archives), "archive").groupBy("archive").applyInArrow(
        run, "warc string, index string, records long"))


def fetch(store: fs.FileSystem, warc: str, entries: list[dict]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(head, block) of records by offset."""
    with store.open_input_file(warc) as f:
        for e in entries:
            raw = zlib.decompress(f.read_at(e["length"], e["offset"]), GZIP)
            top, rest = raw.split(b"\r\n\r\n", 1)
            yield parse_head(top), rest[:-4]


def read(listing: DataFrame, root: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every
    record, each fetched by its offset; digests of responses are computed anew."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        for b in batches:
            for warc, index in zip(b.column("warc").to_pylist(), b.column("index").to_pylist()):
                with store.open_input_stream(f"{base}/{index}", compression=None) as f:
                    entries = [json.loads(line) for line in f.read().splitlines()]
                rows = []
                for fields, block in fetch(store, f"{base}/{warc}", entries):
                    if fields["WARC-Type"] == "response":
                        payload = block.split(b"\r\n\r\n", 1)[1]
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    else:
                        size, digest = int(fields["X-Payload-Bytes"]), fields["WARC-Payload-Digest"][7:]
                    rows.append((page_of(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"],
                                 page_of(fields.get("WARC-Refers-To"))))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(),
                                                                    pa.string(), pa.int64()))],
                        ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return listing.select("warc", "index").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame, root: str) -> DataFrame:
    """Write, normalise and read back."""
    return read(normalise(write(pages, root), root), root)
