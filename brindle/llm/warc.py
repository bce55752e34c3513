"""WARC archives with segmented records: writing, reading, and reassembly of continuation records.

Writing: one task writes its rows to gzip archives (a member per record, a new file beyond ``ARCHIVE_BYTES``). A block
(HTTP head and chunked body) longer than ``segment_bytes`` is cut: its first piece is a response record with segment
number 1, the others are continuation records with the origin's identifier and their number; the last one names the
total length. Of equal payloads of ``least_shared`` bytes or more, the one with the largest page_id is the response
and the others are revisits of it, naming its target URI and date: equal payloads meet as counts (partial aggregates),
never as pairs, and what is shared comes back to the pages under ``SALTS`` keys, so that a payload that a third of all
pages have is dealt over that many. Archives have names of the attempt that wrote them; those of lost attempts are never read.

Reading: archives are streamed record by record; pieces are grouped by origin, ordered by number, checked against the
total length, joined, and the chunked framing is taken off. Groups are single records, so no group grows with the
corpus.

Defined cases: a null payload is empty; a null url is recorded as ``urn:page:``; a null page_id stays null and never
names a response, unless all of a payload's ids are null (all responses); rows with equal page_id and payload are all
responses if that id is the largest; an empty table writes nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, new_path, settle

ARCHIVE_BYTES = 256 << 20
CHUNK = 4096
#: Keys over which a shared payload is dealt.
SALTS = 32
DATE = "1970-01-01T00:00:00Z"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    return b"".join(b"%x\r\n%s\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The body in chunked transfer framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        n = int(framed[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        body = framed[end + 2 : end + 2 + n]
        if len(body) != n or framed[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body)
        at = end + 4 + n


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    lines = [f"{k}: {v}" for k, v in [*fields, ("Content-Length", len(block))] if v is not None]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def records(f, buffer: int = 1 << 20):
    """(fields, block) of each record of an archive, one at a time."""
    data, unpack, out = b"", zlib.decompressobj(31), []
    while True:
        if not data:
            data = f.read(buffer)
            if not data:
                if out:
                    raise ValueError("the archive ends inside a record")
                return
        out.append(unpack.decompress(data))
        data = unpack.unused_data if unpack.eof else b""
        if unpack.eof:
            raw, out, unpack = b"".join(out), [], zlib.decompressobj(31)
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])]


def target(url: str | None, page_id: int | None) -> str:
    return re.sub(r"\s", "%20", url) if url else f"urn:page:{'' if page_id is None else page_id}"


def page_records(page_id, url, payload: bytes, refers_to, refers_url, revisit: bool, name: str, segment_bytes: int):
    """The records of one page, already packed."""
    digest = hashlib.sha1(payload).digest()
    url = target(url, page_id)
    origin = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"
    shared = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()), ("Page-Id", page_id), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        head = HEAD + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", origin), ("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", target(refers_url, refers_to)), ("WARC-Refers-To-Date", DATE), ("Refers-To-Page-Id", refers_to), *shared], head)
        return
    block = HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    whole = len(pieces) == 1
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", origin), *shared, ("WARC-Segment-Number", None if whole else 1)], pieces[0])
    for i, piece in enumerate(pieces[1:], 2):
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{i}')}>"
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", i), ("WARC-Segment-Total-Length", len(block) if i == len(pieces) else None)], piece)


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 4096, least_shared: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> list[str]:
    """Write the archives into the shared folder ``path``; returns their names."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    last = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("x")
    shared = settle(rows.where(F.octet_length("payload") >= least_shared).groupBy("sha1").agg(last, F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", F.col("x.page_id").alias("refers_to"), F.col("x.url").alias("refers_url")), "payloads")
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    typed = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(shared, ["sha1", "salt"], "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull(), F.lit(False))

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        part, mine, store = context.partitionId(), f"{context.taskAttemptId()}-{os.getpid()}", Store(path)
        names, out, size, n = [], None, 0, 0
        for b in batches:
            for page_id, url, body, refers_to, refers_url, again in zip(*(c.to_pylist() for c in b.columns)):
                for packed in page_records(page_id, url, body, refers_to, refers_url, again, f"{path}/{part}/{n}", segment_bytes):
                    if out is None or size + len(packed) > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        names.append(f"part-{part:06d}-{mine}-{len(names):04d}.warc.gz")
                        out, size = store.writer(names[-1]), 0
                    out.write(packed)
                    size += len(packed)
                n += 1
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string())})

    return sorted(r[0] for r in typed.select("page_id", "url", "payload", "refers_to", "refers_url", revisit.alias("again")).mapInArrow(run, "name string").collect())  # one row per archive


PIECE = "origin string, number int, total long, page_id long, type string, refers_to long, digest string, length long, block binary"
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def opened(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head and body of a block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return head, dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def read_archives(spark: SparkSession, path: str, names: list[str], with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to [, payload] of each page in the archives.

    A missing piece, a wrong total length, broken framing or a payload unlike its digest raises an error.
    """
    if not names:
        return spark.createDataFrame([], PAGE + ", payload binary" * with_payload)

    def pieces(batches):
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        columns = [x.split()[0] for x in PIECE.split(", ")]
        store = Store(path)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with store.reader(name) as f:
                    for h, block in records(f):
                        number, total = int(h.get("WARC-Segment-Number", 0)), int(h.get("WARC-Segment-Total-Length", 0))
                        page_id, digest = h.get("Page-Id"), h.get("WARC-Payload-Digest")
                        digest = digest and base64.b32decode(digest.split(":")[1]).hex()
                        length = None
                        if h["WARC-Type"] == "revisit":
                            length, block = int(re.search(rb"Content-Length: (\d+)", block)[1]), None
                        elif not number and not with_payload:
                            body = opened(block)[1]
                            length, block = len(body), None
                            if hashlib.sha1(body).hexdigest() != digest:
                                raise ValueError(f"{h['WARC-Record-ID']}: the payload is not that of its digest")
                        refers_to = h.get("Refers-To-Page-Id")
                        rows.append((h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]), number, total or None, page_id and int(page_id), h["WARC-Type"], refers_to and int(refers_to), digest, length, block))
                        held += len(block or b"") + 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], columns)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], columns)

    def joined(batches):
        for b in batches:
            rows = []
            for origin, page_id, kind, refers_to, digest, length, total, segments in zip(*(c.to_pylist() for c in b.columns)):
                body = None
                if length is None:
                    numbers, blocks = [s["number"] for s in segments], [s["block"] for s in segments]
                    if numbers != [0] and (numbers != list(range(1, len(numbers) + 1)) or sum(map(len, blocks)) != total):
                        raise ValueError(f"{origin}: its segments are {numbers}, {sum(map(len, blocks))} bytes; the total length is {total}")
                    body = opened(b"".join(blocks))[1]
                    length = len(body)
                    if hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"{origin}: the payload is not that of its digest")
                rows.append((page_id, length, digest, kind, refers_to, body))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 5 + with_payload]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in PAGE.split(", ")] + ["payload"] * with_payload)

    found = spark.createDataFrame([(x,) for x in names], "name string").repartition(len(names)).mapInArrow(pieces, PIECE)
    first = lambda c: F.max(F.when(F.col("type") != "continuation", F.col(c))).alias(c)
    whole = found.groupBy("origin").agg(*[first(c) for c in ("page_id", "type", "refers_to", "digest", "length")], F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("number", "block"))).alias("segments"))
    return whole.mapInArrow(joined, PAGE + ", payload binary" * with_payload)


def archive(pages: DataFrame, segment_bytes: int = 4096, least_shared: int = 1000, **cols) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    return read_archives(pages.sparkSession, path, write_archives(pages, path, segment_bytes, least_shared, **cols))
