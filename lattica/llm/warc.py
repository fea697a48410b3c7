"""WARC archives: writing with segmented records and revisits, reading with segment reassembly.

Every page becomes a record named ``<urn:page:ID:DIGEST:TASK.ROW>`` whose block is an HTTP response in chunked transfer
framing. A block longer than ``segment`` bytes is split: the first part stays in the response record (segment number 1),
the others are continuation records that carry the origin's name and their number; the last one states the total length.
Records are gzip members of files of bounded size, written straight into the shared folder under a name of their own for
each task attempt; only the files of attempts that succeeded get into the manifest table, so retries leave no double.

Reading groups continuation records by origin, orders them by segment number, checks numbers and total length, joins the
parts and decodes the chunked framing; the payload's SHA-1 is checked against the header. Revisits are resolved against
the responses they name.

Of equal payloads of ``least`` bytes or more, that with the largest page id is the response; the others revisit it.

Defined results: a null html is an empty payload; a page id that is null, or rows with the same id and payload as the
response, are responses themselves unless a larger id has the payload (null is smaller than any id); an empty table gives
an empty archive; extra columns are ignored; a missing url is written as ``urn:none``.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, new_path, written

CRLF = b"\r\n"
FILE_BYTES = 64 << 20
#: Groups of equal payloads up to which their table is broadcast; beyond it the join shuffles.
BROADCAST_GROUPS = 100_000


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder: the same place for the driver and every executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(piece), piece) for a in range(0, len(payload), size) for piece in [payload[a : a + size]]]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body; extensions after a chunk size and trailers are allowed, anything else is an error."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("chunk size line is missing")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk is cut off")
        out.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + CRLF + CRLF


def page_records(name: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment: int, chunk: int) -> list[bytes]:
    """The record of a page and its continuations."""
    uri = " ".join((url or "urn:none").split()) or "urn:none"
    common = [("WARC-Record-ID", f"<{name}>"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>")]
        return [record([("WARC-Type", "revisit"), *common, *more], http)]
    block = http + chunked(payload, chunk)
    if len(block) <= segment:
        return [record([("WARC-Type", "response"), *common], block)]
    parts = [block[a : a + segment] for a in range(0, len(block), segment)]
    out = [record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", "1")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}/{k}>"), ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", str(k))]
        if k == len(parts):
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record(fields, part))
    return out


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, segment: int = 8192, chunk: int = 4096) -> DataFrame:
    """Writes the archive files into ``folder`` and returns the manifest (file, records, bytes)."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), F.sha1(body).alias("digest"), F.octet_length(body).alias("n"))
    groups = rows.where(F.col("n") >= least).groupBy("digest").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("digest").alias("d"), "last")
    groups = written(spark, groups, "payloads")
    if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    planned = rows.join(groups, (F.col("digest") == F.col("d")) & (F.coalesce(F.col("id"), F.lit(-(1 << 63))) < F.col("last")), "left").select("id", "url", "html", "digest", "last")

    def run(batches):
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        task = TaskContext.get()
        number, row = 0, 0
        sink = name = None
        done: list[tuple[str, int, int]] = []
        records = size = 0
        for batch in by_bytes(batches, "html"):
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4)]
            payloads = batch.column(2).cast(pa.binary()).to_pylist()
            for i, u, digest, last, payload in zip(*columns, payloads):
                if sink is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    sink = fs.open_output_stream(f"{path}/{name}", compression=None)
                    number, records, size = number + 1, 0, 0
                page = f"urn:page:{'-' if i is None else i}:{digest[:16]}"
                to = None if last is None else f"urn:page:{last}:{digest[:16]}"
                for r in page_records(f"{page}:{task.partitionId()}.{row}", u, payload or b"", digest, to, segment, chunk):
                    press = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = press.compress(r) + press.flush()
                    sink.write(member)
                    records, size = records + 1, size + len(member)
                row += 1
                if size >= FILE_BYTES:
                    sink.close()
                    done.append((name, records, size))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((name, records, size))
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*done) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()))], names=["file", "records", "bytes"])

    return written(spark, planned.mapInArrow(run, "file string, records long, bytes long"), "manifest")


def members(stream, block: int = 1 << 20):
    """Uncompressed gzip members of a stream, one after another."""
    inflate, out, pending = zlib.decompressobj(31), [], b""
    while True:
        data = pending or stream.read(block)
        pending = b""
        if not data:
            if out:
                raise ValueError("gzip member is cut off")
            return
        out.append(inflate.decompress(data))
        if inflate.eof:
            pending = inflate.unused_data
            yield b"".join(out)
            inflate, out = zlib.decompressobj(31), []


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, block) of a record."""
    end = raw.find(CRLF + CRLF)
    lines = raw[:end].split(CRLF)
    if end < 0 or not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
    size = int(fields["content-length"])
    block = raw[end + 4 : end + 4 + size]
    if len(block) != size or raw[end + 4 + size :] != CRLF + CRLF:
        raise ValueError("record length is wrong")
    return fields, block


def read_records(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record: type, name, origin, number, total, digest, refers_to, block."""
    kinds = [("type", pa.string()), ("name", pa.string()), ("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("digest", pa.string()), ("refers", pa.string()), ("block", pa.binary())]
    schema = "type string, name string, origin string, number long, total long, digest string, refers string, block binary"

    def run(batches):
        fs, path = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        f, block = parse(raw)
                        own = f["warc-record-id"].strip("<>")
                        origin = f.get("warc-segment-origin-id", own).strip("<>")
                        number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                        refers = f.get("warc-refers-to")
                        rows.append((f["warc-type"], own, origin, number and int(number), total and int(total), f.get("warc-payload-digest", "").removeprefix("sha1:") or None, refers and refers.strip("<>"), block))
                        size += len(block)
                        if size > 8 << 20:
                            yield pa.record_batch([pa.array(x, t) for x, (_, t) in zip(zip(*rows), kinds)], names=[k for k, _ in kinds])
                            rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(x, t) for x, (_, t) in zip(zip(*rows), kinds)], names=[k for k, _ in kinds])

    files = manifest.select("file")
    n = max(1, files.count())
    return files.repartition(min(n, 100_000), "file").mapInArrow(run, schema)


def reassembled(records: DataFrame) -> DataFrame:
    """Whole records: type, name, digest, refers, block. Unsegmented records pass; segments meet by origin."""
    whole = records.where("number is null").select("type", "name", "digest", "refers", "block")
    parts = (
        records.where("number is not null")
        .groupBy("origin")
        .agg(
            F.max("digest").alias("digest"),
            F.max("total").alias("total"),
            F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"),
        )
        .select(
            F.lit("response").alias("type"), F.col("origin").alias("name"), "digest", F.lit(None).cast("string").alias("refers"),
            F.when(
                (F.transform("parts", lambda p: p["number"]) == F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long")))
                & (F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["block"])) == F.col("total")),
                F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["block"])), "")),  # one copy, whatever their number
            ).otherwise(F.raise_error(F.concat(F.lit("segments of "), "origin", F.lit(" are not complete")))).alias("block"),
        )
    )
    return whole.unionByName(parts)


def payloads(whole: DataFrame) -> DataFrame:
    """type, name, page_id, refers_to, digest and the payload decoded from each response (null for revisits)."""

    def page(name: str | None):
        part = (name or "").split(":")[2:3]
        return int(part[0]) if part and part[0] not in ("", "-") else None

    def run(batches):
        for batch in by_bytes(batches, "block"):
            kind, name, digest, refers, block = (c.to_pylist() for c in batch.columns)
            found = []
            for k, d, b in zip(kind, digest, block):
                head, _, body = b.partition(CRLF + CRLF)
                if k == "revisit":
                    found.append(None)
                    continue
                body = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                if hashlib.sha1(body).hexdigest() != d:
                    raise ValueError("payload doesn't match its digest")
                found.append(body)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([page(x) for x in name], pa.int64()), pa.array([page(x) for x in refers], pa.int64()), batch.column(2), pa.array(found, pa.binary())],
                names=["type", "name", "page_id", "refers_to", "digest", "payload"],
            )

    return whole.select("type", "name", "digest", "refers", "block").mapInArrow(run, "type string, name string, page_id long, refers_to long, digest string, payload binary")


def read_pages(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page of the archives."""
    decoded = payloads(reassembled(read_records(spark, manifest, folder)))
    found = written(spark, decoded.select("type", "page_id", "refers_to", "digest", F.octet_length("payload").cast("long").alias("n")), "pages")
    responses = found.where("type = 'response'")
    # A revisit's length is that of the response it names; all responses of one payload have the same.
    sizes = responses.join(found.where("type = 'revisit'").select(F.col("digest").alias("d"), F.col("refers_to").alias("r")).distinct(), (F.col("digest") == F.col("d")) & (F.col("page_id") == F.col("r")), "left_semi")
    sizes = written(spark, sizes.groupBy(F.col("digest").alias("d"), F.col("page_id").alias("p")).agg(F.max("n").alias("full")), "sizes")
    revisits = found.where("type = 'revisit'").join(sizes, (F.col("digest") == F.col("d")) & (F.col("refers_to") == F.col("p")), "left").select("type", "page_id", "refers_to", "digest", F.coalesce("full", F.raise_error(F.lit("a revisit names no response"))).alias("n"))
    return responses.unionByName(revisits).select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def archive_and_read(spark: SparkSession, pages: DataFrame, least: int = 1000) -> DataFrame:
    folder = new_path(spark, "warc")
    return read_pages(spark, write_archives(spark, pages, folder, least=least), folder)
