"""Legacy archives (ARC, versions 1 and 2) converted to WARC, equal payloads once.

An ARC file begins with a version block, whose second line names the fields of every record line; a record is such a
line, a block of the length that it declares, and a line feed. Each becomes a WARC response with an identifier made
from what the line says, the ISO form of its date, and the digests of block and payload. Of equal payloads one record
is the response and the others are revisits that refer to it. Records are gzip members of their own.

Defined results: null html is an empty payload; a null page_id is written without one and never referred to; rows
that repeat a page_id with the referred payload are responses too; an empty table gives no archive and no row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_chunks, commit_file, new_path, stage

# Field lines of the ARC versions and the revisit profile of the WARC format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("7d3c1f0a-52c4-5b7e-9a61-0c8f6f5b2e11")
SALTS = 32


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """The block after its HTTP head, where it has one."""
        if not self.block.startswith(b"HTTP/"):
            return self.block
        head, gap, body = self.block.partition(b"\r\n\r\n")
        return body if gap else self.block


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, by its version's field line and the declared lengths."""
    if not data:
        return
    end = data.index(b"\n")
    length = int(data[:end].rsplit(b" ", 1)[1])
    lines = data[end + 1 : end + 1 + length].split(b"\n")
    version, names = int(lines[0].split(b" ")[0]), lines[1].decode("ascii").split(" ")
    if version not in ARC_FIELDS:
        raise ValueError(f"ARC version {version} is not known")
    at = end + 1 + length
    while True:
        while at < len(data) and data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\n", at)
        values = data[at:end].rstrip(b"\r").decode("utf-8", "surrogateescape").split(" ")
        if len(values) != len(names):
            raise ValueError(f"{len(values)} fields in a record line of ARC version {version}; its field line has {len(names)}")
        fields = dict(zip(names, values))
        length = int(fields["Archive-length"])
        if end + 1 + length > len(data):
            raise ValueError("an ARC record is cut short")
        yield ArcRecord(version, fields, data[end + 1 : end + 1 + length])
        at = end + 1 + length


def write_arc(version: int, records: list[tuple[str, str, str, str, bytes]], name: str = "legacy.arc") -> bytes:
    """An ARC file of (URL, IP address, date, content type, block)."""
    intro = f"{version} 0 -\n{ARC_FIELDS[version]}\n".encode()
    parts = [f"filedesc://{name} 0.0.0.0 {records[0][2] if records else '0' * 14} text/plain{'' if version == 1 else f' 200 - - 0 {name}'} {len(intro)}\n".encode(), intro]
    at = sum(map(len, parts))
    for url, ip, date, kind, block in records:
        middle = "" if version == 1 else f" 200 {hashlib.md5(block, usedforsecurity=False).hexdigest()} - {at + 1} {name}"
        line = f"\n{url} {ip} {date} {kind}{middle} {len(block)}\n".encode("utf-8", "surrogateescape")
        parts += [line, block]
        at += len(line) + len(block)
    return b"".join([*parts, b"\n"])


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def iso_date(arc_date: str) -> str:
    """YYYYMMDDhhmmss, or a prefix of it, as WARC has it."""
    d = (arc_date if arc_date.isdigit() else "").ljust(4, "0")[:14]
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_id(fields: dict[str, str], digest: str, of: str = "") -> str:
    """The same for the same record line, payload and row."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join([fields['URL'], fields['Archive-date'], digest, of]))}>"


def warc_record(arc: ArcRecord, of: str = "", refers_to: tuple[str, str] | None = None) -> bytes:
    """A gzip member. ``of``: the row's id, an extension field; refers_to: row id and record id of the response."""
    payload = arc.payload
    digest, head = base32_sha1(payload), arc.block[: len(arc.block) - len(payload)]
    block = arc.block if refers_to is None else head
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(arc.fields, digest, of)),
        ("WARC-Date", iso_date(arc.fields["Archive-date"])),
        ("WARC-Target-URI", arc.fields["URL"]),
        ("WARC-IP-Address", arc.fields["IP-address"]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response" if head else arc.fields["Content-type"]),
        ("X-ARC-Version", str(arc.version)),
        ("X-Row", of),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers_to[1]), ("X-Refers-To-Row", refers_to[0])]
    fields.append(("Content-Length", str(len(block))))
    text = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(text.encode("utf-8", "surrogateescape") + block + b"\r\n\r\n") + packer.flush()


def read_warc(data: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record of a file of gzip members."""
    at = 0
    while at < len(data):
        opener, parts = zlib.decompressobj(31), []
        while not opener.eof and at < len(data):
            piece = data[at : at + 65_536]
            parts.append(opener.decompress(piece))
            at += len(piece)
        at -= len(opener.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        first, *lines = head.decode("utf-8", "surrogateescape").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines)
        yield fields, rest[: int(fields["Content-Length"])]


def legacy_archive(batch: pa.RecordBatch, version: int) -> bytes:
    """Pages as an ARC file: each an HTTP response with the html as its payload."""
    records = []
    for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
        body = (html or "").encode()
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        records.append((re.sub(r"\s", "%20", url or "") or "unknown:", "0.0.0.0", "20240101000000", "text/html", head + body))
    return write_arc(version, records)


def _arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[ArcRecord]]]:
    for k, (part, _) in enumerate(arrow_chunks(batches, "html")):
        yield part, list(parse_arc(legacy_archive(part, 1 + k % 2)))


def payload_keys(pages: DataFrame) -> DataFrame:
    """page_id, address (SHA-256 of the payload), bytes and record id of each converted page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, arcs in _arcs(batches):
            ids = part.column("page_id").to_pylist()
            rows = [(hashlib.sha256(p).hexdigest(), len(p), record_id(a.fields, base32_sha1(p), "" if i is None else str(i))) for a, i in zip(arcs, ids) for p in [a.payload]]
            a, n, r = zip(*rows)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(a), pa.array(n, pa.int64()), pa.array(r)], ["page_id", "address", "bytes", "record"])

    return pages.mapInArrow(run, "page_id long, address string, bytes long, record string")


def revisits(keys: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id and address of the records that revisit, with the page_id and record id of what they refer to."""
    groups = keys.filter((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("address")
    groups = groups.agg(F.max(F.struct("page_id", "record")).alias("to"), F.min("page_id").alias("least")).filter(F.col("least") < F.col("to.page_id"))
    groups = groups.select("address", "to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = keys.select("page_id", "address").distinct().withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    rows = rows.join(groups, ["address", "salt"])
    return rows.filter(F.col("page_id") < F.col("to.page_id")).select("page_id", "address", F.col("to.page_id").alias("to_page"), F.col("to.record").alias("to_record"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> int:
    """Write one WARC file a partition; the number of records."""
    body = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    refs = revisits(stage(payload_keys(body), "keys"), least_bytes)
    keyed = body.withColumn("address", F.sha2("html", 256)).join(refs, ["page_id", "address"], "left").select("page_id", "url", "html", "to_page", "to_record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out = TaskContext.get(), []
        for part, arcs in _arcs(batches):
            for arc, i, to, rid in zip(arcs, *(part.column(c).to_pylist() for c in ("page_id", "to_page", "to_record"))):
                out.append(warc_record(arc, "" if i is None else str(i), None if to is None else (str(to), rid)))
        if out:
            commit_file(f"{folder}/part-{task.partitionId():06d}.warc.gz", task.taskAttemptId(), out)
            yield pa.RecordBatch.from_pydict({"records": [len(out)]})

    return keyed.mapInArrow(run, "records long").agg(F.sum("records")).first()[0] or 0


def read_archives(spark, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record; digests are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for f, block in read_warc(memoryview(content.as_buffer())):
                    n, digest = int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if f["WARC-Type"] == "response":
                        payload = ArcRecord(1, {}, block).payload
                        if len(payload) != n or base32_sha1(payload) != digest:
                            raise ValueError(f"{f['WARC-Record-ID']}: the payload is not the one that was written")
                    row = lambda k: int(f[k]) if k in f else None
                    rows.append((row("X-Row"), n, digest, f["WARC-Type"], row("X-Refers-To-Row")))
                columns = zip(*rows)
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def convert_files(spark, archives: str, folder: str) -> DataFrame:
    """Convert the ARC files (plain or gzip) of a path or glob to one WARC file each in ``folder``: file and records.

    Every record is a response with its place in its file as row id; a file is one task's work and is held once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                records = [warc_record(arc, str(k)) for k, arc in enumerate(parse_arc(data))]
                name = re.sub(r"(\.arc)?(\.gz)?$", "", path.rsplit("/", 1)[-1])
                commit_file(f"{folder}/{name}-{hashlib.sha256(path.encode()).hexdigest()[:8]}.warc.gz", task.taskAttemptId(), records)
                yield pa.RecordBatch.from_pydict({"file": [path], "records": [len(records)]})

    files = spark.read.format("binaryFile").load(archives).select("path", "content")
    return files.mapInArrow(run, "file string, records long")


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages through legacy archives into WARC files in the shared folder, and what reading these back gives."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    if not write_archives(pages, folder, least_bytes):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(spark, folder)
