"""Converts legacy ARC archives to WARC.

An ARC file opens with a version block that names the fields of its header lines;
every record has such a line, which ends in the declared length, and that many
bytes. The converter reads both versions and makes up what WARC asks for and ARC
lacks: record ids, ISO dates, record types and digests. A payload that an earlier
record of the archive set has already becomes a revisit.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shared_files
from tidemark.llm.text import prepare_arrow
from tidemark.session import materialize, scratch_path

# The field names of the two ARC versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Shorter payloads are always written out.
REVISIT_BYTES = 100
LEVEL = 3
FIRST_DATE = datetime(2020, 1, 1, tzinfo=UTC)


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    """An ARC record with its header fields by name."""

    fields: dict[str, str]
    content: bytes

    @property
    def date(self) -> str:
        return datetime.strptime(self.fields["Archive-date"][:14].ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")

    @property
    def http(self) -> bool:
        return self.content.startswith(b"HTTP/")

    @property
    def head(self) -> bytes:
        """The HTTP header with its blank line; empty for other content."""
        at = self.content.find(b"\r\n\r\n") if self.http else -1
        return self.content[: at + 4] if at >= 0 else b""

    @property
    def payload(self) -> bytes:
        return self.content[len(self.head) :]

    @property
    def digest(self) -> str:
        return hashlib.sha256(self.payload).hexdigest()

    @property
    def record_id(self) -> str:
        name = "\n".join([self.fields["URL"], self.date, hashlib.sha256(self.content).hexdigest()])
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def read_arc(file) -> Iterator[Record]:
    """Records of an ARC stream (its version block is not one).

    Blank lines between records are skipped. A header line that does not fit the
    version block, or a file that ends inside a record, raises ``ValueError``.
    """
    line = file.readline().split()
    if not line or not line[0].startswith(b"filedesc:"):
        raise ValueError("no version block")
    block = file.read(int(line[-1])).split(b"\n")
    version, names = int(block[0].split()[0]), block[1].decode().split()
    if version not in FIELDS:
        raise ValueError(f"ARC version {version}")
    while line := file.readline():
        if not line.strip():
            continue
        values = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"header line {line[:80]!r}")
        content = file.read(int(values[-1]))
        if len(content) < int(values[-1]):
            raise ValueError(f"{values[0]}: {len(content)} of {values[-1]} bytes")
        yield Record(dict(zip(names, values, strict=True)), content)


def http_header(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode()
    return None


def _arc_line(version: int, url: str, date: str, status: int, digest: str, offset: int, file: str, length: int) -> bytes:
    middle = [str(status), digest, "-", str(offset), file] if version == 2 else []
    return " ".join([url, "0.0.0.0", date, "text/html", *middle, str(length)]).encode() + b"\n"


def write_arcs(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as ARC files; returns ``file``.

    Files take turns between the two versions. The content is an HTTP response
    whose header carries the page id. A null html is empty, a null url becomes
    a urn of the id, white space in a url is escaped, and a null id leaves its
    header out. Only the files listed are complete.
    """
    folder = scratch_path(prepare_arrow(pages.sparkSession), "arc")
    rows = pages.selectExpr("bigint(page_id) as page_id", "url", "html", "spark_partition_id() % 2 + 1 as version")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for row in batch.to_pylist():
                page, html = row["page_id"], (row["html"] or "").encode()
                date = (FIRST_DATE + timedelta(seconds=(page or 0) % 10**8)).strftime("%Y%m%d%H%M%S")
                if out is None:
                    version, name = row["version"], uuid.uuid4().hex
                    files, path = shared_files.store(f"{folder}/{name}.arc.gz")
                    files.create_dir(path.rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(path, compression=None)
                    block = f"{version} 0 tidemark\n{FIELDS[version]}\n\n".encode()
                    out.write(_member(f"filedesc://{name}.arc 0.0.0.0 {date} text/plain {len(block)}\n".encode() + block))
                url = "%20".join((row["url"] or f"urn:page:{page}").split()) or "urn:page:"
                head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(html)}"]
                head += [f"X-Page-Id: {page}"] if page is not None else []
                content = "\r\n".join([*head, "", ""]).encode() + html
                digest = hashlib.md5(html).hexdigest() if version == 2 else ""
                out.write(_member(b"\n" + _arc_line(version, url, date, 200, digest, out.tell(), f"{name}.arc", len(content)) + content))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.arc.gz"])], ["file"])

    return materialize(rows.mapInArrow(run, "file STRING"), "arcs")


def _spread(files: DataFrame) -> DataFrame:
    """A task for every file."""
    return files.repartition(max(1, files.count()))


def arc_index(files: DataFrame) -> DataFrame:
    """``file, place, record_id, page_id, payload_bytes, digest`` of every ARC record."""
    names = ["file", "place", "record_id", "page_id", "payload_bytes", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in (u for batch in batches for u in batch.column("file").to_pylist()):
            with _opened(uri) as file:
                rows = [
                    (uri, k, r.record_id, int(p) if (p := http_header(r.head, "X-Page-Id")) else None, len(r.payload), r.digest)
                    for k, r in enumerate(read_arc(file))
                ]
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names)

    return _spread(files.select("file")).mapInArrow(run, "file STRING, place BIGINT, record_id STRING, page_id BIGINT, payload_bytes BIGINT, digest STRING")


def _opened(uri: str):
    files, path = shared_files.store(uri)
    return gzip.GzipFile(fileobj=files.open_input_stream(path, compression=None, buffer_size=1 << 20))


def convert(files: DataFrame) -> DataFrame:
    """Writes a WARC file for every ARC file in ``files (file)``; returns ``file``.

    Of records with equal payloads of at least 100 bytes the one with the
    smallest page id stays (null ids last, then by file and place); the others
    become revisits of it, with their HTTP header but without the payload.
    """
    folder = scratch_path(prepare_arrow(files.sparkSession), "warc")
    index = materialize(arc_index(files), "arc-index")
    order = F.struct(F.col("page_id").isNull(), "page_id", "file", "place", "record_id").alias("first")
    large = index.where(f"payload_bytes >= {REVISIT_BYTES}")
    first = large.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = large.join(first, "digest").where("file <> first.file or place <> first.place")
    later = later.groupBy("file").agg(F.collect_list(F.struct("place", F.col("first.record_id").alias("id"))).alias("later"))
    plan = materialize(files.select("file").join(later, "file", "left"), "plan")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                refers = {x["place"]: x["id"] for x in row["later"] or []}
                uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                out_files, path = shared_files.store(uri)
                out_files.create_dir(path.rpartition("/")[0], recursive=True)
                with out_files.open_output_stream(path, compression=None) as out, _opened(row["file"]) as file:
                    info = f"software: tidemark\r\nformat: WARC/1.1\r\nisPartOf: {row['file'].rpartition('/')[2]}\r\n".encode()
                    out.write(_warc("warcinfo", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, row['file'])}>", FIRST_DATE.strftime("%Y-%m-%dT%H:%M:%SZ"), info, {"Content-Type": "application/warc-fields"}))
                    for place, record in enumerate(read_arc(file)):
                        out.write(warc_record(record, refers.get(place)))
                yield pa.RecordBatch.from_arrays([pa.array([uri])], ["file"])

    return materialize(_spread(plan).mapInArrow(run, "file STRING"), "warcs")


def warc_record(record: Record, refers_to: str | None = None) -> bytes:
    """The WARC record of an ARC record, as a gzip member."""
    digest = f"sha256:{record.digest}"
    more = {"WARC-Target-URI": record.fields["URL"], "WARC-IP-Address": record.fields["IP-address"], "WARC-Payload-Digest": digest}
    kind = "response" if record.http else "resource"
    more["Content-Type"] = "application/http; msgtype=response" if record.http else record.fields["Content-type"]
    block, own = record.content, record.record_id
    if refers_to:
        kind, block = "revisit", record.head
        more |= {"WARC-Profile": REVISIT, "WARC-Refers-To": refers_to}
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, own + refers_to)}>"
    return _warc(kind, own, record.date, block, more)


def _warc(kind: str, own: str, date: str, block: bytes, more: dict[str, str]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": own, "WARC-Date": date, **more}
    head |= {"WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return _member(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n")


def read_warc(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every WARC record of a stream."""
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:80]!r}")
        head = {}
        while (line := file.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            head[key] = value.strip()
        block = file.read(int(head["Content-Length"]))
        if f"sha256:{hashlib.sha256(block).hexdigest()}" != head["WARC-Block-Digest"]:
            raise ValueError(f"{head['WARC-Record-ID']}: block and digest differ")
        yield head, block


def warc_index(files: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the WARC records.

    Payloads that are there are checked against their digests; sizes of payloads
    that are left out come from the HTTP header.
    """
    names = ["record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in (u for batch in batches for u in batch.column("file").to_pylist()):
            rows = []
            with _opened(uri) as file:
                for head, block in read_warc(file):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    http = Record({}, block)
                    digest, page = head["WARC-Payload-Digest"].removeprefix("sha256:"), http_header(http.head, "X-Page-Id")
                    size = int(http_header(http.head, "Content-Length") or len(http.payload))
                    if head["WARC-Type"] != "revisit" and (http.digest != digest or len(http.payload) != size):
                        raise ValueError(f"{head['WARC-Record-ID']}: payload and digest differ")
                    rows.append((head["WARC-Record-ID"], int(page) if page else None, size, digest, head["WARC-Type"], head.get("WARC-Refers-To")))
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names)

    schema = "record_id STRING, page_id BIGINT, payload_bytes BIGINT, payload_digest STRING, record_type STRING, refers_id STRING"
    rows = materialize(_spread(files).mapInArrow(run, schema), "warc-index")
    named = rows.where("record_type = 'revisit'").groupBy("refers_id").agg(F.lit(1).alias("_one")).select("refers_id")
    target = rows.where("record_type <> 'revisit'").selectExpr("record_id as refers_id", "page_id as refers_to")
    target = named.join(target, "refers_id").groupBy("refers_id").agg(F.min("refers_to").alias("refers_to"))
    return rows.join(target, "refers_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
