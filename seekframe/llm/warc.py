"""WARC archives as a Spark data source (operator 7).

``spark.read.format("warc").load(folder)`` plans one partition for each run of whole
files (``.warc.gz``) of about ``PARTITION_BYTES``.  Every record is a gzip member of its own.
A reader inflates the header block of a record first; predicates on ``record_type`` and other
header columns that Spark pushes down are judged there.  Members written here tell their
compressed length in an extra field of the gzip header, so the payload of a record that fails,
or that the schema does not ask for, is passed over unread and not inflated; foreign members
have no such field and are inflated to find their end.
``df.write.format("warc").save(folder)`` writes one file for each task; a file has its
final name only once the job commits, so a lost executor leaves nothing half-written
among the archives.

``archive`` decides which page of equal payloads is the response and which revisit it,
and writes; ``load`` reads back.  Only ids and digests meet by digest, so a payload that a
third of all pages share (an empty page, say) is no hot spot; rows are told apart by
id, url and digest, not by numbers that change when a task runs again.

Results: a null payload is an empty one.  Of equal payloads of at least ``least`` bytes
the row with the largest id is the response (a null id is the smallest; of several rows with
that id the one with the largest url, of repeated rows one); shorter payloads are all
responses.  An empty table gives an empty folder, which reads as no records.  Further columns
are ignored.  In foreign records header names may have any case, an HTTP head is not part of
the payload, and page_id is null; payload_bytes is measured where no header tells it, and a
file that is no WARC archive is an error that names it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

PARTITION_BYTES = 32 << 20
READ_BYTES = 1 << 18
#: Compressed bytes that are inflated at a time.
PIECE = 1 << 13
LEVEL = 1
CRLF = b"\r\n"

#: Columns of the source; all but the last come from a record's header.
SCHEMA = "record_type string, record_id string, refers_to string, target_uri string, page_id bigint, payload_bytes bigint, payload_digest string, payload binary"
HEADERS = {
    "WARC-Type": "record_type",
    "WARC-Record-ID": "record_id",
    "WARC-Refers-To": "refers_to",
    "WARC-Target-URI": "target_uri",
    "WARC-Page-Id": "page_id",
    "WARC-Payload-Length": "payload_bytes",
    "WARC-Payload-Digest": "payload_digest",
}


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


#: Subfield of the gzip header that holds the length of the whole member.
EXTRA = b"SL"


def record(kind: str, page_id: int | None, uri: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One gzip member; a revisit keeps the length and digest of the payload it leaves out."""
    body = bytes(payload) if kind == "response" and payload is not None else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}"]
    if page_id is not None:
        lines.append(f"WARC-Page-Id: {page_id}")
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(body)}")
    plain = "\r\n".join(lines).encode() + CRLF * 2 + body + CRLF * 2
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    packed = packer.compress(plain) + packer.flush()
    size = 12 + 12 + len(packed) + 8
    head = struct.pack("<BBBBIBBH", 0x1F, 0x8B, 8, 4, 0, 0, 255, 12) + EXTRA + struct.pack("<HQ", 8, size)
    return head + packed + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


class _Members:
    """Walks over the gzip members of a file; holds no more than a piece of it and one record."""

    def __init__(self, file):
        self.file, self.held, self.at = file, b"", 0  # what is held stands at this place of the file

    def _bytes(self, place: int, n: int) -> bytes:
        """``n`` bytes from ``place`` on, or all there are."""
        if not self.at <= place <= place + n <= self.at + len(self.held):
            kept = self.held[place - self.at :] if self.at <= place <= self.at + len(self.held) else b""
            self.file.seek(place + len(kept))
            self.held, self.at = kept + self.file.read(max(READ_BYTES, n - len(kept))), place
        return self.held[place - self.at : place - self.at + n]

    def __iter__(self) -> Iterator[tuple[bytes, Callable[[], bytes]]]:
        self.begin = 0
        while start := self._bytes(self.begin, 24):
            self.length = None
            if len(start) == 24 and start[3] & 4 and start[12:14] == EXTRA:
                self.length = struct.unpack("<Q", start[16:24])[0]
            self.used, self.out = 0, b""
            self.unpacker = zlib.decompressobj(31)
            while CRLF * 2 not in self.out:
                self.out += self._inflate(4096)
            head, _, self.out = self.out.partition(CRLF * 2)
            yield head, self._body
            if self.length is None:
                while not self.unpacker.eof:
                    self._inflate(READ_BYTES)
                self.length = self.used - len(self.unpacker.unused_data)
            self.begin += self.length

    def _inflate(self, most: int) -> bytes:
        """The next bytes of the member, ``most`` at most."""
        if self.unpacker.eof:
            raise ValueError("a record has no header block")
        source = self.unpacker.unconsumed_tail
        if not source:
            left = PIECE if self.length is None else min(PIECE, self.length - self.used)
            source = self._bytes(self.begin + self.used, left)
            if not source:
                raise ValueError("a record ends before its payload does")
            self.used += len(source)
        return self.unpacker.decompress(source, most)

    def _body(self) -> bytes:
        parts = [self.out]
        while not self.unpacker.eof:
            parts.append(self._inflate(READ_BYTES))
        return b"".join(parts)


def parse_head(head: bytes) -> dict:
    """The columns of a header block, and content_length and http, whether an HTTP head precedes the payload."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    named = {name.strip().lower(): value.strip() for name, colon, value in (line.partition(":") for line in lines[1:]) if colon}
    out: dict = {column: named.get(name.lower()) for name, column in HEADERS.items()}
    out["content_length"] = int(named.get("content-length", 0))
    out["http"] = named.get("content-type", "").lower().startswith("application/http")
    for column in ("page_id", "payload_bytes"):
        out[column] = int(out[column]) if out[column] is not None and out[column].lstrip("-").isdigit() else None
    if out["payload_digest"]:
        out["payload_digest"] = out["payload_digest"].removeprefix("sha1:")
    return out


def payload_of(fields: dict, body: bytes) -> bytes:
    """The payload of a record's block: without the HTTP head, if there is one."""
    rest = body[fields["content_length"] :]
    if len(body) < fields["content_length"] or rest.strip(CRLF):
        raise ValueError("a record's block is not as long as its header says")
    block = body[: fields["content_length"]]
    return block.partition(CRLF * 2)[2] if fields["http"] else block


class _Files(InputPartition):
    def __init__(self):
        super().__init__(0)
        self.paths: list[str] = []


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.columns, self.types = path, schema.names, schema
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the name is Spark's
        """Takes equality, membership and not-null tests of header columns; Spark keeps the rest."""
        told = {*HEADERS.values()} - {"payload_bytes"}  # foreign headers don't tell that one
        for f in filters:
            if isinstance(f, EqualTo | In | IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in told:
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[_Files]:
        system, path = pafs.FileSystem.from_uri(self.path)
        found = sorted((f.path, f.size) for f in system.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".warc.gz"))
        out, size = [], PARTITION_BYTES
        for name, n in found:
            if size + n > PARTITION_BYTES:
                out.append(_Files())
                size = 0
            out[-1].paths.append(name)
            size += n
        return out or [_Files()]

    def passes(self, head: dict) -> bool:
        for f in self.tests:
            value = head[f.attribute[0]]
            if value is None or isinstance(f, EqualTo) and value != f.value or isinstance(f, In) and value not in f.value:
                return False
        return True

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = pafs.FileSystem.from_uri(self.path)
        schema = to_arrow_schema(self.types)
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                try:
                    for head, body in _Members(file):
                        fields = parse_head(head)
                        if not self.passes(fields):
                            continue
                        if "payload" in self.columns or "payload_bytes" in self.columns and fields["payload_bytes"] is None:
                            payload = payload_of(fields, body()) if fields["record_type"] != "revisit" else None
                            fields["payload"] = payload
                            if fields["payload_bytes"] is None:
                                fields["payload_bytes"] = len(payload or b"")
                            size += fields["content_length"]
                        rows.append([fields[c] for c in self.columns])
                        if len(rows) >= 1000 or size > 4 << 20:
                            yield self._batch(rows, schema)
                            rows, size = [], 0
                except (ValueError, zlib.error) as e:
                    raise ValueError(f"{path}: {e}") from e
        if rows:
            yield self._batch(rows, schema)

    @staticmethod
    def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class _Written(WriterCommitMessage):
    """What a task has written, if it had rows."""

    temporary: str = ""
    final: str = ""


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> _Written:
        system, path = pafs.FileSystem.from_uri(self.path)
        name = uuid.uuid4().hex
        message = _Written(f"{path}/.{name}.part", f"{path}/{name}.warc.gz")
        stream = None
        for row in iterator:
            if stream is None:
                system.create_dir(path)
                stream = system.open_output_stream(message.temporary, compression=None)
            stream.write(record(row.kind, row.page_id, row.uri, row.payload, row.size, row.digest, row.refers_to))
        if stream is None:
            return _Written()
        stream.close()
        return message

    def commit(self, messages: list[_Written | None]) -> None:
        system, path = pafs.FileSystem.from_uri(self.path)
        system.create_dir(path)
        for m in messages:
            if m is not None and m.final:
                system.move(m.temporary, m.final)

    def abort(self, messages: list[_Written | None]) -> None:
        system, _ = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.final:
                system.delete_file(m.temporary)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the source known, and predicates reach it: the session's setting stays on, as plans are made later."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def revisits(pages: DataFrame, *, id_col: str, payload_col: str, url_col: str, least: int) -> DataFrame:
    """kind, page_id, uri, payload, size, digest and refers_to of each record: what the writer takes.

    Payloads are dealt out by id, url and digest, repeated rows combined before; by digest alone
    there meet only ids and urls.
    """
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    page_id, uri = F.col(id_col).cast("long"), F.col(url_col)
    # keys without nulls, which join as they group
    own = {"has_id": page_id.isNotNull(), "id": F.coalesce(page_id, F.lit(0)), "has_uri": uri.isNotNull(), "u": F.coalesce(uri, F.lit(""))}
    rows = pages.select(*[c.alias(name) for name, c in own.items()], F.unhex(F.sha1(payload)).alias("sha"), F.length(payload).cast("long").alias("size"), payload.alias("payload"))
    key = ["sha", "size", *own]
    with_payload = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.first("payload").alias("payload"))
    keys = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    first = keys.where(F.col("size") >= least).groupBy("sha", "size").agg(F.max(F.struct(*own)).alias("first"))
    winners = first.select("sha", "size", "first.*", F.lit(True).alias("won"))
    responses = with_payload.join(winners, key, "left").where(F.col("won") | (F.col("size") < least))
    copies = lambda n: F.explode(F.sequence(F.lit(1), n))
    responses = responses.withColumn("copy", copies(F.when(F.col("won"), F.lit(1).cast("long")).otherwise(F.col("n")))).withColumn("kind", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long"))
    is_first = F.struct(*own) == F.col("first")
    again = keys.join(first, ["sha", "size"]).withColumn("left", F.col("n") - is_first.cast("int")).where("left > 0")
    again = again.withColumn("copy", copies(F.col("left"))).withColumn("kind", F.lit("revisit")).withColumn("payload", F.lit(None).cast("binary"))
    again = again.withColumn("refers_to", F.when(F.col("first.has_id"), F.col("first.id")))
    columns = ["kind", F.when(F.col("has_id"), F.col("id")).alias("page_id"), F.when(F.col("has_uri"), F.col("u")).alias("uri"), "payload", "size", _base32(F.lower(F.hex("sha"))).alias("digest"), "refers_to"]
    return responses.select(*columns).unionByName(again.select(*columns))


def archive(pages: DataFrame, folder: str, *, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least: int = 0) -> None:
    """Writes a record for each row of ``pages`` below ``folder``, a URI all machines share."""
    register(pages.sparkSession)
    revisits(pages, id_col=id_col, payload_col=payload_col, url_col=url_col, least=least).write.format("warc").mode("append").save(folder)


def load(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """The records below ``folder``; without ``payload`` among the columns no payload written here is inflated."""
    register(spark)
    kinds = dict(x.split() for x in SCHEMA.split(", "))
    chosen = ", ".join(f"{c} {kinds[c]}" for c in columns or kinds)
    return spark.read.format("warc").schema(chosen).load(folder)


def _base32(hex_digits):
    """40 hex digits in upper-case base32: five of them are four, so there is no padding."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lpad(F.conv(F.substring(hex_digits, i * 5 + 1, F.lit(5)), 16, 32), 4, "0"))
    return F.translate(F.array_join(groups, ""), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(payload):
    """The bare upper-case base32 SHA-1 of a binary column."""
    return _base32(F.sha1(payload))


def referred_page(refers_to):
    """The page id inside a record id, as a column."""
    return F.regexp_extract(refers_to, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
