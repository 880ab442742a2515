"""WARC archives: written, normalised to a member per record, indexed and read (operator 3).

A whole-file gzip stream can only be read from its start.  The normaliser inflates such
a stream once, rewrites every record as a gzip member of its own, and writes a sidecar
index of offsets, so that any record is read by one seek.  Bodies pass in portions; no
record is held whole.  Of records with equal payloads the one with the largest page_id
carries it, the others are revisit records that name it.

Cases: a null html is an empty payload; a null url becomes ``urn:page:<id>``; control
characters in a url are percent-encoded; rows that repeat page_id and payload are all
responses or all revisits; a null page_id counts as smaller than any, and rows that have
only null ids are responses; an empty table gives no file and no row; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_side, staged
from .files import new_folder, opened, own_name

REVISIT_BYTES = 1000
PORTION = 1 << 18
ROLL_BYTES = 256 << 20
GZIP = 31  # zlib's window bits for gzip members
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long"


def described(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Pages with payload, its size and digest, and ``refers_to`` where another record carries it.

    Only ids and digests move to find equal payloads; ids of a payload are reduced before
    the shuffle.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"),
    )
    carrying = (
        rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
        .agg(F.max("page_id").alias("carrier"), F.count("*").alias("copies"))
        .where("copies > 1 AND carrier IS NOT NULL").drop("copies")
    )
    joined = rows.join(small_side(carrying), "payload_digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("carrier")) & F.col("carrier").isNotNull(), F.col("carrier"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def _uri(url: str | None, page_id: int | None) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)


def record(page_id, url, payload: bytes, payload_bytes: int, digest: str, refers_to) -> tuple[bytes, bytes]:
    """Header and block of a response or revisit record."""
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n"
    ).encode()
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {_uri(url, page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
        f"Payload-Length: {payload_bytes}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = http if refers_to is not None else http + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n", block


def fields_of(header: bytes) -> dict[str, str]:
    """A record header's fields by lower-case name; raises ValueError on anything else."""
    version, *lines = header.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError(f"no record header: {version[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def write_stream(pages: DataFrame, folder: str | None = None, level: int = 1) -> DataFrame:
    """Described pages as archives that are one gzip stream each; the manifest of the files."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc-stream")
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, part, n = None, TaskContext.get().partitionId(), 0

        def finished() -> pa.RecordBatch:
            sink.write(packer.flush())
            sink.close()
            return pa.record_batch([pa.array([place]), pa.array([n], pa.int64())], ["file", "records"])

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)], strict=True):
                if sink is None:
                    place = own_name(folder, f"part-{part:06d}") + ".warc.gz"
                    out, inner = opened(place)
                    sink, packer, n, raw = out.open_output_stream(inner, compression=None), zlib.compressobj(level, zlib.DEFLATED, GZIP), 0, 0
                header, block = record(*row)
                sink.write(packer.compress(header + block + b"\r\n\r\n"))
                n, raw = n + 1, raw + len(block)
                if raw >= ROLL_BYTES:
                    yield finished()
                    sink = None
        if sink is not None:
            yield finished()

    return staged(pages.mapInArrow(write, MANIFEST))


class _Inflated:
    """The bytes of a gzip file, whatever its members, in portions."""

    def __init__(self, source):
        self.source, self.unpacker, self.held, self.at = source, zlib.decompressobj(GZIP), b"", 0

    def _more(self) -> bool:
        """Append a portion; false at the end of the file."""
        while True:
            raw = self.unpacker.unconsumed_tail
            if not raw:
                if self.unpacker.eof:
                    raw = self.unpacker.unused_data
                    if raw or self.source.tell() < self.source.size():
                        self.unpacker = zlib.decompressobj(GZIP)
                raw = raw or self.source.read(PORTION)
            if not raw:
                if self.unpacker.eof:
                    return False
                got = self.unpacker.decompress(b"", PORTION)  # what it still holds
                if not got and not self.unpacker.eof:
                    raise ValueError("the archive ends within a gzip member")
                self.held, self.at = self.held[self.at :] + got, 0
                return bool(got)
            got = self.unpacker.decompress(raw, PORTION)
            if got:
                self.held, self.at = self.held[self.at :] + got, 0
                return True

    def until(self, mark: bytes) -> bytes:
        """Up to and without ``mark``; empty at the end of the file."""
        look = self.at
        while (found := self.held.find(mark, look)) < 0:
            back = max(0, len(self.held) - self.at - len(mark) + 1)
            if not self._more():
                if self.held[self.at :]:
                    raise ValueError("the archive ends within a record header")
                return b""
            look = back
        out = self.held[self.at : found]
        self.at = found + len(mark)
        return out

    def portions(self, count: int) -> Iterator[bytes]:
        while count:
            if self.at == len(self.held) and not self._more():
                raise ValueError("the archive ends within a record")
            part = self.held[self.at : self.at + count]
            self.at += len(part)
            count -= len(part)
            yield part


def normalise_file(source, sink, level: int = 6) -> Iterator[tuple[int, int, str]]:
    """Rewrite one archive; yields offset, length and record id of each member written."""
    stream, offset = _Inflated(source), 0
    while header := stream.until(b"\r\n\r\n"):
        fields = fields_of(header)
        packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
        length = sink.write(packer.compress(header + b"\r\n\r\n"))
        for part in stream.portions(int(fields["content-length"])):
            length += sink.write(packer.compress(part))
        if b"".join(stream.portions(4)) != b"\r\n\r\n":
            raise ValueError("a record is not closed as it should be")
        length += sink.write(packer.compress(b"\r\n\r\n") + packer.flush())
        yield offset, length, fields["warc-record-id"]
        offset += length


def _by_file(manifest: DataFrame, *columns: str) -> DataFrame:
    """One task per file or so; a count of its own keeps small manifests from being put together."""
    return manifest.select(*columns).repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")


def normalise(manifest: DataFrame, folder: str | None = None, level: int = 6) -> DataFrame:
    """Every archive of the manifest rewritten, with a sidecar index; the new manifest.

    The index is a text file, ``<archive>.idx``: offset, length and record id of each
    record, a line each, tab-separated.
    """
    folder = folder or new_folder(manifest.sparkSession, "warc")
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for old, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place, n = own_name(folder, "records") + ".warc.gz", 0
                from_fs, from_path = opened(old)
                to_fs, to_path = opened(place)
                with (
                    from_fs.open_input_file(from_path) as source, to_fs.open_output_stream(to_path, compression=None) as sink,
                    to_fs.open_output_stream(to_path + ".idx") as index,
                ):
                    for offset, length, name in normalise_file(source, sink, level):
                        index.write(f"{offset}\t{length}\t{name}\n".encode())
                        n += 1
                if n != expected:
                    raise ValueError(f"{old} has {n} records, not {expected}")
                yield pa.record_batch([pa.array([place]), pa.array([n], pa.int64())], ["file", "records"])

    return staged(_by_file(manifest, "file", "records").mapInArrow(rewrite, MANIFEST))


def read_record(source, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """The fields and the block of the record at a place of the index."""
    source.seek(offset)
    whole = zlib.decompress(source.read(length), GZIP)
    header, _, rest = whole.partition(b"\r\n\r\n")
    fields = fields_of(header)
    return fields, rest[: int(fields["content-length"])]


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per record of normalised archives, found by their indexes; digests are checked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in READ.split(", ")]
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for place in batch.column(0).to_pylist():
                fs, path = opened(place)
                held, size = [], 0
                with fs.open_input_file(path) as source, fs.open_input_stream(path + ".idx") as index:
                    for line in index.read().decode().splitlines():
                        offset, length, name = line.split("\t")
                        fields, block = read_record(source, int(offset), int(length))
                        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{name} of {place}: the payload is not the one of its digest")
                        refers = _page(fields["warc-refers-to"]) if kind == "revisit" else None
                        held.append((
                            _page(name), fields["warc-target-uri"], payload if payloads else None,
                            len(payload) if payload is not None else int(fields["payload-length"]), digest, kind, refers,
                        ))
                        size += len(block)
                        if size >= 8 << 20 or len(held) >= 10_000:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                            held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    return _by_file(manifest, "file").mapInArrow(rows, READ)
