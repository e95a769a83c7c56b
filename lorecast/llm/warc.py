"""WARC archives compressed record by record with a Zstandard dictionary that leads each archive.

An archive is a sequence of Zstandard frames. The first is a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself a Zstandard frame; each further frame is one WARC record, compressed on its own with that
dictionary, so that any record can be read by its offset.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, new_path, ship

SKIPPABLE_MAGIC = 0x184D2A5D
#: Payloads of fewer bytes are always written out.
REVISIT_BYTES = 1000
#: Records of an archive that its dictionary is built from: evenly spread ones, of about so many bytes together.
DICTIONARY_SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
#: Payload bytes after which a new archive is begun.
ARCHIVE_BYTES = 32 << 20
LEVEL = 3


def payload_digest(payload: bytes) -> str:
    """Bare lower-case hex SHA-1."""
    return hashlib.sha1(payload).hexdigest()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit that ends after the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}:{kind}")
    response = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{refers_to}:{digest}:response")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{response}>", f"X-Refers-To-Page-ID: {refers_to}"]
    block = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record; the payload's digest and length are taken from the payload where there is one."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError("a payload does not match its digest")
    whole = lambda x: int(x) if x not in (None, "") else None
    return {"page_id": whole(fields["X-Page-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": whole(fields.get("X-Refers-To-Page-ID")), "payload": payload}


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the raw bytes of the records where they are too few or too short to train on."""
    step = max(1, -(-sum(min(len(r), 131_072) for r in records) // DICTIONARY_SAMPLE_BYTES))
    sample = [r[:131_072] for r in records[::step]]  # what a dictionary can refer to; the records themselves stay whole
    total = sum(map(len, sample))
    try:
        if len(sample) >= 8:
            return zstandard.train_dictionary(min(size, max(1024, total // 10)), sample).as_bytes()
    except zstandard.ZstdError:
        pass
    return b"".join(sample)[-size:]


def archive_head(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=10).compress(dictionary)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(packed)) + packed


def write_archive(out, records: list[bytes]) -> list[tuple[int, int]]:
    """Write an archive; offset and length of each record's frame."""
    dictionary = build_dictionary(records)
    head = archive_head(dictionary)
    out.write(head)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
    at, frames = len(head), []
    for r in records:
        packed = packer.compress(r)
        out.write(packed)
        frames.append((at, len(packed)))
        at += len(packed)
    return frames


def read_archive(source) -> Iterator[bytes]:
    """Records of an archive in order, one in memory at a time."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    dictionary = zstandard.ZstdDecompressor().decompress(source.read(size))
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    frame, pieces, held = opener.decompressobj(), [], b""
    while True:
        data = held or source.read(1 << 16)
        held = b""
        if not data:
            if pieces:
                raise ValueError("the archive ends within a record")
            return
        pieces.append(frame.decompress(data))
        if frame.eof:
            yield b"".join(pieces)
            held, pieces, frame = frame.unused_data, [], opener.decompressobj()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        task, count, held, size = TaskContext.get(), 0, [], 0

        def flush() -> pa.RecordBatch:
            # a task that runs again writes under another name; only archives that the manifest lists are read
            name = f"{path}/part-{task.partitionId():05d}-{count:03d}-{uuid.uuid4().hex[:12]}.warc.zst"
            with fs.open_output_stream(name, compression=None) as out:
                frames = write_archive(out, held)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([sum(f[1] for f in frames)], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            for page_id, url, html, digest, length, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = b"" if refers_to is not None else (html or "").encode()
                held.append(record_bytes(page_id, url, payload, digest, length, refers_to))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    count, held, size = count + 1, [], 0
        if held:
            yield flush()

    return run


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row into archives under `folder`; the manifest (path, records, bytes), already stored.

    Rows with equal payloads of at least 1000 bytes share one response, that of the largest id; the others become
    revisits of it. Equality is that of SHA-1 and SHA-256 of the payload together. Smaller payloads are always
    responses. The groups are combined on the map side and meet their rows in a join that adaptive execution splits.

    A null html is an empty payload, a null url an empty target. A row with a null id is a response, refers to
    nothing and is referred to by nothing. Rows that repeat an id and payload are responses all, with one record id. An
    empty table gives an empty manifest. Other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    ship(spark)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.select("*", F.sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("length"))
    strong = F.unhex(F.sha2(F.col("html"), 256))
    large = (F.col("length") >= REVISIT_BYTES) & F.col("id").isNotNull()
    groups = rows.where(large).groupBy(strong.alias("k"), F.col("digest").alias("d")).agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    slim = rows.where(large).select(F.col("id").alias("r_id"), strong.alias("r_k"), F.col("digest").alias("r_d"))
    revisits = slim.join(groups, (F.col("r_k") == F.col("k")) & (F.col("r_d") == F.col("d"))).where(F.col("r_id") < F.col("keep")).select("r_id", "r_k", "keep").distinct()
    placed = rows.join(revisits, (F.col("id") == F.col("r_id")) & (F.col("length") >= REVISIT_BYTES) & (strong == F.col("r_k")), "left")
    written = placed.select("id", "url", F.when(F.col("keep").isNull(), F.col("html")).alias("html"), "digest", "length", "keep").mapInArrow(_writer(folder), "path string, records long, bytes long")
    return materialize(written, "warc-manifest")


def read_warc(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """All records of the archives in a manifest: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))

        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                with fs.open_input_stream(path, compression=None) as source:
                    for raw in read_archive(source):
                        held.append(parse_record(raw))
                        size += len(raw)
                        if size >= 8 << 20:
                            yield batch_of(held)
                            held, size = [], 0
                if held:
                    yield batch_of(held)

    ship(spark)
    paths = manifest.select("path")
    return paths.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write archives into the shared folder and read every record back (without payloads)."""
    folder = new_path(pages.sparkSession, "warc")
    manifest = write_warc(pages, folder, **columns)
    return read_warc(pages.sparkSession, manifest, folder).drop("payload", "url")
