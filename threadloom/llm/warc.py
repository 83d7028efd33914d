"""WARC archives compressed record by record with a shared Zstandard dictionary.

``write`` makes one or more archives per task. A dictionary is built from the first
records of an archive and stands in a skippable frame at its start; every record
is a frame of its own, so it can be read alone. ``read`` gives the records back.

Records with equal payloads of at least ``LEAST_REVISIT`` bytes are stored once, by the
page with the largest id; the others are revisits that name it and keep length
and digest of the full payload in their headers.

A task writes under a name of its own attempt, and the manifest that ``write`` returns
lists the archives of those attempts that Spark kept: after lost executors or
repeated tasks nothing is read twice. Archives lie in a folder that all executors
share, by default below spark.checkpoint.dir.

Cases: null payloads are empty; a null url has no target header; null ids are
allowed (such a page never holds the payload for others unless all copies have
null ids, which then all hold it); pages repeated with the largest id are all
responses; repeated rows, and pages with null ids, share one WARC-Record-ID; an empty
table gives no archive; only id, url and payload are read.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.batches import map_batches
from threadloom.session import cut_lineage, ensure_checkpoint_dir

LEAST_REVISIT = 1000
#: Bytes of records kept back to build the dictionary from, and its size.
SAMPLE_BYTES, DICTIONARY_BYTES = 4 << 20, 64 << 10
#: Bytes of records after which a new archive begins.
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
SALTS = 16
#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, keeper: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit has the HTTP headers of the full response and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if revisit:
        head += [f"WARC-Profile: {IDENTICAL_PAYLOAD}", f"WARC-Refers-To: {record_id(keeper)}", f"X-Refers-To-Page-ID: {keeper}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def file_system(uri: str):
    """The file system of a shared folder, and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}")


class Archive:
    """One archive being written. Records wait until the dictionary can be built."""

    def __init__(self, fs, path: str):
        self.out, self.path = fs.open_output_stream(path, compression=None), path
        self.waiting: list[bytes] = []
        self.bytes = self.records = 0
        self.compressor = None

    def add(self, data: bytes) -> None:
        self.bytes += len(data)
        self.records += 1
        if self.compressor:
            self.out.write(self.compressor.compress(data))
        else:
            self.waiting.append(data)
            if self.bytes >= SAMPLE_BYTES:
                self.start()

    def start(self) -> None:
        import zstandard

        try:
            words = zstandard.train_dictionary(DICTIONARY_BYTES, self.waiting)
        except zstandard.ZstdError:  # too little to learn from: the first bytes themselves
            words = zstandard.ZstdCompressionDict(b"".join(self.waiting)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(words)) + words.as_bytes())
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=words)
        for data in self.waiting:
            self.out.write(self.compressor.compress(data))
        self.waiting = []

    def close(self) -> tuple[str, int]:
        if not self.compressor:
            self.start()
        self.out.close()
        return self.path, self.records


def decided(pages: DataFrame, page_id: str, url: str, payload: str) -> DataFrame:
    """(page_id, url, payload, digest, keeper, revisit) for every page."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= LEAST_REVISIT)
    kept = large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    kept = cut_lineage(kept.select("digest", "keeper")).select("digest", "keeper", salts)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    told = salted.join(kept, ["digest", "salt"], "left")
    return told.select("page_id", "url", "payload", "digest", "keeper", (F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))).alias("revisit"))


def write(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write archives; the manifest (path, records) of what was written."""
    if folder is None:
        ensure_checkpoint_dir(pages.sparkSession)
        folder = f"{pages.sparkSession.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = file_system(folder)
        fs.create_dir(place, recursive=True)
        archive, done, name = None, [], uuid.uuid4().hex
        for batch in source:
            columns = (batch.column(c) for c in ("page_id", "url", "payload", "digest", "keeper", "revisit"))
            for row in zip(*columns):
                page, link, text, digest, keeper, revisit = (x.as_py() for x in row)
                if archive and archive.bytes >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
                archive = archive or Archive(fs, f"{place}/{name}-{len(done):05d}.warc.zst")
                archive.add(record(page, link, text.encode(), digest, keeper, revisit))
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    written = map_batches(decided(pages, page_id, url, payload), run, "path string, records long")
    return cut_lineage(written).withColumn("folder", F.lit(folder))


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an open archive."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame at the start")
    words = zstandard.ZstdCompressionDict(stream.read(size))
    with zstandard.ZstdDecompressor(dict_data=words).stream_reader(stream, read_across_frames=True) as plain:
        held = b""

        def take(n: int) -> bytes:
            nonlocal held
            parts, missing = [held], n - len(held)
            while missing > 0:
                data = plain.read(max(missing, 1 << 16))
                if not data:
                    raise EOFError("a record is cut off")
                parts.append(data)
                missing -= len(data)
            whole = b"".join(parts)
            held = whole[n:]
            return whole[:n]

        while True:
            while b"\r\n\r\n" not in held:
                data = plain.read(1 << 16)
                if not data:
                    if held:
                        raise EOFError("a record is cut off")
                    return
                held += data
            lines = take(held.index(b"\r\n\r\n") + 4).decode().split("\r\n")
            head = dict(line.split(": ", 1) for line in lines[1:] if line)
            block = take(int(head["Content-Length"]) + 4)
            yield head, block[:-4]


def read(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of all archives of a manifest.

    The digest of a response is made anew from its payload and must be that of
    its header. Revisits have no payload.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in source:
            for path, count, folder in zip(*(batch.column(c).to_pylist() for c in ("path", "records", "folder"))):
                fs, _ = file_system(folder)
                rows, size, seen = [], 0, 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for head, block in records(stream):
                        http, _, body = block.partition(b"\r\n\r\n")
                        length = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
                        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        kind = head["WARC-Type"]
                        if kind == "response" and (len(body) != length or sha1(body).hexdigest() != digest):
                            raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                        whole = lambda name: int(head[name]) if name in head else None  # noqa: E731, B023
                        rows.append((whole("X-Page-ID"), length, digest, kind, whole("X-Refers-To-Page-ID"), head.get("WARC-Target-URI"), body if kind == "response" else None))
                        size, seen = size + len(body), seen + 1
                        if size >= 8 << 20 or len(rows) >= 5000:
                            yield batch_of(rows)
                            rows, size = [], 0
                if seen != count:
                    raise ValueError(f"{path} has {seen} records in place of {count}")
                if rows:
                    yield batch_of(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    # With a number given, Spark does not put the few small rows together in one task.
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(manifest.repartition(tasks, "path"), run, schema)
