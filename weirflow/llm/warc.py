"""Zstandard WARC archives: writer and reader.

An archive begins with a skippable frame that holds a dictionary, then has one
frame per record. Archives are written to the shared folder by the tasks that hold
the pages, under names that no other attempt uses; the manifest that the write
returns names the archives that count, so a lost or repeated task leaves at most
a file that nobody reads. The reader streams an archive frame by frame.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import arrow_schema, cut, map_arrow, read, shared_path

#: Fixed by the archive format: magic number of the frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
#: Fixed by the query's contract: smaller payloads are never revisits.
MIN_SHARED = 100
ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES, SAMPLE_BYTES = 32 << 10, 1 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def plan_records(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): ``refers_to`` is null for responses.

    Of equal payloads of at least ``min_shared`` bytes the smallest page_id is the
    response. Repeated rows of that page are all responses; rows with a null
    page_id refer to it like others, and are responses where no id is known. A
    null html is an empty payload. Other columns are left out.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    shared = (
        rows.where(F.length("payload") >= min_shared)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select("digest", "first")
    )
    # Cut, so that both sides of the join are dealt anew and a payload with very many pages can be split.
    rows = rows.join(cut(shared), "digest", "left")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return rows.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record. A revisit keeps the response's HTTP header but not its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _name(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """page_id, payload length, digest, type, refers_to and the payload (None for revisits); raises ValueError where anything is wrong."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("record header does not end")
    version, *lines = raw[:end].decode("utf-8").split("\r\n")
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    fields = _fields(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"{name} is missing")
    size = _number(fields["content-length"])
    block = raw[end + 4 : end + 4 + size]
    if len(block) != size or raw[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {size} does not match the block")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        raise ValueError(f"unexpected type {kind!r}")
    digest = fields.get("warc-payload-digest", "")
    if not digest.startswith("sha256:"):
        raise ValueError("no sha256 payload digest")
    split = block.find(b"\r\n\r\n")
    if split < 0:
        raise ValueError("HTTP header does not end")
    status, *http = block[:split].decode("latin-1").split("\r\n")
    length = _number(_fields(http).get("content-length", ""))
    if not status.startswith("HTTP/"):
        raise ValueError("block is no HTTP response")
    payload = block[split + 4 :]
    page = _page(fields["warc-record-id"])
    if kind == "revisit":
        if payload or fields.get("warc-profile") != REVISIT or "warc-refers-to" not in fields:
            raise ValueError("bad revisit record")
        return page, length, digest[7:], kind, _page(fields["warc-refers-to"]), None
    if len(payload) != length:
        raise ValueError(f"HTTP Content-Length {length}, payload {len(payload)}")
    if hashlib.sha256(payload).hexdigest() != digest[7:]:
        raise ValueError("payload does not match its digest")
    return page, length, digest[7:], kind, None, payload


def _fields(lines: list[str]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line[:40]!r}")
        out[name.lower()] = value.strip()
    return out


def _number(value: str) -> int:
    if not (value.isascii() and value.isdigit()):
        raise ValueError(f"bad length {value[:20]!r}")
    return int(value)


def _page(name: str) -> int | None:
    return int(name[10:-1]) if name.startswith("<urn:page:") else None


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on records; where they are too few or too short to train on, their beginnings as raw content."""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples, k=256, d=8)
    except (zstandard.ZstdError, ValueError):
        head = b"".join(raw[: size // max(1, len(samples))] for raw in samples)
        return zstandard.ZstdCompressionDict(head.ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: Iterator[bytes], sample_bytes: int = SAMPLE_BYTES) -> Iterator[bytes]:
    """Frames of one archive: a dictionary made from its first records, then each record."""
    held, size = [], 0
    for raw in records:
        held.append(raw)
        size += len(raw)
        if size >= sample_bytes:
            break
    made = dictionary(held)
    raw = zstandard.ZstdCompressor(level=9).compress(made.as_bytes())
    yield struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
    coder = zstandard.ZstdCompressor(level=3, dict_data=made, write_checksum=True)
    for raw in held:
        yield coder.compress(raw)
    for raw in records:
        yield coder.compress(raw)


def frames(read_some) -> Iterator[bytes]:
    """Records of an archive given by ``read_some()``, which returns its next bytes (none: the end).

    Raises ValueError where the archive does not lead with a dictionary, or a frame
    is cut off or broken.
    """
    data = read_some()
    while len(data) < 8 and (more := read_some()):
        data += more
    if len(data) < 8 or struct.unpack("<I", data[:4])[0] != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    size = struct.unpack("<I", data[4:8])[0]
    while len(data) < 8 + size:
        if not (more := read_some()):
            raise ValueError("the dictionary frame is cut off")
        data += more
    raw, data = data[8 : 8 + size], data[8 + size :]
    try:
        if raw[:4] == struct.pack("<I", ZSTD_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        while data or (data := read_some()):
            frame, parts = coder.decompressobj(), []
            while True:
                parts.append(frame.decompress(data))
                if frame.eof:
                    data = frame.unused_data
                    break
                if not (data := read_some()):
                    raise ValueError("a frame is cut off")
            yield b"".join(parts)
    except zstandard.ZstdError as error:
        raise ValueError(f"a frame is broken: {error}") from error


def write(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives of about ``archive_bytes`` below ``folder``; returns the manifest, computed once."""
    schema = arrow_schema(MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        fs.create_dir(base, recursive=True)
        ended = False
        number = 0
        while not ended:
            written = count = 0

            def some():
                nonlocal ended, count
                while written < archive_bytes:
                    row = next(rows, None)
                    if row is None:
                        ended = True
                        return
                    count += 1
                    yield record(*row)

            name = f"{base}/{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
            number += 1
            with fs.open_output_stream(name + ".part", compression=None) as out:
                for frame in archive(some(), min(SAMPLE_BYTES, archive_bytes)):
                    out.write(frame)
                    written += len(frame)
            if count:
                fs.move(name + ".part", name)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count]), pa.array([written])], schema=schema)
            else:
                fs.delete_file(name + ".part")

    return cut(map_arrow(records, run, MANIFEST))


def read_archives(manifest: DataFrame, folder: str, payload: bool = False, strict: bool = True) -> DataFrame:
    """Read the archives of a manifest, one row per record, and validate each; ``payload`` adds it (null for revisits).

    Anything wrong is an error. If not ``strict``, ``file``, ``number`` (of the
    record in its archive, from 0) and ``error`` are added: a bad record is a row
    with its error and nulls, and reading goes on with the next; where a frame is
    broken, the rest of that archive is one such row.
    """
    ddl = RECORDS + (", payload binary" if payload else "") + ("" if strict else ", file string, number long, error string")
    schema = arrow_schema(ddl)
    width = 6 if payload else 5

    def rows(source, name: str) -> Iterator[tuple[tuple, int]]:
        records, number = frames(lambda: source.read(1 << 20)), 0
        while True:
            try:
                raw = next(records, None)
                if raw is None:
                    return
            except ValueError as error:
                if strict:
                    raise
                yield (*[None] * width, name, number, str(error)), 0
                return
            try:
                got = parse(raw)[:width]
                yield (got if strict else (*got, name, number, None)), len(raw)
            except ValueError as error:
                if strict:
                    raise
                yield (*[None] * width, name, number, str(error)), 0
            number += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(name, compression=None) as source:
                    held, size = [], 0
                    for row, n in rows(source, name):
                        held.append(row)
                        size += n
                        if len(held) >= 5000 or payload and size > 1 << 24:
                            yield _batch(held, schema)
                            held, size = [], 0
                    if held:
                        yield _batch(held, schema)

    return map_arrow(manifest.select("file").repartition(max(1, manifest.rdd.getNumPartitions()), "file"), run, ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    manifest = write(plan_records(read(spark, sf_dir, "pages")), folder)
    found = cut(read_archives(manifest, folder))
    remove(spark, folder)
    return found


#: The same rows straight from the table.
OP4_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest AS payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
