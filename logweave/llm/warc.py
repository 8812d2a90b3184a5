"""WARC archives: monolithic gzip streams written by tasks, their normaliser with an offset index, and readers."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import materialise, new_folder

#: Payloads below this size are never revisits.
REVISIT_BYTES = 1000
#: Uncompressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 32 << 20
#: Bytes that are inflated, scanned or read at once.
STEP = 1 << 18
#: Most revisit rows, some 16 bytes each, that are broadcast to the writing pass.
BROADCAST_ROWS = 250_000

_URN = "urn:uuid:"
_SPACE_ID = uuid.UUID("6f1f6c4e-0b5a-4d0e-9a3c-52a0f6a1c7d1")


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<{_URN}{uuid.uuid5(_SPACE_ID, f'{page_id}/{digest}')}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP headers of the full payload without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha1}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        head += [f"X-Refers-To-Page-Id: {refers_to}"] if refers_to is not None else []
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_MANIFEST = "path string, records long, bytes long"


def _write_monolithic(folder: str):
    """Writes the rows of a task as archives that are one gzip stream each; a row per finished file tells its path.

    Names are new for each attempt, so that a repeated or speculative task leaves files that no manifest names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _filesystem(folder)
        where.create_dir(base, recursive=True)
        out = packer = path = None
        records = size = 0

        def close() -> pa.RecordBatch:
            out.write(packer.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
                page_id, url, payload, refers_to, revisit = (x.as_py() for x in row)
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out, packer, records, size = where.open_output_stream(path, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                record = warc_record(page_id, url, payload, hashlib.sha1(payload).hexdigest(), refers_to, revisit)
                out.write(packer.compress(record))
                records, size = records + 1, size + len(record)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (page_id, url, payload binary, refers_to, revisit) and returns the manifest of the files."""
    ordered = rows.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "payload", F.col("refers_to").cast("long"), "revisit")
    return materialise(ordered.mapInArrow(_write_monolithic(folder), _MANIFEST), "warc-manifest")


class RecordStream:
    """Cuts an inflated stream into WARC records, holding one record at most."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self.chunks, self.buf, self.at = chunks, bytearray(), 0

    def _more(self) -> bool:
        if self.at > STEP:
            del self.buf[: self.at]
            self.at = 0
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        self.buf += chunk
        return True

    def __iter__(self) -> Iterator[bytes]:
        while True:
            scanned = self.at
            while (end := self.buf.find(b"\r\n\r\n", scanned)) < 0:
                behind = len(self.buf) - self.at
                if not self._more():
                    if self.buf[self.at :].strip():
                        raise ValueError("the archive ends inside a record's headers")
                    return
                scanned = self.at + max(0, behind - 3)
            length = int(headers(bytes(self.buf[self.at : end]))["content-length"])
            need = end - self.at + 4 + length + 4
            while len(self.buf) - self.at < need:
                if not self._more():
                    raise ValueError("the archive ends inside a record's block")
            yield bytes(self.buf[self.at : self.at + need])
            self.at += need


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def inflate(source, members: bool = True) -> Iterator[bytes]:
    """The inflated bytes of a gzip file in steps, over one member or many."""
    unpack = zlib.decompressobj(31)
    while data := source.read(STEP):
        while data:
            yield unpack.decompress(data, STEP)
            while unpack.unconsumed_tail:
                yield unpack.decompress(unpack.unconsumed_tail, STEP)
            data = unpack.unused_data
            if unpack.eof and data and members:
                unpack = zlib.decompressobj(31)
            elif unpack.eof:
                break
    if not unpack.eof:
        raise ValueError("the gzip stream is cut short")


_INDEX = "path string, offset long, length long, record_id string, record_type string"


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each archive: inflates it once, writes a copy with a gzip member per record and its sidecar index."""
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            where, _ = _filesystem(base)
            target = f"{path[: -len('.warc.gz')]}.{uuid.uuid4().hex[:8]}.members.warc.gz"
            rows: list[tuple[int, int, str, str]] = []
            offset = 0
            with where.open_input_stream(path, compression=None) as source, where.open_output_stream(target, compression=None) as out, where.open_output_stream(f"{target}.idx.jsonl", compression=None) as index:
                for record in RecordStream(inflate(source)):
                    head = headers(record[: record.index(b"\r\n\r\n")])
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(record) + packer.flush()
                    out.write(member)
                    rows.append((offset, len(member), head["warc-record-id"], head["warc-type"]))
                    index.write(json.dumps({"offset": offset, "length": len(member), "id": head["warc-record-id"], "type": head["warc-type"]}).encode() + b"\n")
                    offset += len(member)
                    if len(rows) >= 10_000:
                        yield _index_rows(target, rows)
                        rows = []
            if rows:
                yield _index_rows(target, rows)


def _index_rows(path: str, rows: list[tuple[int, int, str, str]]) -> pa.RecordBatch:
    offsets, lengths, ids, kinds = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids), pa.array(kinds)], names=["path", "offset", "length", "record_id", "record_type"])


def normalise_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive of the manifest with one gzip member per record; returns the offset index as a table.

    An archive is one task's work and is bounded by ARCHIVE_BYTES and one record; it is inflated once, as a stream.
    Beside each new file lies its index as JSON lines. An archive cut short raises an error.
    """
    spread = manifest.select("path", F.lit(folder).alias("folder")).repartition("path")
    return materialise(spread.mapInArrow(_normalise, _INDEX), "warc-index")


_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _read(folder: str, with_payload: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = _filesystem(folder)
        opened = source = None
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if path != opened:
                    if source is not None:
                        source.close()
                    opened, source = path, where.open_input_file(path)
                source.seek(offset)
                row = parse_record(zlib.decompress(source.read(length), 31))
                rows.append(row if with_payload else (*row[:-1], None))
                held += len(rows[-1][-1] or b"")
                if len(rows) >= 2000 or held > (8 << 20):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def parse_record(record: bytes) -> tuple:
    """(page_id, url, payload bytes, SHA-1, type, refers_to, payload) of one record; a response's digest is checked."""
    end = record.index(b"\r\n\r\n")
    head = headers(record[:end])
    block = record[end + 4 : end + 4 + int(head["content-length"])]
    http_end = block.index(b"\r\n\r\n")
    full = int(headers(block[:http_end])["content-length"])
    stated = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    payload = None
    if head["warc-type"] == "response":
        payload = block[http_end + 4 :]
        if len(payload) != full or hashlib.sha1(payload).hexdigest() != stated:
            raise ValueError(f"record {head['warc-record-id']} doesn't hold the payload that it states")
    number = lambda k: int(head[k]) if k in head else None
    return number("x-page-id"), head.get("warc-target-uri"), full, stated, head["warc-type"], number("x-refers-to-page-id"), payload


def read_archives(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Reads every record that the index names by its offset, each as a gzip member of its own."""
    return index.select("path", "offset", "length").mapInArrow(_read(folder, with_payload), _RECORDS)


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload, of REVISIT_BYTES or more, a page with a larger id has too."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = materialise(pages.select("page_id", payload.alias("payload")).where(F.length("payload") >= REVISIT_BYTES).select("page_id", F.sha1("payload").alias("digest"), F.length("payload").alias("size")), "warc-digests")
    shared = keyed.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Read back, so that a payload that very many pages have can be split in the join.
    found = keyed.join(materialise(shared, "warc-shared"), ["digest", "size"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return materialise(found.select("page_id", "digest", "refers_to").distinct(), "warc-revisits")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes a WARC record per page, normalises the archives and reads them back by the offset index.

    Of equal payloads of REVISIT_BYTES or more the page with the largest id is the response and the others refer to
    it; a null html is an empty payload, a null url or page_id leaves its header out. Null ids sort below all
    others; where all equal payloads have null ids, all are responses. Rows that
    repeat an id are written as often. Payloads are never shuffled while the revisit ids are few enough to
    broadcast, else pages are joined to them by page_id. A payload takes memory several times its length, in the
    task that writes or reads its record. Other columns are not read; no pages, no records.
    """
    folder = new_folder(pages.sparkSession, "warc")
    again = revisits(pages).select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "refers_to")
    few = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    payload = F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    same = F.col("page_id").eqNullSafe(F.col("again_id")) & (F.sha1("payload") == F.col("again_digest"))
    joined = pages.select("page_id", "url", payload).join(F.broadcast(again) if few else again, same, "left")
    rows = joined.select("page_id", "url", "payload", "refers_to", F.col("again_digest").isNotNull().alias("revisit"))
    index = normalise_archives(write_archives(rows, folder), folder)
    return read_archives(index, folder)
