"""WARC archives: write web payloads as records, read archives back, and reassemble segmented records.

Writing: of payloads of at least min_bytes that are equal, the one with the largest key becomes a response record and
the others become revisit records that refer to it; smaller payloads are all responses. A response holds an HTTP message
with chunked transfer framing. A block longer than segment_bytes goes out as a first segment and continuation records
with the origin's identifier and a segment number, the last with the total length. Each record is a gzip member of its
own; a task starts a new archive file after archive_bytes. Files carry a random name and count once their task's row in
the manifest is written, so a task that runs again leaves at most a file that nobody reads.

Reading: archives are streamed record by record. Whole records are decoded on the spot; segments are grouped by origin
identifier, ordered by segment number, checked for gaps and for the total length, and then decoded. The group is one
record's block, which is one row of the result whatever is done. Faults are reported per record in `fault`.

As many records come back as rows went in. Null payloads are empty. Null URLs get a urn of the key. Rows with a null key
are responses and refer to nothing. Rows equal in key and payload write equal records, each of which comes back: every
row's records bear a mark of their own, by which segments are grouped, and a revisit finds its response once. Keys are
longs. Empty tables give empty manifests and no records. Columns beyond key, URL and payload are not written. A payload
is held whole in memory, some three times while it is written or put together.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuetide.llm.common import keep_folder, shared_dir, ship, slices, stored

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
ARCHIVE_BYTES = 8 << 20
#: All records bear this date, so that archives of equal rows have equal records.
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs, a fixed value
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base-32 SHA-1 of a binary column: ten hex digits are eight base-32 ones."""
    hexed = F.upper(F.sha1(payload))
    parts = [F.lpad(F.upper(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32)), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{key}/{digest}')}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk's size line does not end")
        size = int(body[at:end].split(b";")[0].strip() or b"-", 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than its size")
        parts.append(body[at : at + size])
        at += size + 2


def payload_in(block: bytes) -> bytes:
    """The decoded body of an HTTP message."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("the HTTP head does not end")
    fields = dict(line.lower().split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
    return dechunked(body) if fields.get(b"transfer-encoding", b"").strip() == b"chunked" else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def _clean(url: str | None, key: int | None) -> str:
    if url is None:
        return f"urn:key:{key}"
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def records_for(key: int | None, url: str | None, payload: bytes, refers: int | None, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The gzip members for one row."""
    digest = digest_of(payload)
    own = record_id(key, digest)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    mark = uuid.uuid4().hex[:16]
    common = [("WARC-Date", DATE), ("WARC-Target-URI", _clean(url, key)), ("Content-Type", "application/http;msgtype=response"), ("X-Source-Key", key), ("X-Source-Row", mark)]
    if refers is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers, digest)), ("WARC-Payload-Digest", f"sha1:{digest}")], head)
        return
    block = head + chunked(payload)
    cut = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha1:{digest}")]
    if len(cut) == 1:
        yield _record(first, block)
        return
    yield _record([*first, ("WARC-Segment-Number", 1)], cut[0])
    for number, part in enumerate(cut[1:], 2):
        last = len(block) if number == len(cut) else None
        name = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{own}/{number}')}>"
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", last), ("X-Source-Row", mark)], part)


def _open_fs(uri: str):
    """(file system, path) of a folder in any store that pyarrow reaches."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


_MANIFEST = T.StructType([T.StructField("file", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])


def revisits(df: DataFrame, key: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """(key, sha, refers): rows whose payload a row with a larger key has too, and that row's key."""
    keyed = df.where(F.col(key).isNotNull() & (F.coalesce(F.octet_length(payload), F.lit(0)) >= min_bytes)).select(F.col(key).alias("key"), F.sha2(F.coalesce(F.col(payload).cast("binary"), F.lit(b"")), 256).alias("sha"))
    shared = stored(keyed.groupBy("sha").agg(F.max("key").alias("refers"), F.min("key").alias("least")).where("least < refers").drop("least"), "warc-shared")
    return keyed.join(shared, "sha").where("key < refers").distinct()


def write_archives(df: DataFrame, key: str, url: str, payload: str, folder: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write df's rows to archives in folder. The stored manifest: file, records, bytes."""
    ship(df.sparkSession)
    again = revisits(df, key, payload, min_bytes).select(F.col("key").alias("_key"), F.col("sha").alias("_sha"), F.col("refers").alias("_refers"))
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.join(again, (F.col("key") == F.col("_key")) & (F.sha2("payload", 256) == F.col("_sha")), "left").select("key", "url", "payload", "_refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open_fs(folder)
        fs.create_dir(path, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, name, count, size = None, "", 0, 0
        for batch in batches:
            for piece in slices(batch, "payload"):
                for row in zip(*(piece.column(c).to_pylist() for c in ("key", "url", "payload", "_refers")), strict=True):
                    if out is None:
                        name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    for record in records_for(*row, segment_bytes=segment_bytes):
                        out.write(record)
                        count, size = count + 1, size + len(record)
                    if size >= archive_bytes:
                        out.close()
                        done.append((name, count, size))
                        out = None
        if out is not None:
            out.close()
            done.append((name, count, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=_MANIFEST.names)

    return stored(rows.mapInArrow(run, _MANIFEST), "warc-manifest")


def _members(stream) -> Iterator[bytes]:
    """The contents of a file's gzip members, one at a time."""
    unpack, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            if parts:
                raise ValueError("the archive ends within a record")
            return
        parts.append(unpack.decompress(data))
        rest = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("this is no WARC record")
    fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:] if ":" in line)}
    size = int(fields.get("content-length", -1))
    if size < 0 or len(rest) < size:
        raise ValueError("the record is shorter than its length")
    return fields, rest[:size]


_PART = T.StructType(
    [
        T.StructField("origin", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("number", T.IntegerType()),
        T.StructField("total", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("key", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("refers_to_record", T.StringType()),
        T.StructField("stated_digest", T.StringType()),
        T.StructField("block", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("fault", T.StringType()),
    ]
)
_ARROW_PART = pa.schema([(n, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t.dataType.simpleString()]) for n, t in zip(_PART.names, _PART.fields, strict=True)])


def _decoded(block: bytes) -> tuple[int | None, str | None, str | None]:
    try:
        payload = payload_in(block)
    except ValueError as error:
        return None, None, str(error)
    return len(payload), digest_of(payload), None


def read_parts(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record of the manifest's files; segments keep their blocks, whole records are decoded."""
    spark = manifest.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open_fs(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for record in _members(stream):
                        f, block = parse_record(record)
                        number = int(f.get("warc-segment-number", 0))
                        kind = f.get("warc-type")
                        size = digest = fault = None
                        if kind == "response" and not number:
                            size, digest, fault = _decoded(block)
                            block = None
                        elif kind == "revisit":
                            block = None
                        key = f.get("x-source-key")
                        total = f.get("warc-segment-total-length")
                        rows.append((f.get("warc-segment-origin-id", f.get("warc-record-id")), f.get("x-source-row", ""), number, total and int(total), kind, key and int(key), f.get("warc-target-uri"), f.get("warc-refers-to"), f.get("warc-payload-digest", "").removeprefix("sha1:") or None, block, size, digest, fault))
                        held += len(block or b"") + 400
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW_PART.types, strict=True)], schema=_ARROW_PART)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW_PART.types, strict=True)], schema=_ARROW_PART)

    files = max(1, manifest.count())
    return manifest.select("file").repartition(min(files, 20_000)).mapInArrow(run, _PART)


_RECORD = T.StructType([f for f in _PART.fields if f.name not in ("number", "total", "block")])


def reassemble(parts: DataFrame) -> DataFrame:
    """One row per record: its fields, payload_bytes and payload_digest of the decoded payload (null for revisits), fault."""
    # Records of other writers bear no mark of a row: then the origin alone tells.
    own = ["origin", "row"]
    head = F.struct(*[f.name for f in _RECORD.fields if f.name not in own])
    pieces = F.collect_list(F.when(F.col("block").isNotNull(), F.struct("number", "block", "total")))
    grouped = parts.groupBy(*own).agg(F.min_by(head, "number").alias("head"), pieces.alias("pieces"), F.coalesce(F.min("number"), F.lit(0)).alias("first"))
    flat = grouped.select(*own, "head.*", F.when(F.size("pieces") > 0, F.array_sort("pieces")).alias("pieces"), "first")
    arrow = pa.schema([(n, _ARROW_PART.field(n).type) for n in _RECORD.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in ("payload_bytes", "payload_digest", "fault")}
            pieces = batch.column("pieces")
            for at in range(batch.num_rows):
                if not pieces[at].is_valid:
                    continue
                own = {p["number"]: p for p in pieces[at].as_py()}
                block = b"".join(own[n]["block"] for n in sorted(own))
                totals = {p["total"] for p in own.values() if p["total"] is not None}
                if sorted(own) != list(range(1, len(own) + 1)) or len(own) < 2 or not totals:
                    found = None, None, "a segment is missing"
                elif totals != {len(block)}:
                    found = None, None, "the segments' length is not the total stated"
                else:
                    found = _decoded(block)
                for name, value in zip(columns, found, strict=True):
                    columns[name][at] = value
            yield pa.RecordBatch.from_arrays([pa.array(columns[n], arrow.field(n).type) if n in columns else batch.column(n) for n in arrow.names], schema=arrow)

    return flat.mapInArrow(run, _RECORD)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(key, url, payload_bytes, payload_digest, record_type, refers_to, fault), revisits resolved through what they refer to."""
    records = stored(reassemble(read_parts(manifest, folder)), "warc-records")
    responses = records.where("type = 'response'").dropDuplicates(["origin"]).select(F.col("origin").alias("_origin"), F.col("key").alias("_to"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    revisiting = records.where("type = 'revisit'").join(responses, F.col("refers_to_record") == F.col("_origin"), "left")
    # Records that refer to nothing stay out of the join, where their null keys would meet in one task.
    others = records.where("type <> 'revisit' or type is null").select("*", *[F.lit(None).cast(responses.schema[c].dataType).alias(c) for c in responses.columns])
    joined = revisiting.unionByName(others)
    lost = (F.col("type") == "revisit") & F.col("_origin").isNull()
    wrong = F.coalesce("payload_digest", "_digest") != F.col("stated_digest")
    return joined.select(
        "key",
        "url",
        F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "_digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("_to").alias("refers_to"),
        F.coalesce("fault", F.when(lost, F.lit("what it refers to is missing")), F.when(wrong, F.lit("the payload's digest is not the one stated"))).alias("fault"),
    )


def archive_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, which session.clear() deletes."""
    return keep_folder(spark, f"{shared_dir(spark)}/cuetide/warc-{uuid.uuid4().hex}")
