"""Deterministic sharded WARC archives, and their reader.

Records are dealt to shards by ranges of page_id and sorted, so that one task
streams one shard to disk, a record at a time. The range bounds come from ids
chosen by their hashes, not from a random sample, and every header is made anew
from the record, so the same pages always give the same files,
byte for byte. A file is closed as soon as its compressed size passes a limit.

Every task attempt writes under a temporary name of its own and renames whole
files; a repeated or speculative attempt replaces a file by its equal. What
belongs to the archive is what its manifest lists, and the manifest appears by
Spark's own commit after all shards are done. The folder may lie on any storage
that pyarrow's file systems and Spark both reach by its address.

Copies of a payload are found by digest in two grouped steps, the first of them
salted, so a payload that a third of all pages share never meets in one task.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trailwarden.llm.common import saved, table
from trailwarden.operators.ranking import with_row_index
from trailwarden.session import new_workdir

MIN_PAYLOAD = 100
SHARD_BYTES = 128 << 20
FILE_BYTES = 32 << 20
#: Ids per shard that its bounds are taken from.
BOUND_IDS = 100
SALTS = 64
#: Format line, profile of revisits, date of all records unless given.
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
LAST_ID = (1 << 63) - 1
READ = (
    "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, "
    "record_id string, file string, offset long"
)
MANIFEST = "file string, shard int, records long, bytes long, sha256 string, first_id long, last_id long"


def payload(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def digests(pages: DataFrame) -> DataFrame:
    """Narrow rows of all pages: _id (the largest number without page_id), _digest, _bytes and a salt."""
    body = payload(F.col("html"))
    key = F.coalesce(F.col("page_id").cast("long"), F.lit(LAST_ID))
    narrow = pages.select(key.alias("_id"), F.unhex(F.sha2(body, 256)).alias("_digest"), F.octet_length(body).cast("long").alias("_bytes"))
    return saved(narrow.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")), "warc-digests")


def copies(narrow: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """_id, _digest, _owner of the pages that revisit another one.

    Of pages whose payloads are equal and long enough the one with the smallest
    page_id is the response, the others revisit it; all shorter payloads are
    responses. Rows that repeat that smallest id are responses, too; rows
    without page_id revisit any page with an id, and are responses where there
    is none.
    """
    long_enough = narrow.where(F.col("_bytes") >= min_payload)
    salted = long_enough.groupBy("_digest", "_salt").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most"))
    owners = salted.groupBy("_digest").agg(F.min("_least").alias("_owner"), F.max("_most").alias("_last"))
    # only payloads with more than one id are looked up again, by (digest, salt)
    shared = saved(salted.join(owners.where("_owner < _last"), "_digest").select("_digest", "_salt", "_owner"), "warc-copies")
    return long_enough.join(shared, ["_digest", "_salt"]).where("_id > _owner").select("_id", "_digest", "_owner").distinct()


def shard_bounds(narrow: DataFrame, shards: int) -> list[int]:
    """Up to ``shards`` - 1 ids that split the pages evenly, from some ``BOUND_IDS`` ids a shard, chosen by hash.

    The ids are sorted and counted off by Spark; one number per shard comes to the driver.
    """
    if shards < 2:
        return []
    part = min(1.0, BOUND_IDS * shards / narrow.count())
    drawn = narrow.where((F.col("_id") < LAST_ID) & (F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(1 << 30)) < int(part * (1 << 30)) + 1))
    placed = with_row_index(drawn.select(F.col("_id").alias("page")).distinct(), "page")
    n = placed.count()
    first = placed.where(f"row_index > 0 AND row_index * {shards} DIV {n} > (row_index - 1) * {shards} DIV {n}")
    return sorted(r["page"] for r in first.select("page").collect())


def shard_of(page_id: Column, bounds: list[int]) -> Column:
    """How many bounds an id has reached, by binary search; rows without id are in the last shard."""
    if not bounds:
        return F.lit(0)
    key = F.coalesce(page_id, F.lit(LAST_ID))
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.lit([1 << k for k in reversed(range(len(bounds).bit_length()))])
    reaches = lambda at: (at <= len(bounds)) & (F.get(held, at - 1) <= key)
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(reaches(low + step), low + step).otherwise(low))


def record_id(page_id: int | None, digest: str) -> str:
    """A name for a record that depends on nothing but its page and payload; rows that repeat both share it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _line(name: str, value: object) -> str:
    """A header line; control characters in a value are percent-encoded."""
    return f"{name}: {''.join(f'%{ord(c):02X}' if c < ' ' or c == chr(127) else c for c in str(value))}\r\n"


def record_bytes(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, body: bytes, date: str = DATE) -> bytes:
    """One record, uncompressed: headers made anew, an HTTP message as block, the body in responses only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http + body if kind == "response" else http
    head = [
        _line("WARC-Type", kind), _line("WARC-Record-ID", record_id(page_id, digest)), _line("WARC-Date", date),
        "" if url is None else _line("WARC-Target-URI", url), "" if page_id is None else _line("X-Page-ID", page_id),
        _line("WARC-Payload-Digest", f"sha256:{digest}"), _line("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if kind == "revisit":
        head += [
            _line("WARC-Profile", REVISIT), _line("WARC-Refers-To", record_id(refers_to, digest)),
            _line("X-Refers-To-Page-ID", refers_to),
        ]
    head += [_line("Content-Type", "application/http; msgtype=response"), _line("Content-Length", len(block))]
    return f"{VERSION}\r\n{''.join(head)}\r\n".encode() + block + b"\r\n\r\n"


def packed(raw: bytes) -> bytes:
    """A record as a gzip member of its own, without time or name."""
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(raw) + press.flush()


def filesystem(uri: str) -> tuple:
    """(file system, path) of a folder, on whatever storage the address names."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1)) if ":/" in uri else (fs.LocalFileSystem(), uri)


class ShardWriter:
    """Files of one shard in order, each under a temporary name until it is whole."""

    def __init__(self, root: str, shard: int, file_bytes: int) -> None:
        self.fs, self.root = filesystem(root)
        self.shard, self.file_bytes, self.number = shard, file_bytes, 0
        self.attempt = uuid.uuid4().hex
        self.out: BinaryIO | None = None

    def add(self, page_id: int | None, member: bytes) -> Iterator[dict]:
        if self.out is None:
            self.fs.create_dir(f"{self.root}/_temporary/{self.attempt}", recursive=True)
            self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.out = self.fs.open_output_stream(f"{self.root}/_temporary/{self.attempt}/{self.name}", compression=None)
            self.row = {"file": self.name, "shard": self.shard, "records": 0, "bytes": 0, "first_id": page_id}
            self.digest = hashlib.sha256()
        self.out.write(member)
        self.digest.update(member)
        self.row["records"] += 1
        self.row["bytes"] += len(member)
        self.row["last_id"] = page_id
        if self.row["bytes"] >= self.file_bytes:
            yield from self.roll()

    def roll(self) -> Iterator[dict]:
        """Close the open file, if any, and give it its name."""
        if self.out is None:
            return
        self.out.close()
        self.fs.move(f"{self.root}/_temporary/{self.attempt}/{self.name}", f"{self.root}/{self.name}")
        self.out, self.number = None, self.number + 1
        yield self.row | {"sha256": self.digest.hexdigest()}

    def end(self) -> Iterator[dict]:
        yield from self.roll()
        if self.number:
            self.fs.delete_dir(f"{self.root}/_temporary/{self.attempt}")


def write_archive(
    pages: DataFrame, root: str | None = None, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES,
    date: str = DATE, min_payload: int = MIN_PAYLOAD,
) -> str:
    """Write pages (page_id, url, html) as gzip WARC files with a manifest; returns the folder.

    The folder is ``root`` or a fresh working folder. A shard holds about
    ``shard_bytes`` of payload, a file about ``file_bytes`` after compression.
    Null html is an empty payload; a null url or page_id leaves its header out.
    Rows without page_id come last; repeated rows are records of their own.
    Other columns are not read. An empty table gives an archive without files.

    What revisits another page is told to the writer by rows of its own, sorted
    just before the page, so payloads are shuffled once and never joined.
    """
    spark = pages.sparkSession
    root = (root or new_workdir(spark, "warc")).rstrip("/")
    narrow = digests(pages)
    size = narrow.agg(F.sum("_bytes")).collect()[0][0] or 0
    bounds = shard_bounds(narrow, -(-size // shard_bytes))
    body = payload(F.col("html"))
    rows = pages.select(
        F.col("page_id").cast("long"), F.sha2(body, 256).alias("payload_digest"), F.lit(True).alias("is_page"),
        F.col("url").cast("string"), F.lit(None).cast("long").alias("refers_to"), body.alias("payload"),
    )
    told = copies(narrow, min_payload).select(
        F.when(F.col("_id") < LAST_ID, F.col("_id")).alias("page_id"), F.lower(F.hex("_digest")).alias("payload_digest"),
        F.lit(False).alias("is_page"), F.lit(None).cast("string").alias("url"), F.col("_owner").alias("refers_to"),
        F.lit(None).cast("binary").alias("payload"),
    )

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done, copy = None, [], (None, None, None)
        for batch in batches:
            bodies = batch.column("payload")
            heads = zip(*(batch.column(c).to_pylist() for c in ("shard", "page_id", "payload_digest", "is_page", "url", "refers_to")))
            for k, (shard, page_id, digest, is_page, url, owner) in enumerate(heads):
                if not is_page:
                    copy = (page_id, digest, owner)
                    continue
                if writer is None or writer.shard != shard:
                    done.extend(writer.end() if writer else ())
                    writer = ShardWriter(root, shard, file_bytes)
                owner = copy[2] if copy[:2] == (page_id, digest) else None
                kind = "response" if owner is None else "revisit"
                done.extend(writer.add(page_id, packed(record_bytes(page_id, url, kind, owner, digest, bodies[k].as_py(), date))))
        done.extend(writer.end() if writer else ())
        yield pa.RecordBatch.from_pylist(done, pa.schema([
            ("file", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()),
            ("sha256", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64())]))

    dealt = rows.unionAll(told).withColumn("shard", shard_of(F.col("page_id"), bounds).cast("int"))
    order = [F.asc_nulls_last("page_id"), "payload_digest", "is_page", F.asc_nulls_last("url")]
    placed = dealt.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", *order)
    placed.mapInArrow(write, MANIFEST).write.parquet(f"{root}/manifest")
    return root


def _members(stream: BinaryIO, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of every gzip member of a file; one member is held at a time."""
    at, held = 0, b""
    while True:
        held = held or stream.read(step)
        if not held:
            return
        press, start, parts = zlib.decompressobj(31), at, []
        while not press.eof:
            held = held or stream.read(step)
            if not held:
                raise ValueError(f"the archive ends inside the record at {start}")
            parts.append(press.decompress(held))
            at, held = at + len(held) - len(press.unused_data), press.unused_data
        yield start, b"".join(parts)


def parse_record(raw: bytes) -> dict:
    """The row behind a record; raises where a length or a digest does not hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    block = rest[:size]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    http, _, body = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    response = fields["WARC-Type"] == "response"
    sound = (
        version == VERSION and rest[size:] == b"\r\n\r\n" and len(block) == size
        and fields["WARC-Block-Digest"] == f"sha256:{hashlib.sha256(block).hexdigest()}"
        and (not response or len(body) == length and hashlib.sha256(body).hexdigest() == digest)
    )
    if not sound:
        raise ValueError(f"record {fields.get('WARC-Record-ID')} is damaged")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-ID"), "payload_digest": digest, "payload_bytes": length,
        "payload": body if response else None, "record_id": fields["WARC-Record-ID"],
    }


def read_archive(spark: SparkSession, root: str, with_payload: bool = True) -> DataFrame:
    """The records of all files in the manifest, a row each; digests are checked on the way.

    payload_bytes and payload_digest are those of the full payload, in revisits
    as well; the payload itself is there in responses only. Control characters
    in a url come back percent-encoded.
    """
    schema = pa.schema([
        (f.name, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()])
        for f in StructType.fromDDL(READ).fields])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(root)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for offset, raw in _members(stream):
                        row = parse_record(raw) | {"file": name, "offset": offset}
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(raw)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").select("file")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(spread, "file").mapInArrow(read, READ)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = write_archive(table(spark, sf_dir, "pages"))
    return read_archive(spark, root, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), o AS (
  SELECT payload_digest, min(page_id) AS owner FROM p WHERE payload_bytes >= {MIN_PAYLOAD} GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN owner < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN owner < page_id THEN owner END AS refers_to
FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest
"""
