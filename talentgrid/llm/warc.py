"""A deterministic, sharded WARC writer and its reader.

Records are range-sorted by id into shards whose bounds are exact order statistics, so they depend on
the rows alone. Each shard is written by one task: every record is a gzip member of its own, headers
and digests are made anew, and a file is closed when its compressed size reaches a bound. A task
writes under a temporary name and renames; what counts is the manifest, which is itself renamed into
place when all shards are done. A task that runs twice writes the same bytes under the same names.

Of records with equal payloads the one with the smallest id is a response and the others are
revisits that refer to it. Null payloads are empty; rows with the same smallest id are all
responses; rows without an id are sorted first and refer to the smallest id of their payload, if any.
Payloads smaller than ``smallest`` bytes are never revisited. Folders are URIs that pyarrow opens.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentgrid.llm.common import discard, scratch, stored

#: Compressed bytes at which a file is closed, and payload bytes that a shard holds on average.
FILE_BYTES = 32 << 20
SHARD_BYTES = 24 << 20
#: The date in every header; a fixed value, so that the same rows give the same bytes.
DATE = "2024-01-01T00:00:00Z"
NAMES = uuid.UUID("6f0c2c1e-7f5c-4c3e-9a55-3d7c0c6f1b11")
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(page_id: int | None, digest: str, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id} {digest} {url if page_id is None else ""}')}>"


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member (without a time stamp)."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A response, or a revisit of page ``first`` if that is given. Both carry the full payload's length and digest."""
    digest = base32_sha1(payload)
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    http = HTTP.format(len(payload)).encode()
    block = http if first is not None else http + payload
    headers = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest, url)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if first is not None:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(first, digest, "")),
            ("X-Refers-To-Page-Id", str(first)),
        ]
    return member(headers, block)


def information(name: str) -> bytes:
    body = f"software: talentgrid\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
    return member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMES, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], body)


class Shard:
    """Writes the files of one shard, one after the other."""

    def __init__(self, folder: str, shard: int, most: int):
        self.fs, self.folder = pa.fs.FileSystem.from_uri(folder)
        self.shard, self.most, self.done, self.out = shard, most, [], None

    def _open(self) -> None:
        self.name = f"part-{self.shard:06d}-{len(self.done):04d}.warc.gz"
        self.temporary = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.sha, self.size, self.records = hashlib.sha256(), 0, 0
        self._put(information(self.name))

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.sha.update(raw)
        self.size += len(raw)

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self._open()
        self._put(raw)
        self.records += 1
        if self.size >= self.most:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.folder}/{self.name}")
            self.done.append((self.name, self.shard, self.records, self.size, self.sha.hexdigest()))
            self.out = None


def bounds(pages: DataFrame, key: str, rows: int) -> np.ndarray:
    """Every ``rows``-th id in order: the first ids of all shards but the first."""
    ids = stored(pages.select(F.col(key).alias("id")).where("id is not null").orderBy("id").withColumn("at", F.monotonically_increasing_id()), "ids")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = ids.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row for each partition
    begin, total = {}, 0
    for r in counts:
        begin[r["part"]] = total
        total += r["count"]
    if not begin:
        return np.zeros(0, np.int64)
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in begin.items() for x in kv]), part)
    got = ids.where((start + place) % rows == 0).select("id").distinct().orderBy("id").toArrow()  # one row for each shard
    discard(ids)
    return got.column("id").to_numpy()[1:].astype(np.int64)


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", smallest: int = 0, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all rows below ``folder`` and return the manifest: file, shard, records, n_bytes, sha256."""
    spark = pages.sparkSession
    folder = folder if "://" in folder else f"file://{folder}"
    fs, place = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(place)
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    brief = rows.select("id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("n"))
    size = brief.agg(F.sum(F.lit(1)).alias("rows"), F.sum("n").alias("bytes")).first()
    each = max(1, int((size["rows"] or 0) * shard_bytes // max(1, (size["bytes"] or 0))))
    starts = spark.sparkContext.broadcast(bounds(rows.withColumnRenamed("id", key), key, each))
    same = brief.where(F.col("n") >= smallest).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").select("sha", "first")
    known = brief.where(F.col("n") >= smallest).select("sha", "id").join(same, "sha").where("id is null or id <> first")
    # what a record refers to travels as a row of its own just before it, so that payloads are shuffled once
    marks = known.select("id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "sha", "first").distinct()
    both = rows.withColumn("sha", F.sha1("payload")).withColumn("first", F.lit(None).cast("long")).select("id", "url", "payload", "sha", "first").unionByName(marks)

    @F.pandas_udf("int")
    def shard_of(ids):
        return ids.map(lambda x: 0 if x is None or x != x else int(np.searchsorted(starts.value, int(x), side="right"))).astype("int32")

    shards = len(starts.value) + 1
    dealt = both.withColumn("shard", shard_of(F.col("id"))).repartitionByRange(shards, "shard").sortWithinPartitions("shard", F.asc_nulls_first("id"), "sha", F.desc_nulls_last("first"), "url")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done, mark = None, [], (None, None, None)
        for batch in batches:
            for i, link, raw, sha, first, shard in zip(*(batch.column(c) for c in ("id", "url", "payload", "sha", "first", "shard"))):
                if first.is_valid:
                    mark = (i.as_py(), sha.as_py(), first.as_py())
                    continue
                if own is None or own.shard != shard.as_py():
                    if own is not None:
                        own.close()
                        done += own.done
                    own = Shard(folder, shard.as_py(), file_bytes)
                own.add(record(i.as_py(), link.as_py(), raw.as_py(), mark[2] if mark[:2] == (i.as_py(), sha.as_py()) else None))
        if own is not None:
            own.close()
            done += own.done
        cols = list(zip(*done)) or [(), (), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], ["file", "shard", "records", "n_bytes", "sha256"])

    manifest = dealt.select("id", "url", "payload", "sha", "first", "shard").mapInArrow(put, "file string, shard int, records long, n_bytes long, sha256 string")
    manifest.write.mode("overwrite").parquet(f"{folder}/_manifest.tmp")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    path = spark._jvm.org.apache.hadoop.fs.Path
    hadoop.delete(path(f"{folder}/_manifest"), True)
    if not hadoop.rename(path(f"{folder}/_manifest.tmp"), path(f"{folder}/_manifest")):
        raise OSError(f"{folder}: the manifest could not be renamed into place")
    return manifest_of(spark, folder)


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/_manifest")


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an open archive; holds one record at a time."""
    z, rest = None, b""
    buffer = bytearray()
    while True:
        raw = rest or stream.read(1 << 18)
        if not raw:
            break
        z = z or zlib.decompressobj(31)
        buffer += z.decompress(raw)
        rest = z.unused_data
        if z.eof:
            head, _, block = bytes(buffer).partition(b"\r\n\r\n")
            lines = head.decode("utf-8").split("\r\n")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            n = int(headers["Content-Length"])
            if lines[0] != "WARC/1.1" or block[n:] != b"\r\n\r\n":
                raise ValueError("a record is damaged")
            yield headers, block[:n]
            z, buffer = None, bytearray()
    if buffer:
        raise ValueError("an archive ends inside a record")


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row for each response and revisit of the files in the manifest: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url, digest_ok (a response's payload has its digest), and the payload if asked for (null for revisits)."""
    folder = folder if "://" in folder else f"file://{folder}"
    files = manifest_of(spark, folder).select("file")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "digest_ok"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()] + [pa.binary()] * with_payload

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = pa.fs.FileSystem.from_uri(folder)
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{place}/{name}", compression=None) as f:
                    for h, block in records_of(f):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2] if h["WARC-Type"] == "response" else None
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        ok = payload is None or base32_sha1(payload) == digest and len(payload) == int(h["X-Payload-Length"])
                        rows.append((number(h.get("X-Page-Id")), int(h["X-Payload-Length"]), digest, h["WARC-Type"], number(h.get("X-Refers-To-Page-Id")), h["WARC-Target-URI"], ok, payload)[: len(names)])
                        if len(rows) >= 2000 or with_payload and len(rows) >= 100:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, digest_ok boolean" + ", payload binary" * with_payload
    n = max(1, files.count())
    return files.repartition(min(n, 10_000)).mapInArrow(get, schema)


def folder(spark: SparkSession) -> str:
    """A fresh folder that the cluster shares."""
    path = scratch(spark, "warc")
    return path if "://" in path else f"file://{path}"
