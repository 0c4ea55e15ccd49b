"""WARC archives: a deterministic sharded writer, and a reader.

Writing: payload digests alone decide which record of equal payloads is the
response and which revisit it.  Shards are ranges of page_id of about
`shard_bytes` each, cut where the running sum of bytes in the order of the ids
passes a multiple of it, so they depend on the rows and `shard_bytes` only.  Each
shard's rows are sorted and written as gzip members, one a record, with headers
and digests made anew; a file is rolled when its compressed size reaches
`roll_bytes`.  A file is written under a temporary name of its attempt and then
renamed to its shard and number, so that an attempt that is repeated or lost
leaves the same files; so is each shard's own manifest, which names its files.
The manifest of the whole, written last and renamed into place, has the counts;
an archive without it is not complete.

Reading takes the files that the shards' manifests name, one task a shard, and
checks every digest as it streams.

Defined cases: null html is an empty payload; a null url has no target header.
Any long is a page_id.  Of rows that repeat a page_id and payload the first is
the response; all rows of one page_id are in one shard.  Rows without a page_id
come first and never win over one with a page_id; if no row of a payload has
one, each of them is a response.  A very long payload is one
record, behind which its file is rolled.  An empty table gives an archive without files.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm import common as C

#: Payload bytes of a shard, and compressed bytes after which a file is rolled.
SHARD_BYTES = 64 << 20
ROLL_BYTES = 32 << 20
#: Bytes that a record has beside its payload, as the shards count them.
RECORD_BYTES = 700
LEAST_BYTES = 0
#: Digests whose winner is broadcast, at most.
HEAVY = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "MANIFEST.json"
SHARDS = "manifests"


def filesystem(uri: str):
    """The file system of a folder and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, digest: bytes, number: int = 0) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(b'%a %d ' % (page_id, number) + digest).digest()[:16], version=5)}>"


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member without a time."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, number: int, date: str) -> bytes:
    digest = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest, number)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(0x21, 0x7F))))))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("Refers-To-Page-ID", str(refers_to))]
    headers += [
        ("Page-ID", "" if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", f"sha1:{base32(digest)}"),
        ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return member(headers, block)


class ShardWriter:
    """Files of one shard."""

    def __init__(self, folder: str, shard: int, roll_bytes: int, date: str):
        self.fs, self.path = filesystem(folder)
        self.shard, self.roll_bytes, self.date = shard, roll_bytes, date
        self.attempt, self.out, self.files = uuid.uuid4().hex, None, []

    def write(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:07d}-{len(self.files):05d}.warc.gz"
            self.temporary = f"{self.path}/_temporary/{self.attempt}-{self.name}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
            info = b"software: millrace\r\nformat: WARC File Format 1.1\r\n"
            self._put(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name.encode())), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
        self._put(record)
        self.records += 1
        if self.size >= self.roll_bytes:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.path}/{self.name}")
            self.files.append({"shard": self.shard, "file": self.name, "records": self.records, "bytes": self.size, "sha256": self.sha.hexdigest()})
            self.out = None

    def commit(self) -> tuple[int, int]:
        """Close the last file and write the shard's manifest, a line a file; gives the numbers of files and records."""
        self.close()
        name = f"shard-{self.shard:07d}.json"
        put(self.fs, self.path, f"{self.attempt}-{name}", f"{SHARDS}/{name}", "".join(f"{json.dumps(f)}\n" for f in self.files))
        return len(self.files), sum(f["records"] for f in self.files)


def put(fs, path: str, temporary: str, name: str, text: str) -> None:
    """Write a small file under a temporary name and rename it."""
    with fs.open_output_stream(f"{path}/_temporary/{temporary}", compression=None) as out:
        out.write(text.encode())
    fs.move(f"{path}/_temporary/{temporary}", f"{path}/{name}")


def decisions(pages: DataFrame, least_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Digests of all rows, and (page_id, digest, refers_to) of the rows that revisit another page.

    The digests of more than one row in HEAVY, HEAVY at most, are broadcast; the rest meet their rows by a shuffle.
    """
    rows = C.cut(pages.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("n")))
    able = rows.filter(F.col("n") >= least_bytes)
    winners = able.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies"))
    winners = C.cut(winners.filter(F.col("refers_to").isNotNull() & (F.col("copies") > 1)))
    often = F.col("copies") * HEAVY > rows.count()
    heavy = F.broadcast(winners.filter(often).drop("copies"))
    met = able.join(heavy, "digest").unionByName(able.join(heavy, "digest", "left_anti").join(winners.filter(~often).drop("copies"), "digest"))
    return rows, met.filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to")


def shard_ends(rows: DataFrame, shard_bytes: int) -> np.ndarray:
    """The largest page_id of each shard but the last.

    Running sums are made range by range; the driver sees one sum a range, and
    one number for every `shard_bytes` of the input.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy("page_id").agg(F.sum(F.col("n") + RECORD_BYTES).alias("n"))
    ranged = C.cut(sizes.repartitionByRange(C.partitions(spark), F.asc_nulls_first("page_id")).withColumn("part", F.spark_partition_id()))
    totals = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in totals)])
    if before[-1] <= shard_bytes:
        return np.zeros(0, np.int64)
    base = F.broadcast(spark.createDataFrame([(part, int(x)) for (part, _), x in zip(totals, before, strict=False)], "part int, before long"))
    upto = W.partitionBy("part").orderBy(F.asc_nulls_first("page_id")).rowsBetween(W.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("n").over(upto), F.lit(0))
    shard = ranged.join(base, "part").select("page_id", F.floor(start / shard_bytes).alias("shard"))
    ends = shard.groupBy("shard").agg(F.max("page_id").alias("end")).filter(F.col("end").isNotNull()).select("end").toPandas()["end"]
    return np.sort(ends.to_numpy(np.int64))[:-1]


def write(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least_bytes: int = LEAST_BYTES, date: str = DATE) -> dict:
    """Write an archive into a new folder that the driver and all executors reach; gives its counts of shards, files and records."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    fs, path = filesystem(folder)
    fs.create_dir(f"{path}/_temporary", recursive=True)
    fs.create_dir(f"{path}/{SHARDS}")
    if fs.get_file_info(f"{path}/{MANIFEST}").is_file:
        raise FileExistsError(f"{folder} holds an archive")
    rows, revisits = decisions(pages, least_bytes)
    ends = shard_ends(rows, shard_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, page, revisit_of, seen = None, (), {}, {}
        done = []
        for batch in batches:
            for shard, page_id, _, url, html, digest, refers_to in zip(*(c for c in batch.columns), strict=True):
                shard, page_id = shard.as_py(), page_id.as_py()
                if writer is None or writer.shard != shard:
                    if writer is not None:
                        done.append(writer.commit())
                    writer, page = ShardWriter(folder, shard, roll_bytes, date), ()
                if page != (page_id,):
                    page, revisit_of, seen = (page_id,), {}, {}
                if digest.is_valid:  # the page's decisions come before its rows
                    revisit_of[bytes.fromhex(digest.as_py())] = refers_to.as_py()
                    continue
                payload = html.as_py().encode()
                own = hashlib.sha1(payload).digest()
                number = seen[own] = seen.get(own, -1) + 1
                again = number > 0 and page_id is not None and len(payload) >= least_bytes
                writer.write(page_record(page_id, url.as_py(), payload, revisit_of.get(own, page_id), own in revisit_of or again, number, date))
        if writer is not None:
            done.append(writer.commit())
        yield pa.RecordBatch.from_arrays([pa.array([len(done)], pa.int64()), *(pa.array([sum(x[k] for x in done)], pa.int64()) for k in (0, 1))], ["shards", "files", "records"])

    none = F.lit(None).cast("string")
    both = pages.select("page_id", F.lit(1).alias("kind"), "url", "html", none.alias("digest"), F.lit(None).cast("long").alias("refers_to")).unionByName(revisits.select("page_id", F.lit(0).alias("kind"), none.alias("url"), none.alias("html"), "digest", "refers_to"))
    dealt = C.in_ranges(both, "page_id", ends, "shard").select("shard", "page_id", "kind", "url", "html", "digest", "refers_to").repartitionById(len(ends) + 1, "shard").sortWithinPartitions("shard", "page_id", "kind", "url", "html")
    done = dealt.mapInArrow(run, "shards long, files long, records long").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("shards", "files", "records"))).first().asDict()
    put(fs, path, MANIFEST, MANIFEST, json.dumps(done))
    fs.delete_dir(f"{path}/_temporary")
    return done


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a stream of gzip members."""
    waiting, unpacker, raw = b"", zlib.decompressobj(31), []
    while True:
        waiting = waiting or stream.read(1 << 20)
        if not waiting:
            if raw:
                raise ValueError("the file ends within a record")
            return
        raw.append(unpacker.decompress(waiting))
        waiting = unpacker.unused_data
        if unpacker.eof:
            head, _, rest = b"".join(raw).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if not lines[0].startswith("WARC/1."):
                raise ValueError(f"not a record: {lines[0][:40]}")
            headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            size = int(headers["Content-Length"])
            if len(rest) != size + 4:
                raise ValueError(f"a record of {size} bytes has {len(rest) - 4}")
            yield headers, rest[:size]
            unpacker, raw = zlib.decompressobj(31), []


def manifest(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """One row a file of an archive: shard, file, records, bytes, sha256; and the number of shards."""
    fs, path = filesystem(folder)
    with fs.open_input_stream(f"{path}/{MANIFEST}", compression=None) as f:
        expected = json.loads(f.read())
    kinds = "shard long, file string, records long, bytes long, sha256 string"
    if not expected["files"]:
        return spark.createDataFrame([], kinds), 0
    files = spark.read.schema(kinds).json(f"{folder}/{SHARDS}")
    found = files.agg(F.countDistinct("shard").alias("shards"), F.count("*").alias("files"), F.sum("records").alias("records")).first().asDict()
    if found != expected:
        raise ValueError(f"{folder} should have {expected} and has {found}")
    return files, expected["shards"]


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """One row a page: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked for (null of revisits)."""
    files, shards = manifest(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, at = filesystem(folder)
                rows, size, count = [], 0, 0
                with own.open_input_stream(f"{at}/{name}", compression=None) as stream:
                    for headers, block in records(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        revisit = headers["WARC-Type"] == "revisit"
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if headers["WARC-Block-Digest"] != f"sha1:{base32(hashlib.sha1(block).digest())}" or not revisit and digest != base32(hashlib.sha1(payload).digest()):
                            raise ValueError(f"{name}: a digest does not agree with its record {headers['WARC-Record-ID']}")
                        n = int(http.rpartition(b"Content-Length: ")[2])
                        number = lambda x: int(x) if x else None
                        rows.append((number(headers["Page-ID"]), headers.get("WARC-Target-URI"), n, digest, headers["WARC-Type"], number(headers.get("Refers-To-Page-ID")), payload if payloads and not revisit else None))
                        count += 1
                        size += len(block) * payloads
                        if len(rows) >= 4096 or size > 1 << 23:
                            yield made(rows)
                            rows, size = [], 0
                if count != expected:
                    raise ValueError(f"{name} has {count} records, the manifest says {expected}")
                if rows:
                    yield made(rows)

    kinds = (("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()))
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])
    dealt = files.repartitionById(max(shards, 1), F.col("shard").cast("int")).select("file", "records")
    out = dealt.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return out if payloads else out.drop("payload")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{C.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(C.load(spark, sf_dir, "pages"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


OP3_SQL = """
WITH page AS (
    SELECT page_id, url, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS winner, sha1(coalesce(html, '')) AS hex FROM pages
), bit AS (
    SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', substr(hex, i, 1)) - 1) + 1, 4)), 'string_agg', '') AS bits FROM page
)
SELECT page_id, strlen(html) AS payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda k: CASE WHEN substr(bits, 5 * i + k, 1) = '1' THEN 1 << (5 - k) ELSE 0 END))::INT, 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to, url
FROM bit
"""
